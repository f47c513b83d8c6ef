"""Learning from different tokens gives the counts of all tokens; texts are parted once."""

from pyspark.sql import functions as F

from quillmark.operators import sentences as SN


def test_counts_of_different_tokens(spark):
    texts = ["Dr. Who met (Dr.) Who. He left. e.g. he", "He . a. b... He", None, "", "  ", "x.\ty. Y."] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    every, after = SN.different_tokens(df)
    tokens = SN.token_types(df)
    assert sorted(SN.type_counts(every).collect()) == sorted(SN.type_counts(tokens).collect())
    want = tokens.where("dot_before").groupBy("type", "before").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(after.groupBy("type", "before").agg(F.sum("c").alias("n")).collect()) == sorted(want.collect())
    # typed once a different token, not once an occurrence
    assert every.count() < tokens.count()


def test_a_text_is_parted_once(spark):
    df = spark.createDataFrame([("A b. C dd. e.",)], "text string").select(SN.Splitter(["b"], ["c"])("text").alias("s"))
    assert df.first().s == ["A b.", "C dd.", "e."]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1
