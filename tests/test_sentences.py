"""Learned sentence ends."""

import random

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import robust as H
from quillmark.operators import sentences as SN


def corpus(spark):
    rng = random.Random(1)
    names = ["Smith", "Jones", "Brown", "Miller", "Quinn", "Adams"]
    verbs = ["came", "left", "slept", "spoke", "waited", "drove"]
    rows = []
    for k in range(400):
        rows.append((k, " ".join(f"{rng.choice(['He', 'She', 'They', 'The man'])} {rng.choice(verbs)} with {rng.choice(['Dr.', 'Mr.', 'prof.'])} {rng.choice(names)} {rng.choice(verbs)} home, e.g. {rng.choice(['far', 'near', 'late'])} away {rng.choice(verbs)}." for _ in range(3))))
    return spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")


def test_abbreviations_end_no_sentence(spark):
    s = SN.learn(corpus(spark))
    assert {"dr", "mr", "prof", "e.g"} <= set(s.abbreviations) and "he" in s.starters
    assert not {"away", "came", "smith"} & set(s.abbreviations)
    cases = [("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]),
             ("It was Mr.  Jones!  Was it? Yes", ["It was Mr.  Jones!", "Was it?", "Yes"]),
             ("She met the Dr. He left.", ["She met the Dr.", "He left."]),
             ("J. Quinn spoke, e.g. of U. He came", ["J. Quinn spoke, e.g. of U.", "He came"]),
             ("(Dr.) Adams\nspoke. ", ["(Dr.) Adams\nspoke."]), ("  ", []), ("", [])]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", s("text").alias("s")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    assert spark.range(1).select(s(F.lit(None).cast("string")).alias("s")).first().s is None


def test_without_a_model_it_is_the_plain_splitter_but_for_initials(spark):
    df = corpus(spark)
    none = SN.Splitter([], [])
    assert df.where(~none("text").eqNullSafe(T.sentences("text"))).count() == 0


def test_operators_take_the_splitter(spark):
    s = SN.Splitter(["dr"], ["he"])
    df = spark.createDataFrame([(1, "Dr. Smith came. He left.")], "doc_id long, text string")
    count = lambda split: df.select(H.map_sentences("text", lambda x, i: F.concat(x, F.lit("|")), split).alias("t")).first().t
    assert count(s) == "Dr. Smith came.| He left.|" and count(T.sentences) == "Dr.| Smith came.| He left.|"
    v = df.withColumn("variants", F.array(*[F.struct(F.lit(k).alias("variant_pos"), F.lit("Dr. Who spoke.").alias("text")) for k in range(4)]))
    assert H.mix_sentences(v, split=s).first().text.count("Dr. Who spoke.") == 4
    assert H.mix_sentences(v.union(v.withColumn("doc_id", F.lit(2))), split=s, limit_rows=1).count() == 1
    syn = F.create_map(F.lit("smith"), F.lit("jones"))
    for e in (H.perturb_words_expr("text", "doc_id", syn, 1.0, split=s), H.perturb_chars_expr("text", "doc_id", 1.0, split=s), H.perturb_mixed_expr("text", "doc_id", syn, 1.0, split=s)):
        assert len(df.select(e.alias("t")).first().t) > 10


def test_no_texts(spark):
    s = SN.learn(corpus(spark).where("false"))
    assert s.abbreviations == [] and s.starters == []
