"""Findings of round 4."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import sentences as SN
from quillmark.operators import tfidf as TF
from quillmark.operators import variants as V
from quillmark.plans import catalog


def _documents(spark, tmp_path, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_words_are_not_split_for_every_word(spark):
    """without words given, each word split the text again."""
    df = spark.createDataFrame([("a a b  b a",), ("",), (None,)], "text string").select(V.rule_rewrite("dedupe_adjacent", "text").alias("t"))
    assert [r.t for r in df.collect()] == ["a b a", "", None]
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1


@pytest.mark.parametrize("name", ["unpivot", "known_variants"])
def test_wide_rules_split_a_text_once(spark, tmp_path, name):
    d = _documents(spark, tmp_path, ["a a bb ccc. Dd ee!", "", None, "x"])
    df = catalog.queries()[name](spark, d)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = {tuple(r)[:2]: r.n_chars for r in df.collect()}
    first = V.TEXT_PROMPTS if name == "unpivot" else range(4)
    assert [got[0, k] for k in first][:4] == [len("a a bb ccc. ee!"), len("a a bb"), len("a a bb ccc Dd ee"), len("Dd ee! a a bb ccc.")]
    assert {k for k, _ in got} == {0, 3}


def test_mix_drops_texts_without_sentences(spark, tmp_path):
    """a blank text ended the query with an index out of bounds."""
    text = "Abcd efgh. Ijkl mnop qrst. Uvwx yzab?"
    d = _documents(spark, tmp_path, [text, "", " \t ", None])
    got = catalog.queries()["mix"](spark, d).collect()
    assert [(r.doc_id, r.source) for r in got] == [(0, "GPT")]


def test_no_starter_is_left_out(spark):
    """only the 1000 strongest abbreviations and starters made the model."""
    text = "Go over. " + " ".join(f"W{i} goes over and over and over." for i in range(1100) for _ in range(8))
    s = SN.learn(spark.createDataFrame([(k, text) for k in range(2)], "doc_id long, text string"))
    assert {f"w{i}" for i in range(1100)} <= set(s.starters)


def test_abbreviations_and_starters_beyond_those_in_the_plan(spark):
    kept = [f"t{i}" for i in range(SN.IN_PLAN)] + ["dr", "a" + SN.EDGE + "b", "ém"]
    df = spark.createDataFrame([("dr",), ("t7",), ("t",), ("a",), ("b",), ("a" + SN.EDGE + "b",), ("ém",), ("",), (None,), ("t7" + SN.EDGE + "t8",)], "t string")
    found = SN.one_of(kept)
    assert [r.f for r in df.select(found(F.col("t")).alias("f")).collect()] == [True, True, False, False, False, True, True, False, None, False]
    # in a lambda too, and with the same sentences as few
    texts = spark.createDataFrame([("Dr. Who came. He left. T7. On.",)], "text string")
    few, many = SN.Splitter(["dr", "t7"], ["he"]), SN.Splitter(kept, ["he", *kept])
    nested = lambda s: texts.select(F.transform(F.array("text"), lambda t: s(t)).alias("s")).first().s
    assert nested(few) == nested(many) == [["Dr. Who came.", "He left.", "T7. On."]]


def test_intersections_are_counted_per_record(spark, tmp_path):
    """the original's n-grams were found again for every rewrite."""
    text = "Aa bb cc. Dd aa bb ee aa bb!"
    d = _documents(spark, tmp_path, [text, "too short", None])
    df = catalog.queries()["ngram_intersection"](spark, d)
    assert "array_intersect" not in df._jdf.queryExecution().optimizedPlan().toString()
    grams = lambda t, n: set(zip(*[t.lower().split()[i:] for i in range(n)]))
    v = V.rule_variants(spark.createDataFrame([(0, text)], "doc_id long, text string")).first().variants
    want = {(0, x.variant_pos, *(len(grams(text, n) & grams(x.text, n)) for n in (1, 2))) for x in v}
    assert {tuple(r) for r in df.collect()} == want and len(want) == 7
    assert dict(df.dtypes)["c1"] == dict(df.dtypes)["c2"] == "bigint"


def test_weights_of_texts_that_share_a_key(spark):
    """no row per term is shuffled for the weights, and texts of a key count together."""
    docs = spark.createDataFrame([((1, 0), "aa bb aa, Cc"), ((1, 0), "bb dd"), ((2, 0), "zz"), ((3, 0), None), (None, "aa")], "tid struct<a:long,b:int>, text string")
    voc = spark.createDataFrame([("aa", 1.0), ("bb", 2.0), ("dd", 3.0)], "term string, idf double")
    w = TF.tfidf_transform(docs, voc, key="tid")
    assert w.dtypes == [("tid", "struct<a:bigint,b:int>"), ("term", "string"), ("w", "double")]
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    got = {(r.tid and r.tid.a, r.term): round(r.w, 9) for r in w.collect()}
    norm = (2 ** 2 + 4 ** 2 + 3 ** 2) ** 0.5
    assert got == {(1, "aa"): round(2 / norm, 9), (1, "bb"): round(4 / norm, 9), (1, "dd"): round(3 / norm, 9), (None, "aa"): 1.0}
    assert TF.tfidf_transform(docs, voc.where("false"), key="tid").count() == 0
