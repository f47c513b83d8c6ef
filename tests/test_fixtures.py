"""Worked values (FIXTURES.md section 3) and operator properties."""

import math

import pytest
from pyspark.sql import functions as F

from quillmark.functions import fuzzy as FZ
from quillmark.functions import text as T
from quillmark.functions import vectors as VX
from quillmark.operators import corpus as C
from quillmark.operators import embed as E
from quillmark.operators import metrics as M
from quillmark.operators import retrieval as R
from quillmark.operators import tfidf as TF
from quillmark.operators.variants import rewrite_requests

A, B = "The cat sat on the mat", "the cat sat on a mat"


def test_ngram_overlap(spark):
    df = spark.createDataFrame([(A, B)], "a string, b string")
    r = df.select(T.common4(T.tokens("a"), T.tokens("b")).alias("c"),
                  T.common2(T.tokens("a"), T.tokens("b"), legacy_unigrams=True).alias("leg"),
                  *[F.size(F.array_distinct(T.ngrams(T.tokens("a"), n))).alias(f"d{n}") for n in range(1, 5)]).first()
    assert r["c"] == [5, 3, 2, 1]
    assert r["leg"][0] == 0
    assert [r[f"d{n}"] for n in range(1, 5)] == [5, 5, 4, 3]


def test_ngrams_short_and_exact(spark):
    df = spark.createDataFrame([("a b c",), ("a",), ("",)], "t string")
    got = [r[0] for r in df.select(T.ngrams(T.tokens("t"), 2)).collect()]
    assert got == [["a b", "b c"], [], []]


def test_fuzzy():
    assert FZ.lcs_length(A, B) == 18
    assert FZ.ratio(A, B) == 86
    assert FZ.token_set_ratio(A, B) == 100
    assert FZ.ratio("", "") == 100 and FZ.ratio("a", "") == 0 and FZ.ratio(None, "a") == 0


def test_fuzzy_udf(spark):
    df = spark.createDataFrame([(A, B), ("abc", "abc"), ("", "x")], "a string, b string")
    got = [tuple(r) for r in df.select(FZ.fuzz_ratio("a", "b"), FZ.token_set("a", "b")).collect()]
    assert got == [(86, 100), (100, 100), (0, 0)]


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])],
                               "a array<double>, b array<double>")
    r = df.select(VX.euclidean("a", "b"), VX.cosine("a", "b"), VX.manhattan("a", "b")).collect()
    assert r[0][0] == pytest.approx(2.449490, abs=1e-6)
    assert r[0][1] == pytest.approx(0.403715, abs=1e-6)
    assert r[0][2] == pytest.approx(4.0)
    assert r[1][1] == pytest.approx(1.0)


def _scores(spark):
    rows = [(0, 0.1), (0, 0.4), (0, 0.35), (1, 0.35), (1, 0.8), (1, 1.0)]
    df = spark.createDataFrame(rows, "label int, score double")
    return df.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def test_classification_metrics(spark):
    p = _scores(spark)
    assert M.auroc(p).first()["auroc"] == pytest.approx(5 / 6)
    c = M.confusion_counts(p).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (3, 0, 1, 2)
    assert M.accuracy(p).first()["accuracy"] == pytest.approx(5 / 6)
    assert M.f1(p).first()["f1"] == pytest.approx(0.8)


def test_histogram_kl_hellinger(spark):
    p = _scores(spark)
    h = M.score_histogram(p, bins=20)
    counts = {(r["label"], r["bin"]): r["count"] for r in h.collect() if r["count"]}
    assert counts == {(0, 2): 1, (0, 6): 1, (0, 8): 1, (1, 6): 1, (1, 16): 1, (1, 19): 1}
    d = M.kl_hellinger(p).first()
    assert d["kl_pq"] == pytest.approx(16.615314, abs=1e-5)
    assert d["kl_qp"] == pytest.approx(16.615314, abs=1e-5)
    assert d["hellinger"] == pytest.approx(0.816494, abs=1e-6)


def test_kl_self_is_zero(spark):
    df = spark.createDataFrame([(i, float(i + 1), float(i + 1)) for i in range(5)], "bin int, p double, q double")
    r = M.distribution_distances(df).first()
    assert abs(r["kl_pq"]) < 1e-12 and abs(r["hellinger"]) < 1e-7


def test_idf(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "aa dd")], "doc_id long, text string")
    v = {r["term"]: r["idf"] for r in TF.tfidf_fit(docs).collect()}
    assert v["aa"] == pytest.approx(1.0)
    assert v["bb"] == pytest.approx(1.693147, abs=1e-6)
    w = TF.tfidf_transform(docs, TF.tfidf_fit(docs)).groupBy("doc_id").agg(F.sum(F.col("w") ** 2).alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in w.collect())


def test_episode_embedding(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0])], "author string, m int, vec array<double>")
    v = E.episode_embedding(df, "author", "m").first()["vec"]
    assert v == pytest.approx([0.669762, 0.669762], abs=1e-6)


def test_retrieval(spark):
    t = spark.createDataFrame([(1, "A", [1.0, 1.0]), (2, "B", [1.0, 0.0]), (3, "C", [0.0, 1.0])],
                              "tid long, author string, emb array<double>")
    q = spark.createDataFrame([(10, "A", [1.0, 0.0]), (11, "B", [0.0, 1.0])], "qid long, author string, emb array<double>")
    ranks = R.author_ranks(q, t, block=2)
    got = {r["qid"]: r["rank"] for r in ranks.collect()}
    assert got == {10: 2, 11: 3}
    assert M.mrr(ranks).first()["mrr"] == pytest.approx(0.416667, abs=1e-6)


def test_sentences(spark):
    df = spark.createDataFrame([("Hi there. A b! C?",)], "t string")
    assert df.select(T.sentences("t")).first()[0] == ["Hi there.", "A b!", "C?"]


def test_coalesce_text(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", None), (2, "", None, "c", "human")],
                               "doc_id long, explanation string, implementation string, text string, source string")
    got = {r["doc_id"]: (r["text"], r["source"]) for r in C.coalesce_text(df).collect()}
    assert got == {1: ("ab", "unknown"), 2: ("c", "human")}


def test_rewrite_request(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    r = rewrite_requests(df, ["Help me polish this"]).first()
    assert r["request"] == 'Help me polish this: "x"'


def test_dense_index_partition_invariant(spark):
    from quillmark.functions.sampling import hkey
    base = spark.range(0, 500).withColumnRenamed("id", "doc_id").withColumn("k", hkey(7, "doc_id"))
    outs = []
    for parts in (1, 4, 16):
        x = C.dense_index(base.repartition(parts), ["k", "doc_id"], "i")
        outs.append(sorted((r["doc_id"], r["i"]) for r in x.collect()))
    assert outs[0] == outs[1] == outs[2]
    assert sorted(i for _, i in outs[0]) == list(range(500))


def test_random_split_disjoint_complete(spark):
    from quillmark.operators.split import random_split
    df = spark.range(0, 1000).withColumnRenamed("id", "doc_id")
    tr, te = random_split(df, 0.2, 42)
    a = {r[0] for r in tr.collect()}
    b = {r[0] for r in te.collect()}
    assert not (a & b) and len(a | b) == 1000 and 100 < len(b) < 300
