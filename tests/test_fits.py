"""Feature rows and what is fitted on them: texts split once, only labelled documents
rewritten, enough partitions for a fit."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions.sampling import u01
from quillmark.operators import features as G
from quillmark.operators import models as ML
from quillmark.operators import neighbours as NB
from quillmark.operators.variants import rule_rewrite, rule_variants
from quillmark.plans.q_ops import feature_rows
from quillmark.session import spread_rows


def _brute(tok, others, top):
    grams = lambda t, n: {tuple(t[i:i + n]) for i in range(len(t) - n + 1)}
    own = [grams(tok, n) for n in range(1, top + 1)]
    return [len(g) for g in own], [[None if o is None else len(g & grams(o, n)) for o in others] for n, g in enumerate(own, 1)]


@pytest.mark.parametrize("codes", [1_000_000, 0])
def test_gram_counts_by_table_and_by_search(monkeypatch, codes):
    G._numbers()
    monkeypatch.setattr(G, "MOST_CODES", codes)
    rng = np.random.default_rng(5)
    text = lambda: [str(x) for x in rng.integers(0, rng.integers(1, 9), rng.choice([0, 1, 2, 3, 30]))]
    for _ in range(300):
        tok = text()
        others = [None if rng.random() < 0.2 else tok[::-1] if rng.random() < 0.3 else text() for _ in range(rng.integers(0, 5))]
        assert G.gram_counts(tok, others, 4) == _brute(tok, others, 4)
    assert (G._numbers() == -1).all()


def test_texts_are_split_once(spark, tmp_path):
    rows = [(1, "a b c d e f", "en"), (2, "a b c", "en"), (3, None, "en"), (4, " ", None), (5, "x x  y y z z.", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = feature_rows(spark, str(tmp_path))
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {1: 6, 5: 6}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bsplit\(", plan)) == 1
    old = G.overlap_features(rule_variants(G.length_filter(G.with_tokens(spark.createDataFrame(rows, "doc_id long, text string, domain string")))), 7, extra=["domain"])
    assert sorted(map(str, got.collect())) == sorted(map(str, old.collect()))
    only = feature_rows(spark, str(tmp_path), spark.createDataFrame([(5,), (5,), (9,)], "doc_id long"))
    assert [r.doc_id for r in only.collect()] == [5]


def test_repeated_words_are_dropped(spark):
    texts = ["a a b bb b b", "aa a a", "", "a", "x x x", "a \n a. a."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(rule_rewrite("dedupe_adjacent", "t")).collect()]
    assert got == ["a b bb b", "aa a", "", "a", "x", "a a."]


def test_rows_of_a_fit_are_spread(spark):
    df = spark.range(12_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS label", "CAST(id % 7 AS DOUBLE) AS a").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    rows = ML.fit_rows(df, ["a"])
    assert rows.rdd.getNumPartitions() == min(cores, 3) and rows.count() == 12_000 and rows.columns == ["features", "label"]
    assert spread_rows(df.limit(5000).coalesce(1), "doc_id").rdd.getNumPartitions() == 1


def test_block_of_draws(spark):
    nodes = spark.range(40).select("id", F.lit("a").alias("g"), F.lit(2.0).alias("degree")).coalesce(1)
    got = NB._drawn(nodes, NB._names("v"), 42)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    want = {r[0]: r[1:] for r in nodes.select("id", *[u01(42, F.col("id"), F.lit(f"{j}")) - 0.5 for j in range(NB.VECTORS)]).collect()}
    assert {r[0]: r[3:] for r in got.collect()} == want
