"""Properties from the test strategy: self-overlap, symmetry, mixing structure and
partition invariance of a feature query."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import fuzzy as FZ
from quillmark.functions import text as T
from quillmark.functions import vectors as VX
from quillmark.operators import features as G
from quillmark.operators import robust as H
from quillmark.operators.variants import rule_variants

SF = "/root/testdata/sf0.001"


def test_self_overlap_equals_distinct_ngrams(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(50)
    x = G.length_filter(G.with_tokens(d)).withColumn(
        "variants", F.array(F.struct(F.lit(0).alias("variant_pos"), F.col("text").alias("text"))))
    f = G.overlap_features(x, 1).collect()
    for r in f:
        for n in range(1, 5):
            assert r[f"c{n}_v0"] == pytest.approx(r[f"all_c{n}"])
    assert all(FZ.ratio(r, r) == 100 for r in ("a", "abc def", "é"))


def test_distances_symmetric(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    p = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    rows = p.select(VX.euclidean("a.embedding", "b.embedding").alias("ab"),
                    VX.euclidean("b.embedding", "a.embedding").alias("ba"),
                    VX.cosine("a.embedding", "b.embedding").alias("cab"),
                    VX.cosine("b.embedding", "a.embedding").alias("cba")).collect()
    assert all(r["ab"] == pytest.approx(r["ba"]) and r["cab"] == pytest.approx(r["cba"]) for r in rows)


def test_mixing_takes_one_sentence_per_source(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    v = rule_variants(d)
    m = H.mix_sentences(v, 2023, 4)
    j = m.join(v.select("doc_id", F.col("text").alias("orig"), "variants"), "doc_id")
    for r in j.limit(40).collect():
        parts = r["text"]
        orig_sents = set(s.strip() for s in __import__("re").findall(r"[^.!?]+[.!?]+|[^.!?]+$", r["orig"]))
        hits = sum(1 for s in orig_sents if s and s in parts)
        assert hits >= 1
        assert r["source"] == "GPT"
    assert m.select(F.countDistinct("doc_id")).first()[0] == m.count()


def test_features_invariant_under_partitioning(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    outs = []
    for parts in (1, 4, 16):
        x = rule_variants(G.length_filter(G.with_tokens(d.repartition(parts))))
        f = G.overlap_features(x, 7).select("doc_id", "avg_c1", "avg_c4", "c2_v3", "all_c2")
        outs.append(sorted(tuple(r) for r in f.collect()))
    assert outs[0] == outs[1] == outs[2]
