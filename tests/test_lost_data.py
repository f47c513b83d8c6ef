"""Cases in which rows or text were lost or altered before: one test each."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions import fuzzy as FZ
from quillmark.functions import text as T
from quillmark.operators import corpus as C
from quillmark.operators import features as G
from quillmark.operators import layouts as L
from quillmark.operators import metrics as M
from quillmark.operators import models as ML
from quillmark.operators import robust as H
from quillmark.operators import split as SP
from quillmark.sources import io as IO

ODD = ["3.14, see www.a.com or e.g. U.S.", "!!! wow", "...", "One. Two!\n\nThree?  Four", "no end", ".", "a.b.c. d", "  lead. trail  ", "x?! y"]


def test_identity_keeps_the_text(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    got = [r[0] for r in df.select(H.map_sentences("t", lambda s, i: s)).collect()]
    norm = lambda s: " ".join(s.split())
    assert [norm(g) for g in got] == [norm(t) for t in ODD]


def test_sentence_ends_need_white_space(spark):
    df = spark.createDataFrame([("3.14, see www.a.com or e.g. U.S. Next one.",)], "t string")
    assert df.select(T.sentences("t")).first()[0] == ["3.14, see www.a.com or e.g.", "U.S.", "Next one."]


def variants(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, variants array<struct<variant_pos:int,text:string>>")


def test_null_rewrite_is_missing_not_zero(spark):
    d = variants(spark, [(1, "a b c d e f", [(0, "a b c d e f"), (1, None)])])
    r = G.overlap_features(G.with_tokens(d), 2).first()
    assert (r["avg_c1"], r["n_variants"], r["c1_v0"], r["c1_v1"]) == (1.0, 1, 1.0, None)
    w = L.wide_features(d, 2, "hash_proj").first()
    assert (w["avg_c1"], w["n_variants"], w["c1_v1"], w["cos_v1"], w["fr_v1"]) == (1.0, 1, None, None, None)
    assert (w["cos_v0"], w["fr_v0"], w["ts_v0"], w["status"]) == (pytest.approx(0, abs=1e-12), 100.0, 100.0, "ok")


def test_layout_status_instead_of_zeros(spark):
    d = variants(spark, [(1, None, [(0, "x")]), (2, "too short", [(0, "x")]), (3, "one two three four five", None), (4, "one two three four five", [(0, "one")])])
    got = {r["doc_id"]: r for r in L.summary6(d, "hash_proj").collect()}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == ["no text", "too short", "no rewrites", "ok"]
    assert got[1]["cosine"] is None and got[2]["cosine"] is None and got[3]["cosine"] == 0.0 and got[4]["common_unigrams"] == 1.0


@pytest.mark.parametrize("limit", [100, 1])
def test_word_vectors_beyond_the_broadcast_bound(spark, limit):
    vec = spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.0, 1.0])], "word string, vec array<double>")
    d = variants(spark, [(1, "one two three four five", [(0, "one one"), (1, "two two"), (2, "none")])])
    r = L.wide_features(d, 3, "word_avg", vectors=vec, limit=limit, fuzzy=False).first()
    assert [round(r[f"cos_v{p}"], 6) for p in range(3)] == [round(1 - 2 ** -0.5, 6)] * 2 + [1.0]


def test_tfidf_method_equals_sparse_rows(spark):
    from quillmark.operators import tfidf as TF
    d = variants(spark, [(1, "aa bb cc dd ee", [(0, "aa bb"), (1, "zz zz")]), (2, "aa aa cc xx yy", [(0, "cc cc")])])
    texts = d.select("text").union(d.select(F.explode("variants").alias("v")).select("v.text"))
    voc = TF.tfidf_fit(texts)
    w = {(r["doc_id"], p): r[f"cos_v{p}"] for r in L.wide_features(d, 2, "tfidf", fuzzy=False).collect() for p in range(2)}
    old = {r["doc_id"]: r["tfidf_cos"] for r in TF.tfidf_cosines_inrow(d, voc).collect()}
    assert w[(1, 0)] == pytest.approx(old[1][0]) and w[(1, 1)] == pytest.approx(1.0) and w[(2, 0)] == pytest.approx(old[2][0]) and w[(2, 1)] is None


def test_null_groups_and_scores_stay(spark):
    rows = [(k, None if k % 3 == 0 else f"d{k % 3}", k % 2, (k % 10) * 3.0 - 10) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, label int, score double")
    st = SP.stratified_split(df, "label", 0.2, 42, "doc_id", by="domain")
    assert st.count() == 60 and st.where("is_test").count() == 12
    a, b = SP.standard_scale(df, df, ["score"], by="domain")
    assert a.count() == b.count() == 60
    au = {r["domain"]: r["auroc"] for r in M.auroc(df, "domain").collect()}
    assert set(au) == {None, "d1", "d2"}
    for dom, got in au.items():
        pos = [r[3] for r in rows if r[1] == dom and r[2] == 1]
        neg = [r[3] for r in rows if r[1] == dom and r[2] == 0]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert got == pytest.approx(want)
    idx = C.dense_index(df.withColumn("h", F.when(F.col("doc_id") > 5, F.md5(F.col("doc_id").cast("string")))), ["h", "doc_id"], "i")
    assert sorted(r["i"] for r in idx.collect()) == list(range(60))


def test_empty_side_gives_an_empty_mix(spark):
    rows = spark.createDataFrame([(k, "t", "human") for k in range(5)], "doc_id long, text string, source string")
    assert H.balanced_combine(rows, rows.where("false")).count() == 0
    assert H.balanced_combine(rows.where("false"), rows).count() == 0
    assert H.balanced_combine(rows, rows.limit(2)).count() == 4


def test_lenient_reader_counts(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"Index": 1, "Text": "x\\ny", "Source": "human"}, {"Index": 2, "Text": null}]')
    (tmp_path / "b.json").write_text('[{"Index": 3, "Text": ')
    got = IO.read_or_default(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "source"] and got.count() == 2
    assert sorted(map(tuple, got.collect())) == [(1, "x\ny", "human"), (2, None, None)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "c.json").write_text('{"Index": 1, "Text": "x"}\nbroken {\n{"Index": 2, "Text": "y"}\n')
    assert IO.read_or_default(spark, str(tmp_path / "lines"), multiline=False).count() == 2
    assert IO.read_or_default(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        IO.read_corpus(spark, str(tmp_path)).count()


def test_duplicate_synonyms_and_no_limit(spark):
    syn = spark.createDataFrame([("a", "z"), ("a", "b"), ("c", None), (None, "q"), ("d", "dd")], "word string, repl string")
    df = spark.createDataFrame([(k, "a d x. A c") for k in range(4)], "doc_id long, text string")
    outs = []
    for limit in (100, 0):
        x = H.with_synonyms(df, syn, limit=limit)
        outs.append(sorted(r[0] for r in x.select(H.perturb_words_expr("text", "doc_id", F.col("_syn"), 1.0)).collect()))
    assert outs[0] == outs[1] == ["b dd x. b c"] * 4


def test_models_without_trainable_domains(spark):
    df = spark.createDataFrame([(1, "en", 0, 1.0)], "doc_id long, domain string, label int, f double")
    assert ML.per_domain_eval(df, ["f"]) == [] and ML.trainable_domains(df) == []
    assert spark.createDataFrame([], ML.DOMAIN_SCHEMA).count() == 0


def test_common_features_of_domains():
    assert ML.common_features({"a": ["x", "y", "z"], "b": ["z", "x"]}, "a", "b") == ["x", "z"]


def test_seeded_sample_is_a_sample(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    a = sorted(r[0] for r in ML.seeded_sample(df, 100).collect())
    assert len(a) == 100 and a == sorted(r[0] for r in ML.seeded_sample(df.repartition(7), 100).collect())


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_fuzzy_ratio_is_plain_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 40))) for _ in range(2))
        want = 100 if a == b else 0 if not a or not b else round(200.0 * plain_lcs(a, b) / (len(a) + len(b)))
        assert FZ.ratio(a, b) == want


def test_projection_is_standardised_and_keeps_rows(spark):
    from quillmark.operators import density as K
    rng = random.Random(2)
    rows = [(k, rng.gauss(5, 3), rng.gauss(0, 100), 7.0) for k in range(80)]
    rows = [(k, a, a * 2 + b / 50, c) for k, a, b, c in rows] + [(99, None, 1.0, 7.0)]
    got = K.project2d(spark.createDataFrame(rows, "doc_id long, a double, b double, c double"), ["a", "b", "c"]).collect()
    assert len(got) == 81 and [r["xy"] for r in got if r["doc_id"] == 99] == [None]
    xy = [r["xy"] for r in got if r["xy"]]
    assert abs(sum(p[0] for p in xy)) < 1e-6 and abs(sum(p[0] * p[1] for p in xy)) < 1e-6


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    from quillmark.streaming.features import batch_features, stream_features
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    docs.where("doc_id < 100").coalesce(1).write.parquet(src)
    stream_features(spark, src, out, ckpt).awaitTermination()
    first = spark.read.parquet(out).count()
    docs.where("doc_id >= 80").coalesce(1).write.mode("append").parquet(src)   # some again
    stream_features(spark, src, out, ckpt).awaitTermination()
    got = spark.read.parquet(out).drop("batch_id")
    want = batch_features(docs)
    assert first == batch_features(docs.where("doc_id < 100")).count() and got.count() == want.count()
    assert got.exceptAll(want).count() == 0
