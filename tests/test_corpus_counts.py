"""Token cuts, skip counts and the stream's state."""

import glob

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillmark.operators import corpus as C

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n", [1, 3, 7, 1024])
def test_text_of_the_first_tokens(spark, n):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    texts = ["", None, "one two three four five", "日本語のテキスト 𝔘𝔫𝔦", "é" * 50, " \n\n  x", "a" * 3000, "word " * 3000, "naïve — ½ don't 12345 !!"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, other string").repartition(3)
    got = {r.doc_id: r.text for r in C.truncate_bpe(df, path, P.PATTERN, n).collect()}
    assert got == {k: t if t is None else enc.decode_bytes(enc.encode_ordinary(t)[:n]).decode("utf-8", "ignore") for k, t in enumerate(texts)}


def test_skipped_records_are_counted_in_passing(spark):
    rows = [(1, "a", "s"), (2, None, "s"), (3, " ", "s"), (4, None, None), (5, "b", None), (6, "c", "t"), (7, "", None)]
    counts = Observation()
    kept = C.drop_missing(spark.createDataFrame(rows, "doc_id long, text string, source string"), counts=counts)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 6]
    assert counts.get == {"n_kept": 2, "n_no_source": 3, "n_no_text": 1, "n_blank_text": 1}


def test_the_stream_knows_ids_without_its_output(spark, tmp_path):
    from quillmark.streaming.features import stream_features

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    docs.where("doc_id < 40").coalesce(1).write.parquet(src)
    stream_features(spark, src, str(tmp_path / "first"), ckpt).awaitTermination()
    docs.where("doc_id between 30 and 59").coalesce(1).write.mode("append").parquet(src)
    stream_features(spark, src, str(tmp_path / "second"), ckpt).awaitTermination()  # the first output is not there
    ids = [r.doc_id for r in spark.read.parquet(str(tmp_path / "second")).collect()]
    assert ids and min(ids) >= 40 and len(ids) == len(set(ids))
    assert glob.glob(f"{ckpt}/state/*")


def test_a_repeated_id_in_one_batch_counts_once(spark, tmp_path):
    from quillmark.streaming.features import stream_features

    text = "some words that are long enough to be measured at all"
    df = spark.createDataFrame([(1, text, None, None, 1)] * 5 + [(2, text, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream_features(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("doc_id")).collect()) == [1, 2]


def test_metrics_are_read_back_by_run(spark, tmp_path):
    from quillmark.sources import io as IO
    path = str(tmp_path / "log")
    for run, value in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        IO.append_metrics(spark.createDataFrame([("x", value)], "domain string, f1 double"), path, run)
    assert sorted(map(tuple, IO.read_metrics(spark, path).select("run_id", "domain", "metric", "value").collect())) == [("a", "x", "f1", 1.0), ("a", "x", "f1", 3.0), ("b", "x", "f1", 2.0)]
    assert [r.value for r in IO.read_metrics(spark, path, "b").collect()] == [2.0]


def test_points_carry_their_class_or_what_they_lack(spark):
    from quillmark.operators import density as K
    places = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 1.0), (3, 2.0, 2.0)], "doc_id long, x double, y double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1)], "doc_id long, label int")
    got = {r.doc_id: (r.name, r.colour, r.mismatch) for r in K.scatter_points(places, labels, title="t").collect()}
    assert got == {1: ("Human", "forestgreen", None), 2: ("GPT", "firebrick", "no_point"), 3: (None, None, "no_label"), 4: ("GPT", "firebrick", "no_point")}
    assert K.scatter_points(places, labels, title="t").first().title == "t"


def test_a_repeated_word_vector_counts_once_in_either_form(spark):
    from quillmark.operators import layouts as L
    v = spark.createDataFrame([("cat", [1.0, 0.0]), ("cat", [0.0, 1.0]), ("dog", [1.0, 1.0]), (None, [1.0, 1.0])], "word string, vec array<double>")
    text = "the cat and the dog and one more cat"
    df = spark.createDataFrame([(1, text, [(0, "a dog here"), (1, "cat")])], "doc_id long, text string, variants array<struct<variant_pos: int, text: string>>")
    out = []
    for limit in (10, 1):
        frame, method = L._word_avg(df, v, limit=limit)
        lookup = frame.first().asDict().get("_lookup")
        out.append([list(method.vector(t, lookup)) for t in (text, "a dog here", "cat")])
    assert out[0] == out[1] and out[0][2] == [0.0, 1.0]
