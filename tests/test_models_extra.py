"""Early stopping and model embeddings against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import early_stop as ES
from quillmark.operators import embed, layouts, model_embed
from quillmark.operators import models as ML


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(y), *map(float, rng.normal(size=4) + (0.3 * y, 0, 0, 0))) for i, y in enumerate(rng.integers(0, 2, 160))]
    return spark.createDataFrame(rows, "doc_id long, label int, a double, b double, c double, d double")


def test_stops_before_the_cap_keeps_the_best_and_resumes(noise, tmp_path):
    names, folder = ["a", "b", "c", "d"], f"file:{tmp_path}/rounds"
    cut = ES.train_mlp_early(noise, names, hidden=(12,), step=5, max_iter=10, patience=3, folder=folder)
    assert len(cut.accuracies) == 2 and not cut.stopped_early
    whole = ES.train_mlp_early(noise, names, hidden=(12,), step=5, max_iter=500, patience=3, folder=folder)
    assert whole.accuracies[:2] == cut.accuracies and whole.stopped_early and len(whole.accuracies) < 100
    assert whole.n_fit + whole.n_held == 160 and whole.n_held == ES.held_out(noise).where("held").count() > 0
    p = ML.predict(whole.model, ES.held_out(noise).where("held"), names).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert abs(p - whole.accuracies[whole.best]) < 1e-12 and max(whole.accuracies[:whole.best + 1]) == whole.accuracies[whole.best]
    again = ES.train_mlp_early(noise, names, hidden=(12,), step=5, max_iter=500, patience=3, folder=folder)
    assert again.accuracies == whole.accuracies and np.array_equal(again.model.weights.toArray(), whole.model.weights.toArray())


def test_without_held_out_rows_all_serve_as_both(noise):
    few = noise.where("doc_id < 30").join(ES.held_out(noise).where("not held").select("doc_id"), "doc_id")
    e = ES.train_mlp_early(few, ["a", "b"], hidden=(3,), step=5, max_iter=10)
    assert e.n_held == 0 and len(e.accuracies) == 2


def test_model_runs_embed_and_layout(spark):
    texts = ["abc abc zz", "", None, "Hello World " * 30, "naïve café"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    predict = model_embed.letter_model()()
    want = predict(np.array([t or "" for t in texts], dtype=object))
    got = {r.doc_id: r.vec for r in embed.embed(df, "letters").collect()}
    assert all(np.array_equal(got[i], want[i]) for i in range(len(texts)))
    long = df.where("doc_id = 3").withColumn("variants", F.array(*[F.struct(F.lit(k).alias("variant_pos"), F.lit(v).alias("text")) for k, v in enumerate(["hello world", None, "zebra"])]))
    r = layouts.wide_features(long, 3, "letters", fuzzy=False).first()
    a, b, c = predict(np.array([texts[3], "hello world", "zebra"], dtype=object))
    cos = lambda x, y: 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert r.status == "ok" and r.cos_v1 is None and abs(r.cos_v0 - cos(a, b)) < 1e-12 and abs(r.cos_v2 - cos(a, c)) < 1e-12
