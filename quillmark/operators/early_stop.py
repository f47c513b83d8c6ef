"""Multilayer perceptron with early stopping.

The fit is cut into rounds of a few L-BFGS iterations, each started from the weights of the
one before.  After a round the accuracy on a held-out tenth is taken; the fit ends after
``patience`` rounds without a gain of more than ``tol``, and the best round's weights make
the model.  Every round appends one row (its number, accuracy and weights, whose count is
that of the layers and does not grow with the data) to a table in a shared folder; a fit that
is given the folder of one that was cut short goes on after its last round.

Defined results: the held-out rows are ``md5(seed, key)`` draws, so the same after any loss
of executors; without any (or without training rows) all rows serve as both; ties keep the
earlier round."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import u01
from ..session import checkpoint_dir
from .models import fit_rows

ROUNDS_SCHEMA = "round int, accuracy double, weights array<double>"


@dataclass
class EarlyFit:
    model: MultilayerPerceptronClassificationModel
    accuracies: list[float]
    best: int
    n_fit: int
    n_held: int
    stopped_early: bool
    folder: str


def held_out(df: DataFrame, share: float = 0.1, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``df`` with ``held``: a seeded share of the rows, by key."""
    return df.withColumn("held", F.coalesce(u01(seed, F.lit("held"), key) < F.lit(float(share)), F.lit(False)))


def _rounds(spark, folder: str) -> list:
    """The rounds in a folder, in order: at most ``max_iter / step`` rows."""
    try:
        rows = spark.read.schema(ROUNDS_SCHEMA).parquet(folder).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: r["round"])


def _best(rows, tol: float) -> tuple[int, int]:
    """The round that counts as best, and the rounds since."""
    best, top, since = 0, -1.0, 0
    for i, r in enumerate(rows):
        if r["accuracy"] > top + (tol if i else 0.0):
            best, top, since = i, r["accuracy"], 0
        else:
            since += 1
    return best, since


def train_mlp_early(train: DataFrame, names: list[str], label: str = "label", hidden=(100, 50), step: int = 10, max_iter: int = 500,
                    share: float = 0.1, patience: int = 10, tol: float = 1e-4, seed: int = 42, key: str = "doc_id", folder: str | None = None) -> EarlyFit:
    spark = train.sparkSession
    folder = folder or os.path.join(checkpoint_dir(spark), "quillmark", f"rounds-{uuid.uuid4().hex}")
    rows = fit_rows(held_out(train.select(key, F.col(label).cast("double").alias(label), *names), share, seed, key), names, label, key, keep=["held"])
    n = {r["held"]: r["count"] for r in rows.groupBy("held").count().collect()}
    both = len(n) == 2
    fit_on, judge_on = (rows.where("not held"), rows.where("held")) if both else (rows, rows)
    layers = [len(names), *hidden, 2]

    def fit(weights, iterations):
        mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers, maxIter=iterations, tol=1e-6, seed=seed)
        return (mlp if weights is None else mlp.setInitialWeights(Vectors.dense(weights))).fit(fit_on)

    done = _rounds(spark, folder)
    while len(done) * step < max_iter and _best(done, tol)[1] < patience:
        model = fit(done[-1]["weights"] if done else None, step)
        right = model.transform(judge_on).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        row = (len(done), float(right or 0.0), [float(x) for x in model.weights.toArray()])
        spark.createDataFrame([row], ROUNDS_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        done.append({"round": row[0], "accuracy": row[1], "weights": row[2]})
    best, since = _best(done, tol)
    model = fit(done[best]["weights"], 0)  # no iteration: these weights
    return EarlyFit(model, [r["accuracy"] for r in done], best, n.get(False, 0), n.get(True, 0), since >= patience, folder)
