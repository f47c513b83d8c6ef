"""Toxicity scores from a character n-gram linear classifier with naive Bayes scaled
features (operator 11).

Texts are lower-cased, and their 3- to 5-grams of code points (a space before and after
the text) hashed into ``BUCKETS``; a feature is present or not.  Over *all* labelled
training rows each bucket's documents are counted per class; its log-count ratio

    r = log((c1 + PRIOR * p1) / n1) - log((c0 + PRIOR * p0) / n0)

(``c``: documents of the class that hold it, ``n``: documents of the class, ``p``: the
class's share, so that an unseen bucket has r = 0) is the value of the feature.  The
``FEATURES`` buckets whose counts depart most from the class shares, in standard
deviations, form the model; a logistic regression (Spark ML) on the scaled features gives
their weights.  It is fitted on at most about ``TRAIN_ROWS`` labelled rows, chosen by the
hash of the text; counts cover all rows.

Defined results: null and empty texts have the n-grams of two spaces, hence none of three,
and score by the intercept alone; labels other than 0 and 1 and null ids are not learned
from; an id labelled several times is toxic if any label says so; every row of a repeated
id is a training row; without rows of both classes every text scores the share of class 1
(0 without rows); repeated rows are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, mix, slices, stored, two_columns

ORDERS = (3, 4, 5)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Buckets in the model.
FEATURES = 1 << 12
PRIOR = 4.0
#: Labelled rows the regression is fitted on, about.
TRAIN_ROWS = 200_000
#: Code points hashed at once.
PART = 1 << 19
REGULARISATION = 3e-4
ITERATIONS = 60


def buckets(points: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the start and bucket of every n-gram that does not cross ``ends``
    (of each start, the end of its text)."""
    c = points.astype(np.uint64)
    n = len(c)
    if n < ORDERS[0]:
        return
    h = mix(c[:n - 2] << U64(42) | c[1:n - 1] << U64(21) | c[2:])
    for order in ORDERS:
        if order > 3:
            if n < order:
                return
            h = mix(h[:n - order + 1] * U64(0x9E3779B97F4A7C15) + c[order - 1:])
        at = np.flatnonzero(np.arange(n - order + 1) + order <= ends[:n - order + 1])
        yield at, (h[at] >> U64(64 - BUCKET_BITS)).astype(np.int64)


def _parts(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Texts of together about ``PART`` code points; longer ones in parts that overlap by
    the longest n-gram but one character, so that every n-gram lies in a part."""
    held, size = [], 0
    for row, text in enumerate(texts):
        t = f" {(text or '').lower()} "
        for a in range(0, max(len(t) - ORDERS[-1] + 1, 1), PART):
            piece = t[a:a + PART + ORDERS[-1] - 1]
            held.append((row, piece))
            size += len(piece)
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def _distinct(a: np.ndarray) -> np.ndarray:
    """Ascending distinct values; by sorting, as numpy's unique hashes whole numbers, which
    takes many times as long on a million of them."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def present(texts: list[str | None], feature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of the distinct n-gram buckets of each text, ascending; with
    ``feature`` (number of each bucket's feature, -1: none) the features instead."""
    found = []
    for part in _parts(texts):
        lens = np.array([len(p) for _, p in part])
        points = np.frombuffer("".join([p for _, p in part]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        rows = np.repeat(np.array([r for r, _ in part]), lens)
        ends = np.repeat(np.cumsum(lens), lens)
        for at, bucket in buckets(points, ends):
            if feature is not None:
                bucket = feature[bucket]
                have = np.flatnonzero(bucket >= 0)
                at, bucket = at[have], bucket[have]
            found.append(_distinct(rows[at] << BUCKET_BITS | bucket))
    pairs = _distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BUCKET_BITS, pairs & (BUCKETS - 1)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``doc_id, text, label`` of the documents that a label marks 0 or 1.  A sorted join on
    the id at every size (labels grow with the documents); where one id is frequent, the
    adaptive plan splits it."""
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    return two_columns(docs, key, text).where("doc_id is not null").join(marks.hint("merge"), "doc_id")


@dataclass
class Model:
    feature: np.ndarray     # feature number of each bucket, -1: none
    weight: np.ndarray      # of each feature, the log-count ratio multiplied in
    intercept: float


def class_counts(rows: DataFrame) -> DataFrame:
    """``bucket, n0, n1``: documents of each class that hold a bucket; bucket -1 counts
    all.  At most ``BUCKETS`` rows leave a task."""
    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        total = np.zeros(2, np.int64)
        for b in batches:
            marks = b.column(1).to_numpy(zero_copy_only=False)
            for a, z, _, _ in slices(b, "text"):
                row, bucket = present(b.column(0).slice(a, z - a).to_pylist())
                own = marks[a:z]
                for k in (0, 1):
                    counts[k] += np.bincount(bucket[own[row] == k], minlength=BUCKETS)
                    total[k] += int((own == k).sum())
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[0, at], total[0])), pa.array(np.append(counts[1, at], total[1]))], ["bucket", "n0", "n1"])

    return rows.select("text", "label").mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(rows: DataFrame, features: int = FEATURES, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from ``text, label`` rows.  The driver receives at most ``features`` rows
    and the weights of as many features."""
    rows = stored(rows.select("text", "label"))
    counts = stored(class_counts(rows))
    n0, n1 = next(((r.n0, r.n1) for r in counts.where("bucket = -1").collect()), (0, 0))
    none = np.full(BUCKETS, -1, np.int32)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(none, np.zeros(0), np.inf if share == 1 else -np.inf)
    share = n1 / (n0 + n1)
    both = F.col("n0") + F.col("n1")
    ratio = F.log((F.col("n1") + PRIOR * share) / n1) - F.log((F.col("n0") + PRIOR * (1 - share)) / n0)
    departs = F.abs(F.col("n1") - both * share) / F.sqrt((both + PRIOR) * share * (1 - share))
    best = counts.where("bucket >= 0").select("bucket", ratio.alias("ratio"), departs.alias("departs"))
    chosen = best.orderBy(F.col("departs").desc(), "bucket").limit(features).toPandas()
    feature = none
    feature[chosen["bucket"].to_numpy()] = np.arange(len(chosen))
    ratios = chosen["ratio"].to_numpy()

    spark = rows.sparkSession
    bound = spark.sparkContext.broadcast((feature, ratios))
    keep = min(1.0, train_rows / (n0 + n1))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(keep * (1 << 30)))

    def run(batches):
        index, r = bound.value
        for b in batches:
            for a, z, _, _ in slices(b, "text"):
                row, found = present(b.column(0).slice(a, z - a).to_pylist(), index)
                first = np.searchsorted(row, np.arange(z - a + 1)).astype(np.int32)
                at = pa.ListArray.from_arrays(pa.array(first), pa.array(found.astype(np.int32)))
                value = pa.ListArray.from_arrays(pa.array(first), pa.array(r[found]))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(a, z - a), at, value], ["label", "at", "value"])

    sparse = F.udf(lambda at, value: SparseVector(features, at, value), VectorUDT())
    table = stored(sample.mapInArrow(run, "label int, at array<int>, value array<double>"))
    vectors = table.select(F.col("label").cast("double").alias("label"), sparse("at", "value").alias("features"))
    fitted = LogisticRegression(maxIter=ITERATIONS, regParam=REGULARISATION, standardization=False, family="binomial").fit(vectors)
    return Model(feature, fitted.coefficients.toArray()[:len(ratios)] * ratios, float(fitted.intercept))


def raw_scores(texts: list[str | None], model: Model) -> np.ndarray:
    row, found = present(texts, model.feature)
    x = model.intercept + np.bincount(row, weights=model.weight[found], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for a, z, _, _ in slices(b, "text"):
                got = raw_scores(b.column(1).slice(a, z - a).to_pylist(), bound.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(got)], ["doc_id", "score"])

    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, score double")
