"""Embedding operators.

Vector aggregates are per-dimension aggregates over ``posexplode`` rows, so a group's
vectors are summed with partial (map-side) aggregation and never collected into one
task; only the final per-group vector (bounded by the dimension) is re-assembled."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sampling import h32, u01
from ..functions.text import tokens
from .corpus import join_null_safe


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def assemble(df: DataFrame, by, dim: str = "dim", val: str = "val", out: str = "vec") -> DataFrame:
    """(by..., dim, val) -> (by..., vec ARRAY<DOUBLE>) ordered by dim (bounded by the
    vector size)."""
    b = _by(by)
    return (df.groupBy(*b).agg(F.array_sort(F.collect_list(F.struct(F.col(dim).alias("d"), F.col(val).alias("v"))))
                               .alias("_s"))
            .select(*b, F.transform("_s", lambda s: s["v"]).alias(out)))


def vector_mean(df: DataFrame, by, vec: str = "vec", out: str = "vec") -> DataFrame:
    """Per-group mean vector (E3 mean, E5 over rows)."""
    b = _by(by)
    x = df.select(*b, F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "val"))
    return assemble(x.groupBy(*b, "dim").agg(F.avg("val").alias("val")), b, out=out)


def word_avg(docs: DataFrame, vectors: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """E3 (+C10): mean of the vectors of in-vocabulary tokens (repeats count), zero
    vector when none.  ``vectors`` is ``(word, vec)``; the token->vector lookup is an
    equi-join (the optimizer broadcasts it only when its measured size allows)."""
    toks = docs.select(key, F.explode(tokens(text)).alias("word"))
    hit = toks.join(vectors.select("word", F.col("vec").cast("array<double>").alias("vec")), "word")
    mean = vector_mean(hit, key)
    dim = vectors.select(F.max(F.size("vec"))).scalar()      # scalar subquery
    zero = F.array_repeat(F.lit(0.0), dim.cast("int"))
    return docs.select(key).join(mean, key, "left").select(key, F.coalesce("vec", zero).alias("vec"))


def hashed_word_vectors(words: DataFrame, dim: int = 16, seed=7, word: str = "term") -> DataFrame:
    """Deterministic word-vector table for a vocabulary: component k of word w is
    u01(seed, w, k) - 0.5."""
    return words.select(F.col(word).alias("word"),
                        F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                    lambda k: u01(seed, F.col(word), k) - F.lit(0.5)).alias("vec"))


def episode_sample(posts: DataFrame, author: str, order: str, seed=42, max_posts: int = 16,
                   sample_id: int = 0, batch: str | None = None) -> DataFrame:
    """Episodes of the authors of a batch, all of one length and start.

    A history is an author's first ``max_posts`` posts.  With ``s`` the shortest history
    of the batch, the length is ``min(1 + ceil((max_posts - 1) * x), s)`` with x a seeded
    Beta(3,1) draw (``u^(1/3)``); the start is 0 if ``s < max_posts``, else a seeded draw
    from ``0 .. max_posts - length``.  Without ``batch`` all authors are one batch.  The
    rank filter keeps at most ``max_posts`` rows of an author before the exchange."""
    w = Window.partitionBy(author).orderBy(order)
    x = posts.withColumn("_b", F.col(batch) if batch else F.lit(0))
    x = x.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= max_posts).withColumn("_pos", F.col("_pos") - 1)
    n = x.groupBy("_b", author).agg(F.count(F.lit(1)).alias("_n"))
    plan = n.groupBy("_b").agg(F.min("_n").alias("_s"))
    draw = F.ceil(F.lit(float(max_posts - 1)) * F.pow(u01(seed, F.col("_b"), F.lit("len")), 1.0 / 3.0))
    plan = plan.withColumn("_m", F.least(F.lit(1) + draw, F.col("_s")).cast("long"))
    plan = plan.withColumn("_start", F.when(F.col("_s") < max_posts, F.lit(0)).otherwise(
        F.pmod(h32(seed, F.col("_b"), F.lit("start")), F.lit(max_posts) - F.col("_m") + 1)))
    x = join_null_safe(x, plan, ["_b"]).where((F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_start") + F.col("_m")))
    return x.select(*posts.columns, F.lit(sample_id).alias("sample_id"), (F.col("_pos") - F.col("_start")).cast("int").alias("post_pos"))


def episode_embedding(df: DataFrame, by, member: str, vec: str = "vec") -> DataFrame:
    """Dot-product self-attention among the members of a group (scores / sqrt(d),
    softmax per row), then the element-wise max over members.  The member-by-member join
    is within an episode, whose size is bounded by ``episode_sample`` (<= 16)."""
    b = _by(by)
    x = df.select(*b, F.col(member).alias("i"), F.col(vec).cast("array<double>").alias("xi"))
    y = x.select(*b, F.col("i").alias("j"), F.col("xi").alias("xj"))
    pairs = x.join(y, b)
    d = F.size("xi")
    s = F.aggregate(F.zip_with("xi", "xj", lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v) / F.sqrt(d)
    pairs = pairs.select(*b, "i", "j", "xj", s.alias("s"))
    wi = Window.partitionBy(*b, "i")
    pairs = pairs.withColumn("a", F.exp(F.col("s") - F.max("s").over(wi)))
    pairs = pairs.withColumn("a", F.col("a") / F.sum("a").over(wi))
    comp = pairs.select(*b, "i", "a", F.posexplode("xj").alias("dim", "val"))
    yi = comp.groupBy(*b, "i", "dim").agg(F.sum(F.col("a") * F.col("val")).alias("val"))
    ep = yi.groupBy(*b, "dim").agg(F.max("val").alias("val"))
    return assemble(ep, b)


def _sign_matrix(seed, d_in: int, d_out: int) -> np.ndarray:
    """R[j, k] = +1 / -1 from the first hex digit of md5("seed-j-k") (< 8 -> +1)."""
    r = np.empty((d_in, d_out), dtype=np.float64)
    for j in range(d_in):
        for k in range(d_out):
            h = hashlib.md5(f"{seed}-{j}-{k}".encode()).hexdigest()
            r[j, k] = 1.0 if h[0] < "8" else -1.0
    return r


def project(df: DataFrame, dim: int = 512, seed=42, vec: str = "vec", out: str = "proj") -> DataFrame:
    """Seeded random +-1 projection to ``dim`` components, scaled by 1/sqrt(dim).
    Arrow batches + one numpy matmul per batch; the matrix is rebuilt in each task from
    the seed (nothing large is shipped from the driver)."""
    in_fields = df.schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in in_fields]
                       + [f"`{out}` array<double>"])

    def run(batches):
        mats = {}
        for pdf in batches:
            if len(pdf) == 0:
                yield pdf.assign(**{out: pd.Series([], dtype=object)})
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec]])
            d_in = x.shape[1]
            if d_in not in mats:
                mats[d_in] = _sign_matrix(seed, d_in, dim) / math.sqrt(dim)
            y = x @ mats[d_in]
            yield pdf.assign(**{out: list(y)})
    return df.mapInPandas(run, schema)


def softmax_pool(df: DataFrame, by, score: str, vec: str) -> DataFrame:
    """softmax(score)-weighted mean of vectors per group.  Every task keeps one
    partial per group (largest score, weight sum and weighted vector sum relative to it);
    partials are brought to a common maximum and added, so a group with most of the rows
    sends one row per task."""
    b = _by(by)
    rows = df.select(*b, F.col(score).cast("double").alias("_s"), F.col(vec).cast("array<double>").alias("_v")).where("_s is not null and _v is not null")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in b)

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                g, s, v = tuple(None if x != x else x for x in r[:len(b)]), r[-2], np.asarray(r[-1], dtype=np.float64)
                if g not in held:
                    held[g] = [s, 1.0, v.copy()]
                    continue
                m, den, num = held[g]
                if s > m:
                    k = math.exp(m - s)
                    held[g] = [s, den * k + 1.0, num * k + v]
                else:
                    k = math.exp(s - m)
                    held[g] = [m, den + k, num + k * v]
        if held:
            out = pd.DataFrame([list(g) for g in held], columns=b, dtype=object)
            out["_m"], out["_den"], out["_num"] = ([x[i] for x in held.values()] for i in range(3))
            yield out

    part = rows.mapInPandas(run, (fields + ", " if b else "") + "_m double, _den double, _num array<double>")
    merged = part.groupBy(*b).agg(F.max("_m").alias("_mx"), F.collect_list(F.struct("_m", "_den", "_num")).alias("_p"))
    k = lambda p: F.exp(p["_m"] - F.col("_mx"))
    den = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["_den"] * k(p))
    zero = F.transform(F.element_at("_p", 1)["_num"], lambda x: F.lit(0.0))
    num = F.aggregate("_p", zero, lambda a, p: F.zip_with(a, p["_num"], lambda x, y: x + y * k(p)))
    merged = merged.select(*b, den.alias("_den"), num.alias("_num"))
    return merged.select(*b, F.transform("_num", lambda x: x / F.col("_den")).alias("vec"))


# -- E8 registry -------------------------------------------------------------------------

def hash_buckets(text, dim: int = 64):
    """Bucket id (md5 of the token, mod dim) of every token: a Catalyst expression."""
    return F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10)
                                                      .cast("long"), F.lit(dim)))


def _bincount_udf(dim: int):
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def bincount(b: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(x, dtype=np.int64), minlength=dim).astype(np.float64)
                          for x in b])
    return bincount


def _embed_hash_proj(df, key="doc_id", text="text", dim=64, seed=42, **_):
    """Bag of hashed tokens (md5 bucket counts) — a row-local embedding; the per-row
    histogram is one numpy bincount over the Catalyst-computed bucket ids."""
    return df.select(key, _bincount_udf(dim)(hash_buckets(text, dim)).alias("vec"))


def _embed_tfidf(df, key="doc_id", text="text", vocabulary=None, **_):
    from .tfidf import tfidf_fit, tfidf_transform
    voc = vocabulary if vocabulary is not None else tfidf_fit(df.select(key, text), key=key, text=text)
    return tfidf_transform(df.select(key, text), voc, key=key, text=text)


def _embed_word_avg(df, key="doc_id", text="text", vectors=None, **_):
    if vectors is None:
        raise ValueError("word_avg needs a (word, vec) table")
    return word_avg(df, vectors, key, text)


EMBEDDERS = {"hash_proj": _embed_hash_proj, "tfidf": _embed_tfidf, "word_avg": _embed_word_avg}


def register_embedder(name: str, fn) -> None:
    """External models plug in here (e.g. a ``predict_batch_udf`` wrapper)."""
    EMBEDDERS[name] = fn


def embed(df: DataFrame, method: str, **params) -> DataFrame:
    """Run a registered embedding method; unknown methods raise KeyError so callers
    can skip them with a status row."""
    return EMBEDDERS[method](df, **params)
