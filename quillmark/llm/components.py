"""Connected components of an edge table by alternating large and small stars.

Edges are first contracted inside each partition (a spanning forest replaces them), then
every round links a node's larger neighbours, and then its smaller ones, to the smallest
node next to it, until nothing changes; the number of rounds grows with the logarithm of
a component's size.  Every round is written to the shared folder.  Nothing reaches the
driver but a count and a checksum of the edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, smallest node of its component)`` for all nodes but the smallest ones."""
    if len(u) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while True:  # to the end of each chain
            nxt = new[new]
            if (nxt == new).all():
                break
            new = nxt
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contract(batches):
    u, v, n = [], [], 0
    for b in batches:
        u.append(b.column(0).to_numpy(zero_copy_only=False))
        v.append(b.column(1).to_numpy(zero_copy_only=False))
        n += b.num_rows
        if n > 2_000_000:
            a, b_ = forest(np.concatenate(u), np.concatenate(v))
            if len(a) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_)], ["u", "v"])
                a, b_ = a[:0], b_[:0]
            u, v, n = [a], [b_], len(a)
    if u:
        a, b_ = forest(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_)], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` (its smallest node) for every node of an edge that is not
    itself the smallest of its component."""
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = stored(e.mapInArrow(_contract, "u long, v long").distinct())
    state = _state(e)
    while state[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        nxt = stored(small.where("u <> v").distinct())
        new = _state(nxt)
        e = nxt
        if new == state:
            break
        state = new
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
