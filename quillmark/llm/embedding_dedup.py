"""Embedding near-dedup with an inverted multi-index (operator 3).

Vectors are cut in two halves and each half has its own codebook (k-means on a bounded
sample of ``FIT_ROWS`` unit vectors); a cell is a pair of codewords.  A query visits cells
by rising sum of its two distances (the multi-sequence order), the first ``depth`` cells.
``depth`` is the smallest number that reaches ``TARGET`` of all links of ``PROBES`` sample
queries, which are compared by brute force with every vector, and ``TARGET`` of each kind
of planted links: ``PLANTED`` sample vectors moved to the least cosine of a link in any
direction, towards another sample vector, or within either half.  Planted links are there
however rare near copies are, and are the farthest that links can be.  Vectors found in
visited cells are verified by cosine in double precision, so a link is never wrong; one may
be missed with a probability of about ``1 - TARGET``.

Equal vectors are one node with a weight.  A cell's members are cut into blocks of at most
``MEMBERS``, and every query of the cell meets every block, so that a cell with a third of
all vectors is spread over many tasks; tasks return link counts per vector and a spanning
forest of the links they saw, never the pairs.  A link that only one of its two vectors
would find is counted for both.

Defined results: null, empty and zero vectors and those with null or non-finite components
have no links and are their own component, as are rows with a null id (component null);
vectors of different lengths are not compared; every other row with an equal vector is a
link; rows that share an id are one node; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary, shuffle_partitions, stored
from .components import components, forest

COSINE = 0.9
FIT_ROWS, PROBES, PLANTED = 8192, 256, 4096
TARGET = 0.995
MEMBERS = 2048
#: Queries compared at once.
QUERIES = 512
LARGEST_CODEBOOK = 256


def matrix(items: list[bytes], width: int) -> np.ndarray:
    """Rows of stored vectors as unit vectors in double precision."""
    x = np.frombuffer(b"".join(items), np.float64).reshape(len(items), width)
    x = x / np.abs(x).max(1, keepdims=True)  # squares stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Codebook of at most ``k`` words."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


@dataclass
class Index:
    left: np.ndarray
    right: np.ndarray
    depth: int = 1
    taken: np.ndarray | None = None  # cells that hold vectors

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = distances(x[:, :self.half], self.left).argmin(1), distances(x[:, self.half:], self.right).argmin(1)
        return a * len(self.right) + b

    def order(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The first ``depth`` cells of each query in multi-sequence order.  Among the
        ``depth`` nearest cells are only pairs of words whose ranks multiply to at most
        ``depth``, so only those are summed and sorted."""
        a, b = distances(x[:, :self.half], self.left), distances(x[:, self.half:], self.right)
        ra, rb = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        depth = min(depth, len(self.left) * len(self.right))
        i, j = (v.ravel() for v in np.indices((len(self.left), len(self.right))))
        near = (i + 1) * (j + 1) <= depth
        i, j = i[near], j[near]
        total = np.take_along_axis(a, ra, 1)[:, i] + np.take_along_axis(b, rb, 1)[:, j]
        # nearer ranks first where sums are equal, so that a vector's own cell is first
        at = np.lexsort((np.broadcast_to(i + j, total.shape), total), axis=1)[:, :depth]
        return np.take_along_axis(ra[:, i], at, 1) * len(self.right) + np.take_along_axis(rb[:, j], at, 1)

    def rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Place of one cell a query in its multi-sequence order, the last among cells at
        equal sums."""
        a, b = distances(x[:, :self.half], self.left), distances(x[:, self.half:], self.right)
        out = np.zeros(len(x), np.int64)
        i, j = np.divmod(cell, len(self.right))
        for k in np.flatnonzero((i != a.argmin(1)) | (j != b.argmin(1))):
            out[k] = (a[k][:, None] + b[k] <= a[k, i[k]] + b[k, j[k]]).sum() - 1
        return out


def nodes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """All rows as ``vec_id, rep`` (null without a usable vector) and the distinct
    vectors as ``rep, width, vec, weight``."""
    def run(batches):
        for b in batches:
            out, widths = [], []
            for v in b.column(1):
                x = None
                if v.is_valid:
                    flat = v.values
                    if len(flat) and not flat.null_count:
                        a = flat.to_numpy(zero_copy_only=False).astype(np.float64)
                        if np.isfinite(a).all() and a.any():
                            x = a
                out.append(None if x is None else binary(x + 0.0))  # -0.0 is 0.0
                widths.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(widths, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "width", "vec"])

    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = stored(rows.mapInArrow(run, "vec_id long, width int, vec binary").withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.md5("vec")))
    usable = rows.where("vec is not null and vec_id is not null")
    classes = stored(usable.groupBy("width", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec")))
    whose = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("width")).alias("width"), "h1", "h2").join(
        classes.select("width", "h1", "h2", "rep", "weight"), ["width", "h1", "h2"], "left").select("vec_id", "rep", "weight")
    return whose, classes.select("rep", "width", "vec", "weight")


def planted(x: np.ndarray, cosine: float, seed: int = 13) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at ``cosine``, by kind of the direction between them."""
    rng = np.random.default_rng(seed)
    half = max(1, x.shape[1] // 2)
    x = x[rng.permutation(len(x))[:PLANTED]]
    out = []
    for kind in ("any", "sample", "left", "right"):
        d = x[rng.permutation(len(x))] if kind == "sample" else rng.normal(size=x.shape)
        if kind == "left":
            d[:, half:] = 0
        elif kind == "right":
            d[:, :half] = 0
        d = d - (d * x).sum(1)[:, None] * x
        size = np.sqrt((d * d).sum(1))
        some = size > 1e-6  # none between equal vectors, or in one dimension
        if some.any():
            out.append((x[some], cosine * x[some] + np.sqrt(max(0.0, 1 - cosine * cosine)) * d[some] / size[some, None]))
    return out


def planted_depth(index: Index, sample: np.ndarray, cosine: float = COSINE) -> int:
    """Cells that find ``TARGET`` of each kind of planted links from either vector."""
    depth = 1
    for x, y in planted(sample, cosine):
        rank = np.sort(np.minimum(index.rank(x, index.cell(y)), index.rank(y, index.cell(x))))
        depth = max(depth, int(rank[int(np.ceil(TARGET * len(rank))) - 1]) + 1)
    return depth


def fit(vectors: DataFrame, width: int, cosine: float = COSINE) -> Index | None:
    """Codebooks and depth for the vectors of one width."""
    sc = vectors.sparkSession.sparkContext
    vectors = vectors.where(F.col("width") == width)
    n = vectors.count()
    share = int(min(1.0, FIT_ROWS / n) * 1_000_000) if n else 0
    drawn = vectors.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1_000_000)) < share).select("rep", "vec").orderBy("rep").limit(2 * FIT_ROWS).collect()
    if not drawn:
        drawn = vectors.select("rep", "vec").limit(PROBES).collect()
    if not drawn:
        return None
    sample = matrix([bytes(r["vec"]) for r in drawn], width)
    half = max(1, width // 2)
    words = int(np.clip(np.sqrt(n / 32), 4, LARGEST_CODEBOOK))
    index = Index(kmeans(sample[:, :half], words), kmeans(sample[:, half:], words) if width > 1 else np.zeros((1, 0)))
    cells = len(index.left) * len(index.right)
    probes = sample[np.random.default_rng(11).permutation(len(sample))[:PROBES]]
    order = index.order(probes, cells)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(cells), order.shape), 1)
    bound = sc.broadcast((index, probes, rank.astype(np.int32)))

    def run(batches):
        index, probes, rank = bound.value
        for b in batches:
            x = matrix(b.column(0).to_pylist(), width) if b.num_rows else np.zeros((0, width))
            cell = index.cell(x)
            q, y = np.nonzero(probes @ x.T >= cosine)
            at, c = np.unique(np.concatenate([rank[q, cell[y]], -1 - cell]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c)], ["at", "n"])

    # by rank: links of the probes; by -1 - cell: members of the cells
    found = vectors.select("vec").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    links = np.zeros(cells, np.int64)
    members = np.zeros(cells, np.int64)
    for r in found:
        if r["at"] >= 0:
            links[r["at"]] = r["n"]
        else:
            members[-1 - r["at"]] = r["n"]
    # a probe's link to itself is at rank 0 and proves nothing
    links[0] -= min(links[0], len(probes))
    total = links.sum()
    index.depth = max(planted_depth(index, sample, cosine), int(np.searchsorted(np.cumsum(links), TARGET * total)) + 1 if total else 1)
    index.taken = members
    return index


def links(vectors: DataFrame, index: Index, width: int, cosine: float = COSINE) -> DataFrame:
    """``kind, u, v``: kind 0, vector ``u`` has links of weight ``v``; kind 1, ``u`` and
    ``v`` are connected."""
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    bound = spark.sparkContext.broadcast(index)

    def deal(batches):
        index = bound.value
        blocks = -(-index.taken // MEMBERS)
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                r = b.slice(a, 2048)
                rep, w = r.column(0).to_numpy(), r.column(2).to_numpy()
                x = matrix(r.column(1).to_pylist(), width)
                own = index.cell(x)
                block = (rep * 2654435761 >> 7) % np.maximum(blocks[own], 1)
                visit = index.order(x, index.depth)
                q = np.repeat(np.arange(len(x)), visit.shape[1])
                cell = visit.ravel()
                times = blocks[cell]
                q, cell = np.repeat(q, times), np.repeat(cell, times)
                to = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                at = np.concatenate([np.arange(len(x)), q])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, cell]).astype(np.int32)), pa.array(np.concatenate([block, to]).astype(np.int32)),
                                                  pa.array(np.concatenate([np.zeros(len(x)), np.ones(len(q))]).astype(np.int32)), pa.array(rep[at]), r.column(1).take(pa.array(at)), pa.array(w[at])],
                                                 ["cell", "block", "role", "rep", "vec", "weight"])

    def compare(batches):
        index = bound.value
        group, m_rep, m_vec, m_w = None, [], [], []
        members = None
        for b in batches:
            cells, blocks, roles = (b.column(i).to_numpy() for i in (0, 1, 2))
            cut = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1]) | (roles[1:] != roles[:-1])])) if b.num_rows else []
            for a, z in zip(cut, np.append(cut[1:], b.num_rows)):
                if (cells[a], blocks[a]) != group:
                    group, m_rep, m_vec, m_w, members = (cells[a], blocks[a]), [], [], [], None
                rep, vec, w = b.column(3).slice(a, z - a).to_numpy(), b.column(4).slice(a, z - a), b.column(5).slice(a, z - a).to_numpy()
                if roles[a] == 0:
                    m_rep.append(rep)
                    m_vec += vec.to_pylist()
                    m_w.append(w)
                    continue
                if not m_rep:
                    continue
                if members is None:
                    x = matrix(m_vec, width)
                    members = (np.concatenate(m_rep), x, np.concatenate(m_w), None)
                for k in range(0, len(rep), QUERIES):
                    ids, y, w_m, visits = members
                    r, q = rep[k:k + QUERIES], matrix(vec.slice(k, QUERIES).to_pylist(), width)
                    i, j = np.nonzero(q @ y.T >= cosine)
                    other = r[i] != ids[j]
                    i, j = i[other], j[other]
                    if not len(i):
                        continue
                    if visits is None:
                        visits = index.order(y, index.depth)
                        members = (ids, y, w_m, visits)
                    # members that will not visit the query's cell get their link here
                    home = index.cell(q)
                    one_way = ~(visits[j] == home[i][:, None]).any(1)
                    u = np.concatenate([r[i], ids[j[one_way]]])
                    v = np.concatenate([w_m[j], w[k:k + QUERIES][i[one_way]]])
                    at, to = np.unique(u, return_inverse=True)
                    fu, fv = forest(r[i], ids[j])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), [len(at), len(fu)])), pa.array(np.concatenate([at, fu])),
                                                      pa.array(np.concatenate([np.bincount(to, weights=v).astype(np.int64), fv]))], ["kind", "u", "v"])

    rows = vectors.where(F.col("width") == width).select("rep", "vec", "weight").mapInArrow(deal, "cell int, block int, role int, rep long, vec binary, weight long")
    return rows.repartition(n, "cell", "block").sortWithinPartitions("cell", "block", "role").mapInArrow(compare, "kind int, u long, v long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    whose, vectors = nodes(rows, key, vector)
    found = None
    for r in vectors.groupBy("width").count().collect():  # as many rows as there are lengths
        index = fit(vectors, r["width"], cosine)
        part = links(vectors, index, r["width"], cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return whose.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stored(found)
    counts = found.where("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("n"))
    same = whose.where("rep is not null and vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    comps = components(found.where("kind = 1").select("u", "v").union(same)).select(F.col("node").alias("vec_id"), "component")
    out = whose.join(counts, "rep", "left").join(comps, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    n = F.when(F.col("rep").isNotNull(), F.col("weight") - 1 + F.coalesce("n", F.lit(0))).otherwise(0)
    return out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
