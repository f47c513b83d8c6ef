"""All-pairs retrieval (C9, J9): for every query its nearest targets among all, without
comparing it with all: ``pivots`` leaves out the cells that cannot matter.

What is compared is cut into blocks of at most ``block`` rows on both sides; a pair of
blocks is one cogroup whose distance matrix is computed with numpy in the task and reduced
on the spot (min / count), so no pair is ever emitted as a row.  Ranking needs the best
same-author distance first: it meets only the targets of the same author, in blocks of that
author; then the targets nearer than it are counted cell by cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import pivots as P


def nearest_target(queries: DataFrame, targets: DataFrame, block: int = 4096) -> DataFrame:
    """For each query ``(qid, emb)`` its nearest target ``(tid, emb)`` by cosine
    distance (ties -> smaller tid): ``(qid, tid, dist)``."""
    found, _ = P.k_nearest(queries, P.build(targets.select("tid", "emb")), 1, block)
    return found.select("qid", "tid", "dist")


def k_nearest_targets(queries: DataFrame, targets: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The ``k`` nearest targets of each query: ``(qid, tid, dist, place)``."""
    return P.k_nearest(queries, P.build(targets.select("tid", "emb")), k, block)[0]


def author_ranks(queries: DataFrame, targets: DataFrame, block: int = 4096) -> DataFrame:
    """1-based rank of the best same-author target in the query's distance order:
    1 + #targets strictly closer than it.  Queries whose author has no target get a null
    rank (they still count in the recall / MRR denominators)."""
    narrow_q, narrow_t = queries.select("qid", "author", "emb"), targets.select("tid", "author", "emb")
    # the best distance meets only targets of the same author, in blocks of that author
    qa, ta = P.blocks(narrow_q.where("author is not null"), narrow_t.where("author is not null"), "qid", "tid", block, ["author"])

    def best_same(qp: pd.DataFrame, tp: pd.DataFrame) -> pd.DataFrame:
        if len(qp) == 0 or len(tp) == 0:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "dstar": pd.Series([], dtype="float64")})
        t = P.unit(tp["emb"])
        best = [P.distances(P.unit(p["emb"]), t).min(axis=1) for p in P.pieces(qp)]
        return pd.DataFrame({"qid": qp["qid"].to_numpy(), "dstar": np.concatenate(best)})

    dstar = (qa.groupBy("author", "lb", "rb").cogroup(ta.groupBy("author", "lb", "rb"))
             .applyInPandas(best_same, "qid long, dstar double")
             .groupBy("qid").agg(F.min("dstar").alias("dstar")))
    dstar = stored(dstar)
    cnt = P.count_nearer(narrow_q.select("qid", "emb").join(dstar, "qid"), P.build(narrow_t.select("tid", "emb")), block)
    base = queries.select("qid", "author").join(dstar, "qid", "left").join(cnt, "qid", "left")
    return base.select("qid", "author", F.when(F.col("dstar").isNotNull(), F.col("n_below") + 1)
                       .cast("long").alias("rank"))
