"""The most frequent terms of a corpus without a shuffle of its vocabulary.

Every task keeps a Misra-Gries summary of its texts: at most ``capacity`` counters; when
there are more, the count of the first that must go is taken off all of them.  A term's
counter is then at most its true count and falls short of it by no more than what was taken
off, so that with ``low`` the sum of its counters over the tasks and ``lost`` the sum of what
all tasks took off

    low <= true count <= low + lost.

With ``t`` the k-th largest ``low``, k terms occur at least ``t`` times; a term with
``low + lost < t`` is not among the first k, nor is one that no summary holds if
``lost < t``.  The rest are the candidates, and one more pass counts exactly those.  If
``lost >= t`` or the candidates are too many to broadcast, the summaries prove nothing, and
all terms are counted."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import tfidf as TF

#: Counters of a summary, per term that is asked for, and candidates that are broadcast.
COUNTERS = 16
MOST_CANDIDATES = 500_000


def cut_back(counts: Counter, capacity: int) -> int:
    """Leave at most ``capacity`` counters; what was taken off each."""
    if len(counts) <= capacity:
        return 0
    off = sorted(counts.values(), reverse=True)[capacity]
    for term in [t for t, n in counts.items() if n <= off]:
        del counts[term]
    for term in counts:
        counts[term] -= off
    return off


def _lowered(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.lower(F.col(text)).alias("text")).where("text is not null")


def summary(docs: DataFrame, capacity: int, text: str = "text") -> DataFrame:
    """``term, low``: merged counters; the null term holds ``lost``.  Terms are counted by
    slices of texts and added to the summary, cut back when its terms are many."""
    def run(batches):
        counts: Counter = Counter()
        lost = 0
        for b in batches:
            for some in TF.slices(b.column(0)):
                terms, at, _ = TF.numbered_terms(some)
                counts.update(dict(zip(terms.to_pylist(), np.bincount(at, minlength=len(terms)).tolist())))
                if len(counts) > 4 * capacity:
                    lost += cut_back(counts, capacity)
        lost += cut_back(counts, capacity)
        yield pa.RecordBatch.from_arrays([pa.array([*counts.keys(), None], pa.string()), pa.array([*counts.values(), lost], pa.int64())], ["term", "low"])

    return _lowered(docs, text).mapInArrow(run, "term string, low long").groupBy("term").agg(F.sum("low").alias("low"))


def counted(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """``term, cnt, df`` of the given terms: occurrences and texts, in one pass; a task
    sends at most one row per term."""
    bound = docs.sparkSession.sparkContext.broadcast(list(terms))

    def run(batches):
        given = pa.array(bound.value, pa.string())
        cnt, df = np.zeros(len(given), np.int64), np.zeros(len(given), np.int64)
        for b in batches:
            for some in TF.slices(b.column(0)):
                found, at, owner = TF.numbered_terms(some)
                place = TF.places(found, given)[at]
                place, owner = place[place >= 0], owner[place >= 0]
                cnt += np.bincount(place, minlength=len(given))
                once = np.unique(owner.astype(np.int64) * len(given) + place) % max(len(given), 1)
                df += np.bincount(once, minlength=len(given))
        held = np.flatnonzero(cnt)
        yield pa.RecordBatch.from_arrays([given.take(pa.array(held)), pa.array(cnt[held]), pa.array(df[held])], ["term", "cnt", "df"])

    return _lowered(docs, text).mapInArrow(run, "term string, cnt long, df long").groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))


def candidates(docs: DataFrame, k: int, capacity: int, text: str = "text") -> list[str] | None:
    """The terms that can be among the first ``k``, or None if the summaries do not tell."""
    held = stored(summary(docs, capacity, text))
    lost = held.where("term is null").first()
    lost = lost["low"] if lost else 0
    low = held.where("term is not null")
    first = low.orderBy(F.desc("low")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("t")).first()
    if first["n"] < k and lost == 0:
        least = 0           # fewer terms than are asked for, all of them held
    elif first["n"] < k or lost >= first["t"]:
        return None
    else:
        least = first["t"] - lost
    rows = low.where(F.col("low") >= least).select("term").limit(MOST_CANDIDATES + 1).collect()
    return [r["term"] for r in rows] if len(rows) <= MOST_CANDIDATES else None


def top_terms(docs: DataFrame, k: int, capacity: int | None = None, text: str = "text") -> DataFrame:
    """``term, cnt, df`` of the ``k`` most frequent terms, ties by the term; exact."""
    found = candidates(docs, k, capacity or COUNTERS * k, text)
    exact = TF.all_term_counts(docs, text) if found is None else counted(docs, found, text)
    return exact.orderBy(F.desc("cnt"), F.asc("term")).limit(k)
