"""Reversible line dedup (operator 1): exact reference tables behind sharded cuckoo
filters.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased, of
at least ``MIN_CHARS`` code points.  The reference table holds one row per key and
document; the count table one row per key: how many documents hold it and the largest id
among them.  Keys held by at least ``MIN_DOCS`` documents lose their lines everywhere but
in that document.  Inserting documents adds references, deleting documents takes them
away, and only the counts of the keys touched are made anew, so both are reversible.

Repeated keys are spread over shards by hash; each shard's cuckoo filter (16-bit
fingerprints, buckets of four, deletion possible) takes about 2.5 bytes a key.  Texts
probe the filters first, so that only lines that hit go to the exact table: the filter
never decides alone.  ``LineIndex`` keeps the filters as a table: keys that reach or leave
``min_docs`` documents are added to or deleted from the filters of their shards, and only a
filter that is full is built anew.  The one-pass ``dedup`` builds its filters once.  The filters are broadcast while there are at most
``FILTER_KEYS`` repeated keys; beyond that every key row goes to the exact join.

Defined results: a null or empty text is one empty line; a document is an id, so rows that
share one count once for a key and keep or lose its lines together; rows with a null id are
no documents, neither count nor lose lines; an empty table gives an empty table; other
columns, whatever their names, are not read, or with ``columns`` come back unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import plain_names, quoted, stored, two_columns

MIN_CHARS = 40
MIN_DOCS = 5
#: Repeated keys up to which the filters are broadcast (about 2.5 bytes each).
FILTER_KEYS = 16_000_000
#: Keys of a shard.
SHARD_KEYS = 32_768
_ENDS = b" \t\n\v\f\r"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key has two buckets.  ``add`` returns
    False when it finds no place (build a larger one then)."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, 4), np.uint16) if table is None else table

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(len(k1), 1) / 3.4 + 1))))
        while True:
            f = cls(buckets)
            if all(f.add(int(a), int(b)) for a, b in zip(k1.tolist(), k2.tolist())):
                return f
            buckets *= 2

    def _place(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k1, k2 = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
        mark = (k2 & np.uint64(0xFFFF)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        first = ((k1 >> np.uint64(24)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 3) & (self.buckets - 1))

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, a, b = self._place(k1, k2)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def add(self, k1: int, k2: int) -> bool:
        mark, a, b = (x[0] for x in self._place(np.array([k1]), np.array([k2])))
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = b
        for turn in range(500):  # move others on
            slot = turn & 3
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, k1: int, k2: int) -> bool:
        mark, a, b = (x[0] for x in self._place(np.array([k1]), np.array([k2])))
        for bucket in (a, b):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                return True
        return False


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16-byte hash of the line's key, None if the key is too short."""
    k = line.strip(_ENDS)
    if len(k) < min_chars:
        return None
    k = k.lower()  # bytes: A-Z only
    if not k.isascii() and len(k) < 4 * min_chars and len(k.decode("utf-8")) < min_chars:
        return None
    return hashlib.blake2b(k, digest_size=16).digest()


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    out = {line_key(x, min_chars) for x in (text or "").encode().split(b"\n") if len(x) >= min_chars}
    out.discard(None)
    return out


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS, filters: list[CuckooFilter] | None = None) -> DataFrame:
    """Reference rows ``k1, k2, doc_id``: one per row of ``docs`` and key, of the keys
    that hit the ``filters`` if there are any."""
    bound = docs.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                r = b.slice(a, 1024)
                rows, keys = [], []
                for i, t in enumerate(r.column(1).to_pylist()):
                    own = _keys(t, min_chars)
                    keys += own
                    rows += [i] * len(own)
                k = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
                at = np.array(rows, dtype=np.int64)
                if bound is not None and len(k):
                    hit = np.zeros(len(k), bool)
                    shard = shard_of(k[:, 0], len(bound.value))
                    for s in np.unique(shard):
                        own = np.flatnonzero(shard == s)
                        if bound.value[s] is not None:
                            hit[own] = bound.value[s].contains(k[own, 0], k[own, 1])
                    k, at = k[hit], at[hit]
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), r.column(0).take(pa.array(at))], ["k1", "k2", "doc_id"])

    return two_columns(docs).where("doc_id is not null").mapInArrow(run, "k1 long, k2 long, doc_id long")


def shard_of(k1: np.ndarray, shards: int) -> np.ndarray:
    return ((k1.astype(np.int64).view(np.uint64) >> np.uint64(48)) % np.uint64(shards)).astype(np.int64)


def key_counts(refs: DataFrame) -> DataFrame:
    """``k1, k2, n, keeper``: documents (distinct ids) that hold a key, the largest of them.
    Distinct ids are counted in two steps, so the rows of a common line are spread."""
    return refs.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))


class LineIndex:
    """References, counts and filters that follow insertions and deletions of documents.
    References and counts are written anew, filters only in shards with keys that cross
    ``min_docs``."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.refs, self.counts, self.filters, self.shards, self.min_chars, self.min_docs = refs, counts, filters, shards, min_chars, min_docs

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        refs = stored(line_refs(docs, min_chars))
        return cls._dealt(refs, stored(key_counts(refs)), min_chars, min_docs)

    @classmethod
    def _dealt(cls, refs: DataFrame, counts: DataFrame, min_chars: int, min_docs: int) -> LineIndex:
        repeated = counts.where(F.col("n") >= min_docs)
        shards = shards_of(repeated.count())
        return cls(refs, counts, stored(filter_table(repeated, shards)), shards, min_chars, min_docs)

    def _renewed(self, refs: DataFrame, changed: DataFrame) -> LineIndex:
        keys = stored(changed.select("k1", "k2").distinct())
        fresh = stored(key_counts(refs.join(keys, ["k1", "k2"], "left_semi")))
        counts = stored(self.counts.join(keys, ["k1", "k2"], "left_anti").unionByName(fresh))
        repeated = counts.where(F.col("n") >= self.min_docs)
        if shards_of(repeated.count()) > 2 * self.shards:  # filters have become too large
            return self._dealt(refs, counts, self.min_chars, self.min_docs)
        was = keys.join(self.counts.where(F.col("n") >= self.min_docs).select("k1", "k2", F.lit(True).alias("was")), ["k1", "k2"], "left")
        now = was.join(fresh.where(F.col("n") >= self.min_docs).select("k1", "k2", F.lit(True).alias("now")), ["k1", "k2"], "left")
        crossed = now.where(~F.col("was").eqNullSafe(F.col("now"))).select("k1", "k2", F.col("now").isNotNull().alias("more"), shard_column(self.shards))
        renewed = stored(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_followed, FILTERS + ", full boolean"))
        full = repeated.withColumn("shard", shard_column(self.shards)).join(F.broadcast(renewed.where("full").select("shard")), "shard", "left_semi")
        filters = stored(renewed.where("not full").drop("full").unionByName(filter_table(full, self.shards)))
        return LineIndex(refs, counts, filters, self.shards, self.min_chars, self.min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        new = stored(line_refs(docs, self.min_chars))
        return self._renewed(stored(self.refs.unionByName(new)), new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        ids = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        gone = stored(self.refs.join(ids, "doc_id", "left_semi").select("k1", "k2", "doc_id"))
        left = stored(self.refs.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id"))
        return self._renewed(left, gone)

    def repeated(self, min_docs: int | None = None) -> DataFrame:
        return self.counts.where(F.col("n") >= (min_docs or self.min_docs))

    def drops(self, docs: DataFrame) -> DataFrame:
        """``drops`` by the index's own filters."""
        repeated = self.repeated()
        filters = collected(self.filters, self.shards) if repeated.count() <= FILTER_KEYS else None
        return lost_keys(docs, repeated, self.min_chars, filters)


FILTERS = "shard int, buckets int, data binary"


def _followed(held: pd.DataFrame, crossed: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its keys were deleted and added; ``full`` if it must be
    built anew."""
    if not len(crossed):
        return held.assign(full=False)
    full = not len(held)  # no key so far
    shard, buckets, data = int(crossed["shard"].iloc[0]), 0, b""
    if not full:
        f = CuckooFilter(int(held["buckets"].iloc[0]), np.frombuffer(held["data"].iloc[0], np.uint16).reshape(-1, 4).copy())
        for more in (False, True):
            rows = crossed[crossed["more"] == more]
            done = (f.add if more else f.delete)
            full = full or not all(done(a, b) for a, b in zip(rows["k1"].tolist(), rows["k2"].tolist()))
        buckets, data = f.buckets, f.table.tobytes()
    return pd.DataFrame({"shard": [shard], "buckets": [buckets], "data": [data], "full": [full]})


def shards_of(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def shard_column(shards: int):
    return F.expr(f"cast(shiftrightunsigned(k1, 48) % {shards} as int)").alias("shard")


def filter_table(repeated: DataFrame, shards: int) -> DataFrame:
    """``shard, buckets, data``: one filter per shard, built by a task each."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.of(part["k1"].to_numpy(), part["k2"].to_numpy())
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "buckets": [f.buckets], "data": [f.table.tobytes()]})

    return repeated.select("k1", "k2", shard_column(shards)).groupBy("shard").applyInPandas(run, FILTERS)


def collected(filters: DataFrame, shards: int) -> list[CuckooFilter | None]:
    """The filters brought together, as they are broadcast next (their size is bounded by
    the caller's check of the number of keys)."""
    out: list[CuckooFilter | None] = [None] * shards
    for r in filters.collect():
        out[r["shard"]] = CuckooFilter(r["buckets"], np.frombuffer(r["data"], np.uint16).reshape(-1, 4))
    return out


def build_filters(repeated: DataFrame, n_keys: int) -> list[CuckooFilter | None]:
    shards = shards_of(n_keys)
    return collected(filter_table(repeated, shards), shards)


def drops(docs: DataFrame, repeated: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, keys``: hashes of the keys that a document loses.  ``repeated`` is a
    stored table."""
    n = repeated.count()
    return lost_keys(docs, repeated, min_chars, build_filters(repeated, n) if n <= FILTER_KEYS else None)


def lost_keys(docs: DataFrame, repeated: DataFrame, min_chars: int, filters: list[CuckooFilter | None] | None) -> DataFrame:
    refs = line_refs(docs, min_chars, filters)
    lost = refs.join(repeated.select("k1", "k2", "keeper"), ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def without_lines(docs: DataFrame, lost: DataFrame, min_chars: int = MIN_CHARS, columns: list[str] | None = None) -> DataFrame:
    """Texts without the lost lines: ``doc_id, text, n_lines, n_dropped``, or with
    ``columns`` those columns of ``docs`` (``text`` among them) in their order."""
    keep = columns or ["doc_id", "text"]
    known = docs.select(*keep).where("doc_id is not null").join(lost.select(F.col("doc_id").alias("_id"), F.col("keys").alias("_keys")), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    none = docs.select(*keep).where("doc_id is null").withColumn("_keys", F.lit(None).cast(known.schema["_keys"].dataType))
    rows = known.unionByName(none)  # rows without an id are not brought to one task
    at = keep.index("text")
    extra = [] if columns else ["n_lines", "n_dropped"]

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                r = b.slice(a, 1024)
                texts, lines, dropped = [], [], []
                for t, keys in zip(r.column(at).to_pylist(), r.column(len(keep))):
                    raw = (t or "").encode()
                    n, out = raw.count(b"\n") + 1, 0
                    if keys.is_valid:
                        gone = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in keys.as_py()}
                        kept = [x for x in raw.split(b"\n") if len(x) < min_chars or line_key(x, min_chars) not in gone]
                        out = n - len(kept)
                        t = b"\n".join(kept).decode()
                    texts.append(t if columns else t or "")
                    lines.append(n)
                    dropped.append(out)
                cols = [pa.array(texts, pa.string()) if i == at else r.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, *([] if columns else [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())])], [*keep, *extra])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_keys")
    return rows.mapInArrow(run, fields + ("" if columns else ", n_lines long, n_dropped long"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, columns: list[str] | None = None) -> DataFrame:
    """One pass over a whole corpus; see ``LineIndex`` for the incremental form."""
    if columns is not None:
        docs = plain_names(docs.select(*map(quoted, columns)), ("doc_id", "text"))
    rows, inner = (two_columns(docs), None) if columns is None else (docs, docs.columns)
    repeated = stored(key_counts(line_refs(rows, min_chars)).where(F.col("n") >= min_docs))
    out = without_lines(rows, drops(rows, repeated, min_chars), min_chars, inner)
    return out if columns is None else out.toDF(*columns)
