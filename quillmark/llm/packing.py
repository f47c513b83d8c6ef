"""Best-fit packing of token sequences (operator 8): best-two-fit.

Lengths are whole numbers up to the capacity, so the packer needs only the histogram of
lengths (at most ``capacity`` rows).  It fills a bin greedily with the largest lengths
that fit, then replaces the bin's smallest document by two unpacked ones that fill the
widened gap more tightly, and repeats that bin as often as the histogram allows: the same
bins that a run document by document gives.  The plan (lengths to bins) stays small at
any input size; documents are then dealt to the plan by their rank among the documents
of their length.  Ranks come from windows over hashed parts of a length, so a length that
a third of all documents share is not one group.

Defined results: a null or empty text is one piece with the end id only; a document
longer than the capacity is cut into full pieces from its end, the first may be shorter;
repeated rows are packed once each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import give_back, stored, two_columns

CAPACITY = 2048
#: Rows of one window when ranks are taken.
RANK_ROWS = 512
#: Distinct words whose ids a task keeps, and those of them that stay for the worker's
#: next task: the first it met, which are mostly frequent ones.
CACHE_WORDS = 1_200_000
KEPT_WORDS = 60_000
CACHE_CHARS = 200
#: Words encoded at once.
JOINT_WORDS = 4000
_TWO_WHITE = re.compile(r"\s\s")
_BORDER = re.compile(r"(?<=\S)(?=[ \n])")
_state: dict = {}


def _tokenizer(spec: str):
    if _state.get("spec") != spec:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(spec)
        t.encode_special_tokens = True
        _state.update(spec=spec, tok=t, cache={}, old={})
    return _state["tok"], _state["cache"]


def words_of(text: str) -> list[str]:
    """The text cut before spaces (and, where white space repeats, line ends) that follow
    a non-space character; the split pattern of byte-level BPE never crosses there."""
    if _TWO_WHITE.search(text):
        return _BORDER.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]


def encode_words(tok, words: list[str]) -> list[bytes]:
    """Ids of each word as little-endian 32-bit numbers.  Words are encoded many at a
    time, a line feed after each: a line feed without white space beside it is a match of
    its own in the split pattern, so the words' ids lie between the line feeds' ids."""
    mark = tok.encode("\n", add_special_tokens=False).ids
    out: list[bytes | None] = [None] * len(words)
    joint = [i for i, w in enumerate(words) if w and not w[-1].isspace() and (w[0] == " " or not w[0].isspace()) and not _TWO_WHITE.search(w)] if len(mark) == 1 else []
    for a in range(0, len(joint), JOINT_WORDS):
        part = joint[a:a + JOINT_WORDS]
        text = "\n".join([words[i] for i in part]) + "\n"
        ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(ids == mark[0])
        lines = np.array([words[i].count("\n") + 1 for i in part])
        if len(at) != lines.sum():
            continue
        ends = at[np.cumsum(lines) - 1]
        raw = ids.tobytes()
        start = 0
        for i, e in zip(part, ends.tolist()):
            out[i] = raw[4 * start:4 * e]
            start = e + 1
    rest = [i for i, b in enumerate(out) if b is None]
    for a in range(0, len(rest), 2000):
        part = rest[a:a + 2000]
        for i, e in zip(part, tok.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
    return out


def ids_of(texts: list[str], spec: str) -> list[np.ndarray]:
    """Ids of each text.  Words are encoded once per worker by the tokenizers library."""
    tok, cache = _tokenizer(spec)
    cut = [words_of(t) if t else [] for t in texts]
    old = _state["old"]
    if len(cache) > CACHE_WORDS // 2:  # the older half goes; words still in use move on
        old, cache = cache, {}
        _state.update(old=old, cache=cache)
    fresh = set().union(*cut).difference(cache)
    again = fresh & old.keys()
    cache.update(zip(again, map(old.__getitem__, again)))
    fresh = list(fresh - again)
    cache.update(zip(fresh, encode_words(tok, fresh)))
    out = [np.frombuffer(b"".join(map(cache.__getitem__, ws)), dtype="<u4") for ws in cut]
    for w in fresh:
        if len(w) > CACHE_CHARS:  # long runs without a space are not worth keeping
            del cache[w]
    return out


def trim_cache() -> None:
    """Leave only a small cache in the worker, which other stages use next."""
    words = _state["old"] or _state["cache"]
    _state.update(cache=dict(islice(words.items(), KEPT_WORDS)), old={})
    give_back()


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked for): each
    document's ids and the end id, cut at the capacity."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        try:
            yield from encoded(batches)
        finally:
            if "cache" in _state:
                trim_cache()

    def encoded(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                r = b.slice(a, 1024)
                out: list[list] = [[] for _ in names]
                for key_, ids in zip(r.column(0).to_pylist(), ids_of([t or "" for t in r.column(1).to_pylist()], spec.value)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[s:e]
                        row = [key_, k, s, e - s, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])]
                        for c, v in zip(out, row):
                            c.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return two_columns(docs, key, text).mapInArrow(run, schema)


def _two_for_one(counts: np.ndarray, gap: int, better_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum that is at most ``gap`` and over
    ``better_than``; of equal sums the one with the longest document."""
    have = np.flatnonzero(counts[:gap + 1])
    have = have[have > 0]
    if len(have) == 0:
        return None
    at = np.searchsorted(have, gap - have, side="right") - 1
    ok = at >= 0
    other = have[np.maximum(at, 0)]
    # one document cannot be used twice
    twice = ok & (other == have) & (counts[have] < 2)
    lower = np.maximum(at - 1, 0)
    ok &= ~(twice & (at < 1))
    other = np.where(twice, have[lower], other)
    total = np.where(ok, have + other, 0)
    best = int(total.max())
    if best <= better_than:
        return None
    k = np.flatnonzero(total == best)[-1]
    return int(have[k]), int(other[k])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """``(length -> times in the bin, number of such bins)``; the bins use up the
    histogram exactly."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        counts[length] += n
    out: list[tuple[dict[int, int], int]] = []
    while counts.any():
        left, bin_ = counts.copy(), []
        room = capacity
        while room:  # greedy: the largest that fits
            fit = np.flatnonzero(left[:room + 1])
            if len(fit) == 0:
                break
            length = int(fit[-1])
            take = int(min(left[length], room // length))
            bin_ += [length] * take
            left[length] -= take
            room -= take * length
        if room and len(bin_) > 1:  # two for the smallest
            small = bin_[-1]
            two = _two_for_one(left, room + small, small)
            if two:
                left[small] += 1
                bin_[-1:] = two
                for length in two:
                    left[length] -= 1
        need: dict[int, int] = {}
        for length in sorted(bin_, reverse=True):
            need[length] = need.get(length, 0) + 1
        times = int(min(counts[length] // n for length, n in need.items()))
        for length, n in need.items():
            counts[length] -= n * times
        out.append((need, times))
    return out


def deal(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows ``(first rank, times in the bin, first sequence, offset)``."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    first = 0
    for need, times in bins:
        offset = 0
        for length, n in need.items():
            rows.setdefault(length, []).append((used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to
    ``capacity``.  ``items`` is read twice and should be a stored table."""
    spark = items.sparkSession
    histogram = {int(r["length"]): r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = spark.sparkContext.broadcast(deal(plan(histogram, capacity)))
    parts = -(-max(histogram.values(), default=1) // RANK_ROWS)
    rows = items.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_part", (F.sum("_n").over(
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))
    ranked = ranked.select(*items.columns, F.col("_rank").cast("long").alias("_rank"))
    names = items.columns

    def run(batches):
        for b in batches:
            t = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            length, rank = t["length"].to_numpy(zero_copy_only=False), t["_rank"].to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                rows_ = dealt.value[int(k)]
                row = rows_[np.searchsorted(rows_[:, 0], rank[at], side="right") - 1]
                past = rank[at] - row[:, 0]
                seq[at] = row[:, 2] + past // row[:, 1]
                off[at] = row[:, 3] + past % row[:, 1] * k
            yield pa.RecordBatch.from_arrays([*(t[n] for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.
    Texts are tokenized once; the pieces (numbers only) are stored in the shared folder."""
    return pack(stored(pieces(docs, tokenizer_file, capacity, end_id)), capacity)
