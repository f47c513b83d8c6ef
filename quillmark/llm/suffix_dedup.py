"""Suffix-array dedup of byte strings (operator 2).

A byte goes if it lies in a ``window``-byte string that also starts in a document with a
smaller id.  In terms of longest previous factors: order all suffixes; the longest match
of a suffix with an earlier document is with the nearest suffix before or behind it in
suffix order that has a smaller document (previous and next smaller value); the window at
a position goes if that match is at least ``window`` long.

The suffix order is never built in one place:

* Anchors.  Of every window the 16-byte gram with the smallest hash is an anchor, so equal
  windows have an anchor at the same place, and about one byte in 18 is one.
* Filter.  Tasks send the hashes of their anchors' grams to shards, packed and each once;
  grams found in two documents set a bit.  The bit table has a fixed largest size
  (``FILTER_BITS``): a full one only lets more anchors through.
* Suffix order of a shard.  Anchors that pass travel, with the bytes that windows around
  them can hold and each such context once a task, to the shard of their gram.  There the
  suffixes that start ``o`` bytes before the anchors are put in order, those of one ``o``
  from those of the one before by their first byte, with the LCPs of neighbours; previous
  and next smaller documents give each its longest previous factor, counted up to
  ``window``, and the window goes if that reaches it.
* All windows with an anchor contain it, so an anchor's removed windows join to one span;
  spans go back to their documents, packed by buckets of documents.

Defined results: null is the empty text; texts shorter than the window stay; equal texts
with one id remove nothing from each other; rows with a null id stay and remove nothing;
repeated rows are kept, one result each; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, U64, binary, give_back, mix, plain_names, quoted, run_hashes, shuffle_partitions, slices, string_buffers

WINDOW = 50
GRAM = 16
#: Bytes handled at once; entries of a packed array; contexts sorted at once.
BLOCK, PACK, SORT = 1 << 19, 1_500_000, 60_000
#: Bytes of contexts that a task brings together before it sends them.
CONTEXT_BYTES = 12 << 20
FILTER_BITS = 29
ROUNDS = 24  # of jumps between candidates before the pass with a stack


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[:k - w], x[w - k:]) if w > k else x


def _gram_hashes(d: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes at every place."""
    m = len(d)
    w = np.empty(m - 7, np.uint64)
    for r in range(8):
        v = np.frombuffer(d[r:], "<u8", (m - r) // 8)
        w[r::8] = v
    h = w[:m - 15] * U64(0x9E3779B97F4A7C15) + w[8:m - 7] * U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def anchors(data: np.ndarray, off: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all rows; no window crosses rows."""
    span = window - GRAM + 1
    places, hashes = [], []
    n = len(data)
    for a in range(0, max(n - window + 1, 0), BLOCK):
        d = np.ascontiguousarray(data[a:min(n, a + BLOCK + window - 1)])
        h = _gram_hashes(d)
        o = (h >> U64(32)).astype(np.uint32) | np.uint32(1)
        low = _slide(o, span, np.minimum)  # by window
        edge = np.zeros(len(d) + 1, np.int32)
        edge[off[np.searchsorted(off, a + 1):np.searchsorted(off, a + len(d))] - a] = 1
        seen = np.cumsum(edge)
        low[seen[window - 1:window - 1 + len(low)] != seen[:len(low)]] = 0
        pad = np.zeros(span - 1, np.uint32)
        top = _slide(np.concatenate([pad, low, pad]), span, np.maximum)
        at = np.flatnonzero(top == o[:len(top)])
        places.append(at + a)
        hashes.append(mix(h[at]))  # anchors have small hashes; shards and bits need even ones
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 1:
        p, first = np.unique(p, return_index=True)
        h = h[first]
    return p, h


class _Layout:
    """Shards by the upper bits of a gram hash; bits of the filter below them."""

    def __init__(self, partitions: int, n_bytes: int):
        self.shard_bits = max(4, 2 + int(np.ceil(np.log2(max(partitions, 1)))))  # several shards a task
        self.bits = int(np.clip(np.ceil(np.log2(n_bytes / 9 + 1)), self.shard_bits + 8, FILTER_BITS))

    def shard(self, h):
        return (h >> U64(64 - self.shard_bits)).astype(np.int64)

    def rest(self, h):
        return ((h >> U64(32 - self.shard_bits)) & U64(0xFFFFFFFF)).astype(np.uint32)

    def bit(self, h):
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def bit_in_shard(self, rest):
        return rest >> np.uint32(32 - (self.bits - self.shard_bits))


def shared_grams(docs: DataFrame, layout: _Layout, partitions: int, window: int) -> np.ndarray:
    """Bit table of the grams that are anchors in two documents (or hash like one)."""
    def flush(h, doc):
        h, doc = np.concatenate(h), np.concatenate(doc)
        order = np.argsort(h, kind="stable")  # documents ascend within equal grams
        h, doc = h[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = doc[cut] != doc[np.append(cut[1:], len(h)) - 1]
        h = h[cut]
        shard = layout.shard(h)
        ends = np.searchsorted(shard, np.arange((1 << layout.shard_bits) + 1))
        for s in range(1 << layout.shard_bits):
            a, b = ends[s], ends[s + 1]
            if a < b:
                rest = layout.rest(h[a:b])
                yield s, binary(np.array([(~many[a:b]).sum()], np.int64)) + binary(rest[~many[a:b]]) + binary(rest[many[a:b]])

    def send(batches):
        hs, ds, n, seen = [], [], 0, 0
        for batch in batches:
            for a, z, data, off in slices(batch):
                p, h = anchors(data, off, window)
                hs.append(h)
                ds.append(seen + a + np.searchsorted(off, p, side="right"))
                n += len(p)
                if n > PACK:
                    rows = list(flush(hs, ds))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "payload"])
                    hs, ds, n = [], [], 0
                    give_back()
            seen += batch.num_rows
        if n:
            rows = list(flush(hs, ds))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "payload"])

    def bits(shard, once, many):
        rest, c = np.unique(np.concatenate(once), return_counts=True)
        table = np.zeros(1 << (layout.bits - layout.shard_bits), np.uint8)
        table[layout.bit_in_shard(rest[c > 1])] = 1
        table[layout.bit_in_shard(np.concatenate(many))] = 1
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], ["shard", "payload"])

    def gather(batches):
        shard, once, many = None, [], []
        for b in batches:
            for s, payload in zip(b.column(0).to_pylist(), b.column(1)):
                if s != shard and once:
                    yield bits(shard, once, many)
                    once, many = [], []
                shard = s
                raw = payload.as_buffer()
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                once.append(np.frombuffer(raw, np.uint32, n, 8))
                many.append(np.frombuffer(raw, np.uint32, -1, 8 + 4 * n))
        if once:
            yield bits(shard, once, many)

    schema = "shard int, payload binary"
    rows = docs.select("text").mapInArrow(send, schema).repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(gather, schema).collect()
    size = 1 << (layout.bits - layout.shard_bits) >> 3
    table = np.zeros((1 << layout.shard_bits) * size, np.uint8)
    for r in rows:
        table[r["shard"] * size:(r["shard"] + 1) * size] = np.frombuffer(r["payload"], np.uint8)
    return table


def _contexts(data: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray, window: int):
    """The bytes around anchors: ``window - GRAM`` before, ``window`` from them on; zero
    outside the row; how many before and from them on lie in the row."""
    before = window - GRAM
    left, right = np.minimum(before, p - start), np.minimum(window, end - p)
    at = p[:, None] + np.arange(-before, window)
    c = data[np.clip(at, 0, len(data) - 1)]
    c[np.arange(-before, window)[None, :] < -left[:, None]] = 0
    c[np.arange(-before, window)[None, :] >= right[:, None]] = 0
    return c, left.astype(np.uint8), right.astype(np.uint8)


def _context_blocks(docs: DataFrame, layout: _Layout, table, window: int) -> DataFrame:
    """``shard, payload``: contexts (each once), entries that have them, documents."""
    wide = 2 * window - GRAM
    press = _Press()

    def pack(c, left, right, h, doc, place, ids, texts, buckets):
        shard = layout.shard(h)
        same = run_hashes_in_blocks(c, wide) ^ mix(left.astype(np.uint64) << U64(8) | right)
        order = np.lexsort((same, h))
        ends = np.searchsorted(shard[order], np.arange((1 << layout.shard_bits) + 1))
        out = []
        for s in range(1 << layout.shard_bits):
            at = order[ends[s]:ends[s + 1]]
            if not len(at):
                continue
            new = np.concatenate([[True], (same[at][1:] != same[at][:-1]) | (h[at][1:] != h[at][:-1])])
            first = at[new]
            own, d = np.unique(doc[at], return_inverse=True)
            # contexts lie next to others of their gram, so they compress well
            out.append((s, press.compress(b"".join([
                binary(np.array([len(first), len(at), len(own)], np.int64)), binary(c[first]), binary(left[first]), binary(right[first]),
                binary(new.astype(np.uint8)), binary(d.astype(np.uint32)), binary(place[at].astype(np.int64)),
                binary(ids[own]), binary(texts[own]), binary(buckets[own])]))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["shard", "payload"])

    def send(batches):
        held, ids, texts, buckets, n, rows, batch = [], [], [], [], 0, 0, None

        def done():
            return pack(*[np.concatenate(x) for x in zip(*held)], np.concatenate(ids), np.concatenate(texts), np.concatenate(buckets).astype(np.int32))

        for batch in batches:
            number = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
            for a, z, data, off in slices(batch, "text", SLICE_BYTES // 2):
                p, h = anchors(data, off, window)
                bit = layout.bit(h)
                keep = (table.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
                p, h = p[keep > 0], h[keep > 0]
                row = np.searchsorted(off, p, side="right") - 1
                if len(p):
                    c, left, right = _contexts(data, off[row], off[row + 1], p, window)
                    held.append((c, left, right, h, rows + row, p - off[row]))
                ids.append(number[0][a:z])
                texts.append(number[1][a:z])
                buckets.append(number[2][a:z])
                rows += z - a
                n += len(p)
                if n * wide > CONTEXT_BYTES:
                    yield done()
                    held, ids, texts, buckets, n, rows = [], [], [], [], 0, 0
                    give_back()
        if n:
            yield done()
        del held, batch
        give_back()

    return docs.select("text", "doc_id", "_hash", "_bucket").mapInArrow(send, "shard int, payload binary")


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of byte rows and the LCP of each with the one before."""
    n, w = rows.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{w}").ravel(), kind="stable")
    s = rows[order]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), w)
    return order, np.concatenate([[-1], lcp])


def _nearest_smaller(value: np.ndarray, lcp: np.ndarray, window: int) -> np.ndarray:
    """For every suffix, in suffix order, its match with the nearest suffix before it that
    has a smaller value: the least LCP on the way there, 0 without one.  ``lcp[i]`` is that
    of ``i`` with ``i - 1``.  A way is left as soon as its match is below ``window``.

    Candidates jump to their own candidates: between a candidate and its suffix all values
    are as large as the suffix's, so a candidate that is not smaller passes its own one on."""
    n = len(value)
    at, match = np.arange(-1, n - 1), lcp.copy()
    match[:1] = 0
    active = np.flatnonzero(match >= window)
    active = active[value[at[active]] >= value[active]]
    for _ in range(ROUNDS):
        if not len(active):
            return match
        way = at[active]
        match[active] = np.minimum(match[active], match[way])
        at[active] = at[way]
        active = active[match[active] >= window]  # a candidate of -1 has match 0
        active = active[value[at[active]] >= value[active]]
    # long staircases of values: one pass with a stack over the runs that hold the rest
    run = np.cumsum(lcp < window)
    for i in np.flatnonzero(np.isin(run, np.unique(run[active]))).tolist():
        if lcp[i] < window:
            stack = []
        best = int(lcp[i])
        while stack and stack[-1][0] >= value[i]:
            best = min(best, stack.pop()[1])
        match[i] = best if stack else 0
        stack.append((value[i], best))
    return match


def longest_previous(c: np.ndarray, order: np.ndarray, at: int, smallest: np.ndarray, window: int) -> np.ndarray:
    """The longest previous factors, counted up to ``window``, of the suffixes that start at
    column ``at`` of the contexts ``order``, given in suffix order: the better match of the
    two with the previous and the next suffix of a smaller document."""
    rows = c[order, at:at + window]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), window)
    value = smallest[order]
    before = _nearest_smaller(value, np.concatenate([[0], lcp]), window)
    behind = _nearest_smaller(value[::-1], np.concatenate([[0], lcp[::-1]]), window)[::-1]
    return np.maximum(before, behind)


def removed_offsets(c: np.ndarray, left: np.ndarray, right: np.ndarray, smallest: np.ndarray, entry: np.ndarray, doc: np.ndarray, window: int = WINDOW):
    """For entries (context, document): the largest and smallest ``o`` such that the suffix
    ``o`` bytes before the anchor has a longest previous factor of ``window`` (-1: none).
    ``smallest`` is the smallest document of each context, which its others match wholly.
    The suffix order of an ``o`` follows from that of ``o - 1`` by one stable sort of the
    bytes in front."""
    before = window - GRAM
    order, _ = _order(c[:, before:])
    later = smallest[entry] < doc
    most, least = np.full(len(entry), -1), np.full(len(entry), -1)
    for o in range(before + 1):
        if o:
            order = order[np.argsort(c[order, before - o], kind="stable")]
        own = order[(left[order] >= o) & (right[order] >= window - o)]  # the text holds the window
        if not len(own):
            continue
        holds, found = np.zeros(len(c), bool), np.zeros(len(c), bool)
        holds[own] = True
        found[own] = longest_previous(c, own, before - o, smallest, window) >= window
        gone = holds[entry] & (later | found[entry])
        most[gone] = o
        least[gone & (least < 0)] = o
    return most, least


def _spans_of_shards(batches, window: int):
    """``bucket, payload`` with ``id, text hash, start, end`` of removed spans."""
    wide, before = 2 * window - GRAM, window - GRAM
    press = _Press()

    def solve(parts):
        c, left, right, entry, doc, place, ids, texts, buckets = [], [], [], [], [], [], [], [], []
        nc = nd = 0
        while parts:
            raw = press.decompress(parts.pop())
            k, e, d = np.frombuffer(raw, np.int64, 3)
            p = 24
            for to, kind, n, size in ((c, np.uint8, k * wide, 1), (left, np.uint8, k, 1), (right, np.uint8, k, 1), (entry, np.uint8, e, 1), (doc, np.uint32, e, 4),
                                      (place, np.int64, e, 8), (ids, np.int64, d, 8), (texts, np.int64, d, 8), (buckets, np.int32, d, 4)):
                to.append(np.frombuffer(raw, kind, n, p))
                p += n * size
            entry[-1] = np.cumsum(entry[-1], dtype=np.int64) - 1 + nc
            doc[-1] = doc[-1].astype(np.int64) + nd
            nc, nd = nc + k, nd + d
        c = np.concatenate(c).reshape(-1, wide)
        left, right, entry, doc, place, ids, texts, buckets = (np.concatenate(x) for x in (left, right, entry, doc, place, ids, texts, buckets))
        # contexts by gram, equal ones once
        gram = _gram_ids(c[:, before:before + GRAM])
        same = run_hashes_in_blocks(c, wide) ^ mix(left.astype(np.uint64) << U64(8) | right)
        order = np.lexsort((same, gram))
        new = np.concatenate([[True], (gram[order][1:] != gram[order][:-1]) | (same[order][1:] != same[order][:-1])])
        to = np.empty(len(c), np.int64)
        to[order] = np.cumsum(new) - 1
        first = order[new]
        c, left, right, gram, entry = c[first], left[first], right[first], gram[first], to[entry]
        by = np.argsort(entry, kind="stable")
        entry, doc, place = entry[by], doc[by], place[by]
        own = ids[doc]
        head = np.searchsorted(entry, np.arange(len(c)))
        smallest = np.minimum.reduceat(own, head)
        a = 0
        out = []
        while a < len(c):
            b = min(len(c), a + SORT)
            if b < len(c):  # not inside a gram's contexts
                down = int(np.searchsorted(gram, gram[b - 1], side="left"))
                b = down if down > a else int(np.searchsorted(gram, gram[b - 1], side="right"))
            i, j = head[a], head[b] if b < len(c) else len(entry)
            most, least = removed_offsets(c[a:b], left[a:b], right[a:b], smallest[a:b], entry[i:j] - a, own[i:j], window)
            got = np.flatnonzero(most >= 0)
            at = i + got
            out.append((doc[at], place[at] - most[got], place[at] - least[got] + window))
            a = b
        d, s, e = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((s, d, buckets[d]))
        d, s, e = d[order], s[order], e[order]
        k = buckets[d]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(k))
        return pa.RecordBatch.from_arrays([pa.array(k[cut].astype(np.int32)), pa.array([press.compress(_pack_spans(d[a:b], s[a:b], e[a:b], ids, texts)) for a, b in zip(cut, ends)], pa.binary())], ["bucket", "payload"])

    shard, parts = None, []
    for b in batches:
        for s, payload in zip(b.column(0).to_pylist(), b.column(1)):
            if s != shard and parts:
                yield solve(parts)
                parts = []
                give_back()
            shard = s
            parts.append(payload.as_py())
    if parts:
        yield solve(parts)
    give_back()


class _Press:
    """zstd for packed arrays; made anew in each process."""

    def __reduce__(self):
        return (_Press, ())

    def compress(self, raw: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(raw)

    def decompress(self, raw: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(raw)


def _pack_spans(d, s, e, ids, texts) -> bytes:
    """Spans sorted by document and start: documents with their numbers of spans, then
    distances between starts and lengths."""
    own, n = np.unique(d, return_counts=True)
    return b"".join([binary(np.array([len(own), len(d)], np.int64)), binary(ids[own]), binary(texts[own]), binary(n.astype(np.uint32)),
                     binary(np.diff(s, prepend=0).astype(np.int64)), binary((e - s).astype(np.uint16))])


def _unpack_spans(raw: bytes) -> np.ndarray:
    """Rows id, text hash, start, end."""
    k, n = np.frombuffer(raw, np.int64, 2)
    times = np.frombuffer(raw, np.uint32, k, 16 + 16 * k)
    s = np.cumsum(np.frombuffer(raw, np.int64, n, 16 + 20 * k))
    e = s + np.frombuffer(raw, np.uint16, n, 16 + 20 * k + 8 * n)
    return np.stack([np.repeat(np.frombuffer(raw, np.int64, k, 16), times), np.repeat(np.frombuffer(raw, np.int64, k, 16 + 8 * k), times), s, e])


def _gram_ids(g: np.ndarray) -> np.ndarray:
    """Equal for equal grams only (grams of a shard), ascending order of no meaning."""
    w = np.ascontiguousarray(g).view("<u8")
    pair = np.empty(len(w), dtype=[("a", "<u8"), ("b", "<u8")])
    pair["a"], pair["b"] = w[:, 0], w[:, 1]
    order = np.lexsort((pair["b"], pair["a"]))
    new = np.concatenate([[False], pair[order][1:] != pair[order][:-1]]) if len(w) else np.zeros(0, bool)
    out = np.empty(len(w), np.int64)
    out[order] = np.cumsum(new)
    return out


def run_hashes_in_blocks(c: np.ndarray, wide: int, rows: int = 20_000) -> np.ndarray:
    out = []
    for a in range(0, len(c), rows):
        part = np.ascontiguousarray(c[a:a + rows])
        starts = np.arange(len(part)) * wide
        out.append(run_hashes(part.reshape(-1), starts, starts + wide))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans sorted by start."""
    top = np.maximum.accumulate(e)
    new = np.concatenate([[True], s[1:] > top[:-1]])
    cut = np.flatnonzero(new)
    return list(zip(s[cut].tolist(), top[np.append(cut[1:], len(s)) - 1].tolist()))


def _dealt(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents with ``_hash`` and ``_bucket``, their packed spans, partitions."""
    n = shuffle_partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(n, -(-size // (8 << 20)))
    docs = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    layout = _Layout(n, size)
    real = docs.where("doc_id is not null").where(F.octet_length("text") >= window)
    table = docs.sparkSession.sparkContext.broadcast(shared_grams(real, layout, n, window))
    # many small tasks: a few MB of packed contexts each
    found = _context_blocks(real, layout, table, window).repartition(4 * n, "shard").sortWithinPartitions("shard")
    return docs, found.mapInArrow(lambda b: _spans_of_shards(b, window), "_bucket int, _payload binary"), n


def spans(docs: DataFrame, window: int = WINDOW, columns: list[str] | None = None) -> DataFrame:
    """Every row with ``n_bytes, n_removed, spans array<struct<start, end>>, kept binary``
    (``doc_id`` first).  With ``columns`` those columns of ``docs`` come back instead, with
    ``text`` cut; there a character stays unless all its bytes go."""
    whole = columns is not None
    keep = columns or ["doc_id"]
    if whole:
        docs = plain_names(docs.select(*map(quoted, columns)), ("doc_id", "text"))
        keep = docs.columns
    body = docs.select(*[F.col(c) for c in keep], *([] if whole else [F.col("text").cast("string").alias("text")]))
    names = body.columns
    if whole:
        body = body.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    else:
        body = body.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rest = [c for c in body.columns if c not in ("text", "doc_id")]
    rows, packed, n = _dealt(body, window)
    rows = rows.select("_bucket", F.lit(1).alias("_kind"), F.lit(None).cast("binary").alias("_payload"), "doc_id", "_hash", "text", *rest)
    both = rows.unionByName(packed.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    both = both.repartition(2 * n, "_bucket").sortWithinPartitions("_bucket", "_kind")

    press = _Press()

    def run(batches):
        bucket, parts, at = None, [], None
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                r = batch.slice(a, 512)
                kind = r.column(1).to_numpy()
                own_bucket = r.column(0).to_pylist()
                rows_at = []
                results = []
                ids, hashes = r.column(3).to_pylist(), r.column(4).to_pylist()
                data, off = string_buffers(r.column(5))
                for i in range(r.num_rows):
                    if own_bucket[i] != bucket:
                        bucket, parts, at = own_bucket[i], [], None
                    if kind[i] == 0:
                        parts.append(_unpack_spans(press.decompress(r.column(2)[i].as_py())))
                        continue
                    if at is None:
                        at = _lookup(parts)
                    text = data[off[i]:off[i + 1]]
                    got = at[0].get((ids[i], hashes[i]))
                    cut = _merged(at[1][2][got[0]:got[1]], at[1][3][got[0]:got[1]]) if got else []
                    rows_at.append(i)
                    results.append((text, cut))
                if rows_at:
                    yield out(r, rows_at, results)

    def out(r, rows_at, results):
        if whole:
            texts = [_cut_characters(t, cut) for t, cut in results]
            cols = [r.column(6 + i).take(pa.array(rows_at)) for i in range(len(rest))]
            k = names.index("text")
            text = pa.array(texts, pa.string())
            # a null text stays null
            cols[k] = pa.compute.if_else(pa.compute.is_null(cols[k]), pa.scalar(None, pa.string()), text)
            return pa.RecordBatch.from_arrays(cols, names)
        kept = [_cut(t, cut) for t, cut in results]
        return pa.RecordBatch.from_arrays([r.column(3).take(pa.array(rows_at)), pa.array([len(t) for t, _ in results], pa.int64()),
                                           pa.array([sum(e - s for s, e in cut) for _, cut in results], pa.int64()),
                                           pa.array([[{"start": s, "end": e} for s, e in cut] for _, cut in results], SPANS), pa.array(kept, pa.binary())],
                                          ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    if whole:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    else:
        schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    result = both.select("_bucket", "_kind", "_payload", "doc_id", "_hash", "text", *rest).mapInArrow(run, schema)
    return result.toDF(*columns) if whole else result


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _lookup(parts: list[np.ndarray]):
    if not parts:
        return {}, None
    p = np.concatenate(parts, axis=1)
    p = p[:, np.lexsort((p[2], p[1], p[0]))]
    cut = np.flatnonzero(np.concatenate([[True], (p[0][1:] != p[0][:-1]) | (p[1][1:] != p[1][:-1])]))
    ends = np.append(cut[1:], p.shape[1])
    return {(a, b): (s, e) for a, b, s, e in zip(p[0][cut].tolist(), p[1][cut].tolist(), cut.tolist(), ends.tolist())}, p


def _cut(text: np.ndarray, cut: list[tuple[int, int]]) -> bytes:
    if not cut:
        return text.tobytes()
    raw, out, a = text.tobytes(), [], 0
    for s, e in cut:
        out.append(raw[a:s])
        a = e
    return b"".join([*out, raw[a:]])


def _cut_characters(text: np.ndarray, cut: list[tuple[int, int]]) -> str:
    """Without the characters that lie wholly in the spans."""
    inner = []
    for s, e in cut:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        inner.append((s, e))
    return _cut(text, inner).decode("utf-8")


def digest(out: DataFrame) -> DataFrame:
    """Digest columns of ``spans``."""
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """By definition, for tests: ``n_bytes, n_removed, n_spans, kept_sha256`` by id."""
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - window + 1):
            first.setdefault(texts[i][k:k + window], i)
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if first[t[k:k + window]] < i:
                gone[k:k + window] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out
