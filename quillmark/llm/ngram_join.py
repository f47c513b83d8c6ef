"""N-gram Jaccard join by parity sketches (operator 9).

A text's set holds the 64-bit hashes of its distinct word shingles.  Two texts are linked
when ``100 * |A & B| >= percent * |A | B|``, so at most ``D`` shingles differ, where ``D``
follows from the sizes.  Sizes fall into bands (``Bands``); a text is compared in its own
band and, if it is short enough to have partners there, in the band below.

* Pigeonhole: a band splits the shingles by hash into more parts than may differ, and a
  part's key is the XOR of its shingles' hashes, so linked texts share the key of at least
  one part that is not empty.  A text with more empty parts than the band has spare parts
  also gives keys for those, and one family of keys with all shingles (below).
* Shingles that are frequent in a bounded sample are left out of the keys.  Taking the
  same shingles from both sets cannot raise the number that differ, so no link is lost;
  it keeps a common line from making one group of all texts that hold it.
* Keys travel as sorted packed arrays, one per task and shard.  Small groups of equal
  keys give all their pairs; larger ones pairs with a few pivots, the same ones in every
  group, and their member list.
* Candidate pairs are tested on parity sketches: bit vectors with one flip per shingle,
  whose Hamming distance is at most the number of shingles that differ.  The pairs left
  are verified on the whole sets.
* Groups whose members are then in one component are settled.  In the others the members
  outside the largest component are compared, by sketch, with all members in other
  components, in blocks; what passes is verified too.  So every linked pair is either
  verified or inside a verified component, and large groups never give all their pairs.

Defined results: equal sets are one node (its smallest id); null, empty and wordless
texts have size 0 and link with nothing; texts with fewer words than a shingle have one
shingle, the whole sequence; rows that share an id are one node, linked if any of their
texts is; rows with a null id get no component; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, binary, mix, shuffle_partitions, slices, stored, two_columns, word_hashes
from .components import components

#: Members up to which a group of equal keys gives all its pairs; pivots beyond.
ALL_PAIRS = 5
PIVOTS = 4
#: Members of a task's group from which only its pivots go to the shard.
HOT = 1024
#: Rows of a block when the members of a group are compared.
BLOCK = 1024
#: Documents of the sample that frequent shingles are taken from, their share, their most.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 20_000, 0.001, 65_536
#: Documents and keys of one packed array.
PACK_DOCS, PACK_KEYS = 60_000, 3_000_000
#: Candidate documents up to which their ids are broadcast to the scan.
BROADCAST_IDS = 2_000_000


class Bands:
    """Size bands for a threshold in percent: starts, parts and spare parts."""

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent = percent
        first = 1
        while self.differ(first, first + 1) == 0 and self.differ(first, first) == 0:
            first += 1
        self.starts = [first]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * ratio)))
        self.parts, self.spare = [], []
        for a, b in zip(self.starts, self.starts[1:]):
            top = b - 1
            need = self.differ(top, self.longest(top)) + 1
            spare = 2
            for _ in range(4):
                spare = int(np.ceil(1.5 * (need + spare) * np.exp(-a / (need + spare)))) + 2
                spare = min(spare, need + 2)
            self.parts.append(need + spare)
            self.spare.append(spare)

    def differ(self, a: int, b: int) -> int:
        """Most elements that may differ between linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def longest(self, a: int) -> int:
        return 100 * a // self.percent

    def of(self, n: int) -> list[int]:
        """Bands in which a set of this size is compared."""
        if n < self.starts[0]:
            return []
        k = int(np.searchsorted(self.starts, n, side="right")) - 1
        return [k - 1, k] if k and n <= self.longest(self.starts[k] - 1) else [k]

    def bits(self, n: int) -> int:
        """Bits of the parity sketch of a set of this size."""
        return 1 << max(7, int(np.ceil(np.log2(max(n, 1) * 3))))


@lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int):
    """Sorted distinct shingle hashes of every row."""
    h, first = word_hashes(data, off)
    bounds = np.append(first[1:], len(h)) if len(first) else first
    s = np.zeros(len(h), np.uint64)
    n = len(h)
    for k in range(min(words, n)):
        part = mix(h + U64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        s[:n - k] += part[k:] if k else part
    s = mix(s)
    for a, z in zip(first[:-1].tolist(), bounds[:-1].tolist()):
        if z - a >= words:
            yield np.unique(s[a:z - words + 1])
        elif z > a:
            # no shingle: the whole sequence, marked by its length
            place = mix(np.arange(z - a, dtype=np.uint64) + U64(1 << 32) + U64(z - a))
            yield mix(mix(h[a:z] ^ place).sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), mix(s + U64(0x1234567)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def parity_sketch(s: np.ndarray, bits: int) -> bytes:
    at = (mix(s ^ U64(0xC0FFEE)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A parity sketch of fewer bits: halves are XORed."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _family(s: np.ndarray, band: int, parts: int, spare: int, salt: int, empties: bool) -> tuple[np.ndarray, int]:
    part = (mix(s + U64(0x77777)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part, minlength=parts)
    full = np.flatnonzero(sizes)
    none = parts - len(full)
    keys = np.zeros(0, np.uint64)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        parity = np.bitwise_xor.reduceat(mix(s[order]), first)
        keys = mix(parity ^ mix(full.astype(np.uint64) + U64((band << 32) + (salt << 60))))
    if empties and none > spare:
        bare = np.flatnonzero(sizes == 0).astype(np.uint64)
        keys = np.concatenate([keys, mix(bare + U64((band << 32) + (salt << 60) + (1 << 59)))])
    return keys, none


def part_keys(s: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """Keys of a set in all its bands."""
    b = bands(percent)
    out = []
    rare = s if not len(frequent) else s[~np.isin(s, frequent, assume_unique=True)] if len(s) < 4096 else np.setdiff1d(s, frequent, assume_unique=True)
    for k in b.of(len(s)):
        keys, none = _family(rare, k, b.parts[k], b.spare[k], 0, False)
        out.append(keys)
        if none > b.spare[k]:
            out.append(_family(s, k, b.parts[k], b.spare[k], 1, True)[0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# -- tables of sets ---------------------------------------------------------------------

def set_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n, h1, h2, sketch`` of every row."""
    b = bands(percent)

    def run(batches):
        for batch in batches:
            for a, z, data, off in slices(batch):
                n, h1, h2, sk = [], [], [], []
                for s in shingle_sets(data, off, words):
                    x, y = set_hash(s)
                    n.append(len(s))
                    h1.append(x)
                    h2.append(y)
                    sk.append(parity_sketch(s, b.bits(len(s))) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sk, pa.binary())],
                                                 ["doc_id", "n", "h1", "h2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch binary")


def frequent_shingles(docs: DataFrame, words: int, n_docs: int) -> np.ndarray:
    """Shingles in more than ``FREQUENT`` of a sample of about ``SAMPLE_DOCS`` texts.
    Any list would keep the join whole; this one keeps the groups small."""
    share = min(1.0, SAMPLE_DOCS / max(n_docs, 1))
    least = max(8, int(FREQUENT * min(n_docs, SAMPLE_DOCS)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for _, _, data, off in slices(batch):
                held += list(shingle_sets(data, off, words))
        if held:
            s, c = np.unique(np.concatenate(held), return_counts=True)
            s, c = s[c > 1], c[c > 1]  # a shingle seen once by a task is not frequent
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c)], ["s", "c"])

    found = sample.mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    rows = found.orderBy(F.col("c").desc(), "s").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["s"] for r in rows], dtype=np.int64).view(np.uint64))


# -- packed keys ------------------------------------------------------------------------

LOW = U64((1 << 40) - 1)


def _shard(key, shards: int):
    return (key >> U64(40)) % U64(shards)


def _hot_gid(low: int, shard: int) -> int:
    """Group of a hot key, the same wherever its members are found."""
    return int(low) | shard << 40


def _packed(key: np.ndarray, doc: np.ndarray, hot: np.ndarray, shards: int):
    """``(shard, payload)``: entries sorted by key, documents as places in a list."""
    shard = _shard(key, shards)
    order = np.lexsort((key, shard))
    key, doc, hot, shard = key[order], doc[order], hot[order], shard[order]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    z = zstandard.ZstdCompressor(level=1)
    for a, b in zip(cut, cut[1:]):
        ids, at = np.unique(doc[a:b], return_inverse=True)
        small = key[a:b] & LOW
        head = np.array([b - a, len(ids)], dtype=np.int64)
        yield int(shard[a]), b"".join([binary(head), binary((small & U64(0xFFFFFFFF)).astype(np.uint32)), binary((small >> U64(32)).astype(np.uint8)),
                                       binary(at.astype(np.uint16)), binary(np.packbits(hot[a:b])), z.compress(binary(np.diff(ids, prepend=0)))])


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, d = np.frombuffer(payload, np.int64, 2)
    p = 16
    low = np.frombuffer(payload, np.uint32, n, p)
    high = np.frombuffer(payload, np.uint8, n, p + 4 * n)
    at = np.frombuffer(payload, np.uint16, n, p + 5 * n)
    hot = np.unpackbits(np.frombuffer(payload, np.uint8, -(-n // 8), p + 7 * n))[:n].astype(bool)
    ids = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[p + 7 * n + -(-n // 8):]), np.int64))
    return low.astype(np.uint64) | high.astype(np.uint64) << U64(32), ids[at], hot


def _pivots(doc: np.ndarray) -> np.ndarray:
    """The members that come first in an order that is the same in all groups."""
    return doc[np.argsort(mix(doc.astype(np.uint64)), kind="stable")[:PIVOTS]]


def key_blocks(docs: DataFrame, words: int, percent: int, frequent, shards: int) -> DataFrame:
    """``shard, payload`` with the keys of all sets; rows with equal sets in a task give
    theirs once.  A group of a task that is hot gives ``u, v`` pairs and ``gid, doc`` members
    at once and only its pivots to the shard."""
    def flush(keys, ids):
        key, doc = np.concatenate(keys), np.repeat(np.array(ids, dtype=np.int64), [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        hot = np.zeros(len(key), bool)
        drop = np.zeros(len(key), bool)
        us, vs, gs, ms = [], [], [], []
        for i in np.flatnonzero(np.diff(cut) > HOT):
            a, b = cut[i], cut[i + 1]
            members = np.unique(doc[a:b])
            pivots = _pivots(members)
            for p in pivots:
                us.append(np.full(len(members), p))
                vs.append(members)
            gs.append(np.full(len(members), _hot_gid(key[a] & LOW, int(_shard(key[a], shards))), dtype=np.int64))
            ms.append(members)
            stay = np.isin(doc[a:b], pivots)
            drop[a:b], hot[a:b] = ~stay, stay
        for s, payload in _packed(key[~drop], doc[~drop], hot[~drop], shards):
            yield row(shard=[s], payload=[payload])
        if us:
            yield row(u=np.concatenate(us), v=np.concatenate(vs))
            yield row(u=np.concatenate(gs), v=np.concatenate(ms), kind=1)

    def row(shard=None, payload=None, u=None, v=None, kind=0):
        n = len(shard if shard is not None else u)
        none = [None] * n
        if shard is None:  # spread over the shards
            shard = (mix(v.astype(np.uint64)) % U64(shards)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(payload or none, pa.binary()), pa.array([kind] * n, pa.int32()),
                                           pa.array(u if u is not None else none, pa.int64()), pa.array(v if v is not None else none, pa.int64())], ["shard", "payload", "kind", "u", "v"])

    def run(batches):
        keys, ids, seen, size = [], [], set(), 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, z, data, off in slices(batch):
                for i, s in zip(own[a:z], shingle_sets(data, off, words)):
                    if i is None or not len(s):
                        continue
                    same = (len(s), *set_hash(s))
                    if same in seen:
                        continue
                    k = part_keys(s, percent, frequent.value)
                    if len(k):
                        seen.add(same)
                        keys.append(k)
                        ids.append(i)
                        size += len(k)
                    if len(ids) >= PACK_DOCS or size > PACK_KEYS:
                        yield from flush(keys, ids)
                        keys, ids, seen, size = [], [], set(), 0
        if ids:
            yield from flush(keys, ids)

    return docs.mapInArrow(run, "shard int, payload binary, kind int, u long, v long")


def _groups(batches):
    """Pairs (kind 0) and members (kind 1) from the packed arrays of whole shards."""
    def done(parts, shard):
        key, doc, hot = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key, doc, hot = key[order], doc[order], hot[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(cut)
        us, vs, gs, ms, known = [], [], [], [], set()
        for size in range(2, ALL_PAIRS + 1):  # all pairs of small groups
            at = cut[:-1][sizes == size]
            for i in range(size):
                for j in range(i + 1, size):
                    us.append(doc[at + i])
                    vs.append(doc[at + j])
        small = np.flatnonzero((sizes > 1) & (sizes <= ALL_PAIRS))
        for i in small[np.logical_or.reduceat(hot, cut[:-1])[small]] if len(small) else []:
            a, b = cut[i], cut[i + 1]
            gs.append(np.full(b - a, _hot_gid(key[a], shard), dtype=np.int64))
            ms.append(doc[a:b])
        for i in np.flatnonzero(sizes > ALL_PAIRS):
            a, b = cut[i], cut[i + 1]
            members = np.unique(doc[a:b])
            is_hot = hot[a:b].any()
            gid = _hot_gid(key[a], shard) if is_hot else int(mix(members.astype(np.uint64)).sum(dtype=np.uint64).astype(np.int64))
            if gid in known:  # the same members as a group before
                continue
            known.add(gid)
            for p in _pivots(members):
                us.append(np.full(len(members), p))
                vs.append(members)
            gs.append(np.full(len(members), gid, dtype=np.int64))
            ms.append(members)
        for kind, x, y in ((0, us, vs), (1, gs, ms)):
            if x:
                x, y = np.concatenate(x).astype(np.int64), np.concatenate(y)
                if kind == 0:  # pivots first
                    turn = mix(x.astype(np.uint64)) > mix(y.astype(np.uint64))
                    x, y = np.where(turn, y, x), np.where(turn, x, y)
                    x, y = x[x != y], y[x != y]
                both = np.unique(np.stack([x, y], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), kind, np.int32)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["kind", "u", "v"])

    shard, parts = None, []
    for b in batches:
        ready = b.filter(b.column(1).is_null())
        if ready.num_rows:
            yield ready.select([2, 3, 4])
        b = b.filter(b.column(1).is_valid())
        for s, payload in zip(b.column(0).to_pylist(), b.column(1)):
            if s != shard and parts:
                yield from done(parts, shard)
                parts = []
            shard = s
            parts.append(_unpacked(payload.as_py()))
    if parts:
        yield from done(parts, shard)


# -- verification -----------------------------------------------------------------------

def _by_sketch(batches, percent):
    """Keeps the rows ``u, v, nu, nv, su, sv`` that may be linked."""
    b_ = bands(percent)
    for b in batches:
        n = [b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
        ok = 100 * np.minimum(*n) >= percent * np.maximum(*n)
        for i in np.flatnonzero(ok):
            x, y = (np.frombuffer(b.column(j)[int(i)].as_buffer(), np.uint64) for j in (4, 5))
            w = min(len(x), len(y))
            ok[i] = int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()) <= b_.differ(int(n[0][i]), int(n[1][i]))
        yield b.select([0, 1]).filter(pa.array(ok))


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``u, v`` of ``pairs`` (distinct, ``u`` with few values) that are linked, from
    their whole texts.  The sets of a hot ``u``'s partners go to salted groups."""
    pairs = stored(pairs)
    ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text")

    def sets(batches):
        for batch in batches:
            for a, z, data, off in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array([binary(s) for s in shingle_sets(data, off, words)], pa.binary())], ["doc_id", "items"])

    salts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_salts"))
    dealt = pairs.join(salts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("_salts")).alias("salt"))
    need = dealt.select("u", "salt", F.col("v").alias("doc_id"), F.lit(1).alias("role")).union(dealt.select("u", "salt", F.col("u").alias("doc_id"), F.lit(0).alias("role")).distinct())
    rows = need.join(texts.mapInArrow(sets, "doc_id long, items binary"), "doc_id").select("u", "salt", "role", "doc_id", "items")

    def run(batches):
        group, heads = None, []
        for b in batches:
            us, vs = [], []
            for u, salt, role, doc, items in zip(*[b.column(i).to_pylist() if i < 4 else b.column(i) for i in range(5)]):
                s = np.frombuffer(items.as_buffer(), np.uint64)
                if (u, salt) != group:
                    group, heads = (u, salt), []
                if role == 0:
                    heads.append(s)
                    continue
                for h in heads:
                    if 100 * min(len(s), len(h)) < percent * max(len(s), len(h)):
                        continue
                    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                    same = int((h[at] == s).sum()) if len(h) else 0
                    if same and 100 * same >= percent * (len(s) + len(h) - same):
                        us.append(u)
                        vs.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    n = shuffle_partitions(docs.sparkSession)
    return rows.repartition(n, "u", "salt").sortWithinPartitions("u", "salt", "role").mapInArrow(run, "u long, v long")


def _sketch_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    x = nodes.select(F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    y = nodes.select(F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(lambda b: _by_sketch(b, percent), "u long, v long").distinct()


def _unsettled(members: DataFrame, comps: DataFrame, nodes: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs ``u, v`` in different components that share a group and pass the sketch."""
    m = members.join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").select("gid", "doc", F.coalesce("component", "doc").alias("component"))
    sizes = m.groupBy("gid", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("gid").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1")
    open_ = open_.select("gid", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"), F.col("top.component").alias("major"))
    rows = m.join(open_, "gid").withColumn("minor", F.col("component") != F.col("major")).withColumn("home", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # the few outside the largest component meet every block, the rest their own
    to = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))
    rows = rows.withColumn("block", F.explode(to)).join(nodes.select(F.col("doc_id").alias("doc"), "n", "sketch"), "doc")
    rows = rows.select("gid", "block", "doc", "component", "minor", "n", "sketch")

    def run(batches):
        group, held = None, []
        for b in batches:
            for r in zip(*[b.column(i).to_pylist() if i < 6 else b.column(i) for i in range(7)]):
                if r[:2] != group:
                    if held:
                        yield _cross(held, percent)
                    group, held = r[:2], []
                held.append((*r[2:6], np.frombuffer(r[6].as_buffer(), np.uint64)))
        if held:
            yield _cross(held, percent)

    return rows.repartition(n, "gid", "block").sortWithinPartitions("gid", "block").mapInArrow(run, "u long, v long").distinct()


def _cross(held: list, percent: int) -> pa.RecordBatch:
    b_ = bands(percent)
    doc, comp, minor, n = (np.array(x) for x in list(zip(*held))[:4])
    us, vs = [], []
    order = np.argsort(n, kind="stable")
    doc, comp, minor, n = doc[order], comp[order], minor[order], n[order]
    sk = [held[i][4] for i in order]
    for i in np.flatnonzero(minor):
        lo = int(np.searchsorted(n, -(-percent * n[i] // 100)))
        hi = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        at = np.arange(lo, hi)
        at = at[comp[lo:hi] != comp[i]]
        if not len(at):
            continue
        w = min(len(sk[i]), min(len(sk[j]) for j in (at[0], at[-1])))
        x = fold(sk[i], w)
        y = np.stack([fold(sk[j], w) for j in at])
        far = np.bitwise_count(x ^ y).sum(1)
        most = (n[at] + n[i]) * (100 - percent) // (100 + percent)
        for j in at[far <= most]:
            us.append(min(doc[i], doc[j]))
            vs.append(max(doc[i], doc[j]))
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


# -- the join ---------------------------------------------------------------------------

def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = docs.sparkSession
    docs = two_columns(docs, key, text)
    n = shuffle_partitions(spark)
    table = stored(set_table(docs, words, percent))
    classes = table.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    owner = stored(table.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left").select("doc_id", "n", "rep"))
    reps = owner.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    nodes = table.where("n > 0 and doc_id is not null").select("doc_id", "n", "sketch")

    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, words, table.count()))
    found = key_blocks(docs, words, percent, frequent, n).repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_groups, "kind int, u long, v long")
    found = stored(found.distinct())

    def on_reps(df, col):
        return df.join(reps.select(F.col("doc_id").alias(col), F.col("rep").alias("_rep")), col).drop(col).withColumnRenamed("_rep", col)

    pairs = on_reps(on_reps(found.where("kind = 0").select("u", "v"), "u"), "v").select("u", "v").where("u <> v").distinct()
    members = stored(on_reps(found.where("kind = 1").select(F.col("u").alias("gid"), F.col("v").alias("doc")), "doc").select("gid", "doc").distinct())
    # rows that share an id are one node
    same_id = owner.where("rep is not null and doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = stored(verified(_sketch_pairs(pairs, nodes, percent), docs, words, percent))
    comps = stored(components(links))
    more = stored(_unsettled(members, comps, nodes, percent, n))
    if not more.isEmpty():
        links = links.union(stored(verified(more, docs, words, percent)))
    comps = components(links.union(same_id))
    out = owner.join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
