"""Subword lattice language model (operator 4).

An existing subword vocabulary gives the pieces and their starting weights; the weight of
a text is the sum over all its segmentations, found by a log-space forward recursion.  A
piece never crosses the start of a word, so a text's lattice is a chain of word lattices
and a word's marginal is computed once per chunk of texts.

* Vocabulary.  Pieces are byte strings, the word mark is a leading space, byte pieces
  cover everything else.  Scores that are log probabilities are used as they are; a
  vocabulary that only ranks its pieces (0, -1, -2, ...) is read as a Zipf law.
* Learning.  Word counts of all training texts are summed in shards (packed arrays, each
  task adds its own first).  Expectation-maximisation over the distinct words fits the
  piece probabilities, with the existing weights as a prior.  What the driver gets is one
  number per piece.
* Words seen in training are arcs of the lattice over the whole word: of a word's count
  ``DISCOUNT`` is taken off, and the mass set free weights the segmentations into pieces.
* Scoring.  One pass over all texts gives each chunk's distinct words and their marginals
  and sends them, with the documents that hold them, to the shards where the counts are;
  the shards' partial sums of the score and of the add-one word baseline return per
  document.

* A text repeats its own words, so its tokens follow a Polya urn that starts with
  ``URN`` tokens of the model above: a token's probability is ``(URN * p + times seen so
  far) / (URN + tokens so far)``, which sums to one and does not depend on the order.

``score`` is the log10 probability of the lower-cased words and the end of text under all
of this, ``lattice_score`` the marginal of the pieces alone; white space between words
only separates them.

Defined results: null and empty texts have the end token only; rows with a null id are
training rows; repeated rows are kept; without training rows the vocabulary's own weights
are used and every count is 0; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _BASE, _BYTE_HASH, LOWER, SLICE_BYTES, U64, WHITE, binary, run_hashes, shuffle_partitions, slices, stored, word_runs

#: Bytes of text whose words are brought together before they are sent.
CHUNK_BYTES = 24 << 20
EM_ROUNDS = 3
#: Pseudo-count of the existing weights.
PRIOR = 200.0
DISCOUNT = 0.75
#: Weight of the corpus model against the text's own words, in tokens.
URN = 1000.0
#: Cells of a block of words in the recursion.
CELLS = 400_000
LN10 = float(np.log(10))


# -- vocabulary and lattice -------------------------------------------------------------

def vocabulary(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes and log weights (normalised) of a sentencepiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found: dict[bytes, float] = {}
    scores = []
    for i in range(sp.get_piece_size()):
        if sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()
        if sp.is_byte(i):
            found.setdefault(raw, None)
        else:
            found[raw] = sp.get_score(i)
            scores.append(sp.get_score(i))
    for b in range(256):
        found.setdefault(bytes([b]), None)
    top = max(scores, default=0.0)
    if len(scores) > 1 and min(scores) < top - 100:  # merge ranks: no log probability is so low
        weights = {p: -np.log(2 + (top - s)) for p, s in found.items() if s is not None}
    else:
        weights = {p: s for p, s in found.items() if s is not None}
    floor = min(weights.values(), default=0.0) - 2
    pieces = sorted(found)
    w = np.array([weights.get(p, floor) for p in pieces])
    return pieces, w - np.logaddexp.reduce(w)


@dataclass
class Lattice:
    pieces: list[bytes]
    logp: np.ndarray        # by piece, natural logarithm
    log_end: float

    def __post_init__(self):
        self.longest = max(map(len, self.pieces))
        self.key = np.array([_piece_hash(p) for p in self.pieces], dtype=np.uint64)
        self.first = np.full(1 << 20, -1, np.int32)
        self.second = np.full(1 << 20, -1, np.int32)
        spare = []
        for i, k in enumerate(self.key.tolist()):
            for table, at in ((self.first, k >> 44), (self.second, k >> 20 & 0xFFFFF)):
                if table[at] < 0:
                    table[at] = i
                    break
            else:
                spare.append(i)
        order = np.argsort(self.key[spare]) if spare else np.zeros(0, np.int64)
        self.spare = np.array(spare, dtype=np.int64)[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 for none."""
        a = self.first[(h >> U64(44)).astype(np.int64)]
        out = np.where((a >= 0) & (self.key[a] == h), a, -1)
        miss = np.flatnonzero(out < 0)
        b = self.second[((h[miss] >> U64(20)) & U64(0xFFFFF)).astype(np.int64)]
        out[miss] = np.where((b >= 0) & (self.key[b] == h[miss]), b, -1)
        if len(self.spare):
            keys = self.key[self.spare]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out = np.where((out < 0) & (keys[at] == h), self.spare[at], out)
        return out

    def _edges(self, words: np.ndarray, lens: np.ndarray):
        """By end place: ``(length, words, pieces)``; words sorted by falling length."""
        for t in range(1, words.shape[1] + 1):
            m = int(np.searchsorted(-lens, -t, side="right"))
            h = np.zeros(m, np.uint64)
            found = []
            for k in range(1, min(t, self.longest) + 1):
                h = _BYTE_HASH[words[:m, t - k]] + _BASE * h
                piece = self.find(h)
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    found.append((k, hit, piece[hit]))
            yield t, found

    def forward(self, words: np.ndarray, lens: np.ndarray, keep: bool = False):
        """Log marginals of the words (a matrix of bytes); with ``keep`` also the table of
        the recursion and its edges."""
        alpha = np.full((len(words), words.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        edges = []
        for t, found in self._edges(words, lens):
            for k, w, piece in found:
                alpha[w, t] = np.logaddexp(alpha[w, t], alpha[w, t - k] + self.logp[piece])
            if keep:
                edges.append((t, found))
        z = alpha[np.arange(len(words)), lens]
        return (z, alpha, edges) if keep else z

    def expected(self, words: np.ndarray, lens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, weighted by the words' counts."""
        z, alpha, edges = self.forward(words, lens, keep=True)
        beta = np.full(alpha.shape, -np.inf)
        beta[np.arange(len(words)), lens] = 0
        out = np.zeros(len(self.pieces))
        for t, found in reversed(edges):
            for k, w, piece in found:
                step = self.logp[piece] + beta[w, t]
                out += np.bincount(piece, weights=counts[w] * np.exp(alpha[w, t - k] + step - z[w]), minlength=len(out))
                beta[w, t - k] = np.logaddexp(beta[w, t - k], step)
        return out


def _piece_hash(p: bytes) -> int:
    h = 0
    for b in reversed(p):
        h = (int(_BYTE_HASH[b]) + int(_BASE) * h) & (1 << 64) - 1
    return h


def word_blocks(data: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Runs of bytes as matrices with a leading word mark: ``(places, matrix, lengths)``,
    lengths falling; a block has about ``CELLS`` cells."""
    lens = e - s + 1
    order = np.argsort(-lens, kind="stable")
    a = 0
    while a < len(order):
        width = int(lens[order[a]])
        b = min(len(order), a + max(1, CELLS // width))
        at = order[a:b]
        cols = np.arange(width - 1)
        idx = np.minimum(s[at][:, None] + cols, max(len(data) - 1, 0))
        m = np.full((len(at), width), 0x20, np.uint8)
        if width > 1:
            m[:, 1:] = data[idx]
        yield at, m, lens[at]
        a = b


# -- words of chunks --------------------------------------------------------------------

def _slice_words(data: np.ndarray, off: np.ndarray):
    """Hashes, starts, ends and rows of the words, in blocks of bytes."""
    n, a = len(data), 0
    while a < n:
        b = min(n, a + SLICE_BYTES)
        if b < n:
            white = np.flatnonzero(WHITE[data[a:b]])
            if len(white):
                b = a + int(white[-1]) + 1
            else:
                after = np.flatnonzero(WHITE[data[b:]])
                b = b + int(after[0]) + 1 if len(after) else n
        d = LOWER[data[a:b]]
        s, e = word_runs(d, off[(off >= a) & (off <= b)] - a)
        yield d, run_hashes(d, s, e), s, e, np.searchsorted(off, s + a, side="right") - 1
        a = b


class _Words:
    """Distinct words of a chunk with their bytes."""

    def __init__(self):
        self.parts: list = []
        self.size = 0

    def add(self, d, h, s, e, weight):
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=weight, minlength=len(u)).astype(np.int64)
        lens = (e - s)[first]
        at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(s[first], lens)
        self.parts.append((u, n, lens, d[at]))
        self.size += len(u)

    def merged(self):
        return merge_words(self.parts)


def merge_words(parts):
    """``(hashes, counts, lengths, bytes)`` of tables of words, each word once."""
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z.astype(np.uint8)
    h, n, lens, data = (np.concatenate(x) for x in zip(*parts))
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    start = np.cumsum(lens) - lens
    size = lens[first]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[first], size)
    return u, np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64), size, data[at]


def _pack_words(u, n, lens, data) -> bytes:
    return binary(np.array([len(u)], np.int64)) + binary(u) + binary(n.astype(np.int64)) + binary(lens.astype(np.int32)) + binary(data)


def _unpack_words(raw: bytes):
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    p = 8
    u = np.frombuffer(raw, np.uint64, k, p)
    n = np.frombuffer(raw, np.int64, k, p + 8 * k)
    lens = np.frombuffer(raw, np.int32, k, p + 16 * k).astype(np.int64)
    return u, n, lens, np.frombuffer(raw, np.uint8, -1, p + 20 * k)


def word_counts(train: DataFrame, shards: int) -> DataFrame:
    """``shard, payload``: the training words of a shard with their counts."""
    def send(batches):
        words, size = _Words(), 0

        def done():
            u, n, lens, data = words.merged()
            start = np.cumsum(lens) - lens
            shard = (u % U64(shards)).astype(np.int64)
            out = []
            for s in range(shards):
                at = np.flatnonzero(shard == s)
                if len(at):
                    own = lens[at]
                    idx = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[at], own)
                    out.append((s, _pack_words(u[at], n[at], own, data[idx])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["shard", "payload"])

        for batch in batches:
            for _, _, data, off in slices(batch):
                for d, h, s, e, _ in _slice_words(data, off):
                    if len(h):
                        words.add(d, h, s, e, np.ones(len(h)))
                size += len(data)
                if size > CHUNK_BYTES:
                    yield done()
                    words, size = _Words(), 0
        if words.parts:
            yield done()

    def gather(batches):
        for shard, parts in _by_shard(batches):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_pack_words(*merge_words([_unpack_words(p) for p in parts]))], pa.binary())], ["shard", "payload"])

    schema = "shard int, payload binary"
    return train.select("text").mapInArrow(send, schema).repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(gather, schema)


def _by_shard(batches):
    shard, parts = None, []
    for b in batches:
        for s, payload in zip(b.column(0).to_pylist(), b.column(1)):
            if s != shard and parts:
                yield shard, parts
                parts = []
            shard = s
            parts.append(payload.as_py())
    if parts:
        yield shard, parts


@dataclass
class Model:
    lattice: Lattice
    tokens: int     # N
    distinct: int   # V
    texts: int      # training texts: count of the end token
    counts: DataFrame


def fit(train: DataFrame, model_file: str, rounds: int = EM_ROUNDS) -> Model:
    """``train`` has ``text``; null counts as empty."""
    spark = train.sparkSession
    shards = shuffle_partitions(spark)
    counts = stored(word_counts(train, shards))

    def totals(batches):
        for b in batches:
            for payload in b.column(1):
                u, n, _, _ = _unpack_words(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(u)])], ["n", "v"])

    texts = train.count()
    r = counts.mapInArrow(totals, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    words, distinct = r["n"] or 0, r["v"] or 0
    pieces, start = vocabulary(model_file)
    logp = start
    used = 0.0
    for _ in range(rounds if words else 0):
        lattice = spark.sparkContext.broadcast(Lattice(pieces, logp, 0.0))

        def expect(batches, lattice=lattice):
            total = None
            for b in batches:
                for payload in b.column(1):
                    u, n, lens, data = _unpack_words(payload.as_py())
                    end = np.cumsum(lens)
                    for at, m, size in word_blocks(data, end - lens, end):
                        got = lattice.value.expected(m, size, np.ones(len(at)))
                        total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["piece", "n"])

        found = counts.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        e = np.zeros(len(pieces))
        e[found["piece"].to_numpy()] = found["n"].to_numpy()
        used = float(e.sum())
        logp = np.log((e + PRIOR * np.exp(start)) / (used + PRIOR))
    # the end of a text is one more piece of the unigram model
    end = (texts + 1.0) / (texts + words + used + PRIOR + 1.0)
    return Model(Lattice(pieces, logp + np.log1p(-end), float(np.log(end))), words + texts, distinct + (texts > 0), texts, counts)


def score(docs: DataFrame, model: Model, extra: str = "held_out") -> DataFrame:
    """``doc_id, <extra>, n_tokens, n_known, train_tokens, base_score, score`` of every
    row of ``doc_id, text, <extra>`` (a boolean that is passed on)."""
    spark = docs.sparkSession
    shards = shuffle_partitions(spark)
    bound = spark.sparkContext.broadcast(model.lattice)
    n_train, v_train, texts = model.tokens, model.distinct, model.texts

    def send(batches):
        part = TaskContext.get().partitionId()
        chunk = part << 24
        state = {"size": 0, "rows": 0, "ids": [], "flags": [], "words": _Words(), "h": [], "doc": []}

        def done():
            lattice = bound.value
            u, _, lens, data = state["words"].merged()
            end = np.cumsum(lens)
            z = np.zeros(len(u))
            for at, m, size in word_blocks(data, end - lens, end):
                z[at] = lattice.forward(m, size)
            rows = state["rows"]
            ids, flags = pa.concat_arrays(state["ids"]), pa.concat_arrays(state["flags"])
            n_tokens = np.ones(rows, np.int64)
            if len(u):
                pair, tf = np.concatenate(state["h"]), np.concatenate(state["doc"])
                doc, word, times = _pairs(pair, tf, u)
                n_tokens += np.bincount(doc, weights=times, minlength=rows).astype(np.int64)
                shard = (u % U64(shards)).astype(np.int64)
                by = np.argsort(shard[word], kind="stable")
                doc, word, times = doc[by], word[by], times[by]
                ends = np.searchsorted(shard[word], np.arange(shards + 1))
                for s in range(shards):
                    a, b = ends[s], ends[s + 1]
                    if a < b:
                        own, at = np.unique(word[a:b], return_inverse=True)
                        head = np.array([len(own), b - a, rows], np.int64)
                        yield s, 1, binary(head) + binary(u[own]) + binary(z[own]) + binary(at.astype(np.uint32)) + binary(doc[a:b].astype(np.uint32)) + binary(times[a:b].astype(np.uint16 if times[a:b].max() < 65536 else np.uint32)), None, None, None
            yield chunk % shards, 0, None, ids, flags, n_tokens

        def batch_of(rows):
            cols = list(zip(*rows))
            lists = [None if x is None else x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in cols[3]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(lists, pa.list_(pa.int64())),
                                               pa.array([None if x is None else x.to_pylist() for x in cols[4]], pa.list_(pa.bool_())),
                                               pa.array([None if x is None else x.tolist() for x in cols[5]], pa.list_(pa.int64()))],
                                              ["shard", "chunk", "kind", "payload", "ids", "flags", "n_tokens"])

        for batch in batches:
            for a, z, data, off in slices(batch):
                for d, h, s, e, row in _slice_words(data, off):
                    if len(h):
                        state["words"].add(d, h, s, e, np.ones(len(h)))
                        state["h"].append(h)
                        state["doc"].append((row + state["rows"]).astype(np.int32))
                state["ids"].append(batch.column(0).slice(a, z - a))
                state["flags"].append(batch.column(2).slice(a, z - a))
                state["rows"] += z - a
                state["size"] += len(data)
                if state["size"] > CHUNK_BYTES:
                    yield batch_of(list(done()))
                    chunk += 1
                    state.update(size=0, rows=0, ids=[], flags=[], words=_Words(), h=[], doc=[])
        if state["rows"]:
            yield batch_of(list(done()))

    def gather(batches):
        counts = None
        shard = None
        for b in batches:
            passed = b.filter(pa.compute.equal(b.column(2), 0))
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([passed.column(1), passed.column(2), pa.array([None] * passed.num_rows, pa.binary()), *[passed.column(i) for i in (4, 5, 6)]], names)
            for s, chunk, kind, payload in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if kind == 0:
                    continue
                if s != shard:
                    shard, counts = s, None
                if kind == -1:
                    counts = _unpack_words(payload)[:2]
                    continue
                k, n, rows = np.frombuffer(payload, np.int64, 3)
                p = 24
                u = np.frombuffer(payload, np.uint64, k, p)
                z = np.frombuffer(payload, np.float64, k, p + 8 * k)
                at = np.frombuffer(payload, np.uint32, n, p + 16 * k)
                doc = np.frombuffer(payload, np.uint32, n, p + 16 * k + 4 * n)
                rest = len(payload) - (p + 16 * k + 8 * n)
                times = np.frombuffer(payload, np.uint16 if rest == 2 * n else np.uint32, n, p + 16 * k + 8 * n).astype(np.float64)
                c = np.zeros(k)
                if counts is not None and len(counts[0]):
                    i = np.minimum(np.searchsorted(counts[0], u), len(counts[0]) - 1)
                    c = np.where(counts[0][i] == u, counts[1][i], 0)
                base = np.bincount(doc, weights=times * np.log10(c + 1)[at], minlength=rows)
                known = np.bincount(doc, weights=times * (c > 0)[at], minlength=rows).astype(np.int32)
                full = np.bincount(doc, weights=urn_score(token_logp(c, z)[at], times), minlength=rows)
                plain = np.bincount(doc, weights=times * z[at] / LN10, minlength=rows)
                none = [None]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([1], pa.int32()), pa.array([binary(base) + binary(full) + binary(plain) + binary(known)], pa.binary()), pa.array(none, pa.list_(pa.int64())),
                                                  pa.array(none, pa.list_(pa.bool_())), pa.array(none, pa.list_(pa.int64()))], names)

    def finish(batches):
        for b in batches:
            for chunk, kind, payload, ids, flags, n_tokens in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if kind == 0:  # first of its chunk
                    if held[0] is not None:
                        yield result()
                    held[:] = [ids, flags, np.array(n_tokens), np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)]
                    continue
                rows = len(held[0])
                held[3] += np.frombuffer(payload, np.float64, rows)
                held[4] += np.frombuffer(payload, np.float64, rows, 8 * rows)
                held[5] += np.frombuffer(payload, np.float64, rows, 16 * rows)
                held[6] += np.frombuffer(payload, np.int32, rows, 24 * rows)
        if held[0] is not None:
            yield result()

    held = [None] * 7
    names = ["chunk", "kind", "payload", "ids", "flags", "n_tokens"]
    log_end = model.lattice.log_end

    def token_logp(c, z):
        """Log probability of a token from its count and lattice weight."""
        if not n_train:
            return z
        seen = np.where(c > 0, np.log(np.maximum(c - DISCOUNT, 1 - DISCOUNT)), -np.inf)  # counts are whole
        return np.logaddexp(seen - np.log(n_train), np.log(DISCOUNT * v_train / n_train) + z)

    def result():
        ids, flags, n_tokens, base, full, plain, known = held
        end = token_logp(np.array([float(texts)]), np.array([log_end]))[0]
        drawn = np.array([lgamma(URN + k) - lgamma(URN) for k in n_tokens.tolist()])
        total = base + np.log10(texts + 1) - n_tokens * np.log10(n_train + v_train + 1)
        held[0] = None
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flags, pa.bool_()), pa.array(n_tokens), pa.array(known + (texts > 0)), pa.array(np.full(len(ids), n_train, np.int64)), pa.array(total), pa.array(full + (np.log(URN) + end - drawn) / LN10), pa.array(plain + log_end / LN10)],
                                          ["doc_id", extra, "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

    schema = "shard int, chunk long, kind int, payload binary, ids array<long>, flags array<boolean>, n_tokens array<long>"
    sent = docs.select("doc_id", "text", extra).mapInArrow(send, schema)
    counts = model.counts.select("shard", F.lit(None).cast("long").alias("chunk"), F.lit(-1).alias("kind"), "payload")
    both = sent.unionByName(counts, allowMissingColumns=True).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    partial = both.mapInArrow(gather, "chunk long, kind int, payload binary, ids array<long>, flags array<boolean>, n_tokens array<long>")
    return partial.repartition(shards, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(finish, f"doc_id long, {extra} boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")


def urn_score(logp: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sum of ``log10(URN * p + j)`` for ``j`` from 0 to ``times - 1``."""
    times = times.astype(np.int64)
    first = np.cumsum(times) - times
    j = np.arange(int(times.sum())) - np.repeat(first, times)
    start = np.log(URN) + logp
    each = np.where(j == 0, np.repeat(start, times), np.log(np.repeat(np.exp(start), times) + np.maximum(j, 1)))
    return np.add.reduceat(each, first) / LN10 if len(times) else each


def _pairs(h: np.ndarray, doc: np.ndarray, u: np.ndarray):
    """Distinct (document, word) pairs and how often each occurs."""
    word = np.searchsorted(u, h).astype(np.int64)
    key = np.sort(word << 32 | doc.astype(np.int64))
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(cut, len(key)))
    key = key[cut]
    return key & 0xFFFFFFFF, key >> 32, times
