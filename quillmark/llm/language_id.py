"""Language identification of whole texts, with spans for mixed texts (operator 6).

Learning counts hashed character trigrams and bigrams of words per language over all
training rows (numpy per task, then one grouped sum of at most ``BUCKETS`` rows a
language) and which scripts each language uses.  A word's score for a language is the sum
of the log shares of its n-grams.  The script of its first letter narrows the candidate
languages; Viterbi with a penalty for every switch then labels the words, so that a
passage in another language becomes a span of its own.  A text's language is the one
whose spans hold the most letters, its score that language's share of the letters.

Viterbi runs over all texts of a slice at once: blocks of ``BLOCK`` words are reduced to
(first label -> last label) tables, the tables are chained along each text, and the blocks
are traced back in parallel; the labels are those of the plain recursion.

Defined results: null, empty and letterless texts give ``und`` with score 0; equal scores
go to the language that sorts first; letters of a script that no language was seen in
count for the most frequent language; without training rows every text is ``und``;
repeated rows are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SLICE_BYTES, WHITE, give_back, mix, plain_names, slices, word_runs

BUCKETS = 1 << 16
SWITCH_PENALTY = 8.0
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.01
FOREIGN = -30.0
BLOCK = 64

# The main ranges of scripts by code point; anything else is "other".
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("latin", 0xFB00, 0xFB06), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("cyrillic", 0x2DE0, 0x2DFF), ("cyrillic", 0xA640, 0xA69F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("arabic", 0xFB50, 0xFEFC), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x323AF),
]
SCRIPT_NAMES = list(dict.fromkeys(s for s, _, _ in SCRIPTS)) + ["other"]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: script number + 1 of a letter (0: no letter), lower case."""
    n = 0x110000
    lower = np.arange(n, dtype=np.uint32)
    script = np.zeros(n, dtype=np.uint8)
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(n)), dtype=bool, count=n)
    script[letter] = len(SCRIPT_NAMES)
    for name, a, b in SCRIPTS:
        script[a:b + 1][letter[a:b + 1]] = SCRIPT_NAMES.index(name) + 1
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return script, lower


def words(data: np.ndarray, off: np.ndarray):
    """Letters of a slice: lower-cased code points, starts and ends of the words, script
    of each word, row of each word."""
    script, lower = _tables()
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
    edge = first[off]
    kind = script[points]
    s, e = word_runs(kind, edge, _NO_LETTER)
    return lower[points], s, e, kind[s] - 1, np.searchsorted(edge, s, side="right") - 1


def parts(data: np.ndarray, off: np.ndarray):
    """``(bytes, offsets, code points before)``: the slice itself, or a long text of its
    own in parts cut after white space, so that what is held per letter stays small."""
    n, a, before = len(data), 0, 0
    if n <= 2 * SLICE_BYTES or len(off) > 2:
        yield data, off, 0
        return
    while a < n:
        b = min(n, a + SLICE_BYTES)
        while b < n and not WHITE[data[b - 1]]:
            b += 1
        part = data[a:b]
        yield part, np.array([0, b - a]), before
        before += int(((part & 0xC0) != 0x80).sum())
        a = b


_NO_LETTER = np.zeros(256, dtype=bool)
_NO_LETTER[0] = True


def features(points: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigram around and the bigram up to each letter; first letter of
    each word in that order."""
    lens = e - s
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first, lens) + np.repeat(s, lens)
    mid = points[at].astype(np.uint64)
    before, after = np.empty_like(mid), np.empty_like(mid)
    before[1:], after[:-1] = mid[:-1], mid[1:]
    before[first], after[first + lens - 1] = 0, 0
    pair = before << np.uint64(21) | mid
    three = mix(pair << np.uint64(21) | after)
    return (three & np.uint64(BUCKETS - 1)).astype(np.int64), (mix(~pair) & np.uint64(BUCKETS - 1)).astype(np.int64), first


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray      # BUCKETS x languages, log shares
    allowed: np.ndarray     # scripts x languages
    prior: np.ndarray       # log shares of the languages


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all ``rows`` with a language.  What reaches the driver is bounded by
    ``BUCKETS`` rows a language, whatever the size of the input."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(1).to_pylist()
            for a, z, data, off in ((a, z, d, o) for a, z, data, off in slices(b, "text") for d, o, _ in parts(data, off)):
                points, s, e, kind, row = words(data, off)
                if len(s) == 0:
                    continue
                three, two, first = features(points, s, e)
                letter_row = np.repeat(row, e - s)
                own = np.array(names[a:z], dtype=object)
                for name in set(own.tolist()):
                    c = counts.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    mine = (own == name)[letter_row]
                    c[:BUCKETS] += np.bincount(three[mine], minlength=BUCKETS) + np.bincount(two[mine], minlength=BUCKETS)
                    w = (own == name)[row]
                    c[BUCKETS:] += np.bincount(kind[w], weights=(e - s)[w], minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "at", "n"])

    known = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    found = known.mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    for k, name in enumerate(langs):
        mine = found[found["lang"] == name]
        table[mine["at"].to_numpy(), k] = mine["n"].to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    share = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS)) if langs else grams
    letters = scripts.sum(0)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(letters, 1)
    prior = np.log(np.maximum(letters, 1) / max(letters.sum(), 1))
    return Model(langs, share.astype(np.float32), allowed, prior)


def label_words(score: np.ndarray, row: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Viterbi labels.  ``score``: words x languages; ``row``: text of each word,
    ascending."""
    n, k = score.shape
    if n == 0:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    lens = np.diff(np.append(start, n))
    blocks = -(-lens // BLOCK)
    block_text = np.repeat(np.arange(len(start)), blocks)
    block_no = np.arange(len(block_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = start[block_text] + block_no * BLOCK
    size = np.minimum(BLOCK, lens[block_text] - block_no * BLOCK)
    order = np.argsort(-size, kind="stable")
    at, size, block_text, block_no = at[order], size[order], block_text[order], block_no[order]
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(BLOCK)]  # size > t

    # tables[b, i, j]: best score of block b's words, first label i, last label j
    tables = np.full((len(at), k, k), -np.inf)
    tables[:, np.arange(k), np.arange(k)] = score[at]
    for t in range(1, BLOCK):
        m = active[t]
        if not m:
            break
        x = tables[:m]
        tables[:m] = np.maximum(x, x.max(2, keepdims=True) - penalty) + score[at[:m] + t][:, None, :]

    # chain the tables along each text; entry label of every block by tracing back
    place = np.empty(len(at), np.int64)
    offset = np.cumsum(blocks) - blocks
    place[offset[block_text] + block_no] = np.arange(len(at))
    texts = np.argsort(-blocks, kind="stable")
    rank_first = offset[texts]
    have = blocks[texts]
    steps = int(have[0])
    ends = np.empty((len(place), k))          # best score up to the end of a block
    came = np.zeros((len(place), k), np.int64)  # first label of the block on that path
    for step in range(steps):
        m = int(np.searchsorted(-have, -step, side="left"))
        own = place[rank_first[:m] + step]
        if step == 0:
            enter = np.zeros((m, k))
        else:
            past = ends[place[rank_first[:m] + step - 1]]
            enter = np.maximum(past, past.max(1, keepdims=True) - penalty)
        total = enter[:, :, None] + tables[own]
        came[own] = total.argmax(1)
        ends[own] = total.max(1)
    last, entry = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    for step in range(steps - 1, -1, -1):
        m = int(np.searchsorted(-have, -step, side="left"))
        own = place[rank_first[:m] + step]
        pick = np.empty(m, np.int64)
        m2 = int(np.searchsorted(-have, -(step + 1), side="left"))
        pick[m2:] = ends[own[m2:]].argmax(1)
        if m2:
            nxt = entry[place[rank_first[:m2] + step + 1]]
            past = ends[own[:m2]]
            best = past.argmax(1)
            stay = past[np.arange(m2), nxt]
            pick[:m2] = np.where(past[np.arange(m2), best] - penalty > stay, best, nxt)
        last[own] = pick
        entry[own] = came[own, pick]

    # inside the blocks: forward from the entry label, then back from the last label
    back = np.zeros((BLOCK, len(at), k), np.int8)
    cur = np.full((len(at), k), -np.inf)
    cur[np.arange(len(at)), entry] = score[at, entry]
    for t in range(1, BLOCK):
        m = active[t]
        if not m:
            break
        x = cur[:m]
        best = x.argmax(1)
        top = x[np.arange(m), best][:, None] - penalty
        switch = top > x
        back[t, :m] = np.where(switch, best[:, None], np.arange(k)[None, :])
        cur[:m] = np.where(switch, top, x) + score[at[:m] + t]
    out = np.empty(n, np.int64)
    label = last.copy()
    for t in range(BLOCK - 1, -1, -1):
        m = active[t]
        if not m:
            continue
        out[at[:m] + t] = label[:m]
        if t:
            label[:m] = back[t, np.arange(m), label[:m]]
    return out


def word_scores(model: Model, points: np.ndarray, s: np.ndarray, e: np.ndarray, kind: np.ndarray) -> np.ndarray:
    three, two, first = features(points, s, e)
    score = np.add.reduceat(model.scores[three] + model.scores[two], first, axis=0).astype(np.float64)
    fit_ = model.allowed[kind]
    return np.where(fit_ | ~fit_.any(1, keepdims=True), score, score.max(1, keepdims=True) + FOREIGN)


def scored_words(model: Model, data: np.ndarray, off: np.ndarray):
    """Scores, starts, ends and rows of the words of a slice; of long texts only these are
    held whole."""
    found = []
    for part, own, before in parts(data, off):
        points, s, e, kind, row = words(part, own)
        if len(s):
            found.append((word_scores(model, points, s, e, kind), s + before, e + before, row))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros((0, 1)), *[np.zeros(0, np.int64)] * 3)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score, spans``: spans are ``(lang, start, end)`` in code
    points, from the first letter of the first word to the last of the last word.  With
    ``keep`` the input's columns come back instead, with ``_lang_pred`` and ``_score``."""
    bound = docs.sparkSession.sparkContext.broadcast(model)
    names_ = docs.columns
    if keep:
        docs = plain_names(docs, (key, text))
    rows = docs.select("*", F.col(text).cast("string").alias("_text")) if keep else docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    own = [c for c in rows.columns if c != "_text"]

    def run(batches):
        try:
            yield from labelled(batches)
        finally:
            give_back()

    def labelled(batches):
        m = bound.value
        k = max(len(m.langs), 1)
        for b in batches:
            for a, z, data, off in slices(b, "_text"):
                names, shares, spans = ["und"] * (z - a), np.zeros(z - a), [[] for _ in range(z - a)]
                score, s, e, row = scored_words(m, data, off) if m.langs else (None, [], [], [])
                if len(s):
                    label = label_words(score, row)
                    letters = np.bincount(row * k + label, weights=e - s, minlength=(z - a) * k).reshape(-1, k)
                    total = letters.sum(1)
                    best = letters.argmax(1)
                    got = np.flatnonzero(total)
                    shares[got] = letters[got, best[got]] / total[got]
                    for r in got:
                        names[r] = m.langs[best[r]]
                    if not keep:
                        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])]))
                        end = e[np.append(new[1:], len(s)) - 1]
                        base = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
                        for r, lab, x, y in zip(row[new].tolist(), label[new].tolist(), s[new].tolist(), end.tolist()):
                            spans[r].append({"lang": m.langs[lab], "start": x - int(base[r]), "end": y - int(base[r])})
                part = b.slice(a, z - a)
                cols = [part.column(i) for i, n in enumerate(part.schema.names) if n != "_text"]
                extra = [pa.array(names, pa.string()), pa.array(shares)]
                if not keep:
                    extra.append(pa.array(spans, SPANS))
                yield pa.RecordBatch.from_arrays([*cols, *extra], [*own, "_lang_pred", "_score"] if keep else [*own, "lang_pred", "score", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    added = "_lang_pred string, _score double" if keep else "lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>"
    out = rows.mapInArrow(run, f"{fields}, {added}")
    return out.toDF(*names_, "_lang_pred", "_score") if keep else out


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text falls in the part that is not learned from."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == part
