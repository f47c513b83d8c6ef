"""Spelling variant grouping over a bit-sliced position index (operator 12).

The words of all texts are counted (combined per task, then one sum), and each frequent
word gets its near words: those one inserted, deleted or replaced code point away.  Two
near words share the first half of the shorter or the rest of it: with ``s`` code points
in the shorter, ``h = s // 2`` at the front or ``s - h`` at the end.  Words therefore meet
in groups by (s, side, half).  A block of groups is indexed by bitsets, one per (position,
letter), over its words; a word runs through the index letter by letter with four sets:

    Z  words equal so far                  Z' = Z & at[i][c]
    S  one replaced                        S' = S & at[i][c] | Z
    I  the other word has one letter more  I' = (I | Z) & at[i + 1][c]
    D  the other word has one letter less  D' = D & at[i - 1][c] | Z

At the front groups' pairs are dropped from the end groups by Z after ``h`` letters, so
that a pair counts once.  Bits are in descending order of count, so a set's lowest bit is
the form.  A task sends one row per word and group, never pairs.  A group beyond ``BLOCK``
words is cut into chunks by the hash of its words; each chunk indexes its own words and is
asked by all words of the group.

A word's form is its near word with the largest count, if that is ``factor`` times its own
at least; the root follows forms to the last by pointer doubling.

Defined results: null and empty texts have no words; repeated rows count again; equal
counts go to the word that is smallest in code-point order; a null id is the text ``None``
in the hash that picks the runs to be changed; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored, two_columns

MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
#: Words of one index.
BLOCK = 2048
#: Distinct words a task holds before it sends its counts.
HELD_WORDS = 400_000
#: Code points of a text that are searched at once.
PART = 1 << 20
_RUN = re.compile("[a-zÀ-ÿ]+")
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")

#: ``(key, run) -> word``: what becomes of a run of letters in the document of that key.
Change = Callable[[int, str], str]


def drop_a_letter(key: int | None, run: str) -> str:
    """The run without one code point if 199 divides the crc32 of ``key:run``."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % 199:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def runs(text: str) -> Iterator[list[str]]:
    """The letter runs of a text, A-Z lower-cased, in lists of a bounded part each."""
    a = 0
    while a < len(text):
        b = a + PART
        if b < len(text):  # at a place without a letter, so that no run is cut
            after = _NO_LETTER.search(text, b)
            b = after.start() if after else len(text)
        yield _RUN.findall(text[a:b].encode().lower().decode())  # of bytes only A-Z change
        a = b


def word_counts(docs: DataFrame, change: Change = lambda key, run: run, min_length: int = MIN_LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of all words of ``min_length`` code points and more."""
    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for i in range(b.num_rows):
                own, value = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for found in runs(value or ""):
                    for r, n in Counter(found).items():
                        if len(r) >= min_length:
                            w = change(own, r)
                            if len(w) >= min_length:
                                held[w] += n
                    if len(held) > HELD_WORDS:
                        yield table(held)
                        held.clear()
        yield table(held)

    return two_columns(docs, key, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class PositionIndex:
    """Bitsets of the words that have a letter at a position, and of their lengths."""

    def __init__(self, words: list[str]):
        size = len(words) // 8 + 1
        at: dict = {}
        lengths: dict = {}
        for i, w in enumerate(words):
            byte, bit = i >> 3, 1 << (i & 7)
            for key in enumerate(w):
                s = at.get(key)
                if s is None:
                    s = at[key] = bytearray(size)
                s[byte] |= bit
            lengths.setdefault(len(w), bytearray(size))[byte] |= bit
        self.at = {k: int.from_bytes(v, "little") for k, v in at.items()}
        self.lengths = {k: int.from_bytes(v, "little") for k, v in lengths.items()}

    def longer(self, word: str, among: int, front: int) -> tuple[int, int]:
        """Words with one letter replaced or one more, and those of them that share the
        first ``front`` letters."""
        get = self.at.get
        zero, replaced, more, shared = among, 0, 0, 0
        for i, c in enumerate(word):
            here = get((i, c), 0)
            replaced = replaced & here | zero
            more = (more | zero) & get((i + 1, c), 0)
            zero &= here
            if i + 1 == front:
                shared = zero
            if not (replaced | more):
                return 0, shared
        n = len(word)
        return replaced & ~zero & self.lengths.get(n, 0) | (more | zero) & self.lengths.get(n + 1, 0), shared

    def shorter(self, word: str, among: int, front: int) -> tuple[int, int]:
        """Words with one letter less, and those that share the first ``front``."""
        get = self.at.get
        zero, less, shared = among, 0, 0
        for i, c in enumerate(word):
            less = less & get((i - 1, c), 0) | zero
            zero &= get((i, c), 0)
            if i + 1 == front:
                shared = zero
            if not less:
                return 0, shared
        return less & self.lengths.get(len(word) - 1, 0), shared


def _ask(index: PositionIndex, word: str, s: int, front: bool, among: int) -> int:
    """The near words of ``word`` in a group of shorter length ``s``."""
    found, shared = (index.longer if len(word) == s else index.shorter)(word, among, s // 2)
    return found if front else found & ~shared


def _groups(batches) -> Iterator[tuple[tuple, Iterator[tuple[str, int, bool]]]]:
    """``(s, front, half, chunk, chunks)`` and its rows, from sorted rows."""
    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    for key, group in groupby(rows(), lambda r: r[:5]):
        yield key, ((r[5], r[6], r[7]) for r in group)


def _near_rows(batches) -> Iterator[pa.RecordBatch]:
    """``word, n_near, best_n, best`` per word and group."""
    out: list[tuple] = []

    def table():
        cols = list(zip(*out)) or [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.string()])], ["word", "n_near", "best_n", "best"])

    def note(word, found, words, counts):
        if found:
            first = (found & -found).bit_length() - 1
            out.append((word, found.bit_count(), counts[first], words[first]))

    def solve(block):
        words = [w for _, group in block for w, _ in group]
        counts = [n for _, group in block for _, n in group]
        index, first = PositionIndex(words), 0
        for (s, front), group in block:
            among = (1 << len(group)) - 1 << first
            first += len(group)
            for w, _ in group:
                note(w, _ask(index, w, s, front, among), words, counts)

    block: list = []
    size = 0
    for (s, front, _, _, chunks), rows in _groups(batches):
        if chunks == 1:
            group = [(w, n) for w, n, _ in rows]
            if len(group) > 1:
                block.append(((s, front), group))
                size += len(group)
            if size >= BLOCK:
                solve(block)
                block, size = [], 0
        else:  # own words first, then all others of the group one by one
            index, words, counts, own = None, [], [], []
            for w, n, inside in rows:
                if inside:
                    words.append(w)
                    counts.append(n)
                    continue
                if index is None:
                    index = PositionIndex(words)
                note(w, _ask(index, w, s, front, (1 << len(words)) - 1), words, counts)
                if len(out) >= 8192:
                    yield table()
            index = index or PositionIndex(words)
            for w in words:
                note(w, _ask(index, w, s, front, (1 << len(words)) - 1), words, counts)
        if len(out) >= 8192:
            yield table()
    if block:
        solve(block)
    yield table()


def near_words(words: DataFrame, block: int = BLOCK, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word, n_near, best_n, best`` for the words of ``word, n`` (distinct, stored) that
    have a near word among them; none is shorter than ``min_length``."""
    length = F.length("word")
    shorter = F.explode(F.filter(F.array(length, length - 1), lambda s: s >= min_length)).alias("s")
    sides = words.select("word", "n", shorter)
    keys = F.array(F.struct(F.lit(True).alias("front"), F.expr("substring(word, 1, s div 2)").alias("half")),
                   F.struct(F.lit(False).alias("front"), F.expr("substring(word, length(word) - (s - s div 2) + 1, s - s div 2)").alias("half")))
    entries = sides.select("word", "n", "s", F.explode(keys).alias("k")).select("word", "n", "s", "k.front", "k.half")
    large = stored(entries.groupBy("s", "front", "half").count().where(F.col("count") > block)
                   .select("s", "front", "half", F.ceil(F.col("count") / block).cast("int").alias("chunks")))
    cut = entries.join(large, ["s", "front", "half"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    cut = cut.select("s", "front", "half", "chunk", "chunks", "word", "n", (F.pmod(F.xxhash64("word"), F.col("chunks")) == F.col("chunk")).alias("inside"))
    dealt = cut.repartition("s", "front", "half", "chunk").sortWithinPartitions("s", "front", "half", "chunk", F.col("inside").desc(), F.col("n").desc(), "word")
    rows = dealt.mapInArrow(_near_rows, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form`` (every form not null): forms are followed to
    the last by doubling.  Counts grow along a chain by ``FACTOR``, so a few rounds do."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, change: Change = lambda key, run: run, min_count: int = MIN_COUNT, factor: int = FACTOR,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    words = stored(word_counts(docs, change, key=key, text=text).where(F.col("n") >= min_count))
    near = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    found = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
