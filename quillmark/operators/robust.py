"""Robustness corpora (H1-H7): sentence mixing, balanced combination and seeded word /
character perturbations.

Every random choice is md5(seed, record, position) (see ``functions.sampling``), so the
output is the same whatever the partitioning or task retries.  Mixing and perturbation
are row-local over a record's sentences: the text is never shuffled.  Perturbed columns of
registered queries come from ``edited``, which draws once a word in an Arrow function; the
``perturb_*_expr`` are the same edits as array expressions, for any sentence splitter and
any synonyms.  A synonym table of at most ``MAX_SYNONYM_MAP`` words goes to the tasks; in
expressions it is one array of small maps that a word's hash points into (a scalar
subquery), and from a larger one every record gets the words it needs through a join."""

from __future__ import annotations

import math
import re
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import h32, hkey, u01
from ..functions.text import SENTENCE_TRIM, sentences, words
from .sentences import Split
from .corpus import dense_index

MAX_SYNONYM_MAP = 200_000

# Look-alike replacements (Latin -> Cyrillic) for the mixed attack.
LOOKALIKE_FROM = "aeocpx"
LOOKALIKE_TO = "аеосрх"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
ROTATED = ALPHABET[1:] + ALPHABET[:1]


def map_sentences(text, f, split: Split = sentences) -> Column:
    """H6: split into sentences, apply ``f(sentence, index)`` to each, fall back to the
    original sentence when ``f`` gives null, join with spaces."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.transform(split(t), lambda s, i: F.coalesce(f(s, i), s)), " ")


def mix_sentences(df: DataFrame, seed=2023, k: int = 4, key: str = "doc_id", split: Split = sentences, limit_rows: int | None = None) -> DataFrame:
    """H1: one seeded sentence of the original plus one seeded sentence from each of k
    distinct seeded rewrites, in a seeded order, joined; ``source='GPT'``.  Records whose
    original has no sentence or whose chosen rewrites do not all have one are dropped.
    Input: ``(key, text, variants ARRAY<STRUCT<variant_pos, text>>)``.  ``limit_rows``
    keeps the first records by key, as a saved sample does."""
    so = split("text")
    # a text without a sentence has none to pick
    orig_pick = F.try_element_at(so, (F.pmod(h32(seed, key, F.lit("o")), F.greatest(F.size(so), F.lit(1))) + 1).cast("int"))
    ranked = F.array_sort(F.transform("variants", lambda v: F.struct(
        hkey(seed, key, F.lit("p"), v["variant_pos"]).alias("k"), v["variant_pos"].alias("pos"),
        v["text"].alias("text"))))
    chosen = F.slice(ranked, 1, k)

    def pick(v):
        s = split(v["text"])
        i = (F.pmod(h32(seed, key, F.lit("s"), v["pos"]), F.greatest(F.size(s), F.lit(1))) + 1).cast("int")
        return F.when(F.size(s) > 0, F.element_at(s, i))

    picks = F.transform(chosen, pick)
    x = df.select(key, F.size(so).alias("_ns"), F.size("variants").alias("_nv"),
                  orig_pick.alias("_o"), picks.alias("_p"))
    keep = ((F.col("_ns") > 0) & (F.col("_nv") >= k) &
            (F.size(F.filter("_p", lambda s: s.isNotNull())) == k))
    slots = F.concat(F.array(F.col("_o")), F.col("_p"))
    keyed = F.transform(slots, lambda s, j: F.struct(hkey(seed, key, F.lit("m"), j).alias("k"), s.alias("s")))
    mixed = F.array_join(F.transform(F.array_sort(keyed), lambda r: r["s"]), " ")
    # dropped records produce no row from the generator: a Filter on the computed
    # columns would be pushed below them and split every sentence again
    out = F.when(keep, F.array(mixed)).otherwise(F.array().cast("array<string>"))
    mixed_rows = x.select(key, F.explode(out).alias("text"), F.lit("GPT").alias("source"))
    return mixed_rows if limit_rows is None else mixed_rows.orderBy(key).limit(limit_rows)


def balanced_combine(human: DataFrame, machine: DataFrame, seed=2023, key: str = "doc_id") -> DataFrame:
    """H2: min(n_human, n_machine) seeded records from each side, combined, shuffled and
    re-indexed 0..2m-1 (B2 text coalescing applied).  Ranks come from the bucketed dense
    index; m is a scalar subquery — no driver round trip, no single-partition sort."""
    h = human.withColumn("_side", F.lit("h"))
    g = machine.withColumn("_side", F.lit("g"))
    both = h.unionByName(g, allowMissingColumns=True)
    both = both.withColumn("_k", hkey(seed, F.col("_side"), key))
    # both sides counted by name: an empty side makes the result empty
    m = both.select(F.least(F.count_if(F.col("_side") == "h"), F.count_if(F.col("_side") == "g"))).scalar()
    ranked = dense_index(both, ["_k", key], "_r", by="_side")
    picked = ranked.filter(F.col("_r") < m)
    for c in ("explanation", "implementation"):
        if c not in picked.columns:
            picked = picked.withColumn(c, F.lit(None).cast("string"))
    ei = F.concat(F.coalesce("explanation", F.lit("")), F.coalesce("implementation", F.lit("")))
    text = F.coalesce(F.when(ei != "", ei), F.col("text"), F.lit(""))
    picked = picked.withColumn("_c", hkey(seed, F.lit("c"), F.col("_side"), key))
    out = dense_index(picked, ["_c"], "new_index")
    return out.select("new_index", key, text.alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"))


def synonym_map(synonyms: DataFrame) -> DataFrame:
    """One-row table holding the synonym map (word -> replacement; of several
    replacements the first in order)."""
    one = synonyms.where("word is not null and repl is not null").groupBy("word").agg(F.min("repl").alias("repl"))
    return one.agg(F.map_from_entries(F.collect_list(F.struct("word", "repl"))).alias("_syn"))


def _chosen(seed, key, si, wi, share) -> Column:
    return u01(seed, key, si, wi) < F.lit(float(share))


def hashed_lookup(df: DataFrame, synonyms: DataFrame, key: str = "doc_id", text: str = "text", limit: int | None = None):
    """``df`` with the synonyms as column ``_syn``, and ``word -> replacement`` over it.

    Spark looks a key up in a map by scanning it, so the table is one array of maps of
    about two words, and the word's hash names the map.  A table of more than ``limit``
    words takes ``with_synonyms``'s joins, with the same results."""
    limit = MAX_SYNONYM_MAP if limit is None else limit
    n = synonyms.limit(limit + 1).count()
    if n > limit:
        return with_synonyms(df, synonyms, key, text, limit), lambda w: F.try_element_at(F.col("_syn"), w)
    size = max(1, n // 2)
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int")
    one = synonyms.where("word is not null and repl is not null").groupBy("word").agg(F.min("repl").alias("repl"))
    kept = one.groupBy(place(F.col("word")).alias("at")).agg(F.collect_list(F.struct("word", "repl")).alias("of"))
    every = df.sparkSession.range(size).select(F.col("id").cast("int").alias("at")).join(kept, "at", "left")
    none = F.array().cast("array<struct<word:string,repl:string>>")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("of", none).alias("of")))),
                                  lambda r: F.map_from_entries(r["of"])).alias("_syn"))
    return df.withColumn("_syn", table.scalar()), lambda w: F.try_element_at(F.get(F.col("_syn"), place(w)), w)


def perturb_words_expr(text, key, syn, share: float = 0.1, seed=11, split: Split = sentences) -> Column:
    """H3 on a row that carries the synonyms: ``syn`` is a map column or a function from a
    lower-cased word to its replacement (``hashed_lookup``)."""
    find = (lambda w: F.try_element_at(syn, w)) if isinstance(syn, Column) else syn

    def per_sentence(s, si):
        w = words(s)
        return F.array_join(F.transform(w, lambda x, wi: F.when(
            _chosen(seed, key, si, wi, share), F.coalesce(find(F.lower(x)), x)).otherwise(x)), " ")
    return map_sentences(text, per_sentence, split)


def char_edit(w: Column, key, si, wi, seed) -> Column:
    """One character edit: swap neighbours, drop, duplicate or substitute (rotate the
    letter) at a seeded position; words shorter than 2 keep swap/drop unchanged."""
    n = F.length(w)
    op = F.pmod(h32(seed, key, si, wi, F.lit("op")), F.lit(4))
    k = (F.pmod(h32(seed, key, si, wi, F.lit("k")), F.greatest(n, F.lit(1))) + 1).cast("int")
    k2 = (F.pmod(h32(seed, key, si, wi, F.lit("k")), F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    pre = w.substr(F.lit(1), k - 1)
    ch = w.substr(k, F.lit(1))
    post = w.substr(k + 1, F.greatest(n - k, F.lit(0)))
    swap = F.concat(w.substr(F.lit(1), k2 - 1), w.substr(k2 + 1, F.lit(1)), w.substr(k2, F.lit(1)),
                    w.substr(k2 + 2, F.greatest(n - k2 - 1, F.lit(0))))
    return (F.when(op == 0, F.when(n >= 2, swap).otherwise(w))
            .when(op == 1, F.when(n >= 2, F.concat(pre, post)).otherwise(w))
            .when(op == 2, F.concat(pre, ch, ch, post))
            .otherwise(F.concat(pre, F.translate(ch, ALPHABET, ROTATED), post)))


def perturb_chars_expr(text, key, share: float = 0.1, seed=13, split: Split = sentences) -> Column:
    """H4."""
    def per_sentence(s, si):
        return F.array_join(F.transform(words(s), lambda x, wi: F.when(
            _chosen(seed, key, si, wi, share), char_edit(x, key, si, wi, seed)).otherwise(x)), " ")
    return map_sentences(text, per_sentence, split)


def space_insert(w: Column, key, si, wi, seed) -> Column:
    """A space at a seeded place inside the word; words shorter than 2 stay."""
    n = F.length(w)
    k = (F.pmod(h32(seed, key, si, wi, F.lit("sp")), F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    return F.when(n >= 2, F.concat(w.substr(F.lit(1), k), F.lit(" "), w.substr(k + 1, n - k))).otherwise(w)


def perturb_mixed_expr(text, key, syn, share: float = 0.1, seed=17, split: Split = sentences, spaces: bool = False) -> Column:
    """H5: synonyms, then character edits, then look-alike characters, each on its own
    seeded share of words; with ``spaces`` also spaces put into another share of them."""
    t1 = perturb_words_expr(text, key, syn, share, seed, split)
    t2 = perturb_chars_expr(t1, key, share, seed + 1, split)

    def edit(x, si, wi):
        y = F.when(_chosen(seed + 2, key, si, wi, share), F.translate(x, LOOKALIKE_FROM, LOOKALIKE_TO)).otherwise(x)
        return F.when(_chosen(seed + 3, key, si, wi, share), space_insert(y, key, si, wi, seed + 3)).otherwise(y) if spaces else y

    def per_sentence(s, si):
        return F.array_join(F.transform(words(s), lambda x, wi: edit(x, si, wi)), " ")
    return map_sentences(t2, per_sentence, split)


_END = re.compile(r"[.!?][ \t\n\r\f\x0b]+")
_NUMBERS = [str(i).encode() for i in range(4096)]
_ROTATE = str.maketrans(ALPHABET, ROTATED)
_LOOK = str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO)


def cut_sentences(text: str) -> list[str]:
    """``functions.text.sentences`` of one text."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.start() > start:  # a sentence is more than its terminators
            out.append(text[start:m.end()])
            start = m.end()
    out.append(text[start:])
    return [s for s in (x.strip(SENTENCE_TRIM) for x in out) if s]


def _draw(message: bytes) -> int:
    return int.from_bytes(md5(message).digest()[:4], "big")


def edit_word(kind: str, w: str, head: bytes, known: dict) -> str:
    """One edit of a chosen word: ``words`` (synonym), ``chars`` (``char_edit``), ``look``
    (look-alikes) or ``space`` (``space_insert``); ``head`` names its seed and place."""
    if kind == "words":
        return known.get(w.lower(), w)
    if kind == "look":
        return w.translate(_LOOK)
    n = len(w)
    if kind == "space":
        k = _draw(head + b"-sp") % max(n - 1, 1) + 1
        return f"{w[:k]} {w[k:]}" if n >= 2 else w
    op, k = _draw(head + b"-op") % 4, _draw(head + b"-k")
    if op < 2 and n < 2:
        return w
    if op == 0:
        k = k % (n - 1)
        return w[:k] + w[k + 1] + w[k] + w[k + 2:]
    k %= n
    return w[:k] + ("" if op == 1 else w[k] * 2 if op == 2 else w[k].translate(_ROTATE)) + w[k + 1:]


def edit_text(text: str, key: str | None, steps, known: dict, share: float) -> str:
    """The text after ``steps``; sentences are found again before each, and a step's edits
    ``(kind, seed)`` are made in order, each on its own seeded share of words."""
    first = math.ceil(share * 2 ** 32)  # the least draw that is not chosen
    limit = min(max(first, 0), 2 ** 32 - 1).to_bytes(4, "big") if first < 2 ** 32 else b"\xff" * 17
    of = "" if key is None else f"{key}-"
    for edits in steps:
        out = []
        for si, sentence in enumerate(cut_sentences(text)):
            w = sentence.split()
            while len(w) > len(_NUMBERS):
                _NUMBERS.append(str(len(_NUMBERS)).encode())
            for kind, seed in edits:
                head = f"{seed}-{of}{si}-".encode()
                for i in [i for i, x in enumerate(_NUMBERS[:len(w)]) if md5(head + x).digest() < limit]:
                    w[i] = edit_word(kind, w[i], head + _NUMBERS[i], known)
            out.append(" ".join(w))
        text = " ".join(out)
    return text


def words_step(seed=11) -> list:
    return [[("words", seed)]]


def chars_step(seed=13) -> list:
    return [[("chars", seed)]]


def mixed_steps(seed=17, spaces: bool = False) -> list:
    """H5: the steps of ``perturb_mixed_expr``."""
    return [[("words", seed)], [("chars", seed + 1)], [("look", seed + 2), *[("space", seed + 3)] * spaces]]


def known_synonyms(synonyms: DataFrame, limit: int | None = None):
    """``word -> replacement`` (of several the first in order) for the tasks, or None if
    there are more than ``limit`` words."""
    limit = MAX_SYNONYM_MAP if limit is None else limit
    one = synonyms.where("word is not null and repl is not null").groupBy("word").agg(F.min("repl").alias("repl"))
    rows = one.limit(limit + 1).collect()
    return None if len(rows) > limit else synonyms.sparkSession.sparkContext.broadcast({r["word"]: r["repl"] for r in rows})


def edited(text, key, steps, known=None, share: float = 0.1) -> Column:
    """The text after ``steps`` (see ``edit_text``), with ``known_synonyms`` for those of
    kind ``words``."""
    @F.pandas_udf("string")
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        table = known.value if known else {}
        return pd.Series([edit_text(t, k if isinstance(k, str) else None, steps, table, share) if isinstance(t, str) else None
                          for t, k in zip(texts, keys)], dtype=object)

    return run(F.col(text), F.col(key).cast("string"))


def with_synonyms(df: DataFrame, synonyms: DataFrame, key: str = "doc_id", text: str = "text",
                  limit: int | None = None) -> DataFrame:
    """Attach the synonyms of a record's words as column ``_syn``: the whole map if the
    table has at most ``limit`` words, else a map of the record's own words by two joins
    (distinct words of a record to the table, then back by key)."""
    limit = MAX_SYNONYM_MAP if limit is None else limit
    if synonyms.limit(limit + 1).count() <= limit:
        return df.withColumn("_syn", synonym_map(synonyms).scalar())
    one = synonyms.where("word is not null and repl is not null").groupBy("word").agg(F.min("repl").alias("repl"))
    need = df.select(key, F.explode(F.array_distinct(F.transform(words(text), lambda w: F.lower(w)))).alias("word")).distinct()
    own = need.join(one, "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "repl"))).alias("_syn"))
    none = F.map_from_entries(F.array().cast("array<struct<word:string,repl:string>>"))
    return df.join(own, key, "left").withColumn("_syn", F.coalesce("_syn", none))


def with_perturbations(df: DataFrame, synonyms: DataFrame, share: float = 0.1, key: str = "doc_id") -> DataFrame:
    """H7: the three perturbed texts as extra columns; empty texts are skipped."""
    x = df.filter(F.col("text").isNotNull() & (F.trim("text") != ""))
    known = known_synonyms(synonyms)
    if known is not None:
        return x.select(*df.columns, *[edited("text", key, steps, known, share).alias(f"perturb_{name}") for name, steps in (
            ("words", words_step()), ("chars", chars_step()), ("mixed", mixed_steps()))])
    x, syn = hashed_lookup(x, synonyms, key)
    return x.select(*df.columns,
                    perturb_words_expr("text", key, syn, share).alias("perturb_words"),
                    perturb_chars_expr("text", key, share).alias("perturb_chars"),
                    perturb_mixed_expr("text", key, syn, share).alias("perturb_mixed"))


def vocabulary_synonyms(vocab: DataFrame) -> DataFrame:
    """Deterministic near-synonym table from a (bounded) vocabulary: each term maps to
    the next term of the same length in sorted order."""
    from pyspark.sql import Window
    w = Window.partitionBy(F.length("term")).orderBy("term")
    return (vocab.select("term", F.lead("term").over(w).alias("repl"))
            .filter(F.col("repl").isNotNull()).select(F.col("term").alias("word"), "repl"))
