"""Sentences with learned abbreviations.

After the collocation statistics of Kiss and Strunk ("Unsupervised multilingual sentence
boundary detection", 2006): a word type is an abbreviation if it stands with a period far
more often than words do (log-likelihood ratio), weighed down by its length and by every
time it stands without one; a type starts sentences if it follows a period that ends no
abbreviation more often than chance.  The counts are two aggregates over the tokens of the
corpus; all types that reach the scores make the model.  Splitting is row-local: a period
after an abbreviation or a single letter ends no sentence unless a starter follows."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_PATTERN, SENTENCE_TRIM
from ..session import stored

#: Trimmed off a token before its period is looked at.
AROUND = "\"'()[]{}«»“”‘’„,;:!?"
TOKEN = r"[^ \t\n\r\f\x0B]+"
#: Score from which a type is an abbreviation, and ratio from which one starts sentences.
ABBREVIATION = 0.3
STARTER = 30.0
#: Share of an abbreviation's uses that have the period, under the alternative.
WITH_PERIOD = 0.99
#: Types that stand in the plan one by one; more are one literal, a table by their hash.
IN_PLAN = 500
#: A noncharacter, which no text holds, between sentences while a text is split.
MARK = "﷐"
#: Noncharacters around the types of a table and between its rows.
EDGE, ROW = "﷑", "﷒"


def _core(token: Column) -> Column:
    return F.btrim(token, F.lit(AROUND))


def _dot(token: Column) -> Column:
    return F.rlike(_core(token), F.lit(r"[^.]\.$"))


def _type(token: Column) -> Column:
    return F.lower(F.rtrim(_core(token), F.lit(".")))


def token_types(docs: DataFrame, text: str = "text") -> DataFrame:
    """``type, dot, before, dot_before``: every token that has a letter, with the token
    before it."""
    x = _tokens(docs, text).select(F.explode(_pairs()).alias("r"))
    return _typed(x.select("r.x", "r.p"))


def _tokens(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.regexp_extract_all(F.col(text), F.lit(TOKEN), 0).alias("t")).where("t is not null")


def _pairs() -> Column:
    return F.transform("t", lambda x, i: F.struct(x.alias("x"), F.try_element_at(F.col("t"), F.when(i > 0, i).otherwise(F.lit(None))).alias("p")))


def _typed(pairs: DataFrame, *keep: str) -> DataFrame:
    """Types and periods of tokens ``x`` with the token ``p`` before."""
    x = pairs.select(_type(F.col("x")).alias("type"), _dot(F.col("x")).alias("dot"), _type(F.col("p")).alias("before"), F.coalesce(_dot(F.col("p")), F.lit(False)).alias("dot_before"), *keep)
    return x.where(F.rlike("type", F.lit(r"\p{L}")))


def different_tokens(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``token_types`` in two tables with the times ``c`` they occur, typed once a different
    token and not once an occurrence: all tokens (``before`` left out), and those that
    follow a period."""
    every = _tokens(docs, text).select(F.explode("t").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    dotted = F.filter(_pairs(), lambda r: F.contains(r["p"], F.lit(".")))
    after = _tokens(docs, text).select(F.explode(dotted).alias("r")).groupBy("r.x", "r.p").agg(F.count(F.lit(1)).alias("c"))
    return _typed(every.withColumn("p", F.lit(None).cast("string")), "c"), _typed(after, "c").where("dot_before")


def type_counts(tokens: DataFrame) -> DataFrame:
    """``type, n, n_dot`` of tokens, or of different ones that occur ``c`` times."""
    c = F.col("c") if "c" in tokens.columns else F.lit(1)
    return tokens.groupBy("type").agg(F.sum(c).alias("n"), F.sum(F.when(F.col("dot"), c).otherwise(0)).alias("n_dot"))


def _part(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k successes in n with probability p (nothing if k or n - k is 0
    where p is 0 or 1)."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1.0 - p)).otherwise(0.0)


def abbreviations(counts: DataFrame) -> DataFrame:
    """``type, score`` of the types that are abbreviations."""
    total = counts.select(F.sum("n")).scalar()
    dots = counts.select(F.sum("n_dot")).scalar()
    n, k = F.col("n").cast("double"), F.col("n_dot").cast("double")
    p = dots / total
    ratio = -2.0 * (_part(k, n, p) - _part(k, n, F.lit(WITH_PERIOD)))
    size = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("type") - size + 1.0
    score = ratio * F.exp(-size) * inner * F.pow(size, -(n - k))
    return counts.where("n_dot > 0").select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def one_of(types: list[str]) -> Callable[[Column], Column]:
    """Whether a type is one of these, however many: Spark folds the split of a constant into
    one array, of which the type's hash names the row to look in."""
    if len(types) <= IN_PLAN:
        return lambda t: t.isin(types)  # a set, not a list to go through
    odd = [x for x in types if EDGE in x or ROW in x]
    rows = [EDGE] * len(types)
    for x in set(types) - set(odd):
        rows[zlib.crc32(x.encode()) % len(rows)] += x + EDGE
    table = F.split(F.lit(ROW.join(rows)), ROW)

    def found(t: Column) -> Column:
        row = F.get(table, F.pmod(F.crc32(t.cast("binary")), F.lit(len(rows))).cast("int"))
        return (F.contains(row, F.concat(F.lit(EDGE), t, F.lit(EDGE))) & ~F.contains(t, F.lit(EDGE))) | t.isin(odd)
    return found


def _ends(short: list[str]) -> Column:
    return F.col("dot_before") & ~F.array_contains(F.lit(short).cast("array<string>"), F.col("before")) & (F.length("before") > 1)


def starters(tokens: DataFrame, short: list[str]) -> DataFrame:
    """``type, ratio`` of the types that start sentences."""
    return _starters(tokens.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(_ends(short)).alias("n_after")))


def _starters(counts: DataFrame) -> DataFrame:
    """The same of ``type, n, n_after``."""
    total = counts.select(F.sum("n")).scalar().cast("double")
    breaks = counts.select(F.sum("n_after")).scalar().cast("double")
    n, k = F.col("n").cast("double"), F.col("n_after").cast("double")
    p, p1, p2 = n / total, k / breaks, (n - k) / (total - breaks)
    # of the breaks k are followed by the type, of the other places n - k
    ratio = -2.0 * (_part(k, breaks, p) + _part(n - k, total - breaks, p) - _part(k, breaks, p1) - _part(n - k, total - breaks, p2))
    return counts.where("n_after > 0").select("type", ratio.alias("ratio"), (total / breaks > n / k).alias("more")).where((F.col("ratio") >= STARTER) & F.col("more")).drop("more")


@dataclass
class Splitter:
    """A model to split by; call it on a text column, as ``functions.text.sentences``."""
    abbreviations: list[str]
    starters: list[str]

    def __call__(self, text) -> Column:
        t = F.col(text) if isinstance(text, str) else text
        white = F.lit(SENTENCE_TRIM)
        short, starts = one_of(self.abbreviations), one_of(self.starters)

        def goes_on(part: Column, following: Column) -> Column:
            last = F.substring_index(F.translate(F.rtrim(part, white), SENTENCE_TRIM, " " * len(SENTENCE_TRIM)), " ", -1)
            first = _type(F.regexp_extract(following, TOKEN, 0))
            kind = _type(last)
            stop = _dot(last) & (short(kind) | F.rlike(kind, F.lit(r"^\p{L}$")))
            return following.isNotNull() & stop & ~starts(first)

        def mark(parts: Column) -> Column:
            return F.transform(parts, lambda p, i: F.concat(p, F.when(F.coalesce(goes_on(p, F.try_element_at(parts, i + 2)), F.lit(False)), "").otherwise(MARK)))

        # bound once as a lambda variable: every part would otherwise find all parts again
        marked = F.get(F.transform(F.array(F.regexp_extract_all(t, F.lit(SENTENCE_PATTERN), 0)), mark), 0)
        whole = F.split(F.array_join(marked, ""), MARK)
        return F.filter(F.transform(whole, lambda s: F.btrim(s, F.lit(SENTENCE_TRIM))), lambda s: s != F.lit(""))


def learn(docs: DataFrame, text: str = "text") -> Splitter:
    """A splitter from the counts of all texts."""
    every, after = different_tokens(docs, text)
    counts, after = stored(type_counts(every)), stored(after)  # as many rows as there are types and pairs
    short = stored(abbreviations(counts))
    ends = after.where(F.length("before") > 1).join(short.select(F.col("type").alias("before")), "before", "left_anti")
    n_after = ends.groupBy("type").agg(F.sum("c").alias("n_after"))
    found = counts.join(n_after, "type", "left").select("type", "n", F.coalesce("n_after", F.lit(0)).cast("long").alias("n_after"))
    start = [r["type"] for r in _starters(found).orderBy(F.desc("ratio"), "type").collect()]
    return Splitter([r["type"] for r in short.orderBy(F.desc("score"), "type").collect()], start)


#: What the operators that work on sentences take: a column of texts to an array column.
Split = Callable[[Column], Column]
