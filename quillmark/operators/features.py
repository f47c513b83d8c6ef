"""Feature assembly.

Layout: the variants of a record travel *in the record* as
``variants ARRAY<STRUCT<variant_pos INT, text STRING>>`` (built row-locally by the rule
rewriters, or by one pre-aggregating shuffle in ``attach_rewrites``).  All overlap
features are then computed inside the record: the original's n-gram sets are built
once and probed by every variant, and the "pivot" to named per-variant columns is a
position lookup — no groupBy/pivot shuffle.  ``overlap_long`` gives the same counts with one row
per variant.
"""

from __future__ import annotations

from functools import cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import token_count, tokens, words

NGRAM_ORDERS = (1, 2, 3, 4)
MIN_TOKENS, MAX_TOKENS = 5, 20000
#: Largest table of pairs of a gram and a token that grams are looked up in.
MOST_CODES = 1_000_000
_END = (None,)


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("toks", tokens(text)).withColumn("n_tokens", F.size("toks"))


def length_filter(df: DataFrame, lo: int = MIN_TOKENS, hi: int = MAX_TOKENS, text: str = "text") -> DataFrame:
    """Keep lo <= #tokens <= hi.  The predicate counts tokens on the text (a filter on
    ``n_tokens`` is pushed below the projection by inlining it, whatever it costs) and
    names the count once: both bounds are one comparison, as a filter's conjuncts share
    no subexpression."""
    return df.filter(F.abs(2 * token_count(text) - (lo + hi)) <= hi - lo)


def eligible(df: DataFrame, lo: int = MIN_TOKENS, hi: int = MAX_TOKENS, text: str = "text") -> DataFrame:
    """B6 with ``n_tokens`` and the words as ``_w``, split once: for the filter, the count
    and the rewrites.  The words are a generated column, as a filter on any other is pushed
    below it and splits every text again."""
    x = df.select("*", F.explode(F.array(words(text))).alias("_w"))
    n = F.when(F.col("_w").isNotNull(), F.size("_w"))
    return x.filter(F.abs(2 * n - (lo + hi)) <= hi - lo).withColumn("n_tokens", F.size("_w"))


def overlap_long(df: DataFrame, key: str = "doc_id", keep: list[str] | None = None, top: int = NGRAM_ORDERS[-1]) -> DataFrame:
    """One row per (record, variant): ``c1..c4`` = common distinct 1..4-grams between
    the original (``toks``, or ``text``) and the variant, plus ``d1..d4`` = distinct n-grams of the
    original (block 3, equal to its overlap with original + all rewrites).  A variant
    without text keeps its row, with null counts.  ``top`` less than 4: only 1..top-grams.

    The counts of a record come from one call (``_overlap_udf``) and only they are
    exploded: neither the texts nor the original's n-grams are repeated per variant."""
    keep, orders = keep or [], NGRAM_ORDERS[:top]
    v = F.col("variants")
    given = F.transform(F.coalesce(v, F.array().cast(df.schema["variants"].dataType)), lambda x: F.lower(x["text"]))
    own = F.array_join("toks", " ") if "toks" in df.columns else F.lower("text")
    x = df.select(key, *keep, "n_tokens", F.transform(v, lambda x: x["variant_pos"]).alias("_vpos"),
                  _overlap_udf(top)(own, given).alias("ov"))
    z = F.arrays_zip(F.col("_vpos").alias("variant_pos"), *[F.col(f"ov.c{n}").alias(f"c{n}") for n in orders])
    y = x.select(key, *keep, "n_tokens", "ov", F.inline(z))
    return y.select(key, *keep, "n_tokens", "variant_pos", *[f"c{n}" for n in orders],
                    *[F.col(f"ov.d{n}").alias(f"d{n}") for n in orders])


@cache
def _numbers() -> np.ndarray:
    """The table of a process; every entry is -1 between uses."""
    return np.full(MOST_CODES, -1, dtype=np.int64)


def gram_counts(tok: list, others: list[list | None], top: int) -> tuple[list[int], list[list]]:
    """Distinct 1..top-grams of ``tok`` and, per order, how many of them each of ``others``
    holds (None for one that is missing).

    Grams of the original are numbered order by order: one of n tokens is the number of
    its first n - 1 and that of its last token.  A gram of another text counts only if
    those are grams of the original, so others need no numbers of their own: all are
    looked up together, held apart by tokens that nothing has, in a table of all such pairs
    or, if that is larger than ``MOST_CODES``, by search."""
    at = dict.fromkeys(tok)
    at = dict(zip(at, range(len(at))))
    size = len(at)
    one = np.fromiter(map(at.__getitem__, tok), np.int64, len(tok))
    given = [i for i, o in enumerate(others) if o is not None]
    counts = [len(others[i]) + 1 for i in given]
    whose = np.repeat(np.array(given, dtype=np.int64), counts)
    # None, which is no token, ends each text; the last ends suffice for the longest gram
    words = chain.from_iterable(chain(others[i], _END) for i in given)
    first = np.full(len(whose) + top, -1, dtype=np.int64)
    first[:len(whose)] = np.fromiter(map(at.get, words, repeat(-1)), np.int64, len(whose))
    place = np.flatnonzero(first >= 0)  # where their grams that the original has begin
    mine, theirs, n_mine, n_known = one, first[place], size, size
    distinct, common = [], []
    for n in range(1, top + 1):
        if n > 1:
            codes = mine[:-1] * size + one[n - 1:] if len(mine) > 1 else one[:0]
            after = first[place + n - 1]
            place, look = place[after >= 0], (theirs * size + after)[after >= 0]
            if n_mine * size <= MOST_CODES:  # a gram's number is where it stands last
                number, every = _numbers(), np.arange(len(codes))
                number[codes] = every
                mine, theirs = number[codes], number[look]
                number[codes] = -1
                n_mine, n_known = len(codes), int(np.count_nonzero(mine == every))
            else:
                known, mine = np.unique(codes, return_inverse=True)
                n_mine = n_known = len(known)
                at_ = np.minimum(np.searchsorted(known, look), max(n_mine - 1, 0))
                theirs = np.where(known[at_] == look, at_, -1) if n_mine else np.full(len(look), -1, dtype=np.int64)
            place, theirs = place[theirs >= 0], theirs[theirs >= 0]
        held = np.zeros(len(others) * n_mine, dtype=bool)
        held[whose[place] * n_mine + theirs] = True
        shared = np.count_nonzero(held.reshape(len(others), n_mine), axis=1).tolist() if len(others) else []
        distinct.append(n_known)
        common.append([None if o is None else c for o, c in zip(others, shared)])
    return distinct, common


def _overlap_udf(top: int = NGRAM_ORDERS[-1]):
    """Per record: distinct 1..top-gram counts of the original and, per variant, the size
    of the intersection (null for a variant that is null)."""
    orders = NGRAM_ORDERS[:top]
    kind = T.StructType([T.StructField(f"d{n}", T.LongType()) for n in orders]
                        + [T.StructField(f"c{n}", T.ArrayType(T.LongType())) for n in orders])

    @F.pandas_udf(kind)
    def run(text: pd.Series, variants: pd.Series) -> pd.DataFrame:
        out = {f"{k}{n}": [] for k in ("d", "c") for n in orders}
        for t, vs in zip(text, variants):
            ds, cs = gram_counts(t.lower().split() if t is not None else [],
                                 [v.lower().split() if v is not None else None for v in (vs if vs is not None else [])], top)
            for i, n in enumerate(orders):
                out[f"d{n}"].append(ds[i])
                out[f"c{n}"].append(cs[i])
        return pd.DataFrame(out)

    return run


def with_overlap_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``ov`` (struct of d1..d4 and per-variant c1..c4 arrays, in variant order) and
    ``vpos`` (the variants' positions).  A rewrite without text is missing: it is skipped,
    so it neither counts in means nor fills its slot.  Row-local: no shuffle."""
    given = present("variants")
    return df.withColumn("ov", _overlap_udf()(F.col(text), F.transform(given, lambda v: v["text"]))) \
             .withColumn("vpos", F.transform(given, lambda v: v["variant_pos"]))


def present(variants) -> Column:
    """The variants that have a text."""
    v = F.col(variants) if isinstance(variants, str) else variants
    return F.filter(v, lambda x: x["text"].isNotNull())


def overlap_features(df: DataFrame, n_variants: int, key: str = "doc_id",
                     extra: list[str] | None = None) -> DataFrame:
    """G2 blocks 1-3: named columns ``avg_c{n}``, ``c{n}_v{p}`` and ``all_c{n}``, computed
    inside each record (its variants travel with it), so there is no shuffle at all.  A
    variant position that is absent gives null; no variants gives block 1 = 0.0."""
    extra = extra or []
    x = with_overlap_counts(df)
    nt = F.col("n_tokens")
    k = F.size("vpos")
    cols = [key] + extra + ["n_tokens", k.cast("long").alias("n_variants")]
    for n in NGRAM_ORDERS:
        tot = F.aggregate(F.col(f"ov.c{n}"), F.lit(0).cast("long"), lambda a, b: a + b)
        cols.append(F.when(k > 0, tot / k / nt).otherwise(F.lit(0.0)).alias(f"avg_c{n}"))
    for p in range(n_variants):
        idx = F.array_position("vpos", p).cast("int")
        for n in NGRAM_ORDERS:
            cols.append(F.when(idx > 0, F.try_element_at(F.col(f"ov.c{n}"), idx) / nt).alias(f"c{n}_v{p}"))
    cols += [(F.col(f"ov.d{n}") / nt).alias(f"all_c{n}") for n in NGRAM_ORDERS]
    return x.select(*cols)


def per_variant_long(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """G4 in long form: ``(doc_id, variant_pos, r1..r4)`` = common n-grams / #tokens."""
    x = with_overlap_counts(df)
    z = F.arrays_zip(F.col("vpos").alias("variant_pos"),
                     *[F.col(f"ov.c{n}").alias(f"c{n}") for n in NGRAM_ORDERS])
    y = x.select(key, "n_tokens", F.inline(z))
    return y.select(key, "variant_pos",
                    *[(F.col(f"c{n}") / F.col("n_tokens")).alias(f"r{n}") for n in NGRAM_ORDERS])


def summary_common2(df: DataFrame, key: str = "doc_id", legacy_unigrams: bool = False) -> DataFrame:
    """The overlap part of Summary-6 (G1): mean over variants of common unigrams and
    bigrams (raw counts).  ``legacy_unigrams`` keeps the reference's 1-gram-vs-2-gram
    comparison, which is always 0 (a bigram contains a space, a unigram never does).
    Counts that ``df`` already has (``ov``, ``vpos``) are not made again."""
    x = df if "ov" in df.columns else with_overlap_counts(df)
    k = F.size("vpos")

    def mean(arr: Column) -> Column:
        return F.when(k > 0, F.aggregate(arr, F.lit(0).cast("long"), lambda a, b: a + b) / k).otherwise(F.lit(0.0))
    uni = F.transform("vpos", lambda p: F.lit(0).cast("long")) if legacy_unigrams else F.col("ov.c1")
    return x.select(key, mean(uni).alias("common_unigrams"), mean(F.col("ov.c2")).alias("common_bigrams"),
                    k.alias("n_variants"))


def feature_matrix(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """Named feature columns -> ML vector; any null feature is an error (as the
    reference stacks a rectangular matrix)."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=names, outputCol=out, handleInvalid="error")
    return va.transform(df)


def select_features(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Choose features by name; unknown names raise (no silent positional slice)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown feature(s): {missing}")
    return df.select(*(keep or []), *names)


def rescale_features(df: DataFrame, names: list[str], by: float = 100.0) -> DataFrame:
    """Divide the fuzzy block (0..100) by ``by``."""
    return df.withColumns({n: F.col(n) / F.lit(float(by)) for n in names})


def extract_report(df: DataFrame, method: str = "method") -> DataFrame:
    """Processed / skipped counts per embedding method.  ``df`` has one row per
    (method, record) with a boolean ``ok``."""
    return df.groupBy(method).agg(F.count_if(F.col("ok")).alias("processed"),
                                  F.count_if(~F.col("ok")).alias("skipped"))
