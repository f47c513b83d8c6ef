"""Corpus operators: projections, filters, limits (B1-B7) and joins / set operations /
ordering (C1, C2, C5-C7)."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.sampling import hkey
from ..functions.text import truncate_chars, truncate_tokens


def label_from_source(c="source") -> Column:
    """Human -> 0, anything else (including null) -> 1."""
    s = F.col(c) if isinstance(c, str) else c
    return F.when(s == "human", F.lit(0)).otherwise(F.lit(1))


def core_fields(df: DataFrame, key: str = "doc_id", code: bool = False) -> DataFrame:
    """B1: keep key, text and source; the code domain prefixes the implementation."""
    text = (F.concat(F.lit("Implementation: "), F.col("implementation")) if code else F.col("text"))
    return df.select(key, text.alias("text"), "source")


def coalesce_text(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """B2: explanation+implementation when non-empty, else text; source default 'unknown'."""
    ei = F.concat(F.coalesce("explanation", F.lit("")), F.coalesce("implementation", F.lit("")))
    text = F.coalesce(F.when(ei != "", ei), F.col("text"), F.lit(""))
    return df.select(key, text.alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"))


def truncate_text(df: DataFrame, n: int = 1024, unit: str = "tokens", text: str = "text") -> DataFrame:
    """The extraction-time input cut (whitespace tokens, or characters)."""
    cut = truncate_tokens(text, n) if unit == "tokens" else truncate_chars(text, n)
    return df.withColumn(text, cut)


def truncate_bpe(df: DataFrame, ranks_file: str, pattern: str, n: int = 1024, text: str = "text") -> DataFrame:
    """The text of the first ``n`` byte-level BPE tokens, by a local rank file and its
    split pattern; a character whose bytes are cut is left out whole.  Matches of the
    pattern are encoded one by one until ``n`` tokens are there, so the rest of a long
    text is not looked at.  A null text stays null."""
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe
    bound = df.sparkSession.sparkContext.broadcast((load_tiktoken_bpe(ranks_file), pattern))
    state: dict = {}

    def cut(value: str | None) -> str | None:
        if not value:
            return value
        if not state:
            ranks, split = bound.value
            state["enc"] = tiktoken.Encoding("local", pat_str=split, mergeable_ranks=ranks, special_tokens={})
            state["split"] = regex.compile(split)
        ids: list[int] = []
        for match in state["split"].finditer(value):
            ids += state["enc"].encode_ordinary(match.group())
            if len(ids) >= n:
                return state["enc"].decode_bytes(ids[:n]).decode("utf-8", "ignore")
        return value

    @F.pandas_udf("string")
    def first(values: pd.Series) -> pd.Series:
        return values.map(cut, na_action="ignore")

    return df.withColumn(text, first(F.col(text)))


def drop_missing(df: DataFrame, cols=("source", "text"), counts: Observation | None = None) -> DataFrame:
    """Drop rows with a null column, and null/blank text.  ``counts`` gets ``n_kept``
    and, by the first reason that applies, ``n_no_<column>`` and ``n_blank_text`` in the
    same pass."""
    reason = F.lit(None).cast("string")
    reasons = []
    for c in reversed(list(cols)):
        if c == "text":
            reason = F.when(F.trim(F.col(c)) == "", "blank_text").otherwise(reason)
            reasons.append("blank_text")
        reason = F.when(F.col(c).isNull(), f"no_{c}").otherwise(reason)
        reasons.append(f"no_{c}")
    if counts is not None:
        df = df.observe(counts, F.count_if(reason.isNull()).alias("n_kept"), *[F.count_if(reason == r).alias(f"n_{r}") for r in reasons])
    return df.filter(reason.isNull())


def first_n(df: DataFrame, n: int, by: str = "doc_id") -> DataFrame:
    """The first n records in key order (TakeOrderedAndProject: each partition keeps
    its top n, the merge sees at most partitions*n rows)."""
    return df.orderBy(by).limit(n)


def align_features(records: DataFrame, features: DataFrame, key: str = "doc_id"):
    """Records zipped with their feature rows by key (not by position).  Returns the
    aligned rows and a one-row report of unmatched counts on either side."""
    aligned = records.join(features, key, "inner")
    r = records.select(key, F.lit(1).alias("_r"))
    f = features.select(key, F.lit(1).alias("_f"))
    rep = (r.join(f, key, "full_outer")
           .agg(F.count_if(F.col("_r").isNull()).alias("features_only"),
                F.count_if(F.col("_f").isNull()).alias("records_only"),
                F.count_if(F.col("_r").isNotNull() & F.col("_f").isNotNull()).alias("matched")))
    return aligned, rep


def pending_docs(df: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Records not processed yet (left anti join; resume by key, not by count)."""
    return df.join(done.select(key), key, "left_anti")


def union_sources(*dfs: DataFrame) -> DataFrame:
    """C5."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def shuffle_rows(df: DataFrame, seed, key: str = "doc_id") -> DataFrame:
    """Seeded shuffle = order by md5(seed-key)."""
    return df.withColumn("_h", hkey(seed, key)).orderBy("_h", key).drop("_h")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys of ``left`` stay."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def dense_index(df: DataFrame, order_cols: list[str], out: str = "idx",
                bucket: Column | None = None, start: int = 0, by=()) -> DataFrame:
    """Dense index in ``order_cols`` order (within ``by`` groups) without one window
    over a whole group.

    Rows are cut into buckets that follow the order (``bucket`` must be monotone in the
    order; default: the first 4 hex digits of the first order column, for md5 keys).
    Each (group, bucket) is numbered by its own window (bounded by the bucket size), the
    bucket sizes (at most 65,536 per group) get a running total, and that offset is
    added back with a null-safe join on (group, bucket): rows with a null group or order
    key are numbered too."""
    by = [by] if isinstance(by, str) else list(by)
    b = bucket if bucket is not None else F.substring(F.col(order_cols[0]), 1, 4)
    x = df.withColumn("_b", b)
    counts = x.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    offs = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    w = Window.partitionBy(*by, "_b").orderBy(*order_cols)
    x = x.withColumn("_rn", F.row_number().over(w))
    return (join_null_safe(x, offs, [*by, "_b"])
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1 + start).cast("long"))
            .drop("_b", "_rn", "_off"))


def reindex(df: DataFrame, seed, key: str = "doc_id", out: str = "new_index") -> DataFrame:
    """C6 + C7: seeded shuffle then a dense 0-based index."""
    x = df.withColumn("_h", hkey(seed, key))
    return dense_index(x, ["_h", key], out).drop("_h")
