"""Train/test splits and scaling (I1-I3).  Splits are functions of md5(seed-key), so
they are stable under repartitioning and task retries (unlike ``randomSplit``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import hkey, u01
from .corpus import dense_index, join_null_safe


def random_split(df: DataFrame, test_fraction: float = 0.2, seed=42, key: str = "doc_id"):
    """Scan-only split (no exchange)."""
    flag = u01(seed, key) < F.lit(float(test_fraction))
    return df.filter(~flag), df.filter(flag)


def stratified_split(df: DataFrame, label: str = "label", test_fraction: float = 0.2, seed=42,
                     key: str = "doc_id", by=()) -> DataFrame:
    """Adds ``is_test``: per (by, label) the first round(f * n) rows in md5 order.
    Ranking uses the bucketed dense index, so a large class is not sorted in one task."""
    by = [by] if isinstance(by, str) else list(by)
    grp = [*by, label]
    x = df.withColumn("_h", hkey(seed, key))
    n = x.groupBy(*grp).agg(F.count("*").alias("_cnt"))
    x = dense_index(x, ["_h", key], "_rank", by=grp, start=1)
    return (join_null_safe(x, n, grp)
            .withColumn("is_test", F.col("_rank") <= F.round(F.col("_cnt") * F.lit(float(test_fraction))))
            .drop("_h", "_rank", "_cnt"))


def scaler_stats(train: DataFrame, cols: list[str], by=()) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return train.groupBy(*by).agg(*aggs)


def standard_scale(train: DataFrame, test: DataFrame, cols: list[str], by=()):
    """Fit mean / population std on train (per ``by``), apply to train and test;
    zero variance scales by 1.  The statistics table has one row per group; it is joined
    null-safe (a null group is a group) and left to the optimizer, which broadcasts it
    only if it is small.  Without ``by`` the statistics are scalar subqueries."""
    by = [by] if isinstance(by, str) else list(by)
    st = scaler_stats(train, cols, by)

    def apply(d: DataFrame) -> DataFrame:
        if by:
            j = join_null_safe(d, st, by)
        else:  # one row of statistics as one scalar subquery
            one = st.select(F.struct(*st.columns)).scalar()
            j = d.withColumn("_st", one)
        at = (lambda c: F.col(c)) if by else (lambda c: F.col("_st")[c])
        scaled = {c: (F.col(c) - at(f"{c}__mean")) / F.when(at(f"{c}__std") == 0, F.lit(1.0)).otherwise(at(f"{c}__std")) for c in cols}
        return j.withColumns(scaled).drop("_st", *[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])
    return apply(train), apply(test)
