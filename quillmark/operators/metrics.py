"""Evaluation metrics (J1-J12) as aggregates over a predictions table
``(by..., label INT, score DOUBLE, prediction INT)``.  Every metric is a grouped
aggregate with partial (map-side) aggregation; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .corpus import join_null_safe

EPS = 1e-10


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def confusion_counts(pred: DataFrame, by=()) -> DataFrame:
    """TN, FP, FN, TP (class 1 = machine-written is positive)."""
    l, p = F.col("label"), F.col("prediction")
    return pred.groupBy(*_by(by)).agg(
        F.count_if((l == 0) & (p == 0)).cast("long").alias("tn"),
        F.count_if((l == 0) & (p == 1)).cast("long").alias("fp"),
        F.count_if((l == 1) & (p == 0)).cast("long").alias("fn"),
        F.count_if((l == 1) & (p == 1)).cast("long").alias("tp"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def accuracy(pred: DataFrame, by=()) -> DataFrame:
    """J1."""
    return pred.groupBy(*_by(by)).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def f1(pred: DataFrame, by=()) -> DataFrame:
    """F1 of class 1; 0.0 when undefined."""
    c = confusion_counts(pred, by)
    return c.select(*_by(by), _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
                    .alias("f1"))


def classification_report(pred: DataFrame, by=(), names=("human", "GPT")) -> DataFrame:
    """Precision / recall / F1 / support per class, accuracy, macro and weighted
    averages (zero-division -> 0.0), as rows ``(by..., row, precision, recall, f1, support)``."""
    b = _by(by)
    c = confusion_counts(pred, b)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def cls(name, t, fpos, fneg, support):
        prec = _safe_div(t, t + fpos)
        rec = _safe_div(t, t + fneg)
        return F.struct(F.lit(name).alias("row"), prec.alias("precision"), rec.alias("recall"),
                        _safe_div(2 * prec * rec, prec + rec).alias("f1"),
                        support.cast("long").alias("support"))

    c0 = cls(names[0], tn, fn, fp, tn + fp)
    c1 = cls(names[1], tp, fp, fn, tp + fn)
    x = c.select(*b, c0.alias("c0"), c1.alias("c1"), n.alias("n"), ((tn + tp) / n).alias("acc"))
    acc = F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                   F.col("n").cast("long").alias("support"))

    def avg_row(name, w0, w1):
        return F.struct(
            F.lit(name).alias("row"),
            *[((F.col(f"c0.{m}") * w0 + F.col(f"c1.{m}") * w1)).alias(m)
              for m in ("precision", "recall", "f1")],
            F.col("n").cast("long").alias("support"))

    macro = avg_row("macro avg", F.lit(0.5), F.lit(0.5))
    weighted = avg_row("weighted avg", F.col("c0.support") / F.col("n"), F.col("c1.support") / F.col("n"))
    return x.select(*b, F.inline(F.array("c0", "c1", acc, macro, weighted)))


def auroc(pred: DataFrame, by=(), buckets: int = 128) -> DataFrame:
    """Area under the ROC curve from ``score`` (ties count one half).

    Rank-sum form: sum over positives of (#negatives with a lower score + half the tied
    negatives) / (P*N).  Scores are first aggregated per distinct value (a hot score is
    one row), the running count of negatives is computed per score bucket (bounded window
    partitions) plus a running offset over the small bucket-total table — never one
    window over all rows.  Buckets are cut at quantiles of the distinct scores, so scores
    of any range and any crowding spread over them; rows without a score or label are left
    out, a null group is a group."""
    b = _by(by)
    pred = pred.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    # one row per distinct score, stored: the cuts, the totals and the ranks read it, and the
    # predictions are computed once
    per_score = stored(pred.groupBy(*b, "score").agg(
        F.count_if(F.col("label") == 1).alias("npos"), F.count_if(F.col("label") == 0).alias("nneg")))
    cuts = per_score.agg(F.approx_percentile("score", [i / buckets for i in range(1, buckets)], 10_000)).scalar()
    per_score = per_score.withColumn("_cuts", F.coalesce(cuts, F.array().cast("array<double>")))
    # number of cuts below the score: monotone in the score
    per_score = per_score.withColumn("_bk", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    tot = per_score.groupBy(*b, "_bk").agg(F.sum("nneg").alias("_bn"))
    wb = Window.partitionBy(*b).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", F.coalesce(F.sum("_bn").over(wb), F.lit(0))).drop("_bn")
    ws = Window.partitionBy(*b, "_bk").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    x = per_score.withColumn("_below", F.coalesce(F.sum("nneg").over(ws), F.lit(0)))
    x = join_null_safe(x, tot, [*b, "_bk"])
    x = x.withColumn("_u", F.col("npos") * (F.col("_off") + F.col("_below") + F.col("nneg") / 2.0))
    agg = x.groupBy(*b).agg(F.sum("_u").alias("u"), F.sum("npos").alias("p"), F.sum("nneg").alias("n"))
    return agg.select(*b, F.when((F.col("p") > 0) & (F.col("n") > 0),
                                 F.col("u") / (F.col("p") * F.col("n"))).alias("auroc"))


def score_bin(s: Column, bins: int) -> Column:
    """Bin index with the edges of ``linspace(0, 1, bins+1)`` in floating point: the
    first guess floor(s*bins) is corrected against the edges k*(1/bins); the last bin is
    closed."""
    step = 1.0 / bins
    i0 = F.least(F.floor(s * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    i1 = F.when(s < i0 * F.lit(step), i0 - 1).otherwise(i0)
    return F.when((s >= (i1 + 1) * F.lit(step)) & (i1 != bins - 1), i1 + 1).otherwise(i1)


def score_histogram(pred: DataFrame, by=(), bins: int = 20) -> DataFrame:
    """Per-class density histogram on [0, 1], zero-filled:
    ``(by..., label, bin, count, density)``.  A linear plan: one count per (group,
    class, bin) over the predictions, one small aggregate per (group, class) holding its
    bin -> count map and total, then the fixed bin list is exploded — no join, no
    second pass over the predictions."""
    b = _by(by)
    step = 1.0 / bins
    # the range test stays inside the grouping key (a filter on ``score`` would be pushed
    # below its projection and re-evaluate it); out-of-range rows get a null bin
    s = F.col("score")
    key = F.when((s >= 0) & (s <= 1), score_bin(s, bins))
    counts = pred.groupBy(*b, "label", key.alias("bin")).agg(F.count("*").alias("count"))
    # null bins are dropped inside the aggregate (a filter on the grouping key would be
    # pushed down to the scan and re-evaluate the score there)
    inr = F.col("bin").isNotNull()
    per = counts.groupBy(*b, "label").agg(
        F.map_from_entries(F.collect_list(F.when(inr, F.struct("bin", "count")))).alias("_m"),
        F.sum(F.when(inr, F.col("count"))).alias("n"))
    per = per.filter(F.col("n").isNotNull())
    full = per.select(*b, "label", "n", "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    c = F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0))
    width = (F.col("bin") + 1) * F.lit(step) - F.col("bin") * F.lit(step)
    return full.select(*b, "label", "bin", c.cast("long").alias("count"),
                       (c / (F.col("n") * width)).alias("density"))


def distribution_distances(dist: DataFrame, by=(), p: str = "p", q: str = "q",
                           eps_mode: str = "before") -> DataFrame:
    """KL(P||Q), KL(Q||P) and Hellinger over rows ``(by..., p, q)``.

    ``before``: clip at 0, add eps, normalise (the histogram / multi-plot form).
    ``after``: normalise, add eps; KL renormalises, Hellinger does not (single plot)."""
    b = _by(by)
    def floor0(c):  # greatest() skips nulls; a missing density stays missing
        return F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))
    x = dist.select(*b, floor0(p).alias("p"), floor0(q).alias("q"))
    w = Window.partitionBy(*b)
    if eps_mode == "before":
        x = x.select(*b, ((F.col("p") + EPS) / F.sum(F.col("p") + EPS).over(w)).alias("p"),
                     ((F.col("q") + EPS) / F.sum(F.col("q") + EPS).over(w)).alias("q"))
        x = x.withColumns({"pk": F.col("p"), "qk": F.col("q")})
    elif eps_mode == "after":
        x = x.select(*b, (F.col("p") / F.sum("p").over(w) + EPS).alias("p"),
                     (F.col("q") / F.sum("q").over(w) + EPS).alias("q"))
        x = x.select(*b, "p", "q", (F.col("p") / F.sum("p").over(w)).alias("pk"),
                     (F.col("q") / F.sum("q").over(w)).alias("qk"))
    else:
        raise ValueError(eps_mode)
    return x.groupBy(*b).agg(
        F.sum(F.col("pk") * F.log(F.col("pk") / F.col("qk"))).alias("kl_pq"),
        F.sum(F.col("qk") * F.log(F.col("qk") / F.col("pk"))).alias("kl_qp"),
        (F.sqrt(F.sum(F.pow(F.sqrt("p") - F.sqrt("q"), 2))) / F.sqrt(F.lit(2.0))).alias("hellinger"))


def kl_hellinger(pred: DataFrame, by=(), bins: int = 20) -> DataFrame:
    """J6+J7+J8: distances between the class-0 and class-1 score histograms; groups
    with an empty class give nulls (as the reference returns None).  The two classes are
    put side by side with one conditional aggregate (no self-join)."""
    b = _by(by)
    h = score_histogram(pred, b, bins)
    pq = h.groupBy(*b, "bin").agg(
        F.sum(F.when(F.col("label") == 0, F.col("density"))).alias("p"),
        F.sum(F.when(F.col("label") == 1, F.col("density"))).alias("q"))
    if not b:
        return distribution_distances(pq.filter(F.col("p").isNotNull() & F.col("q").isNotNull()), b)
    # a class without scores in range has no density: its sums, and so the distances, are null
    return distribution_distances(pq, b)


# -- retrieval metrics (J10-J12) ---------------------------------------------------------

def recall_at_k(ranks: DataFrame, ks=(8, 16, 32, 64), legacy_offset: bool = False) -> DataFrame:
    """Share of queries whose 1-based rank is <= k (``legacy_offset``: the
    reference's zero-based comparison, i.e. rank <= k+1).  Null ranks count as misses."""
    off = 1 if legacy_offset else 0
    return ranks.agg(*[F.avg(F.coalesce((F.col("rank") <= k + off).cast("double"), F.lit(0.0)))
                       .alias(f"r_at_{k}") for k in ks])


def mrr(ranks: DataFrame) -> DataFrame:
    """Mean reciprocal rank (null rank contributes 0)."""
    return ranks.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def collect_outputs(batches: DataFrame) -> DataFrame:
    """Flatten batched ``(author ARRAY, embedding ARRAY<ARRAY>)`` outputs."""
    return batches.select(F.inline(F.arrays_zip(F.col("author").alias("author"),
                                                F.col("embedding").alias("embedding"))))
