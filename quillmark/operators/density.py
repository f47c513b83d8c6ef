"""Explainability tables (K1-K5): 2-D projection, evaluation grid, Gaussian KDE per
class, density distances and a plot-ready scatter table.

The KDE is evaluated as partial sums: every task takes its own points, adds their
kernel values onto the (bounded, ``n x n``) grid with numpy, and emits one partial row
per grid cell; a grouped sum merges the partials.  No point x cell pair is ever a row,
and only per-class statistics (a handful of numbers per group) go to the tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import distribution_distances


def project2d(df: DataFrame, cols: list[str], k: int = 2, out: str = "xy") -> DataFrame:
    """K1 (re-aimed from UMAP): PCA to ``k`` components of the standardised feature
    columns.  A record with a missing feature is kept with a null projection.  Signs are
    fixed: the loading of largest size of every component is positive."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from .split import scaler_stats
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    st = scaler_stats(df.where(whole), cols).select(F.struct("*")).scalar()
    x = df.withColumn("_st", st)
    z = [(F.col(c) - F.col("_st")[f"{c}__mean"]) / F.when(F.col("_st")[f"{c}__std"] == 0, F.lit(1.0)).otherwise(F.col("_st")[f"{c}__std"]) for c in cols]
    x = x.withColumn("_z", F.when(whole, F.array(*z))).drop("_st")
    fitted = PCA(k=k, inputCol="_f", outputCol="_p").fit(x.where("_z is not null").select(array_to_vector("_z").alias("_f")))
    load = fitted.pc.toArray()                         # features x k
    load = load * np.where(load[np.abs(load).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    comp = [F.aggregate(F.zip_with("_z", F.array(*map(F.lit, load[:, j].tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for j in range(k)]
    return x.withColumn(out, F.when(F.col("_z").isNotNull(), F.array(*comp))).drop("_z")


def project_domains(df: DataFrame, cols: list[str], domains: list[str], by: str = "domain", k: int = 2, out: str = "xy") -> DataFrame:
    """K1 per domain: each domain standardised and projected on its own."""
    parts = [project2d(df.where(F.col(by) == d), cols, k, out) for d in domains]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def grid_axis(lo: F.Column, hi: F.Column, k: F.Column, n: int) -> F.Column:
    """numpy.linspace(lo, hi, n)[k] (last point is ``hi`` exactly)."""
    step = (hi - lo) / F.lit(float(n - 1))
    return F.when(k == n - 1, hi).otherwise(lo + k.cast("double") * step)


def eval_grid(points: DataFrame, by, n: int = 150, pad: float = 0.1) -> DataFrame:
    """K2: ``n x n`` grid over the data range +- ``pad`` per group:
    ``(by..., cell, gx, gy, x, y)`` with cell = gy*n + gx (row-major as meshgrid)."""
    b = [by] if isinstance(by, str) else list(by)
    rng = points.groupBy(*b).agg((F.min("x") - pad).alias("x0"), (F.max("x") + pad).alias("x1"),
                                 (F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1"))
    ax = F.sequence(F.lit(0), F.lit(n - 1))
    g = rng.select(*b, "x0", "x1", "y0", "y1", F.explode(ax).alias("gy")).select(
        "*", F.explode(ax).alias("gx"))
    return g.select(*b, (F.col("gy") * n + F.col("gx")).alias("cell"), "gx", "gy",
                    grid_axis(F.col("x0"), F.col("x1"), F.col("gx"), n).alias("x"),
                    grid_axis(F.col("y0"), F.col("y1"), F.col("gy"), n).alias("y"))


def kde_stats(points: DataFrame, by, cls: str = "label") -> DataFrame:
    """Per (group, class): n, bandwidth covariance (sample covariance x n^(-1/3), i.e.
    Scott's factor n^(-1/6) squared) and its inverse / normaliser.  Classes with < 2
    points or a singular covariance are dropped."""
    b = [by] if isinstance(by, str) else list(by)
    st = points.groupBy(*b, cls).agg(F.count("*").alias("n"), F.var_samp("x").alias("vxx"),
                                     F.var_samp("y").alias("vyy"), F.covar_samp("x", "y").alias("vxy"))
    f2 = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    st = st.select(*b, cls, "n", (F.col("vxx") * f2).alias("a"), (F.col("vxy") * f2).alias("c"),
                   (F.col("vyy") * f2).alias("d"))
    det = F.col("a") * F.col("d") - F.col("c") * F.col("c")
    st = st.withColumn("det", det).filter((F.col("n") >= 2) & (F.col("det") > 0))
    return st.select(*b, cls, "n", (F.col("d") / F.col("det")).alias("ia"), (-F.col("c") / F.col("det")).alias("ic"),
                     (F.col("a") / F.col("det")).alias("id"),
                     (F.col("n") * F.sqrt(F.lit((2 * math.pi) ** 2) * F.col("det"))).alias("norm"))


def kde2d(points: DataFrame, by: str, cls: str = "label", n: int = 150, pad: float = 0.1,
          chunk: int = 256) -> DataFrame:
    """K3: Gaussian KDE of each (group, class) evaluated on its group's K2 grid:
    ``(by, cls, cell, x, y, density)``.  The tasks rebuild the grid from four range
    numbers per group, so only per-group / per-class statistics leave the executors."""
    # the points feed three jobs (statistics, partial sums, grid); keep their plan from
    # being re-run: a cache (recomputed from lineage if an executor is lost)
    points = points.select(by, cls, "x", "y").cache()
    st = kde_stats(points, by, cls)
    rng = points.groupBy(by).agg((F.min("x") - pad).alias("x0"), (F.max("x") + pad).alias("x1"),
                                 (F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1"))
    params = {}
    for r in st.collect():                      # one row per (group, class)
        params.setdefault(r[by], {})[r[cls]] = (r["ia"], r["ic"], r["id"])
    ranges = {r[by]: (r["x0"], r["x1"], r["y0"], r["y1"]) for r in rng.collect()}   # one row per group
    by_type = points.schema[by].dataType.simpleString()
    cls_type = points.schema[cls].dataType.simpleString()

    def axis(lo, hi):
        step = (hi - lo) / float(n - 1)
        v = np.arange(n, dtype=np.float64) * step + lo
        v[-1] = hi
        return v

    def run(batches):
        grids, sums = {}, {}
        for pdf in batches:
            for (g, c), sub in pdf.groupby([by, cls], sort=False):
                if g not in params or c not in params[g] or g not in ranges:
                    continue
                if g not in grids:
                    x0, x1, y0, y1 = ranges[g]
                    gx, gy = np.meshgrid(axis(x0, x1), axis(y0, y1))
                    grids[g] = (gx.ravel(), gy.ravel())
                ia, ic, idd = params[g][c]
                gx, gy = grids[g]
                acc = sums.setdefault((g, c), np.zeros(len(gx)))
                px, py = sub["x"].to_numpy(float), sub["y"].to_numpy(float)
                for s in range(0, len(px), chunk):
                    dx = gx[None, :] - px[s:s + chunk, None]
                    dy = gy[None, :] - py[s:s + chunk, None]
                    q = ia * dx * dx + 2.0 * ic * dx * dy + idd * dy * dy
                    acc += np.exp(-0.5 * q).sum(axis=0)
        for (g, c), acc in sums.items():  # one row per cell and task
            yield pd.DataFrame({by: g, cls: c, "cell": np.arange(len(acc), dtype=np.int64), "part": acc})
    parts = points.select(by, cls, "x", "y").mapInPandas(
        run, f"`{by}` {by_type}, `{cls}` {cls_type}, cell long, part double")
    summed = parts.groupBy(by, cls, "cell").agg(F.sum("part").alias("s"))
    grid = eval_grid(points, by, n, pad)
    return (summed.join(st.select(by, cls, "norm"), [by, cls])
            .join(grid.select(by, "cell", "x", "y"), [by, "cell"])
            .select(by, cls, "cell", "x", "y", (F.col("s") / F.col("norm")).alias("density")))


def density_distance(kde: DataFrame, by: str, cls: str = "label", eps_mode: str = "before") -> DataFrame:
    """K4: KL both ways and Hellinger between the class-0 and class-1 grid densities; the
    classes meet in one conditional aggregate."""
    pq = kde.groupBy(by, "cell").agg(F.max(F.when(F.col(cls) == 0, F.col("density"))).alias("p"),
                                     F.max(F.when(F.col(cls) == 1, F.col("density"))).alias("q"))
    return distribution_distances(pq.where("p is not null and q is not null"), by, eps_mode=eps_mode)


def scatter_table(points: DataFrame, by: str, cls: str = "label", names=("human", "GPT")) -> DataFrame:
    """K5: plot-ready per-class counts with display names; ``complete`` flags groups that
    have both classes."""
    c = points.groupBy(by, cls).agg(F.count("*").alias("n"))
    name = F.when(F.col(cls) == 0, F.lit(names[0])).otherwise(F.lit(names[1]))
    from pyspark.sql import Window
    both = F.count("*").over(Window.partitionBy(by)) == 2
    return c.select(by, cls, name.alias("label_name"), F.col("n").cast("long"), both.alias("complete"))


#: Display names, colours and title of the scatter plot.
NAMES = ("Human", "GPT")
COLOURS = ("forestgreen", "firebrick")
TITLE = "2D UMAP Projection of Text Embeddings by Source"


def scatter_points(places: DataFrame, labels: DataFrame, key: str = "doc_id", cls: str = "label", title: str = TITLE) -> DataFrame:
    """K5: plot-ready points of ``(key, x, y)`` with the name and colour of their class and
    the title; ``mismatch`` tells what a record lacks (``no_label``, ``no_point``, else
    null).  One full join on the key; a key with several labels gives a point for each."""
    p = places.select(key, "x", "y", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("_placed"))
    c = labels.select(key, cls)
    x = p.join(c, key, "full_outer")
    first = F.col(cls) == 0
    lacks = F.when(F.col(cls).isNull(), "no_label").when(~F.coalesce("_placed", F.lit(False)), "no_point")
    pick = lambda pair: F.when(F.col(cls).isNotNull(), F.when(first, pair[0]).otherwise(pair[1]))
    return x.select(key, "x", "y", cls, pick(NAMES).alias("name"), pick(COLOURS).alias("colour"), F.lit(title).alias("title"), lacks.alias("mismatch"))
