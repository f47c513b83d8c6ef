"""Model training and evaluation (I4-I8) with Spark ML.

The models are distributed Spark ML estimators; the only driver loop is over the
(few) domains in ``per_domain_eval``, guarded by one grouped aggregate."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import hkey
from ..session import cut_lineage, spread_rows
from . import metrics as M
from .corpus import dense_index
from .split import standard_scale, stratified_split


def assemble(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="error").transform(df)


def fit_rows(train: DataFrame, names: list[str], label: str = "label", key: str = "doc_id", keep=()) -> DataFrame:
    """The assembled rows, made once for all passes of a fit, in enough partitions."""
    rows = cut_lineage(assemble(train, names).select(*([key] if key in train.columns else []), "features", label, *keep))
    return spread_rows(rows, key).drop(key) if key in train.columns else rows


def train_gbt(train: DataFrame, names: list[str], label: str = "label", max_iter: int = 100, max_depth: int = 6, seed: int = 42, key: str = "doc_id"):
    """I4: gradient-boosted trees (100 rounds of depth 6 unless told otherwise)."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, seed=seed,
                        cacheNodeIds=True, maxMemoryInMB=512)
    return gbt.fit(fit_rows(train, names, label, key))


def train_mlp(train: DataFrame, names: list[str], label: str = "label", hidden=(100, 50),
              max_iter: int = 500, tol: float = 1e-4, seed: int = 42, key: str = "doc_id"):
    """Multilayer perceptron (sigmoid hidden layers, softmax output, L-BFGS): at most
    ``max_iter`` iterations, ended when the loss improves by less than ``tol``."""
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                         layers=[len(names), *hidden, 2], maxIter=max_iter, tol=tol, seed=seed)
    return mlp.fit(fit_rows(train, names, label, key))


def predict(model, df: DataFrame, names: list[str], key: str = "doc_id", label: str = "label") -> DataFrame:
    """``(key, label, prediction INT, score = P(class 1))``."""
    p = model.transform(assemble(df, names))
    return p.select(key, F.col(label).cast("int").alias("label"),
                    F.col("prediction").cast("int").alias("prediction"),
                    vector_to_array("probability")[1].alias("score"))


METRICS_SCHEMA = ("accuracy double, f1 double, auroc double, kl_pq double, kl_qp double, hellinger double, "
                  "n_train long, n_test long, n_test_machine long")


def evaluate(pred: DataFrame, n_train: int | None = None) -> dict:
    """One small metrics row (accuracy, f1, auroc, KL both ways, Hellinger, test counts).
    The model scores the test set once, into a reliable checkpoint that all metrics read."""
    pred = cut_lineage(pred)
    one = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
                   F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n1")).first()
    f = M.f1(pred).first()["f1"]
    u = M.auroc(pred).first()["auroc"]
    k = M.kl_hellinger(pred).first()
    return {"accuracy": one["accuracy"], "f1": f, "auroc": u, "kl_pq": k["kl_pq"] if k else None,
            "kl_qp": k["kl_qp"] if k else None, "hellinger": k["hellinger"] if k else None,
            "n_train": n_train, "n_test": one["n"], "n_test_machine": one["n1"]}


CROSS_SCHEMA = "train_domain string, test_domain string, model string, n_features long, " + METRICS_SCHEMA
DOMAIN_SCHEMA = "domain string, model string, " + METRICS_SCHEMA


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """The ``n`` first rows in md5 order, by bucketed ranks (no task holds the sample)."""
    ranked = dense_index(df.withColumn("_h", hkey(seed, key)), ["_h", key], "_rank")
    return ranked.where(F.col("_rank") < n).drop("_h", "_rank")


def common_features(names_by_domain: dict[str, list[str]], a: str, b: str) -> list[str]:
    """Features that two domains share, in the order of the first."""
    return [n for n in names_by_domain[a] if n in set(names_by_domain[b])]


def cross_domain(df: DataFrame, names, train_domain: str, test_domains, seed: int = 42, key: str = "doc_id"):
    """Fit on one domain, evaluate on a seeded sample of each other domain sized 20 %
    of the training set (capped at the domain's size); boosted trees (10 rounds) and MLP
    (10 hidden, at most 1000 iterations).  ``names``: the features, or a list per domain,
    of which each pair of domains uses the common ones.  One fit per feature list."""
    test_domains = [test_domains] if isinstance(test_domains, str) else list(test_domains)
    per = names if isinstance(names, dict) else {d: list(names) for d in [train_domain, *test_domains]}
    tr = df.filter(F.col("domain") == train_domain)
    n = tr.count()
    rows = []
    lists: dict[tuple, list[str]] = {}
    for d in test_domains:
        lists.setdefault(tuple(common_features(per, train_domain, d)), []).append(d)
    for used, domains in lists.items():
        use = list(used)
        samples = {d: seeded_sample(df.filter(F.col("domain") == d), max(1, int(0.2 * n)), seed, key) for d in domains}
        tr_s, _ = standard_scale(tr, tr.limit(0), use)
        tr_s = cut_lineage(tr_s.select(key, "label", *use))
        models = (("gbt", train_gbt(tr_s, use, max_iter=10, max_depth=6, seed=seed, key=key)),
                  ("mlp", train_mlp(tr_s, use, hidden=(10,), max_iter=1000, seed=seed, key=key)))
        for d in domains:
            _, te_s = standard_scale(tr, samples[d], use)
            for name, model in models:
                rows.append({"train_domain": train_domain, "test_domain": d, "model": name, "n_features": len(use),
                             **evaluate(predict(model, te_s, use, key), n)})
    return rows


def domain_guards(df: DataFrame) -> DataFrame:
    """I8 guards: per domain row count, number of classes and whether it can be trained."""
    g = df.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_classes"))
    return g.withColumn("trainable", (F.col("n") > 0) & (F.col("n_classes") == 2))


def trainable_domains(df: DataFrame) -> list[str]:
    """Names of the domains that pass the guards (few: they are a catalogue)."""
    return sorted(r["domain"] for r in domain_guards(df).where("trainable and domain is not null").collect())


def per_domain_eval(df: DataFrame, names: list[str], seed: int = 42, key: str = "doc_id"):
    """I8: for every trainable domain: stratified 80/20 split, boosted trees on raw
    features and MLP on standardised features; one metrics row per (domain, model)."""
    rows = []
    for dom in trainable_domains(df):
        d = cut_lineage(stratified_split(df.filter(F.col("domain") == dom), "label", 0.2, seed, key))
        tr, te = d.filter(~F.col("is_test")), d.filter(F.col("is_test"))
        g = train_gbt(tr, names, seed=seed, key=key)
        n = tr.count()
        rows.append({"domain": dom, "model": "gbt", **evaluate(predict(g, te, names, key), n)})
        tr_s, te_s = standard_scale(tr, te, names)
        m = train_mlp(tr_s, names, seed=seed, key=key)
        rows.append({"domain": dom, "model": "mlp", **evaluate(predict(m, te_s, names, key), n)})
    return rows
