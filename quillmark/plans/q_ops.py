"""Registered queries: models (I4-I8), streaming (L1) and sources / sinks.
Outputs of models depend on library numerics, so these carry no SQL oracle (rows only),
except A8 which is a plain union."""

from __future__ import annotations

import os
import uuid
from urllib.parse import quote

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import features as G
from ..operators import models as ML
from ..operators.variants import RULES, rule_variants
from ..session import checkpoint_dir, cut_lineage, spread
from ..sources import io as IO
from ..sources.tables import corpus, table
from ..streaming.features import batch_features, stream_features
from . import sqlfrag as S
from .q_eval import STRAT_SQL
from .q_text import _wide_sql
from .q_vectors import _u01_sql
from .registry import r6, register

NAMES = [f"avg_c{n}" for n in range(1, 5)] + [f"all_c{n}" for n in range(1, 5)] + \
    [f"c{n}_v{p}" for p in range(len(RULES)) for n in range(1, 5)]


def _scratch(spark, tag: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local
    temporary folder on a cluster)."""
    return os.path.join(checkpoint_dir(spark), "quillmark", f"{tag}-{uuid.uuid4().hex}")


def feature_rows(spark, sf_dir, of=None):
    """``doc_id, domain`` and all features of every eligible document, row-locally; with
    ``of (doc_id)``, of those documents."""
    c = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain")), "doc_id")
    c = c if of is None else c.join(of, "doc_id", "left_semi")
    x = rule_variants(G.eligible(c))
    return G.overlap_features(x, len(RULES), extra=["domain"])


def model_table(spark, sf_dir):
    """Features of the documents that have a label, then the labels: only narrow rows are
    joined, and no text is rewritten that the join would drop."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 0).otherwise(1).alias("label"))
    f = feature_rows(spark, sf_dir, lab.select("doc_id")).join(lab, "doc_id")
    # iterative fitting re-reads its input many times: cut the text plan off with a
    # reliable checkpoint in the shared checkpoint folder
    return cut_lineage(f)


@register("gbt", "I4+I6")
def q_gbt(spark, sf_dir):
    from ..operators.split import stratified_split
    d = stratified_split(model_table(spark, sf_dir), "label", 0.2, 42, by="domain")
    m = ML.train_gbt(d.filter(~F.col("is_test")), NAMES)
    return ML.predict(m, d.filter(F.col("is_test")), NAMES)


@register("mlp", "I5+I6")
def q_mlp(spark, sf_dir):
    from ..operators.split import standard_scale, stratified_split
    d = stratified_split(model_table(spark, sf_dir), "label", 0.2, 42, by="domain")
    tr, te = standard_scale(d.filter(~F.col("is_test")), d.filter(F.col("is_test")), NAMES)
    m = ML.train_mlp(tr, NAMES)
    return ML.predict(m, te, NAMES)


MODEL_SQL = f"""pr AS (SELECT doc_id, lang AS domain, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS label FROM documents JOIN labels USING (doc_id)
       WHERE len({S.tokens('text')}) BETWEEN {G.MIN_TOKENS} AND {G.MAX_TOKENS})"""


@register("mlp_early", "I5 early stopping", f"""WITH {MODEL_SQL}, {STRAT_SQL},
h AS (SELECT is_test, {_u01_sql(42, "'held'", 'doc_id')} < 0.1 AS held FROM st)
SELECT CAST(count_if(NOT is_test AND NOT held) AS BIGINT) AS n_fit, CAST(count_if(NOT is_test AND held) AS BIGINT) AS n_held,
       CAST(count_if(is_test) AS BIGINT) AS n_test, true AS best_kept, true AS within_cap FROM h""")
def q_mlp_early(spark, sf_dir):
    """Facts of a fit that stops early: rows it fits and judges on, that the kept weights
    are those of the best round (by the accuracy of the model returned), and the cap."""
    from ..operators import early_stop as ES
    from ..operators.split import standard_scale, stratified_split
    d = cut_lineage(stratified_split(model_table(spark, sf_dir), "label", 0.2, 42, by="domain"))
    tr, te = standard_scale(d.filter(~F.col("is_test")), d.filter(F.col("is_test")), NAMES)
    e = ES.train_mlp_early(tr, NAMES, step=20, max_iter=200, patience=3)
    p = ML.predict(e.model, ES.held_out(tr).where("held").drop("held"), NAMES).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a"))
    return p.crossJoin(te.agg(F.count(F.lit(1)).alias("n_test"))).select(
        F.lit(e.n_fit).cast("long").alias("n_fit"), F.lit(e.n_held).cast("long").alias("n_held"), "n_test",
        (F.coalesce(F.abs(F.col("a") - e.accuracies[e.best]), F.lit(0.0)) < 1e-9).alias("best_kept"), F.lit(len(e.accuracies) * 20 <= 200).alias("within_cap"))


@register("cross_domain", "I7")
def q_cross_domain(spark, sf_dir):
    d = model_table(spark, sf_dir)
    domains = ML.trainable_domains(d)   # a catalogue of few names
    rows = [r for a in domains for r in ML.cross_domain(d, NAMES, a, [b for b in domains if b != a])]
    return spark.createDataFrame(rows, ML.CROSS_SCHEMA)


@register("per_domain_eval", "I8")
def q_per_domain_eval(spark, sf_dir):
    d = model_table(spark, sf_dir)
    return spark.createDataFrame(ML.per_domain_eval(d, NAMES), ML.DOMAIN_SCHEMA)


def _streamed(spark, sf_dir):
    base = _scratch(spark, "stream")
    # the table is one file or a folder of files: a pattern matches both, while a plain path
    # must be a folder
    q = stream_features(spark, f"{sf_dir.rstrip('/')}/documents.parque[t]", f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


def _rounded(f):
    return f.select(*[F.col(c) if c == "doc_id" else F.col(c).cast("long") if c in ("n_tokens", "n_variants") else r6(c).alias(c) for c in f.columns])


@register("stream", "L1", _wide_sql())
def q_stream(spark, sf_dir):
    return _rounded(_streamed(spark, sf_dir))


@register("stream_equals_batch", "L1 check", f"SELECT * FROM ({_wide_sql()}) WHERE false")
def q_stream_equals_batch(spark, sf_dir):
    """Rows where the streamed features differ from the batch run (expected: none)."""
    s = _streamed(spark, sf_dir)
    b = batch_features(table(spark, sf_dir, "documents"))
    return s.exceptAll(b).unionByName(b.exceptAll(s))


@register("io_roundtrip", "A1+A2+A4+A5+A7", """
SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'human' WHEN 0 THEN 'GPT' END AS source, CASE WHEN l.quality = 1 THEN 0 ELSE 1 END AS label,
       d.lang AS domain, md5(d.text) AS text_md5, md5(d.text) AS lenient_md5 FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_io_roundtrip(spark, sf_dir):
    base = _scratch(spark, "io")
    c = corpus(spark, sf_dir, labelled_only=False).select(
        F.col("doc_id").alias("Index"), F.col("text").alias("Text"), F.col("source").alias("Source"), "domain")
    IO.write_rewrites(c, f"{base}/rewrites", fmt="json", partition_by="domain")
    IO.write_labels(c.select("Index", "Source"), f"{base}/labels")
    # the list form: JSON lists of up to 256 records, a file each, and a broken file beside
    lists = c.groupBy(F.pmod(F.xxhash64("Index"), F.lit(8)).alias("part"), F.floor(F.col("Index") / 2048).alias("run")).agg(
        F.to_json(F.collect_list(F.struct("Index", "Text", "Source"))).alias("value"))
    lists.write.partitionBy("part", "run").text(f"{base}/lists")
    spark.range(1).select(F.lit('[{"Index": 1, "Text": ').alias("value")).write.text(f"{base}/broken")
    got = IO.read_corpus(spark, f"{base}/rewrites", multiline=False)
    lenient = IO.read_or_default(spark, f"{base}/lists")
    lenient = lenient.unionByName(IO.read_or_default(spark, f"{base}/missing")).unionByName(IO.read_or_default(spark, f"{base}/broken"))
    lab = IO.read_labels(spark, f"{base}/rewrites", multiline=False)
    return (got.join(lab, "doc_id").join(lenient.select("doc_id", F.md5("text").alias("lenient_md5")), "doc_id")
            .select("doc_id", "source", "label", "domain", F.md5("text").alias("text_md5"), "lenient_md5"))


@register("json_lists", "A1+A2+A7 lists", """
SELECT doc_id, source, md5(text) AS text_md5, CAST(count(*) OVER () AS BIGINT) AS n_records, CAST(0 AS BIGINT) AS n_malformed FROM documents""")
def q_json_lists(spark, sf_dir):
    """Documents written as JSON lists and read back in byte ranges far smaller than a
    list, strictly and leniently; the lenient reader's counts come in the same pass."""
    base = _scratch(spark, "lists")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Index"), F.col("text").alias("Text"), F.col("source").alias("Source"))
    IO.write_lists(d, base)
    counts = Observation()
    lenient = IO.read_or_default(spark, base, split_bytes=1 << 18, counts=counts).select("doc_id", F.md5("text").alias("lenient_md5"))
    lenient.write.parquet(f"{base}-read")
    seen = counts.get
    strict = IO.read_corpus(spark, base, split_bytes=1 << 18).select("doc_id", "source", F.md5("text").alias("text_md5"))
    both = strict.join(spark.read.parquet(f"{base}-read"), "doc_id").where("text_md5 <=> lenient_md5")
    return both.select("doc_id", "source", "text_md5", *[F.lit(seen[c]).cast("long").alias(c) for c in ("n_records", "n_malformed")])


@register("features_roundtrip", "A3+A6+A9", f"""SELECT doc_id, [{", ".join(NAMES)}] AS f FROM ({_wide_sql()})""")
def q_features_roundtrip(spark, sf_dir):
    base = _scratch(spark, "feat")
    x = rule_variants(G.length_filter(G.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    f = G.overlap_features(x, len(RULES))
    vec = f.select("doc_id", F.array(*[F.col(n) for n in NAMES]).alias("f"), F.lit("overlap").alias("method"))
    IO.write_features(vec, f"{base}/features")
    back = IO.read_features(spark, f"{base}/features/method=overlap")
    IO.append_metrics(back.select(F.size("f").alias("width")).agg(F.max("width").alias("width")),
                      f"{base}/metrics", "run-1")
    return back.select("doc_id", F.transform("f", lambda x: F.round(x, 6)).alias("f"))


@register("metrics_log", "A9", """
WITH m AS (SELECT lang AS domain, CAST(count(*) AS DOUBLE) AS n_docs, CAST(sum(n_chars) AS DOUBLE) AS n_chars FROM documents GROUP BY lang),
r AS (SELECT 'run-1' AS run_id, * FROM m UNION ALL SELECT 'run-2', * FROM m)
SELECT run_id, domain, 'n_docs' AS metric, n_docs AS value FROM r UNION ALL SELECT run_id, domain, 'n_chars', n_chars FROM r""")
def q_metrics_log(spark, sf_dir):
    """Metrics per domain appended to a log by two runs and read back."""
    path = _scratch(spark, "metrics")
    m = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("domain")).agg(
        F.count(F.lit(1)).cast("double").alias("n_docs"), F.sum("n_chars").cast("double").alias("n_chars"))
    for run in ("run-1", "run-2"):
        IO.append_metrics(m, path, run)
    return IO.read_metrics(spark, path).select("run_id", "domain", "metric", "value")


@register("read_domains", "A8", """
SELECT domain, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT lang AS domain FROM documents UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY domain""")
def q_read_domains(spark, sf_dir):
    """A catalogue of paths: the documents written once per language (one scan, one
    partitioned write) and the benchmark table as it is."""
    base = _scratch(spark, "domains")
    d = table(spark, sf_dir, "documents").select("lang", "text")
    d.write.partitionBy("lang").parquet(base)
    langs = [r["lang"] for r in d.select("lang").distinct().collect()]   # the catalogue names (few)
    paths = {x: f"{base}/lang={'__HIVE_DEFAULT_PARTITION__' if x is None else quote(x, safe=' ')}" for x in langs}
    paths["benchmark"] = f"{sf_dir.rstrip('/')}/benchmark.parquet"
    cat = IO.read_domains(spark, paths, reader=lambda p: spark.read.parquet(p).select("text"))
    return cat.groupBy("domain").agg(F.count("*").cast("long").alias("n"))
