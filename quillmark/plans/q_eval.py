"""Registered queries: splits and scaling (I1-I3, I8) and classification metrics
(J1-J8) on a deterministic score, so every metric is exactly checkable.

Score of a labelled document = its type-token ratio (block-3 slot 1); prediction =
score >= 0.5; label = 0 for human (quality 1), 1 otherwise; group = language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import split as SP
from ..operators.corpus import label_from_source
from ..session import spread
from ..sources.tables import source_from_quality, table
from . import sqlfrag as S
from .registry import r6, register

D = "CAST({} AS DOUBLE)".format


def predictions(spark, sf_dir):
    """Scores are computed where the text is; only the narrow rows meet the labels."""
    c = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain")), "doc_id")
    c = c.filter(T.token_count("text") > 0).withColumn("t", T.tokens("text"))
    scored = c.select("doc_id", "domain", F.size("t").cast("long").alias("n_tokens"), (F.size(F.array_distinct("t")) / F.size("t")).alias("score"))
    lab = table(spark, sf_dir, "labels").select("doc_id", label_from_source(source_from_quality()).alias("label"))
    return (scored.join(lab, "doc_id").select("doc_id", "domain", "label", "n_tokens", "score")
            .withColumn("prediction", (F.col("score") >= 0.5).cast("int")))


PRED_SQL = f"""pr AS (
  SELECT doc_id, domain, label, n_tokens, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM (
    SELECT d.doc_id, d.lang AS domain, CASE WHEN l.quality = 1 THEN 0 ELSE 1 END AS label,
           CAST(len(t) AS BIGINT) AS n_tokens, len(list_distinct(t)) / len(t) AS score
    FROM (SELECT doc_id, lang, {S.tokens('text')} AS t FROM documents) d JOIN labels l USING (doc_id)
    WHERE len(t) > 0))"""

CONF_SQL = """cm AS (SELECT domain,
  CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS tp FROM pr GROUP BY domain)"""


@register("accuracy", "J1", f"WITH {PRED_SQL} SELECT domain, {S.r6('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM pr GROUP BY domain")
def q_accuracy(spark, sf_dir):
    a = M.accuracy(predictions(spark, sf_dir), "domain")
    return a.select("domain", r6("accuracy").alias("accuracy"))


@register("f1", "J2", f"""WITH {PRED_SQL}, {CONF_SQL}
SELECT domain, {S.r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END')} AS f1 FROM cm""")
def q_f1(spark, sf_dir):
    f = M.f1(predictions(spark, sf_dir), "domain")
    return f.select("domain", r6("f1").alias("f1"))


@register("auroc", "J3", f"""WITH {PRED_SQL},
ps AS (SELECT domain, score, count(*) FILTER (WHERE label = 1) AS npos, count(*) FILTER (WHERE label = 0) AS nneg
       FROM pr GROUP BY domain, score),
c AS (SELECT *, coalesce(sum(nneg) OVER (PARTITION BY domain ORDER BY score
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ps)
SELECT domain, {S.r6('CASE WHEN sum(npos) > 0 AND sum(nneg) > 0 THEN sum(npos * (below + nneg / 2.0)) / (sum(npos) * sum(nneg)) END')} AS auroc
FROM c GROUP BY domain""")
def q_auroc(spark, sf_dir):
    a = M.auroc(predictions(spark, sf_dir), "domain")
    return a.select("domain", r6("auroc").alias("auroc"))


@register("report_cls", "J4", f"""WITH {PRED_SQL}, {CONF_SQL},
cl AS (
  SELECT domain, 'human' AS "row", CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS precision,
         CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS recall, tn + fp AS support, tn + fp + fn + tp AS n FROM cm
  UNION ALL
  SELECT domain, 'GPT', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, tp + fn, tn + fp + fn + tp FROM cm),
cf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM cl),
allrows AS (
  SELECT domain, "row", precision, recall, f1, support FROM cf
  UNION ALL SELECT domain, 'accuracy', NULL, NULL, (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp FROM cm
  UNION ALL SELECT domain, 'macro avg', avg(precision), avg(recall), avg(f1), max(n) FROM cf GROUP BY domain
  UNION ALL SELECT domain, 'weighted avg', sum(precision * support / n), sum(recall * support / n), sum(f1 * support / n), max(n)
            FROM cf GROUP BY domain)
SELECT domain, "row", {S.r6('precision')} AS precision, {S.r6('recall')} AS recall, {S.r6('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM allrows""")
def q_report_cls(spark, sf_dir):
    r = M.classification_report(predictions(spark, sf_dir), "domain")
    return r.select("domain", "row", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), F.col("support").cast("long"))


@register("confusion", "J5", f"WITH {PRED_SQL}, {CONF_SQL} SELECT * FROM cm")
def q_confusion(spark, sf_dir):
    return M.confusion_counts(predictions(spark, sf_dir), "domain")


_STEP = D("0.05")
HIST_SQL = f"""b0 AS (SELECT domain, label, score, least(CAST(floor(score * {D('20')}) AS INTEGER), 19) AS i0
       FROM pr WHERE score >= 0 AND score <= 1),
b1 AS (SELECT *, CASE WHEN score < i0 * {_STEP} THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT domain, label, CASE WHEN score >= (i1 + 1) * {_STEP} AND i1 <> 19 THEN i1 + 1 ELSE i1 END AS bin FROM b1),
cnt AS (SELECT domain, label, bin, count(*) AS c FROM b2 GROUP BY ALL),
keys AS (SELECT domain, label, count(*) AS n FROM b2 GROUP BY ALL),
hist AS (SELECT k.domain, k.label, g.bin, CAST(coalesce(c.c, 0) AS BIGINT) AS count,
                coalesce(c.c, 0) / (k.n * ((g.bin + 1) * {_STEP} - g.bin * {_STEP})) AS density
         FROM keys k CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) g
         LEFT JOIN cnt c ON c.domain = k.domain AND c.label = k.label AND c.bin = g.bin)"""


@register("histogram", "J6", f"WITH {PRED_SQL}, {HIST_SQL} SELECT domain, label, bin, count, {S.r6('density')} AS density FROM hist")
def q_histogram(spark, sf_dir):
    h = M.score_histogram(predictions(spark, sf_dir), "domain", 20)
    return h.select("domain", "label", "bin", "count", r6("density").alias("density"))


KL_SQL = f"""pq AS (SELECT h0.domain, h0.bin, h0.density AS p, h1.density AS q FROM hist h0 JOIN hist h1
        ON h0.domain = h1.domain AND h0.bin = h1.bin AND h0.label = 0 AND h1.label = 1),
nz AS (SELECT domain, (greatest(p, 0) + {D('1e-10')}) / sum(greatest(p, 0) + {D('1e-10')}) OVER (PARTITION BY domain) AS p,
              (greatest(q, 0) + {D('1e-10')}) / sum(greatest(q, 0) + {D('1e-10')}) OVER (PARTITION BY domain) AS q FROM pq),
dist AS (SELECT domain, sum(p * ln(p / q)) AS kl_pq, sum(q * ln(q / p)) AS kl_qp,
                sqrt(sum(pow(sqrt(p) - sqrt(q), 2))) / sqrt({D('2')}) AS hellinger FROM nz GROUP BY domain)"""


@register("kl_hellinger", "J7+J8", f"""WITH {PRED_SQL}, {HIST_SQL}, {KL_SQL}
SELECT g.domain, {S.r6('kl_pq')} AS kl_pq, {S.r6('kl_qp')} AS kl_qp, {S.r6('hellinger')} AS hellinger
FROM (SELECT DISTINCT domain FROM pr) g LEFT JOIN dist USING (domain)""")
def q_kl_hellinger(spark, sf_dir):
    d = M.kl_hellinger(predictions(spark, sf_dir), "domain", 20)
    return d.select("domain", *[r6(c).alias(c) for c in ("kl_pq", "kl_qp", "hellinger")])


@register("hellinger_after", "J8 eps-after", f"""WITH {PRED_SQL}, {HIST_SQL},
pq AS (SELECT h0.domain, h0.bin, h0.density AS p, h1.density AS q FROM hist h0 JOIN hist h1
        ON h0.domain = h1.domain AND h0.bin = h1.bin AND h0.label = 0 AND h1.label = 1),
a AS (SELECT domain, greatest(p, 0) / sum(greatest(p, 0)) OVER (PARTITION BY domain) + {D('1e-10')} AS p,
             greatest(q, 0) / sum(greatest(q, 0)) OVER (PARTITION BY domain) + {D('1e-10')} AS q FROM pq),
k AS (SELECT domain, p, q, p / sum(p) OVER (PARTITION BY domain) AS pk, q / sum(q) OVER (PARTITION BY domain) AS qk FROM a)
SELECT domain, {S.r6('sum(pk * ln(pk / qk))')} AS kl_pq, {S.r6('sum(qk * ln(qk / pk))')} AS kl_qp,
       {S.r6(f"sqrt(sum(pow(sqrt(p) - sqrt(q), 2))) / sqrt({D('2')})")} AS hellinger FROM k GROUP BY domain""")
def q_hellinger_after(spark, sf_dir):
    h = M.score_histogram(predictions(spark, sf_dir), "domain", 20)
    h0 = h.filter("label = 0").select("domain", "bin", F.col("density").alias("p"))
    h1 = h.filter("label = 1").select("domain", "bin", F.col("density").alias("q"))
    d = M.distribution_distances(h0.join(h1, ["domain", "bin"]), "domain", eps_mode="after")
    return d.select("domain", *[r6(c).alias(c) for c in ("kl_pq", "kl_qp", "hellinger")])


@register("split", "I1", f"""WITH {PRED_SQL}
SELECT doc_id, ('0x' || substr(md5('42-' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / {D('4294967296')} < {D('0.2')} AS is_test FROM pr""")
def q_split(spark, sf_dir):
    p = predictions(spark, sf_dir).select("doc_id")
    train, test = SP.random_split(p, 0.2, 42)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


STRAT_SQL = f"""st AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id)
                 <= round(count(*) OVER (PARTITION BY domain, label) * {D('0.2')}) AS is_test FROM pr)"""


@register("stratified", "I2", f"WITH {PRED_SQL}, {STRAT_SQL} SELECT doc_id, domain, label, is_test FROM st")
def q_stratified(spark, sf_dir):
    p = predictions(spark, sf_dir).select("doc_id", "domain", "label")
    return SP.stratified_split(p, "label", 0.2, 42, "doc_id", by="domain")


@register("scale", "I3", f"""WITH {PRED_SQL}, {STRAT_SQL},
s AS (SELECT domain, avg(score) AS ms, stddev_pop(score) AS ss, avg(n_tokens) AS mn, stddev_pop(n_tokens) AS sn
      FROM st WHERE NOT is_test GROUP BY domain)
SELECT doc_id, is_test, {S.r6('(score - ms) / CASE WHEN ss = 0 THEN 1.0 ELSE ss END')} AS score,
       {S.r6('(n_tokens - mn) / CASE WHEN sn = 0 THEN 1.0 ELSE sn END')} AS n_tokens
FROM st JOIN s USING (domain)""")
def q_scale(spark, sf_dir):
    p = predictions(spark, sf_dir).select("doc_id", "domain", "label", "score",
                                          F.col("n_tokens").cast("double"))
    st = SP.stratified_split(p, "label", 0.2, 42, "doc_id", by="domain")
    train, test = st.filter(~F.col("is_test")), st.filter(F.col("is_test"))
    a, b = SP.standard_scale(train, test, ["score", "n_tokens"], by="domain")
    return a.unionByName(b).select("doc_id", "is_test", r6("score").alias("score"),
                                   r6("n_tokens").alias("n_tokens"))


@register("domain_guards", "I8 guards", f"""WITH {PRED_SQL}
SELECT domain, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT label) AS BIGINT) AS n_classes,
       count(*) > 0 AND count(DISTINCT label) = 2 AS trainable FROM pr GROUP BY domain""")
def q_domain_guards(spark, sf_dir):
    from ..operators.models import domain_guards
    g = domain_guards(predictions(spark, sf_dir))
    return g.select("domain", F.col("n").cast("long"), F.col("n_classes").cast("long"), "trainable")
