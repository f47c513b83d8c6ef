"""Registered queries: fuzzy similarity (D8, D9) and the complete feature layouts
(G1 Summary-6, G2 wide 8+7P, G6 report, G7 matrix, B11/B12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy as FZ
from ..operators import features as G
from ..operators import layouts as L
from ..operators import tfidf as TF
from ..operators.variants import RULES, unpacked
from ..session import stored
from ..sources.tables import table
from . import sqlfrag as S
from .q_text import eligible_with_variants, _sql_base, _sql_variants, _wide_sql
from .registry import r6, register

P = len(RULES)
HASH_DIM = 64


def _pairs(spark, sf_dir):
    """Eligible originals with their 7 rewrites, one row per (doc, variant)."""
    x = eligible_with_variants(spark, sf_dir)
    return x.select("doc_id", F.col("text").alias("orig"), unpacked())


@register("fuzz_ratio", "D8")
def q_fuzz_ratio(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("doc_id", "variant_pos", FZ.fuzz_ratio("orig", "text").alias("fuzz_ratio"))


@register("token_set", "D9")
def q_token_set(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("doc_id", "variant_pos", FZ.token_set("orig", "text").alias("token_set_ratio"))


# -- block 5: TF-IDF cosine distance original vs each rewrite ----------------------------

def _texts8(spark, sf_dir):
    """All documents' originals (pos -1) and rule rewrites (pos 0..6) as one text table
    keyed by tid = (doc_id, pos) (the vectorizer is fitted on all of them)."""
    from ..operators.variants import rule_variants
    from ..session import spread
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    v = rule_variants(d).select("doc_id", unpacked())
    o = d.select("doc_id", F.lit(-1).alias("variant_pos"), "text")
    t = o.unionByName(v)
    return t.withColumn("tid", F.struct("doc_id", "variant_pos"))


def tfidf_cosines(spark, sf_dir):
    t = _texts8(spark, sf_dir)
    voc = stored(TF.tfidf_fit(t, 5000, key="tid"))  # both sides of the join read it
    vec = TF.tfidf_transform(t, voc, key="tid")
    vec = vec.select("tid.doc_id", "tid.variant_pos", "term", "w")
    o = vec.filter("variant_pos = -1").select("doc_id", "term", "w")
    r = vec.filter("variant_pos >= 0")
    cos = TF.sparse_cosine(r, o, ["doc_id", "variant_pos"], on=["doc_id"]).withColumnRenamed("cos", "cos_d")
    return cos


def _sql_texts8() -> str:
    parts = [f"SELECT doc_id, {i} AS variant_pos, {S.rule(r, 'text', 'w')} AS text FROM dw" for i, r in enumerate(RULES)]
    return ("dw AS (SELECT doc_id, text, " + S.words("text") + " AS w FROM documents), "
            "t8 AS (SELECT doc_id, -1 AS variant_pos, text FROM dw UNION ALL " + " UNION ALL ".join(parts) + ")")


_TERMS = f"list_filter(regexp_extract_all(lower(text), {S.q(TF.TERM_PATTERN.replace('{2,}', '+'))}), lambda x: length(x) >= 2)"
TFIDF_COS_SQL = f"""{_sql_texts8()},
tt AS (SELECT doc_id, variant_pos, unnest({_TERMS}) AS term FROM t8),
st AS (SELECT term, count(*) AS cnt, count(DISTINCT doc_id * 8 + variant_pos + 1) AS df FROM tt GROUP BY term),
voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM t8)) / (1.0 + df)) + 1.0 AS idf FROM st ORDER BY cnt DESC, term LIMIT 5000),
tf AS (SELECT doc_id, variant_pos, term, count(*) * max(idf) AS raw FROM tt JOIN voc USING (term) GROUP BY ALL),
vw AS (SELECT doc_id, variant_pos, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id, variant_pos)) AS w FROM tf),
cs AS (SELECT r.doc_id, r.variant_pos, least(greatest(1.0 - sum(r.w * o.w), 0.0), 2.0) AS cos_d
       FROM vw r JOIN vw o ON o.doc_id = r.doc_id AND o.term = r.term AND o.variant_pos = -1
       WHERE r.variant_pos >= 0 GROUP BY ALL)"""


_WIDE_COS_SQL = ("WITH " + _sql_base()[1:] + ", " + TFIDF_COS_SQL + """
SELECT d.doc_id, """ + ", ".join(
    S.r6(f"coalesce(max(CASE WHEN cs.variant_pos = {p} THEN cs.cos_d END), 1.0)") + f" AS cos_v{p}" for p in range(P))
    + " FROM d LEFT JOIN cs USING (doc_id) GROUP BY d.doc_id")


@register("wide_tfidf_cos", "G2 block 5 + E1", _WIDE_COS_SQL)
def q_wide_tfidf_cos(spark, sf_dir):
    f = L.wide_features(_records(spark, sf_dir), P, "tfidf", fuzzy=False, overlap=False).where("status = 'ok'")
    return f.select("doc_id", *[r6(f"cos_v{p}").alias(f"cos_v{p}") for p in range(P)])


@register("wide_tfidf_cos_long", "G2 block 5 + E2 (sparse rows)", _WIDE_COS_SQL)
def q_wide_tfidf_cos_long(spark, sf_dir):
    """Same distances through the long sparse E2 table and a join per (doc, term)."""
    d = G.length_filter(G.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    cos = tfidf_cosines(spark, sf_dir)
    piv = cos.groupBy("doc_id").agg(*[F.max(F.when(F.col("variant_pos") == p, F.col("cos_d"))).alias(f"c{p}")
                                      for p in range(P)])
    j = d.select("doc_id").join(piv, "doc_id", "left")
    # a rewrite sharing no vocabulary term with the original has cosine distance 1
    return j.select("doc_id", *[r6(F.coalesce(f"c{p}", F.lit(1.0))).alias(f"cos_v{p}") for p in range(P)])


def _records(spark, sf_dir):
    """Every document with its rule rewrites, as the layouts read them."""
    from ..operators.variants import rule_variants
    from ..session import spread
    return rule_variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def _rounded(f, skip=("doc_id", "n_tokens", "n_variants", "status")):
    return f.select(*[F.col(c) if c in skip else r6(c).alias(c) for c in f.columns])


@register("wide_full", "G2")
def q_wide_full(spark, sf_dir):
    """All five blocks in one pass, TF-IDF as the method; blocks 1-3 and 5 are the columns
    of ``wide_overlap`` and ``wide_tfidf_cos``."""
    return _rounded(L.wide_features(_records(spark, sf_dir), P, "tfidf"))


HASH_COS_SQL = f"""h8 AS (SELECT doc_id, -1 AS variant_pos, toks AS t FROM d UNION ALL SELECT doc_id, variant_pos, {S.tokens('vtext')} FROM v),
hb AS (SELECT doc_id, variant_pos, ('0x' || substr(md5(unnest(t)), 1, 8))::BIGINT % {HASH_DIM} AS b FROM h8),
hc AS (SELECT doc_id, variant_pos, b, count(*)::DOUBLE AS c FROM hb GROUP BY ALL),
hn AS (SELECT doc_id, variant_pos, sqrt(sum(c * c)) AS n FROM hc GROUP BY ALL),
hd AS (SELECT o.doc_id, r.variant_pos, sum(o.c * r.c) AS dot FROM hc o JOIN hc r ON r.doc_id = o.doc_id AND r.b = o.b AND o.variant_pos = -1 AND r.variant_pos >= 0 GROUP BY ALL),
hs AS (SELECT h.doc_id, h.variant_pos, least(greatest(1.0 - coalesce(hd.dot / (a.n * b.n), 0.0), 0.0), 2.0) AS cos_d
       FROM h8 h LEFT JOIN hd ON hd.doc_id = h.doc_id AND hd.variant_pos = h.variant_pos
       LEFT JOIN hn a ON a.doc_id = h.doc_id AND a.variant_pos = -1 LEFT JOIN hn b ON b.doc_id = h.doc_id AND b.variant_pos = h.variant_pos
       WHERE h.variant_pos >= 0)"""


@register("wide_hash_proj", "G2 blocks 1-3 + 5, hashed bags", "SELECT w.*, h.* EXCLUDE (doc_id) FROM (" + _wide_sql() + ") w JOIN (WITH " + _sql_base()[1:] + ", " + _sql_variants() + ", " + HASH_COS_SQL + """
SELECT doc_id, """ + ", ".join(S.r6(f"max(CASE WHEN variant_pos = {p} THEN cos_d END)") + f" AS cos_v{p}" for p in range(P)) + """ FROM hs GROUP BY doc_id) h USING (doc_id)""")
def q_wide_hash_proj(spark, sf_dir):
    f = L.wide_features(_records(spark, sf_dir), P, "hash_proj", fuzzy=False, dim=HASH_DIM)
    return _rounded(f.where("status = 'ok'").drop("status"))


# -- G1 Summary-6 -------------------------------------------------------------------------

SUMMARY_SQL = "WITH " + _sql_base()[1:] + ", " + _sql_variants() + f""",
t8 AS (SELECT doc_id, -1 AS variant_pos, toks AS t FROM d UNION ALL SELECT doc_id, variant_pos, {S.tokens('vtext')} FROM v),
bk AS (SELECT doc_id, variant_pos, ('0x' || substr(md5(unnest(t)), 1, 8))::BIGINT % {HASH_DIM} AS b FROM t8),
cn AS (SELECT doc_id, variant_pos, b, count(*) AS c FROM bk GROUP BY ALL),
grid AS (SELECT doc_id, variant_pos, k FROM t8, range(0, {HASH_DIM}) r(k)),
ev AS (SELECT g.doc_id, g.variant_pos, list(CAST(coalesce(cn.c, 0) AS DOUBLE) ORDER BY g.k) AS e
       FROM grid g LEFT JOIN cn ON cn.doc_id = g.doc_id AND cn.variant_pos = g.variant_pos AND cn.b = g.k GROUP BY ALL),
pr AS (SELECT o.doc_id, o.e AS a, r.e AS b, d.toks AS ot, t8.t AS rt FROM ev o JOIN ev r ON r.doc_id = o.doc_id AND o.variant_pos = -1 AND r.variant_pos >= 0
       JOIN d ON d.doc_id = o.doc_id JOIN t8 ON t8.doc_id = r.doc_id AND t8.variant_pos = r.variant_pos)
SELECT doc_id,
  {S.r6("avg(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))))")} AS euclidean,
  {S.r6("avg(CASE WHEN list_inner_product(a, a) = 0 OR list_inner_product(b, b) = 0 THEN 1.0 ELSE least(greatest(1.0 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 0.0), 2.0) END)")} AS cosine,
  {S.r6("avg(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))))")} AS manhattan,
  {S.r6("avg(" + S.common("ot", "rt") + ")")} AS common_unigrams,
  {S.r6("avg(" + S.common(S.ngrams("ot", 2), S.ngrams("rt", 2)) + ")")} AS common_bigrams
FROM pr GROUP BY doc_id"""


@register("summary6", "G1 (without fuzz)", SUMMARY_SQL)
def q_summary6(spark, sf_dir):
    f = L.summary6(_records(spark, sf_dir), "hash_proj", fuzzy=False, dim=HASH_DIM)
    return _rounded(f.where("status = 'ok'").drop("status", "n_variants"))


@register("summary6_full", "G1")
def q_summary6_full(spark, sf_dir):
    return _rounded(L.summary6(_records(spark, sf_dir), "hash_proj", dim=HASH_DIM))


@register("layout_status", "G1/G2 status column", f"""SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN text IS NULL THEN 'no text' WHEN len(t) < 5 THEN 'too short' WHEN len(t) > 20000 THEN 'too long' ELSE 'ok' END AS status
  FROM (SELECT text, {S.tokens('text')} AS t FROM documents)) GROUP BY status""")
def q_layout_status(spark, sf_dir):
    f = L.summary6(_records(spark, sf_dir), "hash_proj", fuzzy=False, dim=HASH_DIM)
    return f.groupBy("status").agg(F.count("*").cast("long").alias("n"))


# -- G6, G7, B11, B12 ---------------------------------------------------------------------

METHODS = ["tfidf", "word_avg", "hash_proj", "bert_cls", "bert_mean", "style"]


@register("extract_report", "G6", f"""WITH d AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents),
m AS (SELECT * FROM (VALUES {", ".join(f"({S.q(m)}, {str(m in ('tfidf', 'word_avg', 'hash_proj')).upper()})" for m in METHODS)}) x(method, available))
SELECT method, CAST(count(*) FILTER (WHERE available AND len(t) BETWEEN 5 AND 20000) AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE NOT (available AND len(t) BETWEEN 5 AND 20000)) AS BIGINT) AS skipped
FROM m, d GROUP BY method""")
def q_extract_report(spark, sf_dir):
    from ..operators.embed import EMBEDDERS
    d = G.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # one status row per (method, record): unavailable methods skip every record
    avail = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(m in EMBEDDERS).alias("available")) for m in METHODS])
    x = d.select("n_tokens", F.inline(avail))
    x = x.withColumn("ok", F.col("available") & F.col("n_tokens").between(G.MIN_TOKENS, G.MAX_TOKENS))
    r = G.extract_report(x)
    return r.select("method", F.col("processed").cast("long"), F.col("skipped").cast("long"))


def _feature_table(spark, sf_dir):
    x = eligible_with_variants(spark, sf_dir)
    return G.overlap_features(x, P)


@register("feature_matrix", "G7+B11+B12", "WITH " + _sql_base()[1:] + ", " + _sql_variants() + "," + """
vt AS (SELECT doc_id, variant_pos, """ + S.tokens('vtext') + """ AS t FROM v),
ov AS (SELECT d.doc_id, len(d.toks) AS n, """ + S.common('d.toks', 'vt.t') + """ AS c1 FROM vt JOIN d ON vt.doc_id = d.doc_id)
SELECT doc_id, CAST(""" + str(4 + 4 * P + 4) + """ AS BIGINT) AS width,
       """ + S.r6("sum(c1) / count(*) / max(n) / 100.0") + """ AS avg_c1_scaled FROM ov GROUP BY doc_id""")
def q_feature_matrix(spark, sf_dir):
    f = _feature_table(spark, sf_dir)
    names = [c for c in f.columns if c not in ("doc_id", "n_tokens", "n_variants")]
    sel = G.select_features(f, names, keep=["doc_id"])
    sel = G.rescale_features(sel, ["avg_c1"], 100.0)
    m = G.feature_matrix(sel, names)   # a missing feature is an error
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("features")
    return m.select("doc_id", F.size(arr).cast("long").alias("width"), r6(arr[0]).alias("avg_c1_scaled"))
