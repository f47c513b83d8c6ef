"""Registered queries over ``embeddings`` (and token ids from ``documents``): distances,
pooling, episodes, projection, retrieval ranks (C9, E3-E12, F1-F3, J9-J12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as VX
from ..functions.sampling import u01
from ..operators import embed as E
from ..operators import model_embed  # noqa: F401  (registers its model)
from ..operators import metrics as M
from ..operators import neighbours as NB
from ..operators import retrieval as R
from ..operators import tfidf as TF
from ..session import spread
from ..sources.tables import table
from . import sqlfrag as S
from .registry import register

D = "CAST({} AS DOUBLE)".format


def rvec(c):
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: F.round(x, 6))


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def _u01_sql(seed, *keys) -> str:
    k = " || '-' || ".join([S.q(str(seed))] + [f"CAST({x} AS VARCHAR)" for x in keys])
    return f"(('0x' || substr(md5({k}), 1, 8))::BIGINT / {D('4294967296')})"


def _h32_sql(seed, *keys) -> str:
    k = " || '-' || ".join([S.q(str(seed))] + [f"CAST({x} AS VARCHAR)" for x in keys])
    return f"('0x' || substr(md5({k}), 1, 8))::BIGINT"


EMB_SQL = "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
PAIRS_SQL = f"""{EMB_SQL},
pairs AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1)"""


def _pairs(spark, sf_dir):
    e = _emb(spark, sf_dir)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b"))
    return e.select("vec_id", F.col("e").alias("a")).join(b, "vec_id")


@register("distances", "F1-F3", f"""WITH {PAIRS_SQL}
SELECT vec_id,
  {S.r6("sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")} AS euclidean,
  {S.r6("CASE WHEN list_inner_product(a, a) = 0 OR list_inner_product(b, b) = 0 THEN 1.0 ELSE least(greatest(1.0 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 0.0), 2.0) END")} AS cosine,
  {S.r6("list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])))")} AS manhattan
FROM pairs""")
def q_distances(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("vec_id", F.round(VX.euclidean("a", "b"), 6).alias("euclidean"),
                    F.round(VX.cosine("a", "b"), 6).alias("cosine"),
                    F.round(VX.manhattan("a", "b"), 6).alias("manhattan"))


def _tok_emb(c):
    """64-d row viewed as 8 token rows of 8 dims."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, 8))


@register("pool_tokens", "E4", f"""WITH {EMB_SQL}
SELECT vec_id, list_transform(e[1:8], lambda x: round(x, 6)) AS cls,
       list_transform(range(0, 8), lambda j: round(list_sum(list_transform(range(0, 8), lambda i: e[i * 8 + j + 1])) / 8, 6)) AS mean
FROM emb""")
def q_pool_tokens(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumn("t", _tok_emb(F.col("e")))
    return e.select("vec_id", rvec(VX.pool_tokens("t", "cls")).alias("cls"),
                    rvec(VX.pool_tokens("t", "mean")).alias("mean"))


@register("masked_mean", "E5", f"""WITH {EMB_SQL},
m AS (SELECT vec_id, e, list_transform(range(0, 8), lambda i: CASE WHEN (vec_id + i) % 3 = 0 THEN 0 ELSE 1 END) AS mask FROM emb)
SELECT vec_id, list_transform(range(0, 8), lambda j: round(
         list_sum(list_transform(range(0, 8), lambda i: e[i * 8 + j + 1] * mask[i + 1])) / greatest(list_sum(mask), 1e-9), 6)) AS pooled
FROM m""")
def q_masked_mean(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumn("t", _tok_emb(F.col("e")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)),
                       lambda i: F.when(F.pmod(F.col("vec_id") + i, F.lit(3)) == 0, 0).otherwise(1))
    return e.select("vec_id", rvec(VX.masked_mean_pool("t", mask)).alias("pooled"))


def _episodes(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumnRenamed("label", "author")
    return E.episode_sample(e.withColumn("batch", F.pmod("author", F.lit(3))), "author", "vec_id", seed=42, max_posts=16, batch="batch")


EPISODE_SQL = f"""{EMB_SQL},
pos AS (SELECT * FROM (SELECT label AS author, label % 3 AS b, vec_id, e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p FROM emb) WHERE p < 16),
short AS (SELECT b, min(n) AS s FROM (SELECT b, author, count(*) AS n FROM pos GROUP BY b, author) GROUP BY b),
plan AS (SELECT b, s, CAST(least(1 + ceil({D('15')} * pow({_u01_sql(42, 'b', "'len'")}, {D('1')} / 3)), s) AS BIGINT) AS m FROM short),
plan2 AS (SELECT *, CASE WHEN s < 16 THEN 0 ELSE {_h32_sql(42, 'b', "'start'")} % (16 - m + 1) END AS start FROM plan),
ep AS (SELECT pos.author, vec_id, e, CAST(p - start AS INTEGER) AS post_pos FROM pos JOIN plan2 USING (b)
       WHERE p >= start AND p < start + m)"""


@register("episode_sample", "E12", f"WITH {EPISODE_SQL} SELECT author, 0 AS sample_id, post_pos, vec_id FROM ep")
def q_episode_sample(spark, sf_dir):
    return _episodes(spark, sf_dir).select("author", "sample_id", "post_pos", "vec_id")


@register("episode", "E6", f"""WITH {EPISODE_SQL},
pr AS (SELECT x.author, x.vec_id AS i, y.e AS xj, list_inner_product(x.e, y.e) / sqrt(len(x.e)) AS s
       FROM ep x JOIN ep y USING (author)),
pa AS (SELECT *, exp(s - max(s) OVER (PARTITION BY author, i)) AS a0 FROM pr),
pb AS (SELECT *, a0 / sum(a0) OVER (PARTITION BY author, i) AS a FROM pa),
comp AS (SELECT author, i, a, unnest(xj) AS val, unnest(range(0, len(xj))) AS dim FROM pb),
yi AS (SELECT author, i, dim, sum(a * val) AS val FROM comp GROUP BY ALL),
e6 AS (SELECT author, dim, max(val) AS val FROM yi GROUP BY ALL)
SELECT author, 0 AS sample_id, list(round(val, 6) ORDER BY dim) AS vec FROM e6 GROUP BY author""")
def q_episode(spark, sf_dir):
    ep = E.episode_embedding(_episodes(spark, sf_dir), ["author", "sample_id"], "vec_id", "e")
    return ep.select("author", "sample_id", rvec("vec").alias("vec"))


@register("project", "E7", f"""WITH {EMB_SQL},
rm AS (SELECT j, k, CASE WHEN substr(md5('42-' || CAST(j AS VARCHAR) || '-' || CAST(k AS VARCHAR)), 1, 1) < '8'
                   THEN {D('1')} ELSE {D('-1')} END AS r FROM range(0, 64) t1(j), range(0, 64) t2(k)),
x AS (SELECT vec_id, unnest(e) AS v, unnest(range(0, len(e))) AS j FROM emb),
p AS (SELECT vec_id, k, sum(v * r) / sqrt({D('64')}) AS val FROM x JOIN rm USING (j) GROUP BY ALL)
SELECT vec_id, list(round(val, 6) ORDER BY k) AS proj FROM p GROUP BY vec_id""")
def q_project(spark, sf_dir):
    e = _emb(spark, sf_dir).select("vec_id", F.col("e").alias("vec"))
    p = E.project(e, dim=64, seed=42)
    return p.select("vec_id", rvec("proj").alias("proj"))


@register("softmax_pool", "E11", f"""WITH {EMB_SQL},
w AS (SELECT label, e, exp(e[1] - max(e[1]) OVER (PARTITION BY label)) AS w FROM emb),
comp AS (SELECT label, w, unnest(e) AS val, unnest(range(0, len(e))) AS dim FROM w),
num AS (SELECT label, dim, sum(w * val) AS num FROM comp GROUP BY ALL),
den AS (SELECT label, sum(w) AS den FROM w GROUP BY label)
SELECT label, list(round(num / den, 6) ORDER BY dim) AS vec FROM num JOIN den USING (label) GROUP BY label""")
def q_softmax_pool(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumn("s", F.element_at("e", 1))
    return E.softmax_pool(e, "label", "s", "e").select("label", rvec("vec").alias("vec"))


def _qt(spark, sf_dir):
    """Queries / targets: every embedding is one or the other by a seeded draw."""
    e = _emb(spark, sf_dir).withColumn("is_query", u01("qt", "vec_id") < 0.5)
    q = e.filter("is_query").select(F.col("vec_id").alias("qid"), F.col("label").alias("author"), F.col("e").alias("emb"))
    t = e.filter("NOT is_query").select(F.col("vec_id").alias("tid"), F.col("label").alias("author"), F.col("e").alias("emb"))
    return q, t


QT_SQL = f"""{EMB_SQL},
qt AS (SELECT *, {_u01_sql('qt', 'vec_id')} < 0.5 AS is_query FROM emb),
q AS (SELECT vec_id AS qid, label AS author, e FROM qt WHERE is_query),
t AS (SELECT vec_id AS tid, label AS author, e FROM qt WHERE NOT is_query),
d AS (SELECT q.qid, q.author AS qa, t.tid, t.author AS ta,
        CASE WHEN list_inner_product(q.e, q.e) = 0 OR list_inner_product(t.e, t.e) = 0 THEN 1.0
             ELSE least(greatest(1.0 - list_inner_product(q.e, t.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(t.e, t.e))), 0.0), 2.0) END AS dist
      FROM q, t),
ds AS (SELECT qid, min(dist) AS dstar FROM d WHERE qa = ta GROUP BY qid),
rk AS (SELECT q.qid, q.author, CASE WHEN ds.dstar IS NOT NULL THEN
         1 + (SELECT count(*) FROM d WHERE d.qid = q.qid AND d.dist < ds.dstar) END AS rank
       FROM q LEFT JOIN ds USING (qid))"""


@register("ranks", "J9", f"WITH {QT_SQL} SELECT qid, author, CAST(rank AS BIGINT) AS rank FROM rk")
def q_ranks(spark, sf_dir):
    q, t = _qt(spark, sf_dir)
    return R.author_ranks(q, t)


@register("recall", "J10", f"""WITH {QT_SQL}
SELECT {", ".join(S.r6(f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END)") + f" AS r_at_{k}" for k in (8, 16, 32, 64))} FROM rk""")
def q_recall(spark, sf_dir):
    q, t = _qt(spark, sf_dir)
    r = M.recall_at_k(R.author_ranks(q, t))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@register("mrr", "J11", f"WITH {QT_SQL} SELECT {S.r6('avg(coalesce(1.0 / rank, 0.0))')} AS mrr FROM rk")
def q_mrr(spark, sf_dir):
    q, t = _qt(spark, sf_dir)
    return M.mrr(R.author_ranks(q, t)).select(F.round("mrr", 6).alias("mrr"))


@register("all_pairs", "C9", f"""WITH {QT_SQL}
SELECT qid, arg_min(tid, [dist, tid]) AS tid, {S.r6('min(dist)')} AS dist FROM d GROUP BY qid""")
def q_all_pairs(spark, sf_dir):
    q, t = _qt(spark, sf_dir)
    n = R.nearest_target(q.select("qid", "emb"), t.select("tid", "emb"))
    return n.select("qid", "tid", F.round("dist", 6).alias("dist"))


@register("nearest_five", "C9 k nearest", f"""WITH {QT_SQL}
SELECT qid, tid, {S.r6('dist')} AS dist, CAST(place AS INT) AS place FROM (
  SELECT qid, tid, dist, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 12), tid) AS place FROM d) WHERE place <= 5""")
def q_nearest_five(spark, sf_dir):
    q, t = _qt(spark, sf_dir)
    n = R.k_nearest_targets(q.select("qid", "emb"), t.select("tid", "emb"), 5)
    return n.select("qid", "tid", F.round("dist", 6).alias("dist"), "place")


@register("neighbour_graph", "K1 graph", f"""WITH {EMB_SQL},
nz AS (SELECT vec_id, e, list_inner_product(e, e) AS s FROM emb),
gd AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(CASE WHEN a.s = 0 OR b.s = 0 THEN 1.0
         ELSE least(greatest(1.0 - list_inner_product(a.e, b.e) / (sqrt(a.s) * sqrt(b.s)), 0.0), 2.0) END, 12) AS dist FROM nz a JOIN nz b ON a.vec_id <> b.vec_id)
SELECT src, dst, CAST(place AS INT) AS place FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS place FROM gd) WHERE place <= 20""")
def q_neighbour_graph(spark, sf_dir):
    """The twenty nearest others of every embedding, exactly."""
    e = _emb(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("e").alias("emb"))
    return NB.neighbours(e).select("src", "dst", "place")


@register("collect_outputs", "J12", f"""WITH {EMB_SQL}
SELECT label AS author, vec_id, {S.r6('list_sum(e)')} AS total FROM emb""")
def q_collect_outputs(spark, sf_dir):
    e = _emb(spark, sf_dir)
    # batched outputs: one row per batch of 32 consecutive ids (bounded batch size)
    b = e.groupBy(F.floor(F.col("vec_id") / 32).alias("batch")).agg(
        F.collect_list(F.struct("vec_id", "label", "e")).alias("rows"))
    b = b.select(F.transform("rows", lambda r: r["label"]).alias("author"),
                 F.transform("rows", lambda r: F.struct(r["vec_id"].alias("vec_id"), r["e"].alias("e"))).alias("embedding"))
    flat = M.collect_outputs(b)
    return flat.select("author", F.col("embedding.vec_id").alias("vec_id"),
                       F.round(F.aggregate("embedding.e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# -- token ids (E9, E10) ----------------------------------------------------------------

def _ids_sql() -> str:
    return (f"ids AS (SELECT doc_id, list_transform({S.tokens('text')}, lambda t: "
            f"CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 50000 + 4 AS INTEGER)) AS ids FROM documents)")


def _ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", VX.token_ids(T.tokens("text")).alias("ids"))


@register("token_window", "E9", f"""WITH {_ids_sql()},
w AS (SELECT doc_id, ids, len(ids) AS n, {_h32_sql(42, 'doc_id')} % greatest(len(ids) - 30 + 1, 1) + 1 AS st FROM ids),
b AS (SELECT doc_id, [0] || ids[st:st + 29] || [2] AS body FROM w)
SELECT doc_id, CAST(body || list_transform(range(0, greatest(32 - len(body), 0)), lambda x: 1) AS INTEGER[]) AS window
FROM b""")
def q_token_window(spark, sf_dir):
    x = _ids(spark, sf_dir)
    return x.select("doc_id", VX.token_window("ids", "doc_id", 32, 42).alias("window"))


@register("mask_tokens", "E10", f"""WITH {_ids_sql()}
SELECT doc_id, CAST(list_transform(ids, lambda v, i: CASE WHEN v NOT IN (0, 1, 2) AND
         {_u01_sql(42, 'doc_id', 'i - 1')} < {D('0.15')} THEN 50264 ELSE v END) AS INTEGER[]) AS masked
FROM ids""")
def q_mask_tokens(spark, sf_dir):
    x = _ids(spark, sf_dir)
    return x.select("doc_id", VX.mask_tokens("ids", "doc_id", 0.15, 42).alias("masked"))


# -- TF-IDF (E1, E2) and word vectors (E3, C10) ------------------------------------------

TERMS_SQL = f"list_filter(regexp_extract_all(lower(text), {S.q(TF.TERM_PATTERN.replace('{2,}', '+'))}), lambda x: length(x) >= 2)"
VOCAB_SQL = f"""tt AS (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents),
st AS (SELECT term, count(*) AS cnt, count(DISTINCT doc_id) AS df FROM tt GROUP BY term),
voc AS (SELECT term, CAST(cnt AS BIGINT) AS cnt, CAST(df AS BIGINT) AS df,
               ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf
        FROM st ORDER BY cnt DESC, term ASC LIMIT 5000)"""


def _vocab(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return TF.tfidf_fit(d, 5000)


@register("tfidf_fit", "E1", f"WITH {VOCAB_SQL} SELECT term, cnt, df, {S.r6('idf')} AS idf FROM voc")
def q_tfidf_fit(spark, sf_dir):
    v = _vocab(spark, sf_dir)
    return v.select("term", "cnt", "df", F.round("idf", 6).alias("idf"))


@register("tfidf_transform", "E2", f"""WITH {VOCAB_SQL},
tf AS (SELECT doc_id, term, count(*) * max(idf) AS raw FROM tt JOIN voc USING (term) GROUP BY doc_id, term)
SELECT doc_id, term, {S.r6('raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id))')} AS w FROM tf""")
def q_tfidf_transform(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = TF.tfidf_transform(d, _vocab(spark, sf_dir))
    return x.select("doc_id", "term", F.round("w", 6).alias("w"))


@register("word_avg", "E3+C10", f"""WITH {VOCAB_SQL},
wv AS (SELECT term AS word, list_transform(range(0, 16), lambda k: {_u01_sql(7, 'term', 'k')} - 0.5) AS vec FROM voc),
tk AS (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents),
comp AS (SELECT doc_id, unnest(vec) AS val, unnest(range(0, 16)) AS dim FROM tk JOIN wv USING (word)),
m AS (SELECT doc_id, dim, avg(val) AS val FROM comp GROUP BY ALL),
mv AS (SELECT doc_id, list(round(val, 6) ORDER BY dim) AS vec FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(mv.vec, list_transform(range(0, 16), lambda x: {D('0')})) AS vec
FROM documents d LEFT JOIN mv USING (doc_id)""")
def q_word_avg(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    vecs = E.hashed_word_vectors(_vocab(spark, sf_dir), 16, 7)
    w = E.word_avg(d, vecs)
    return w.select("doc_id", rvec("vec").alias("vec"))


# -- E8 registry ---------------------------------------------------------------------------

@register("embed_model", "E8 model", f"""WITH lt AS (SELECT doc_id, unnest(list_transform(range(97, 123), lambda c: length(t) - length(replace(t, chr(CAST(c AS INT)), '')))) AS v,
    unnest(range(0, 26)) AS j FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
rm AS (SELECT j, k, CASE WHEN substr(md5('42-' || CAST(j AS VARCHAR) || '-' || CAST(k AS VARCHAR)), 1, 1) < '8' THEN 1 ELSE -1 END AS r
       FROM range(0, 26) t1(j), range(0, 8) t2(k)),
p AS (SELECT doc_id, k, CAST(greatest(sum(v * r), 0) AS DOUBLE) AS val FROM lt JOIN rm USING (j) GROUP BY ALL)
SELECT doc_id, list(val ORDER BY k) AS vec FROM p GROUP BY doc_id""")
def q_embed_model(spark, sf_dir):
    """Every document through a registered model, in batches."""
    return E.embed(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "letters")


@register("embed_hash_proj", "E8", f"""WITH t AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents),
bk AS (SELECT doc_id, ('0x' || substr(md5(unnest(toks)), 1, 8))::BIGINT % 64 AS b FROM t),
cn AS (SELECT doc_id, b, count(*) AS c FROM bk GROUP BY ALL),
g AS (SELECT doc_id, k FROM t, range(0, 64) r(k))
SELECT g.doc_id, list(CAST(coalesce(cn.c, 0) AS DOUBLE) ORDER BY g.k) AS vec
FROM g LEFT JOIN cn ON cn.doc_id = g.doc_id AND cn.b = g.k GROUP BY g.doc_id""")
def q_embed_hash_proj(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return E.embed(d, "hash_proj", dim=64)
