"""Registered queries: corpus projections/filters (B*), joins, set operations and
ordering (C*)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import features as G
from ..operators import sentences as SN
from ..operators import variants as V
from ..session import spread
from ..sources.tables import corpus, table
from . import sqlfrag as S
from .registry import r6, register

CORPUS_SQL = """(SELECT d.doc_id, d.text, d.lang AS domain,
        CASE l.quality WHEN 1 THEN 'human' WHEN 0 THEN 'GPT' END AS source
 FROM documents d JOIN labels l USING (doc_id))"""
CORPUS_ALL_SQL = CORPUS_SQL.replace("JOIN labels", "LEFT JOIN labels")


@register("core_fields", "B1", f"""
SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars FROM {CORPUS_SQL}""")
def q_core_fields(spark, sf_dir):
    c = C.core_fields(corpus(spark, sf_dir))
    return c.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"))


_CODE_SQL = """(SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS explanation,
        CASE WHEN turn % 2 = 0 THEN '' END AS implementation, text,
        CASE WHEN role = 'assistant' THEN 'GPT' END AS source FROM conversations)"""


@register("coalesce_text", "B2", f"""
SELECT conv_id, turn, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars, source FROM (
  SELECT conv_id, turn,
         coalesce(CASE WHEN coalesce(explanation, '') || coalesce(implementation, '') <> ''
                       THEN coalesce(explanation, '') || coalesce(implementation, '') END, text, '') AS t,
         coalesce(source, 'unknown') AS source
  FROM {_CODE_SQL})""")
def q_coalesce_text(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    code = conv.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.col("text")).alias("explanation"),
        F.when(F.col("turn") % 2 == 0, F.lit("")).alias("implementation"),
        "text", F.when(F.col("role") == "assistant", F.lit("GPT")).alias("source"))
    out = C.coalesce_text(code.withColumn("doc_id", F.struct("conv_id", "turn")))
    return out.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"),
                      F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"),
                      "source")


@register("labels", "B3", f"""
SELECT doc_id, domain, CASE WHEN source = 'human' THEN 0 ELSE 1 END AS label FROM {CORPUS_ALL_SQL}""")
def q_labels(spark, sf_dir):
    c = corpus(spark, sf_dir, labelled_only=False)
    return c.select("doc_id", "domain", C.label_from_source("source").alias("label"))


@register("truncate", "B4", f"""
SELECT doc_id, CAST(length(array_to_string(w[1:1024], ' ')) AS BIGINT) AS tok_cut_chars,
       CAST(length(substr(text, 1, 4000)) AS BIGINT) AS char_cut_chars
FROM (SELECT doc_id, text, {S.words('text')} AS w FROM documents)""")
def q_truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    cut = C.truncate_text(d, 1024, "tokens").withColumnRenamed("text", "by_tokens")
    cut = C.truncate_text(cut.withColumnRenamed("whole", "text"), 4000, "chars")
    return cut.select("doc_id", F.length("by_tokens").cast("long").alias("tok_cut_chars"),
                      F.length("text").cast("long").alias("char_cut_chars"))


@register("drop_missing", "B5", f"""
SELECT domain, source, CAST(count(*) AS BIGINT) AS n FROM {CORPUS_ALL_SQL}
WHERE source IS NOT NULL AND text IS NOT NULL AND trim(text) <> '' GROUP BY domain, source""")
def q_drop_missing(spark, sf_dir):
    c = C.drop_missing(corpus(spark, sf_dir, labelled_only=False))
    return c.groupBy("domain", "source").agg(F.count("*").cast("long").alias("n"))


@register("skip_counts", "B5 counts", f"""
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN source IS NULL THEN 'no_source' WHEN text IS NULL THEN 'no_text' WHEN trim(text) = '' THEN 'blank_text' ELSE 'kept' END AS reason FROM {CORPUS_ALL_SQL}) GROUP BY reason""")
def q_skip_counts(spark, sf_dir):
    """Counts of kept and skipped records as they fall out of the pass that drops them."""
    counts = Observation()
    kept = C.drop_missing(corpus(spark, sf_dir, labelled_only=False), counts=counts)
    kept.select("doc_id").write.format("noop").mode("overwrite").save()
    seen = [(k[2:], n) for k, n in counts.get.items() if n]
    return spark.createDataFrame(seen, "reason string, n long")


@register("first_n", "B7", """
SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 200""")
def q_first_n(spark, sf_dir):
    return C.first_n(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 200)


def _wide_rules(spark, sf_dir):
    """Rewrite record in the reference's wide shape: one string column per prompt; an
    empty rewrite is missing (null)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    # split once; a rule given no words splits the text itself
    d = d.withColumn("_w", T.words("text"))
    cols = [F.nullif(V.rule_rewrite(r, "text", F.col("_w")), F.lit("")).alias(V.TEXT_PROMPTS[i])
            for i, r in enumerate(V.RULES)]
    return d.select("doc_id", "text", F.lit("src").alias("source"), *cols)


def _sql_rules_long(where: str = "") -> str:
    parts = [f"SELECT doc_id, {S.q(V.TEXT_PROMPTS[i])} AS variant, NULLIF({S.rule(r, 'text', 'w')}, '') AS vtext FROM base"
             for i, r in enumerate(V.RULES)]
    return ("WITH base AS (SELECT doc_id, text, " + S.words("text") + " AS w FROM documents), "
            "lv AS (" + " UNION ALL ".join(parts) + ")")


@register("unpivot", "B8", _sql_rules_long() + """
SELECT doc_id, variant, CAST(length(vtext) AS BIGINT) AS n_chars FROM lv WHERE vtext IS NOT NULL""")
def q_unpivot(spark, sf_dir):
    w = _wide_rules(spark, sf_dir)
    u = V.unpivot_variants(w, ["doc_id", "text", "source"])
    return u.select("doc_id", "variant", F.length("text").cast("long").alias("n_chars"))


@register("known_variants", "B9", _sql_rules_long() + """,
p AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {S.q(p)})" for i, p in enumerate(V.TEXT_PROMPTS[:4])) + """) t(variant_pos, prompt))
SELECT doc_id, variant_pos, CAST(length(vtext) AS BIGINT) AS n_chars FROM lv JOIN p ON lv.variant = p.prompt
WHERE vtext IS NOT NULL""")
def q_known_variants(spark, sf_dir):
    w = _wide_rules(spark, sf_dir)
    u = V.unpivot_variants(w, ["doc_id", "text", "source"])
    known = V.prompts_df(spark).filter(F.col("variant_pos") < 4)   # only 4 of 7 prompts are "known"
    k = V.known_variants(u, known)
    return k.select("doc_id", "variant_pos", F.length("text").cast("long").alias("n_chars"))


@register("align", "C1", f"""
SELECT c.doc_id, c.source, {S.r6("len(list_distinct(t)) / len(t)")} AS all_c1
FROM {CORPUS_SQL} c JOIN (SELECT doc_id, {S.tokens('text')} AS t FROM documents) f USING (doc_id)
WHERE len(t) BETWEEN 5 AND 20000""")
def q_align(spark, sf_dir):
    feats = G.length_filter(G.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    feats = feats.select("doc_id", r6(T.distinct_ratio("toks", 1)).alias("all_c1"))
    aligned, _report = C.align_features(corpus(spark, sf_dir).select("doc_id", "source"), feats)
    return aligned


@register("align_report", "C1 report", f"""
SELECT CAST(count(*) FILTER (WHERE c.doc_id IS NULL) AS BIGINT) AS features_only,
       CAST(count(*) FILTER (WHERE f.doc_id IS NULL) AS BIGINT) AS records_only,
       CAST(count(*) FILTER (WHERE c.doc_id IS NOT NULL AND f.doc_id IS NOT NULL) AS BIGINT) AS matched
FROM {CORPUS_SQL} c FULL OUTER JOIN
     (SELECT doc_id FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents) WHERE len(t) BETWEEN 5 AND 20000) f
     USING (doc_id)""")
def q_align_report(spark, sf_dir):
    feats = G.length_filter(G.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    _aligned, rep = C.align_features(corpus(spark, sf_dir).select("doc_id", "source"), feats.select("doc_id"))
    return rep.select(*[F.col(c).cast("long") for c in rep.columns])


@register("pending", "C2", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_pending(spark, sf_dir):
    return C.pending_docs(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"))


@register("requests", "C3", f"""
WITH p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {S.q(p)})" for i, p in enumerate(V.TEXT_PROMPTS))}) t(variant_pos, prompt))
SELECT doc_id, variant_pos, md5(prompt || ': "' || text || '"') AS request_md5,
       CAST(length(prompt || ': "' || text || '"') AS BIGINT) AS request_chars
FROM {CORPUS_SQL} c, p""")
def q_requests(spark, sf_dir):
    r = V.rewrite_requests(corpus(spark, sf_dir), V.TEXT_PROMPTS)
    return r.select("doc_id", "variant_pos", F.md5("request").alias("request_md5"),
                    F.length("request").cast("long").alias("request_chars"))


_PAIRS_SQL = """(SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS reply
 FROM conversations u JOIN conversations a
   ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
 WHERE u.role = 'user')"""


@register("attach", "C4", f"""
SELECT m.conv_id, m.turn, CAST(count(p.reply) AS BIGINT) AS n_variants,
       max(md5(p.reply)) AS reply_md5
FROM conversations m LEFT JOIN {_PAIRS_SQL} p ON p.conv_id = m.conv_id AND p.turn = m.turn
WHERE m.role = 'user' GROUP BY m.conv_id, m.turn""")
def q_attach(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    pairs = V.conversation_pairs(conv)
    users = conv.filter(F.col("role") == "user").select(
        F.struct("conv_id", "turn").alias("doc_id"), "text")
    resp = pairs.select("doc_id", F.lit(0).alias("variant_pos"), F.col("reply").alias("text"))
    att = V.attach_rewrites(users, resp)
    return att.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"), F.size("variants").cast("long").alias("n_variants"),
                      F.md5(F.try_element_at("variants", F.lit(1))["text"]).alias("reply_md5"))


@register("union", "C5", """
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT text, 'documents' AS source FROM documents UNION ALL SELECT text, 'benchmark' FROM benchmark)
GROUP BY source""")
def q_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("text", F.lit("documents").alias("source"))
    b = table(spark, sf_dir, "benchmark").select("text", F.lit("benchmark").alias("source"))
    u = C.union_sources(d, b)
    return u.groupBy("source").agg(F.count("*").cast("long").alias("n"),
                                   F.sum(F.length("text")).cast("long").alias("chars"))


@register("shuffle", "C6", """
SELECT doc_id, md5('2023-' || CAST(doc_id AS VARCHAR)) AS shuffle_key,
       CAST(row_number() OVER (ORDER BY md5('2023-' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS BIGINT) AS pos
FROM labels""")
def q_shuffle(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id")
    from ..functions.sampling import hkey
    x = C.shuffle_rows(lab, 2023).withColumn("shuffle_key", hkey(2023, "doc_id"))
    return C.dense_index(x, ["shuffle_key", "doc_id"], "pos")


@register("reindex", "C7", f"""
SELECT doc_id, source, CAST(row_number() OVER (ORDER BY md5('2023-' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS BIGINT) AS new_index
FROM {CORPUS_SQL}""")
def q_reindex(spark, sf_dir):
    c = corpus(spark, sf_dir).select("doc_id", "source")
    return C.reindex(c, 2023, "doc_id", "new_index")


@register("combined_text", "D7", "WITH " + """
d AS (SELECT doc_id, text, """ + S.words("text") + """ AS w FROM documents),
c AS (SELECT doc_id, concat_ws(' ', text, """ + " || ' ' || ".join(S.rule(r, 'text', 'w') for r in V.RULES) + """) AS ct FROM d)
SELECT doc_id, CAST(length(ct) AS BIGINT) AS n_chars, md5(ct) AS combined_md5 FROM c""")
def q_combined_text(spark, sf_dir):
    d = V.rule_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ct = T.combined_text("text", F.transform("variants", lambda v: v["text"]))
    return d.select("doc_id", F.length(ct).cast("long").alias("n_chars"), F.md5(ct).alias("combined_md5"))


@register("sentences", "D6", f"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, s[1] AS first_sentence,
       CAST(length(array_to_string(s, ' ')) AS BIGINT) AS joined_chars
FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)""")
def q_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"),
                    F.try_element_at("s", F.lit(1)).alias("first_sentence"),
                    F.length(T.join_sentences("s")).cast("long").alias("joined_chars"))


# fixed values: the characters around a token, its white space
_AROUND = "chr(34) || chr(39) || '()[]{}«»“”‘’„,;:!?'"
_TYPES_SQL = f"""tk AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+') AS t FROM documents WHERE text IS NOT NULL),
tp AS (SELECT unnest(list_zip(t, list_prepend(NULL, t)[1:len(t)])) AS r FROM tk),
tc AS (SELECT trim(r[1], {_AROUND}) AS c, trim(r[2], {_AROUND}) AS b FROM tp),
tt AS (SELECT lower(rtrim(c, '.')) AS type, regexp_matches(c, '[^.]\\.$') AS dot, lower(rtrim(b, '.')) AS before, coalesce(regexp_matches(b, '[^.]\\.$'), false) AS dot_before
       FROM tc WHERE regexp_matches(lower(rtrim(c, '.')), '\\pL')),
ct AS (SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (dot) AS BIGINT) AS n_dot FROM tt GROUP BY type)"""


@register("sentence_types", "D6 counts", f"WITH {_TYPES_SQL} SELECT type, n, n_dot FROM ct")
def q_sentence_types(spark, sf_dir):
    return SN.type_counts(SN.token_types(table(spark, sf_dir, "documents")))


def _ll(k, n, p):
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


@register("sentences_learned", "D6 learned", f"""WITH {_TYPES_SQL},
al AS (SELECT sum(n) AS total, sum(n_dot) / sum(n) AS p FROM ct),
sc AS (SELECT type, -2 * ({_ll('n_dot', 'n', 'p')} - {_ll('n_dot', 'n', '0.99')}) * exp(-length(replace(type, '.', '')))
         * (length(type) - length(replace(type, '.', '')) + 1) * pow(CAST(length(replace(type, '.', '')) AS DOUBLE), -(n - n_dot)) AS score FROM ct, al WHERE n_dot > 0),
ab AS (SELECT list(type) AS a FROM sc WHERE score >= 0.3),
st AS (SELECT type, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (dot_before AND NOT list_contains(coalesce(a, []), before) AND length(before) > 1) AS DOUBLE) AS k FROM tt, ab GROUP BY type),
sl AS (SELECT sum(n) AS m, sum(k) AS e FROM st),
ss AS (SELECT type, -2 * ({_ll('k', 'e', '(n / m)')} + {_ll('(n - k)', '(m - e)', '(n / m)')} - {_ll('k', 'e', '(k / e)')} - {_ll('(n - k)', '(m - e)', '((n - k) / (m - e))')}) AS ratio
       FROM st, sl WHERE k > 0 AND m / e > n / k),
so AS (SELECT list(type) AS s FROM ss WHERE ratio >= 30),
se AS (SELECT doc_id, {S.sentences('text')} AS s FROM documents),
bo AS (SELECT doc_id, unnest(list_zip(s[:len(s) - 1], s[2:])) AS r FROM se WHERE len(s) > 1),
bt AS (SELECT doc_id, trim(regexp_extract(r[1], '[^ \\t\\n\\r\\f\\x0B]+$'), {_AROUND}) AS c, lower(rtrim(trim(regexp_extract(r[2], '[^ \\t\\n\\r\\f\\x0B]+'), {_AROUND}), '.')) AS f FROM bo),
j AS (SELECT doc_id, count(*) AS n FROM bt, ab, so WHERE regexp_matches(c, '[^.]\\.$')
        AND (list_contains(coalesce(a, []), lower(rtrim(c, '.'))) OR regexp_matches(lower(rtrim(c, '.')), '^\\pL$')) AND NOT list_contains(coalesce(s, []), f) GROUP BY doc_id)
SELECT se.doc_id, CAST(len(s) - coalesce(j.n, 0) AS BIGINT) AS n_sentences FROM se LEFT JOIN j ON j.doc_id = se.doc_id""")
def q_sentences_learned(spark, sf_dir):
    """Sentences by abbreviations and starters learned from all documents."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.size(SN.learn(d)("text")).cast("long").alias("n_sentences"))
