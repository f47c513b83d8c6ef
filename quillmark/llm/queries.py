"""The registered queries ``opN_*`` over the whole tables, and the DuckDB statements for
those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, embedding_dedup, fingerprint, language_id, lattice_lm, license_scan, line_dedup, merkle, ngram_join, packing, spelling, suffix_dedup, toxicity
from ._common import table, two_columns

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.spans(table(spark, sf_dir, "documents")))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_lattice_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = two_columns(table(spark, sf_dir, "documents"))
    docs = docs.withColumn("held_out", F.coalesce(language_id.held_out(parts=7), F.lit(False)))
    return lattice_lm.score(docs, lattice_lm.fit(docs.where("not held_out"), PIECES))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out()
    model = language_id.fit(docs.where(~held))
    out = language_id.predict(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(language_id.held_out(), F.lit(False))
    model = toxicity.fit(toxicity.labelled(docs.where(~held), table(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spelling.group_variants(table(spark, sf_dir, "documents"), spelling.drop_a_letter)
    return out.select("word", "n", "n_near", "form", "form_n", "root")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(merkle.leaves(docs, tampered=tampered)).withColumnRenamed("key", "doc_id")


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: crc32 of the bytes of ``{0}`` (hex) as a DuckDB expression; ``crc_table`` is its table, a list.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length({0}) // 2), lambda i: CAST('0x' || substr({0}, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, crc_table[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"""
_CRC_TABLE = """one AS (SELECT list(c ORDER BY i) AS crc_table FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _fold(tree: str, start: str) -> str:
    """Recursion that folds ``start`` (doc_id, grp, idx, h) up the trees of ``tree``."""
    return f"""
  SELECT doc_id, grp, 0 AS level, idx, h FROM {start}
  UNION ALL
  SELECT f.doc_id, f.grp, f.level + 1, f.idx // 3, sha256(string_agg(CASE WHEN t.idx = f.idx THEN f.h ELSE t.h END, '' ORDER BY t.idx))
  FROM f JOIN {tree} t ON t.grp = f.grp AND t.level = f.level AND t.idx // 3 = f.idx // 3 WHERE t.m > 1 GROUP BY f.doc_id, f.grp, f.level, f.idx"""


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _merkle_sql() -> str:
    leaf = " || ".join(_field(c) for c in merkle.FIELDS)
    grown = """SELECT grp, 0 AS level, idx, h, m FROM {0} UNION ALL
  SELECT grp, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (m + 2) // 3 FROM {1} WHERE m > 1 GROUP BY grp, level, idx // 3, m"""
    return f"""
WITH RECURSIVE {_CRC_TABLE},
x AS (SELECT *, hex(CAST(doc_id AS VARCHAR)) AS hx FROM documents, one),
d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN {_CRC.format('hx')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM x),
s AS (SELECT source AS name, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT source FROM d)),
l AS (SELECT doc_id, source, grp, sha256({leaf}) AS h, sha256({leaf.replace('CAST(text AS', 'CAST(cut AS')}) AS bad,
      row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS m
      FROM d JOIN s ON source IS NOT DISTINCT FROM name),
t AS ({grown.format('l', 't')}),
b AS (SELECT 0 AS grp, grp AS idx, h, count(*) OVER () AS m FROM t WHERE m = 1),
u AS ({grown.format('b', 'u')}),
f AS ({_fold('t', '(SELECT doc_id, grp, idx, bad AS h FROM l)')}),
f1 AS (SELECT doc_id, arg_max(h, level) AS h FROM f GROUP BY doc_id),
g AS ({_fold('u', '(SELECT doc_id, 0 AS grp, grp AS idx, f1.h AS h FROM l JOIN f1 USING (doc_id))').replace('FROM f JOIN', 'FROM g AS f JOIN')}),
g1 AS (SELECT doc_id, arg_max(h, level) AS folded_root FROM g GROUP BY doc_id),
p AS (
  SELECT doc_id, 0 AS phase, level, t.idx AS i, t.h AS h FROM l JOIN t ON t.grp = l.grp AND t.m > 1 AND t.idx // 3 = CAST(floor(l.idx / pow(3, level + 1)) AS BIGINT) AND t.idx <> CAST(floor(l.idx / pow(3, level)) AS BIGINT)
  UNION ALL
  SELECT doc_id, 1, level, u.idx, u.h FROM l JOIN u ON u.m > 1 AND u.idx // 3 = CAST(floor(l.grp / pow(3, level + 1)) AS BIGINT) AND u.idx <> CAST(floor(l.grp / pow(3, level)) AS BIGINT)),
q AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY phase, level, i)) AS proof_sha256 FROM p GROUP BY doc_id)
SELECT l.doc_id, l.source, l.h AS leaf, b.h AS subroot, (SELECT h FROM u WHERE m = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM u WHERE m = 1) AS verified
FROM l JOIN b ON b.idx = l.grp JOIN g1 USING (doc_id) LEFT JOIN q USING (doc_id)"""


_SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS n, hex(doc_id || ':' || run) AS hx FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, n, {_CRC.format('hx')} AS h FROM o, one),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.part = b.word
      UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.part = b.word),
c AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, f := near)) AS best FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * w.n THEN best.f END AS form, CASE WHEN -best.m >= 5 * w.n THEN -best.m END AS form_n
      FROM w LEFT JOIN c USING (word)),
g(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, z.root FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM g GROUP BY word) z ON z.word = f.word"""

SQL = {
    "op12_spelling_variants": _SPELLING_SQL,
    "op13_merkle_manifest": _merkle_sql(),
    "op10_license_scan": license_scan.oracle(),
    "op3_embedding_near_dedup": """
WITH RECURSIVE d AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM d a JOIN d b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(vec_id, near) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.y FROM r JOIN e ON r.near = e.x),
c AS (SELECT vec_id, min(near) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id""",
    "op1_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LETTERS}) AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
r AS (SELECT k.doc_id, pos, line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id""",
    "op2_suffix_array_dedup": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
-- windows from parts of 200 bytes (and 49 more), so that no long string is searched for each
c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 498) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 200)) AS o FROM d)),
w AS (SELECT doc_id, o + i AS i, substr(part, 2 * i + 1, 100) AS g
      FROM (SELECT doc_id, o, part, unnest(range(0, least(200, length(part) // 2 - 49))) AS i FROM c)),
m AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
x AS (SELECT w.doc_id, i FROM w JOIN m ON w.g = m.g WHERE low < w.doc_id),
y AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM x),
z AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM y),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM z GROUP BY doc_id, run),
k AS (
  SELECT s.doc_id, a, b - a AS n, substr(h, 2 * coalesce(lag(b) OVER p, 0) + 1, 2 * (a - coalesce(lag(b) OVER p, 0))) AS part,
         CASE WHEN lead(a) OVER p IS NULL THEN substr(h, 2 * b + 1) ELSE '' END AS tail
  FROM s JOIN d ON d.doc_id = s.doc_id WINDOW p AS (PARTITION BY s.doc_id ORDER BY a)),
r AS (SELECT doc_id, sum(n) AS n_removed, count(*) AS n_spans, string_agg(part || tail, '' ORDER BY a) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id""",
    "op9_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.near = b.x),
c AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
