"""Registered queries: robustness corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import robust as H
from ..operators import synonyms as SY
from ..operators import tfidf as TF
from ..operators.variants import RULES, promote_variant, rule_variants
from ..session import spread
from ..sources.tables import corpus, source_from_quality, table
from . import sqlfrag as S
from .q_corpus import CORPUS_SQL
from .q_vectors import D, TERMS_SQL, VOCAB_SQL, _h32_sql, _u01_sql
from .registry import register

SEED_MIX = 2023


def _hk(seed, *keys) -> str:
    k = " || '-' || ".join([S.q(str(seed))] + [f"CAST({x} AS VARCHAR)" for x in keys])
    return f"md5({k})"


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


MIX_SQL = f"""dw AS (SELECT doc_id, text, {S.words('text')} AS w, {S.sentences('text')} AS so FROM documents),
v AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS pos, {S.rule(r, 'text', 'w')} AS vtext FROM dw" for i, r in enumerate(RULES))}),
vr AS (SELECT doc_id, pos, vtext, row_number() OVER (PARTITION BY doc_id ORDER BY {_hk(SEED_MIX, 'doc_id', "'p'", 'pos')}) AS slot FROM v),
vc AS (SELECT doc_id, pos, slot, {S.sentences('vtext')} AS s FROM vr WHERE slot <= 4),
vp AS (SELECT doc_id, slot, CASE WHEN len(s) > 0 THEN s[{_h32_sql(SEED_MIX, 'doc_id', "'s'", 'pos')} % len(s) + 1] END AS sent FROM vc),
op AS (SELECT doc_id, 0 AS slot, so[{_h32_sql(SEED_MIX, 'doc_id', "'o'")} % len(so) + 1] AS sent FROM dw WHERE len(so) > 0),
ok AS (SELECT doc_id FROM vp GROUP BY doc_id HAVING count(sent) = 4),
allp AS (SELECT * FROM op WHERE doc_id IN (SELECT doc_id FROM ok) UNION ALL SELECT * FROM vp WHERE doc_id IN (SELECT doc_id FROM op)),
mix AS (SELECT doc_id, string_agg(sent, ' ' ORDER BY {_hk(SEED_MIX, 'doc_id', "'m'", 'slot')}) AS text, 'GPT' AS source
        FROM allp WHERE doc_id IN (SELECT doc_id FROM ok) GROUP BY doc_id)"""


@register("mix", "H1", f"WITH {MIX_SQL} SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars, source FROM mix")
def q_mix(spark, sf_dir):
    m = H.mix_sentences(rule_variants(_docs(spark, sf_dir)), SEED_MIX, 4)
    return m.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"), "source")


@register("combine", "H2", f"""WITH c AS {CORPUS_SQL},
s AS (SELECT *, CASE WHEN source = 'human' THEN 'h' ELSE 'g' END AS side FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {_hk(SEED_MIX, 'side', 'doc_id')}, doc_id) - 1 AS rk FROM s),
m AS (SELECT min(n) AS m FROM (SELECT side, count(*) AS n FROM s GROUP BY side)),
p AS (SELECT * FROM r WHERE rk < (SELECT m FROM m))
SELECT CAST(row_number() OVER (ORDER BY {_hk(SEED_MIX, "'c'", 'side', 'doc_id')}) - 1 AS BIGINT) AS new_index,
       doc_id, source, CAST(length(text) AS BIGINT) AS n_chars FROM p""")
def q_combine(spark, sf_dir):
    c = corpus(spark, sf_dir).select("doc_id", "text", "source")
    out = H.balanced_combine(c.filter("source = 'human'"), c.filter("source = 'GPT'"), SEED_MIX)
    return out.select("new_index", "doc_id", "source", F.length("text").cast("long").alias("n_chars"))


def _synonyms(spark, sf_dir):
    voc = TF.tfidf_fit(_docs(spark, sf_dir), 5000)
    return H.vocabulary_synonyms(voc)


SYN_SQL = f"""{VOCAB_SQL},
syn AS (SELECT term AS word, lead(term) OVER (PARTITION BY length(term) ORDER BY term) AS repl FROM voc)"""


def _edit_sql(seed: int, ws: str) -> str:
    """One seeded character edit of ``{ws}.x``."""
    h = lambda tag: _h32_sql(seed, f'{ws}.doc_id', f'{ws}.si', f'{ws}.wi', f"'{tag}'")
    n = f"length({ws}.x)"
    k = f"CAST({h('k')} % greatest({n}, 1) + 1 AS BIGINT)"
    k2 = f"CAST({h('k')} % greatest({n} - 1, 1) + 1 AS BIGINT)"
    pre = f"substring({ws}.x, 1, {k} - 1)"
    ch = f"substring({ws}.x, {k}, 1)"
    post = f"substring({ws}.x, {k} + 1, greatest({n} - {k}, 0))"
    swap = (f"substring({ws}.x, 1, {k2} - 1) || substring({ws}.x, {k2} + 1, 1) || substring({ws}.x, {k2}, 1) || "
            f"substring({ws}.x, {k2} + 2, greatest({n} - {k2} - 1, 0))")
    return (f"CASE {h('op')} % 4 WHEN 0 THEN CASE WHEN {n} >= 2 THEN {swap} ELSE {ws}.x END "
            f"WHEN 1 THEN CASE WHEN {n} >= 2 THEN {pre} || {post} ELSE {ws}.x END "
            f"WHEN 2 THEN {pre} || {ch} || {ch} || {post} "
            f"ELSE {pre} || translate({ch}, '{H.ALPHABET}', '{H.ROTATED}') || {post} END")


def _space_sql(seed: int, ws: str) -> str:
    """A space at a seeded place inside ``{ws}.x``."""
    k = f"CAST({_h32_sql(seed, f'{ws}.doc_id', f'{ws}.si', f'{ws}.wi', chr(39) + 'sp' + chr(39))} % greatest(length({ws}.x) - 1, 1) + 1 AS BIGINT)"
    return f"CASE WHEN length({ws}.x) >= 2 THEN substring({ws}.x, 1, {k}) || ' ' || substring({ws}.x, {k} + 1) ELSE {ws}.x END"


def _step_sql(kind: str, seed: int, src: str, tag: str) -> str:
    """CTEs ending in ``t_{tag} (doc_id, text)``: ``src`` with one kind of edit on its
    seeded share of words."""
    ws = f"ws_{tag}"
    change = {"words": "coalesce(syn.repl, {0}.x)", "chars": _edit_sql(seed, ws), "space": _space_sql(seed, ws),
              "look": f"translate({ws}.x, '{H.LOOKALIKE_FROM}', '{H.LOOKALIKE_TO}')"}[kind].replace("{0}", ws)
    join = f"LEFT JOIN syn ON syn.word = lower({ws}.x) AND syn.repl IS NOT NULL" if kind == "words" else ""
    return f"""ss_{tag} AS (SELECT doc_id, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS si FROM (SELECT doc_id, {S.sentences('text')} AS s FROM {src})),
{ws} AS (SELECT doc_id, si, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS wi FROM (SELECT doc_id, si, {S.words('sent')} AS w FROM ss_{tag})),
wo_{tag} AS (SELECT {ws}.doc_id, {ws}.si, {ws}.wi, CASE WHEN {_u01_sql(seed, f'{ws}.doc_id', f'{ws}.si', f'{ws}.wi')} < 0.1 THEN {change} ELSE {ws}.x END AS y FROM {ws} {join}),
so_{tag} AS (SELECT doc_id, si, string_agg(y, ' ' ORDER BY wi) AS sent FROM wo_{tag} GROUP BY doc_id, si),
dt_{tag} AS (SELECT doc_id, string_agg(sent, ' ' ORDER BY si) AS t FROM so_{tag} GROUP BY doc_id),
t_{tag} AS (SELECT d.doc_id, coalesce(dt.t, '') AS text FROM {src} d LEFT JOIN dt_{tag} dt ON dt.doc_id = d.doc_id)"""


def _perturb_sql(kind: str, seed: int) -> str:
    pre = SYN_SQL + ", " if kind == "words" else ""
    return (f"WITH {pre}{_step_sql(kind, seed, 'documents', 'a')} "
            "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM t_a")


def _mixed_sql(src: str, tag: str, seed: int = 17) -> str:
    return ", ".join([_step_sql("words", seed, src, f"{tag}1"), _step_sql("chars", seed + 1, f"t_{tag}1", f"{tag}2"),
                      _step_sql("look", seed + 2, f"t_{tag}2", f"{tag}3")])


@register("perturb_words", "H3+H6", _perturb_sql("words", 11))
def q_perturb_words(spark, sf_dir):
    t = H.edited("text", "doc_id", H.words_step(11), H.known_synonyms(_synonyms(spark, sf_dir)))
    return _digest(_docs(spark, sf_dir).select("doc_id", t.alias("text")))


@register("perturb_chars", "H4+H6", _perturb_sql("chars", 13))
def q_perturb_chars(spark, sf_dir):
    t = H.edited("text", "doc_id", H.chars_step(13))
    return _digest(_docs(spark, sf_dir).select("doc_id", t.alias("text")))


@register("perturb_mixed", "H5", f"WITH {SYN_SQL}, {_mixed_sql('documents', 'm')} "
          "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM t_m3")
def q_perturb_mixed(spark, sf_dir):
    t = H.edited("text", "doc_id", H.mixed_steps(17), H.known_synonyms(_synonyms(spark, sf_dir)))
    return _digest(_docs(spark, sf_dir).select("doc_id", t.alias("text")))


DIM, SEED_CONTEXT = SY.DIM, 5
NEAR_SQL = f"""{VOCAB_SQL},
tl AS (SELECT doc_id, t, list_transform(t, lambda x: CAST({_h32_sql(SEED_CONTEXT, 'x')} % {DIM} AS INT)) AS b FROM (SELECT doc_id, {TERMS_SQL} AS t FROM documents)),
tp AS (SELECT doc_id, unnest(t) AS term, unnest(b) AS b, generate_subscripts(t, 1) AS i FROM tl),
nx AS (SELECT term, b, lead(term, 1) OVER w AS t1, lead(b, 1) OVER w AS b1, lead(term, 2) OVER w AS t2, lead(b, 2) OVER w AS b2 FROM tp WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cp AS (SELECT term, b1 + {DIM} AS bucket FROM nx WHERE t1 IS NOT NULL UNION ALL SELECT t1, b FROM nx WHERE t1 IS NOT NULL
       UNION ALL SELECT term, b2 + {DIM} FROM nx WHERE t2 IS NOT NULL UNION ALL SELECT t2, b FROM nx WHERE t2 IS NOT NULL),
cc AS (SELECT term, bucket, count(*) AS c FROM cp WHERE term IN (SELECT term FROM voc) GROUP BY ALL),
pm AS (SELECT term, bucket, greatest(ln(CAST(c AS DOUBLE) * sum(c) OVER () / (CAST(sum(c) OVER (PARTITION BY term) AS DOUBLE) * sum(c) OVER (PARTITION BY bucket))), {D('0')}) AS v FROM cc),
vm AS (SELECT term, map_from_entries(list((bucket, v))) AS m FROM pm GROUP BY term),
ve AS (SELECT term, list_transform(range(0, {2 * DIM}), lambda k: coalesce(m[CAST(k AS INT)], {D('0')})) AS e FROM vm),
vn AS (SELECT term, e, sqrt(list_inner_product(e, e)) AS s FROM ve WHERE list_inner_product(e, e) > 0),
vd AS (SELECT a.term AS word, b.term AS repl, round(least(greatest(1.0 - list_inner_product(a.e, b.e) / (a.s * b.s), 0.0), 2.0), 12) AS dist FROM vn a JOIN vn b ON a.term <> b.term),
syn AS (SELECT word, repl, 1.0 - dist AS similarity FROM (SELECT word, repl, dist, row_number() OVER (PARTITION BY word ORDER BY dist, repl) AS place FROM vd)
        WHERE place = 1 AND 1.0 - dist >= {SY.FLOOR})"""


def _near(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return SY.near_synonyms(SY.context_vectors(d, TF.tfidf_fit(d, 5000), seed=SEED_CONTEXT))


@register("near_synonyms", "H3 table", f"WITH {NEAR_SQL} SELECT word, repl, {S.r6('similarity')} AS similarity FROM syn")
def q_near_synonyms(spark, sf_dir):
    """Near-synonyms of the frequent words: nearest by context, above the floor."""
    return _near(spark, sf_dir).select("word", "repl", F.round("similarity", 6).alias("similarity"))


@register("perturb_near", "H3+H5", f"WITH {NEAR_SQL}, {_mixed_sql('documents', 'n', 19)}, {_step_sql('space', 22, 't_n3', 'n4')} "
          "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM t_n4")
def q_perturb_near(spark, sf_dir):
    """Near-synonyms, character edits, look-alikes and inserted spaces."""
    t = H.edited("text", "doc_id", H.mixed_steps(19, spaces=True), H.known_synonyms(_near(spark, sf_dir)))
    return _digest(_docs(spark, sf_dir).select("doc_id", t.alias("text")))


def _digest(d):
    """Digests of a text that is computed once (a stored column, not an expression that
    both digests would run)."""
    d = d.select("doc_id", F.explode(F.array("text")).alias("text"))
    return d.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@register("with_perturbations", "H7+B10", f"""WITH {SYN_SQL},
c AS (SELECT * FROM {CORPUS_SQL} WHERE text IS NOT NULL AND trim(text) <> ''),
{_step_sql('words', 11, 'c', 'w')}, {_step_sql('chars', 13, 'c', 'k')}, {_mixed_sql('c', 'm')}
SELECT c.doc_id, source, md5(t_w.text) AS words_md5, md5(t_k.text) AS chars_md5, md5(t_m3.text) AS mixed_md5
FROM c JOIN t_w USING (doc_id) JOIN t_k USING (doc_id) JOIN t_m3 USING (doc_id)""")
def q_with_perturbations(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", source_from_quality().alias("source"))
    c = _docs(spark, sf_dir).join(lab, "doc_id")
    x = H.with_perturbations(c, _synonyms(spark, sf_dir))
    # Each perturbed column in turn becomes the text
    parts = [promote_variant(x, f"perturb_{k}").select("doc_id", F.md5("text").alias(f"{k}_md5")) for k in ("chars", "mixed")]
    out = promote_variant(x, "perturb_words").select("doc_id", "source", F.md5("text").alias("words_md5"))
    for p in parts:
        out = out.join(p, "doc_id")
    return out
