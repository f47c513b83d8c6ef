"""Registered queries over ``documents`` / ``labels``: text functions and overlap
features (D*, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as G
from ..operators.variants import RULES, rule_variants
from ..session import spread, stored
from ..sources.tables import source_from_quality, table
from . import sqlfrag as S
from .registry import r6, register

N_RULES = len(RULES)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def eligible_with_variants(spark, sf_dir):
    """documents -> tokens -> B6 length filter -> 7 rule variants (row-local)."""
    d = spread(_docs(spark, sf_dir), "doc_id")
    d = G.length_filter(G.with_tokens(d))
    return rule_variants(d)


# -- SQL building blocks ------------------------------------------------------------

def _sql_base(where_len: bool = True) -> str:
    filt = "WHERE len(toks) BETWEEN 5 AND 20000" if where_len else ""
    return f"""
d0 AS (SELECT doc_id, text, {S.words('text')} AS w, {S.tokens('text')} AS toks FROM documents),
d AS (SELECT * FROM d0 {filt})"""


def _sql_variants() -> str:
    parts = [f"SELECT doc_id, {i} AS variant_pos, {S.rule(r, 'text', 'w')} AS vtext FROM d"
             for i, r in enumerate(RULES)]
    return "v AS (" + " UNION ALL ".join(parts) + ")"


def _sql_overlap() -> str:
    cs = ", ".join(f"{S.common(S.ngrams('d.toks', n), S.ngrams('vt.t', n))} AS c{n}" for n in range(1, 5))
    return f"""
vt AS (SELECT doc_id, variant_pos, {S.tokens('vtext')} AS t FROM v),
ov AS (SELECT d.doc_id, vt.variant_pos, len(d.toks) AS n_tokens, {cs}
       FROM vt JOIN d ON vt.doc_id = d.doc_id)"""


def _sql_features_cte() -> str:
    return "WITH " + _sql_base() + "," + _sql_variants() + "," + _sql_overlap()


# -- flagship ------------------------------------------------------------------------

def class_overlap(spark, sf_dir):
    """Flagship: mean n-gram overlap with 7 rewrites (block 1) and distinct n-gram ratio
    (block 3) per class of the labelled corpus."""
    x = eligible_with_variants(spark, sf_dir)
    f = G.overlap_features(x, N_RULES)
    # the features already come from documents: only the labels are joined
    lab = table(spark, sf_dir, "labels").select("doc_id", source_from_quality().alias("source"))
    j = f.join(lab, "doc_id")
    aggs = [F.count("*").alias("n_docs")]
    aggs += [r6(F.avg(f"avg_c{n}")).alias(f"avg_c{n}") for n in range(1, 5)]
    aggs += [r6(F.avg(f"all_c{n}")).alias(f"all_c{n}") for n in range(1, 5)]
    return j.groupBy("source").agg(*aggs)


_CLASS_SQL = _sql_features_cte() + """,
pd AS (SELECT doc_id, """ + ", ".join(
    f"sum(c{n}) / count(*) / max(n_tokens) AS avg_c{n}" for n in range(1, 5)) + """ FROM ov GROUP BY doc_id),
dr AS (SELECT doc_id, """ + ", ".join(
    f"len(list_distinct({S.ngrams('toks', n)})) / len(toks) AS all_c{n}" for n in range(1, 5)) + """ FROM d)
SELECT CASE l.quality WHEN 1 THEN 'human' WHEN 0 THEN 'GPT' END AS source, count(*) AS n_docs, """ + ", ".join(
    [f"{S.r6(f'avg(avg_c{n})')} AS avg_c{n}" for n in range(1, 5)]
    + [f"{S.r6(f'avg(all_c{n})')} AS all_c{n}" for n in range(1, 5)]) + """
FROM pd JOIN dr USING (doc_id) JOIN labels l USING (doc_id)
GROUP BY 1"""

register("class_overlap", "G3+G5 flagship", _CLASS_SQL)(class_overlap)


# -- D1 tokens, B6 length filter -----------------------------------------------------

@register("tokens", "D1", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_types,
       t[1] AS first_token, t[len(t)] AS last_token
FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)""")
def q_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                    F.size(F.array_distinct("t")).cast("long").alias("n_types"),
                    F.try_element_at("t", F.lit(1)).alias("first_token"),
                    F.try_element_at("t", F.lit(-1)).alias("last_token"))


@register("length_filter", "B6", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents) WHERE len(t) BETWEEN 5 AND 20000""")
def q_length_filter(spark, sf_dir):
    d = G.length_filter(G.with_tokens(_docs(spark, sf_dir)))
    return d.select("doc_id", F.col("n_tokens").cast("long"))


# -- D2 n-grams, C8 intersection -----------------------------------------------------

@register("ngrams", "D2", f"""
SELECT doc_id, {', '.join(f"CAST(len({S.ngrams('t', n)}) AS BIGINT) AS n{n}" for n in range(1, 5))},
       {S.ngrams('t', 3)}[1] AS first_trigram, {S.ngrams('t', 4)}[-1] AS last_4gram
FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)""")
def q_ngrams(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("t"))
    d = d.select("doc_id", *[T.ngrams("t", n).alias(f"g{n}") for n in range(1, 5)])
    return d.select("doc_id", *[F.size(f"g{n}").cast("long").alias(f"n{n}") for n in range(1, 5)],
                    F.try_element_at("g3", F.lit(1)).alias("first_trigram"),
                    F.try_element_at("g4", F.lit(-1)).alias("last_4gram"))


@register("ngram_intersection", "C8", _sql_features_cte() + """
SELECT doc_id, variant_pos, c1, c2 FROM ov""")
def q_ngram_intersection(spark, sf_dir):
    # the intersections of a record's variants are counted together, its n-grams made once
    x = rule_variants(G.eligible(spread(_docs(spark, sf_dir), "doc_id")))
    return G.overlap_long(x, top=2).select("doc_id", "variant_pos", "c1", "c2")


# -- D3 common2 (Summary-6 overlap part), D4 common4 --------------------------------

@register("common2", "D3", _sql_features_cte() + """,
leg AS (SELECT vt.doc_id, avg(""" + S.common('d.toks', S.ngrams('vt.t', 2)) + """) AS lu
        FROM vt JOIN d ON vt.doc_id = d.doc_id GROUP BY vt.doc_id)
SELECT doc_id, """ + S.r6("avg(c1)") + " AS common_unigrams, " + S.r6("avg(c2)") + """ AS common_bigrams,
       """ + S.r6("max(lu)") + """ AS legacy_unigrams
FROM ov JOIN leg USING (doc_id) GROUP BY doc_id""")
def q_common2(spark, sf_dir):
    # both forms read the counts of one pass over the texts
    x = stored(G.with_overlap_counts(eligible_with_variants(spark, sf_dir)).select("doc_id", "ov", "vpos"))
    a = G.summary_common2(x)
    b = G.summary_common2(x, legacy_unigrams=True).select(
        "doc_id", F.col("common_unigrams").alias("legacy_unigrams"))
    return a.join(b, "doc_id").select("doc_id", r6("common_unigrams").alias("common_unigrams"),
                                      r6("common_bigrams").alias("common_bigrams"),
                                      r6("legacy_unigrams").alias("legacy_unigrams"))


@register("common4", "D4", _sql_features_cte() + """
SELECT doc_id, variant_pos, c1, c2, c3, c4 FROM ov""")
def q_common4(spark, sf_dir):
    x = eligible_with_variants(spark, sf_dir)
    ov = G.overlap_long(x)
    return ov.select("doc_id", "variant_pos", "c1", "c2", "c3", "c4")


@register("sum_lists", "D5", _sql_features_cte() + """
SELECT doc_id, CAST(sum(c1) AS BIGINT) AS s1, CAST(sum(c2) AS BIGINT) AS s2,
       CAST(sum(c3) AS BIGINT) AS s3, CAST(sum(c4) AS BIGINT) AS s4 FROM ov GROUP BY doc_id""")
def q_sum_lists(spark, sf_dir):
    x = eligible_with_variants(spark, sf_dir)
    ov = G.overlap_long(x)
    # per record the list of per-variant count vectors is bounded by the prompt count
    vecs = ov.groupBy("doc_id").agg(F.collect_list(F.array("c1", "c2", "c3", "c4")).alias("vecs"))
    tot = F.aggregate("vecs", F.array(*[F.lit(0).cast("long")] * 4), lambda a, b: T.sum_lists(a, b))
    return vecs.select("doc_id", tot.alias("s")).select(
        "doc_id", *[F.col("s")[i].alias(f"s{i + 1}") for i in range(4)])


# -- G3 / G4 / G5 / G2 ----------------------------------------------------------------

@register("avg_common", "G3", _sql_features_cte() + """
SELECT doc_id, """ + ", ".join(S.r6(f"sum(c{n}) / count(*) / max(n_tokens)") + f" AS avg_c{n}"
                              for n in range(1, 5)) + " FROM ov GROUP BY doc_id")
def q_avg_common(spark, sf_dir):
    f = G.overlap_features(eligible_with_variants(spark, sf_dir), N_RULES)
    return f.select("doc_id", *[r6(f"avg_c{n}").alias(f"avg_c{n}") for n in range(1, 5)])


@register("per_variant", "G4", _sql_features_cte() + """
SELECT doc_id, variant_pos, """ + ", ".join(S.r6(f"c{n} / n_tokens") + f" AS r{n}" for n in range(1, 5))
          + " FROM ov")
def q_per_variant(spark, sf_dir):
    pv = G.per_variant_long(eligible_with_variants(spark, sf_dir))
    return pv.select("doc_id", "variant_pos", *[r6(f"r{n}").alias(f"r{n}") for n in range(1, 5)])


@register("distinct_ratio", "G5", "WITH " + _sql_base() + """
SELECT doc_id, """ + ", ".join(S.r6(f"len(list_distinct({S.ngrams('toks', n)})) / len(toks)") + f" AS all_c{n}"
                              for n in range(1, 5)) + " FROM d")
def q_distinct_ratio(spark, sf_dir):
    d = G.length_filter(G.with_tokens(_docs(spark, sf_dir)))
    return d.select("doc_id", *[r6(T.distinct_ratio("toks", n)).alias(f"all_c{n}") for n in range(1, 5)])


def _wide_sql() -> str:
    piv = []
    for p in range(N_RULES):
        for n in range(1, 5):
            piv.append(S.r6(f"max(CASE WHEN variant_pos = {p} THEN c{n} / n_tokens END)") + f" AS c{n}_v{p}")
    return _sql_features_cte() + """,
pd AS (SELECT doc_id, CAST(max(n_tokens) AS BIGINT) AS n_tokens, CAST(count(*) AS BIGINT) AS n_variants, """ + ", ".join(
        [S.r6(f"sum(c{n}) / count(*) / max(n_tokens)") + f" AS avg_c{n}" for n in range(1, 5)] + piv) + """
       FROM ov GROUP BY doc_id)
SELECT pd.*, """ + ", ".join(S.r6(f"len(list_distinct({S.ngrams('d.toks', n)})) / len(d.toks)") + f" AS all_c{n}"
                             for n in range(1, 5)) + " FROM pd JOIN d USING (doc_id)"


@register("wide_overlap", "G2 blocks 1-3", _wide_sql())
def q_wide_overlap(spark, sf_dir):
    f = G.overlap_features(eligible_with_variants(spark, sf_dir), N_RULES)
    out = []
    for c in f.columns:
        if c in ("doc_id",):
            out.append(F.col(c))
        elif c in ("n_tokens", "n_variants"):
            out.append(F.col(c).cast("long"))
        else:
            out.append(r6(c).alias(c))
    return f.select(*out)
