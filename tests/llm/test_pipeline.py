"""Registered queries of the operators and the pipeline."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillmark.llm import language_id, line_dedup, packing, queries
from tests.oracle_check import compare, duck

from .test_join_operators import groups, shingles
from .test_text_operators import key

SF = "/root/testdata/sf0.001"


def test_ten_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    r = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert r["ok"], r


def near_kept(rows):
    sets = [(i, shingles(t, 5)) for i, t in rows]
    edges = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1:] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    comp = groups({i for i, _ in rows}, edges)
    return {i for i in comp if comp[i] == i}


def cut(rows, window=50):
    first = {}
    for i, t in sorted(rows):
        raw = t.encode()
        for k in range(len(raw) - window + 1):
            first.setdefault(raw[k:k + window], i)
    out = {}
    for i, t in rows:
        raw = t.encode()
        gone = [False] * (len(raw) + 1)
        for k in range(len(raw) - window + 1):
            if first[raw[k:k + window]] < i:
                gone[k:k + window] = [True] * window
        kept, a = [], 0
        for ch in t:
            b = a + len(ch.encode())
            if not all(gone[a:b]):
                kept.append(ch)
            a = b
        out[i] = "".join(kept)
    return out


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()

    model = language_id.fit(docs.where(~language_id.held_out()))
    said = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    texts = [(i, rows[i].text) for i in sorted(rows) if said[i].lang_pred != "und"]
    holders = Counter(k for _, t in texts for k in {key(x) for x in t.split("\n")} - {None})
    keep = {k: max(i for i, t in texts if k in {key(x) for x in t.split("\n")}) for k, n in holders.items() if n >= line_dedup.MIN_DOCS}
    texts = [(i, "\n".join(x for x in t.split("\n") if keep.get(key(x), i) == i)) for i, t in texts]
    stay = near_kept(texts)
    final = cut([(i, t) for i, t in texts if i in stay])
    ids = dict(zip(final, packing.ids_of(list(final.values()), open(queries.TOKENIZER, encoding="utf-8").read())))
    want = {i: len(x) + 1 for i, x in ids.items()}
    assert dict(Counter({r.doc_id: 0 for r in got})).keys() == want.keys()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert dict(total) == want


def test_stages_keep_columns_and_survive_odd_rows(spark, docs, corpus):
    from pyspark.sql import functions as F

    d = docs.withColumn("lang", F.when(F.col("doc_id") < 90, "xx")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        d = corpus_pipeline.stored(out)
        assert d.count() > 0
        assert stage(spark, d.where("false"), SF).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert last.count() >= d.count()


def test_stages_keep_columns_of_any_name(spark, corpus):
    names = ["_id", "_keys", "_text", "_lang_pred", "_score", "_kept", "_node", "_first", "a.b", "component_id", "_bucket", "TEXT"]
    rows = [(i, t, "xx" if k % 2 else None, None, 1, *range(k, k + len(names))) for k, (i, t) in enumerate(corpus)] + [(None, "many rows without an id", "xx", None, 1, *range(len(names)))] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names)).repartition(3)
    extra = {(r[0], *r[5:]) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, d, SF).toDF(*[f"c{i}" for i in range(len(d.columns))])).toDF(*d.columns)
        assert out.columns == d.columns, name
        assert {(r[0], *r[5:]) for r in out.collect()} <= extra, name
        assert out.where("doc_id is null").count() >= 50, name
        d = out
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() >= d.count()


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = corpus_pipeline.language_stage(spark, docs, SF).count()
    assert left >= 0.98 * docs.count()


def test_documents_of_several_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = {}
    for r in docs.where("lang is not null and n_chars > 2000").orderBy("doc_id").collect():
        long.setdefault(r.lang, r.text)
    a, b, c = (long[k] for k in sorted(long)[:3])
    mixed = " ".join([a[:800], b[:700], c[:500]])
    rows = spark.createDataFrame([(10**9, mixed, None, "s", len(mixed)), (10**9 + 1, "12 34 !!", None, "s", 8)], docs.schema)
    model = language_id.fit(docs.where(~language_id.held_out()))
    said = {r.doc_id: r.score for r in language_id.predict(rows, model).collect()}
    assert 0 < said[10**9] < 0.5
    left = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.union(rows), SF).collect()}
    assert 10**9 in left and 10**9 + 1 not in left


def test_texts_that_share_an_id_go_by_their_own_near_duplicates(spark):
    a, z, w, v, u = (" ".join(f"{k}{i}" for i in range(60)) for k in "azwvu")
    rows = [(1, a), (2, a), (2, z), (2, z), (3, a + " more"), (4, w), (4, v), (5, w + " more"), (6, u), (6, u + " more"), (7, None), (7, u), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, df, SF)
    assert got.columns == df.columns
    out = Counter((r.doc_id, r.text) for r in got.collect())
    six = {k for k in out if k[0] == 6}
    assert len(six) == 1 and six < {(6, u), (6, u + " more")}
    assert out - Counter(six) == Counter([(1, a), (2, z), (4, w), (4, v), (7, None), (None, a), (None, a)])
