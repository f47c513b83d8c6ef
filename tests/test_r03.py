"""Repairs of the third round."""

import random

import numpy as np
import pytest

from quillmark.functions import text as T
from quillmark.operators import features as G
from quillmark.operators import pivots as P
from quillmark.operators import retrieval as R

TEXT = "The cat sat. The dog, the cat and the bird sat here again, the cat sat."


def gram_sets(text):
    t = text.lower().split()
    return [set(zip(*[t[i:] for i in range(n)])) for n in range(1, 5)]


def documents(spark, path, parts):
    rows = [(k, f"{TEXT} number {k} of a few", "en", "web", 10) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if parts:
        df.repartition(parts).write.parquet(f"{path}/documents.parquet")
    else:
        df.toPandas().to_parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("parts", [0, 3])
@pytest.mark.parametrize("query", ["stream", "stream_equals_batch"])
def test_stream_reads_a_file_or_a_folder_of_files(spark, tmp_path, query, parts):
    documents(spark, tmp_path, parts)
    from __spark_entry__ import queries
    assert queries()[query](spark, str(tmp_path)).count() == (6 if query == "stream" else 0)


def test_gram_counts_are_those_of_the_sets():
    rng = np.random.default_rng(1)
    for size in (0, 1, 3, 40):
        tok = [f"w{x}" for x in rng.integers(0, 6, size)]
        others = [[f"w{x}" for x in rng.integers(0, 8, n)] for n in (0, 1, 2, 50)] + [None, tok]
        distinct, common = G.gram_counts(tok, others, 4)
        own = gram_sets(" ".join(tok))
        assert distinct == [len(g) for g in own]
        assert common == [[None if o is None else len(g & gram_sets(" ".join(o))[n]) for o in others] for n, g in enumerate(own)]


def test_overlap_long_repeats_no_text_and_keeps_a_missing_variant(spark):
    df = spark.createDataFrame([(1, TEXT, [(0, "The cat sat here"), (1, None), (2, "")])], "doc_id long, text string, variants array<struct<variant_pos:int,text:string>>")
    x = G.overlap_long(G.with_tokens(df))
    got = {r.variant_pos: (r.c1, r.c2, r.c3, r.c4, r.d1) for r in x.collect()}
    own, v = gram_sets(TEXT), gram_sets("The cat sat here")
    assert got == {0: (*[len(a & b) for a, b in zip(own, v)], len(own[0])), 1: (None,) * 4 + (len(own[0]),), 2: (0,) * 4 + (len(own[0]),)}
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan  # grams are not rebuilt for every variant


def test_length_filter_counts_tokens_once(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, " a b c d\te "), (3, None), (4, "a b c d e f")], "doc_id long, text string")
    x = G.length_filter(df, 5, 5)
    assert [r.doc_id for r in x.collect()] == [2]
    assert [r.n for r in df.orderBy("doc_id").select(T.token_count("text").alias("n")).collect()] == [4, 5, None, 6]
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "regexp_extract_all" not in plan


def test_a_query_is_sent_once_to_a_shard_of_cells(spark):
    """Unclustered vectors: every query must meet every cell; they travelled once a cell."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1200, 24)))]
    index = P.build(spark.createDataFrame(rows, "tid long, emb array<double>"))
    shard = index.cells.shards(P.SHARD * 4096)
    assert set(shard.tolist()) == {0} and len(index.cells.n) > 30
    small = index.cells.shards(100)
    held = np.bincount(small, weights=index.cells.n)
    assert all(held[s] <= 100 or (small == s).sum() == 1 for s in range(len(held)))
    row, at, lists = P._by_shard(np.ones((5, len(small)), bool), small)
    assert len(row) == 5 * len(held) and sorted(c for x in lists for c in x) == sorted(list(range(len(small))) * 5)
    q = spark.createDataFrame(rows[:50], "qid long, emb array<double>")
    got = {}
    for r in P.k_nearest(q, index, 6, block=64)[0].orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append(r.tid)
    m = P.unit([v for _, v in rows])
    d = P.distances(m[:50], m)
    assert got == {i: np.lexsort((np.arange(1200), d[i]))[:6].tolist() for i in range(50)}


def test_many_equal_vectors_tie_by_id(spark):
    t = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(300)], "tid long, emb array<double>")
    q = spark.createDataFrame([(7, [2.0, 4.0, 2.0])], "qid long, emb array<double>")
    assert [r.tid for r in R.k_nearest_targets(q, t, 5, block=16).orderBy("place").collect()] == [1, 3, 5, 7, 9]


def _plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_band_holds_a_longest_common_subsequence(monkeypatch):
    """Narrow band, wider band, whole matrix and subsequences give the plain length."""
    from quillmark.functions import fuzzy as FZ
    monkeypatch.setattr(FZ, "BANDED", 0)
    monkeypatch.setattr(FZ, "ROWS", 16)
    monkeypatch.setattr(FZ, "CARRIES", 8)
    widths = []
    whole = FZ._matched
    monkeypatch.setattr(FZ, "_matched", lambda a, b, masks, k, least=0.0: widths.append(k < len(a)) or whole(a, b, masks, k, least))
    r = random.Random(3)
    for n in (1, 40, 200, 300):
        a = "".join(r.choice("abcdé ") for _ in range(n))
        near = "".join(c for c in a if r.random() > 0.1) + "zé"
        moved = a[n // 3:] + a[:n // 3]
        for b in (near, a[::-1], moved, a[::2], a.upper(), a[n // 2:], a):
            assert FZ.lcs_length(a, b) == FZ.lcs_length(b, a) == _plain_lcs(a, b)
    assert True in widths and False in widths


def test_token_set_compares_only_the_rests(monkeypatch):
    """A shared beginning is not run through again, and a set within the other needs no
    comparison at all (F24)."""
    from quillmark.functions import fuzzy as FZ
    seen = []
    whole = FZ.lcs_length
    monkeypatch.setattr(FZ, "lcs_length", lambda a, b, masks=None: seen.append((a, b)) or whole(a, b, masks))
    assert FZ.token_set_ratio("b a, c d.", "A; d") == 100 and not seen
    assert FZ.token_set_ratio("aa bb cc dd xyz", "aa bb cc dd xyy") == max(round(200 * 11 / 26), round(200 * 14 / 30))
    assert seen in ([], [(" xyz", " xyy")])
    assert FZ.token_set_ratio("abc", "abd") == FZ.ratio("abc", "abd") and FZ.token_set_ratio("?!", "a") == 0


def test_rewrites_are_planned_once(spark, tmp_path):
    """No filter below the rewrites makes them over again."""
    from quillmark.operators import layouts as L
    from quillmark.plans import q_features as Q
    documents(spark, tmp_path, 2)
    wide = L.wide_features(Q._records(spark, str(tmp_path)), 7, "hash_proj", fuzzy=False).where("status = 'ok'")
    for df in (Q._pairs(spark, str(tmp_path)), Q._texts8(spark, str(tmp_path)), wide):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("$2 $1") == 1
        assert df.count() > 0


def test_terms_word_by_word():
    """Terms of words are those of the text, whatever the white space and the wanted set."""
    from collections import Counter

    import regex

    from quillmark.operators import tfidf as TF
    for text in ("a bb, bb-cc_d éé e1 日本語 日本 don't x\x1cyy", "", " . ", "ab" * 80 + " ab"):
        want = Counter(regex.findall(TF.TERM_PATTERN, text))
        assert TF.WordTerms().counts(Counter(text.split())) == want
        assert TF.WordTerms({"bb", "ab"}).counts(Counter(text.split())) == {t: n for t, n in want.items() if t in ("bb", "ab")}
