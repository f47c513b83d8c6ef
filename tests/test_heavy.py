"""Frequent terms from summaries against the full count."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.operators import heavy as H
from quillmark.operators import tfidf as TF


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 20), st.integers(1, 40))
def test_summary_bounds_the_counts(items, capacity, every):
    counts, lost = Counter(), 0
    for k, x in enumerate(items):
        counts[x] += 1
        if k % every == 0:
            lost += H.cut_back(counts, capacity)
    lost += H.cut_back(counts, capacity)
    true = Counter(items)
    assert len(counts) <= capacity and all(n > 0 for n in counts.values())
    assert all(counts[x] <= true[x] <= counts[x] + lost for x in true)
    assert lost * (capacity + 1) <= len(items)


def texts(spark, seed, n, zipf=True):
    rng = random.Random(seed)
    words = [f"w{k}x" for k in range(900)]
    weights = [1 / (k + 1) if zipf else 1 for k in range(900)]
    rows = [(i, " ".join(rng.choices(words, weights, k=60)).title() + " é_1 ÀB a") for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "x y z")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("zipf, k, capacity, told", [(True, 10, 300, True), (True, 50, 2000, True), (True, 10, 12, False), (False, 40, 60, False), (True, 5000, 6000, True), (True, 5000, 100, False)])
def test_first_terms_are_exact(spark, zipf, k, capacity, told):
    docs = texts(spark, 1, 200, zipf)
    found = H.candidates(docs, k, capacity)
    assert (found is not None) == told
    want = TF.all_term_counts(docs).orderBy("cnt", "term").collect()
    want = sorted(map(tuple, want), key=lambda r: (-r[1], r[0]))[:k]
    assert [tuple(r) for r in H.top_terms(docs, k, capacity).collect()] == want
    if told and k < 900:
        assert len(found) < 900  # fewer than the vocabulary are counted


def test_no_texts(spark):
    assert H.top_terms(texts(spark, 1, 0).where("false"), 5).count() == 0
