"""N-gram join, suffix dedup, lattice LM and embedding dedup against plain Python."""

from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import components, embedding_dedup, lattice_lm, ngram_join, suffix_dedup
from quillmark.llm.queries import PIECES

DOWN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(DOWN))


def shingles(t, k):
    w = tokens(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def ngram_result(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    edges = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1:] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    comp = groups({i for i, _ in sets if i is not None}, edges)
    return Counter((i, len(s), comp.get(i)) for i, s in sets)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_join_is_the_definition(docs, corpus, k, percent):
    got = Counter(map(tuple, ngram_join.similar_groups(docs, k, percent).collect()))
    assert got == ngram_result(corpus, k, percent)


def test_ngram_join_with_hot_groups(docs, corpus, monkeypatch):
    """Pivots, hot keys and blocks of one group give the same as all pairs."""
    monkeypatch.setattr(ngram_join, "HOT", 6)
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", 2)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    got = Counter(map(tuple, ngram_join.similar_groups(docs, 3, 90).collect()))
    assert got == ngram_result(corpus, 3, 90)


def test_ngram_join_of_nothing(empty):
    assert ngram_join.similar_groups(empty).count() == 0


def test_linked_sets_share_a_key():
    """Pigeonhole: any two sets over the threshold share a part key."""
    rng = np.random.default_rng(4)
    none = np.zeros(0, np.uint64)
    for percent in (80, 90):
        for _ in range(300):
            n = int(rng.integers(4, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut = rng.integers(0, max(1, n * (100 - percent) // 100) + 1)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, rng.integers(0, cut + 2)).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if not same or 100 * same < percent * (len(a) + len(b) - same):
                continue
            frequent = np.sort(rng.choice(a, len(a) // 3, replace=False)) if rng.random() < 0.5 else none
            if len(a) == len(b) == same:
                continue
            assert len(np.intersect1d(ngram_join.part_keys(a, percent, frequent), ngram_join.part_keys(b, percent, frequent)))
            bits = ngram_join.bands(percent).bits(min(len(a), len(b)))
            x, y = (np.frombuffer(ngram_join.parity_sketch(s, bits), np.uint8) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * same


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = rng.integers(0, 400, (300, 2)).tolist() + [[k, k + 1] for k in range(1000, 1100)] + [[7, 7]]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {r.node: r.component for r in components.components(df).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.components(df.where(F.lit(False))).count() == 0


def suffix_result(rows, window):
    """``brute_force`` by row: rows may share an id or have none."""
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for k in range(len(raw) - window + 1):
            first.setdefault(raw[k:k + window], i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - window + 1 if i is not None else 0):
            if first[raw[k:k + window]] < i:
                gone[k:k + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return Counter(out)


def test_suffix_dedup_is_the_definition(docs, corpus, empty):
    got = suffix_dedup.spans(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == suffix_result(corpus, 50)
    assert suffix_dedup.spans(empty).count() == 0
    cut = suffix_dedup.spans(docs, columns=docs.columns)
    assert cut.columns == docs.columns and cut.count() == len(corpus)


def test_suffix_dedup_of_dense_repeats(spark):
    """A small alphabet gives matches of every length, at every place of a window."""
    rng = np.random.default_rng(8)
    rows = []
    source = "".join(rng.choice(list("ab"), 600))
    for k in range(60):
        a, n = rng.integers(0, 500), rng.integers(30, 100)
        rows.append((k, "".join(rng.choice(list("ab"), rng.integers(0, 40))) + source[a:a + n] + "".join(rng.choice(list("ab"), rng.integers(0, 40)))))
    rows.append((99, "日本" * 40))
    rows.append((98, "本日" * 41))
    rows.append((97, "\0" * 70 + "x"))
    rows.append((96, "\0" * 60))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.spans(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == suffix_result(rows, 50)
    for r in suffix_dedup.spans(df, columns=["doc_id", "text"]).collect():
        assert isinstance(r.text, str)


def test_anchors_agree_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    off = np.array([0, 10, 700, 700, 2500, 5000])
    want = suffix_dedup.anchors(data, off)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 333)
    got = suffix_dedup.anchors(data, off)
    assert all((a == b).all() for a, b in zip(want, got))


@pytest.fixture(scope="module")
def scored(docs):
    rows = docs.select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("held_out")).withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    model = lattice_lm.fit(rows.where("not held_out"), PIECES)
    return model, lattice_lm.score(rows, model).collect()


def segmentations(word, pieces):
    """Log probability of all segmentations, by plain recursion on the text."""
    total = [0.0] + [-np.inf] * len(word)
    for t in range(1, len(word) + 1):
        parts = [total[s] + pieces[word[s:t]] for s in range(max(0, t - 64), t) if word[s:t] in pieces]
        top = max(parts)
        total[t] = top + log(sum(np.exp(x - top) for x in parts))
    return total[-1]


def test_lattice_scores_are_the_definition(scored, corpus):
    model, got = scored
    rows = [(i, tokens(t)) for i, t in corpus]
    train = [w for i, w in rows if i is None or i % 3]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    assert (model.tokens, model.distinct) == (n, v)
    pieces = dict(zip(model.lattice.pieces, model.lattice.logp))
    end = float(np.exp(model.lattice.log_end))
    assert abs(np.exp(model.lattice.logp).sum() + end - 1) < 1e-9
    d, urn = lattice_lm.DISCOUNT, lattice_lm.URN
    want = {}
    for i, w in rows:
        base = sum(log((c[x] + 1) / (n + v + 1), 10) for x in w) + log((len(train) + 1) / (n + v + 1), 10)
        lattice = {x: segmentations(b" " + x.encode(), pieces) for x in set(w)}
        p = {x: log((c[x] - d) / n + d * v / n * np.exp(lattice[x])) if c[x] else log(d * v / n) + lattice[x] for x in lattice}
        p_end = max(len(train) - d, 0) / n + d * v / n * end
        seen, score = Counter(), 0.0
        for k, x in enumerate([*w, None]):
            start = log(urn * p_end) if x is None else log(urn) + p[x]
            score += ((log(np.exp(start) + seen[x]) if seen[x] else start) - log(urn + k)) / log(10)
            seen[x] += 1
        want.setdefault((i, len(w) + 1, sum(c[x] > 0 for x in w) + 1, round(base, 6)), []).append((score, (sum(lattice[x] for x in w) + log(end)) / log(10)))
    for r in got:
        options = want[(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6))]
        assert r.train_tokens == n and any(abs(a - r.score) < 1e-6 and abs(b - r.lattice_score) < 1e-6 for a, b in options)
    assert len(got) == len(rows)


def test_lattice_without_training_rows(docs, empty):
    rows = docs.select("doc_id", "text", F.lit(False).alias("held_out"))
    model = lattice_lm.fit(rows.where("false"), PIECES)
    got = lattice_lm.score(rows, model).collect()
    assert model.tokens == 0 and all(np.isfinite(r.score) and r.n_known == 0 for r in got)
    assert lattice_lm.score(empty.select("doc_id", "text", F.lit(False).alias("held_out")), model).count() == 0


def test_expected_counts_are_derivatives():
    pieces, logp = lattice_lm.vocabulary(PIECES)
    lattice = lattice_lm.Lattice(pieces, logp, -1.0)
    data = np.frombuffer(b"therealthing", np.uint8)
    s, e = np.array([0, 3]), np.array([3, 12])
    total = np.zeros(len(pieces))
    for at, m, size in lattice_lm.word_blocks(data, s, e):
        total += lattice.expected(m, size, np.array([2.0, 1.0])[at])
    lens = np.array([len(p) for p in pieces])
    assert abs((total * lens).sum() - (2 * 4 + 10)) < 1e-9  # pieces cover the words


def vectors(rng):
    x = rng.normal(size=(300, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    for k in range(120):  # near copies
        rows.append((1000 + k, (x[k % 7] + rng.normal(scale=0.12, size=16)).tolist()))
    rows += [(2000 + k, rows[5][1]) for k in range(40)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, None] + [0.0] * 14), (3004, []), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [float("inf")] * 16), (None, rows[5][1]), (3008, [-0.0, 1.0]), (3009, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize("members", [2048, 16])
def test_embedding_dedup_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(embedding_dedup, "MEMBERS", members)
    rows = vectors(np.random.default_rng(6))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x")).repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    edges = [(a, b) for n, (a, x) in enumerate(good) for b, y in good[n + 1:] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9]
    count = Counter(x for e in edges for x in e)
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= count[i] for i in got if i is not None)
    assert found >= 0.98 * 2 * len(edges) and len(edges) > 1000
    comp = groups({i for i, _ in rows if i is not None}, edges)
    assert np.mean([got[i].component_id == comp[i] for i in comp]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in comp)
    assert got[3000].n_links == got[3001].n_links == got[3002].n_links == got[3003].n_links == 0
    assert got[3005].n_links == 1 and got[3006].component_id == 3005 and got[3009].component_id == 3008


@pytest.mark.parametrize("pairs", [12, 60])  # 0.2 % and 1 % of the vectors
def test_embedding_dedup_finds_rare_pairs(spark, pairs):
    rng = np.random.default_rng(pairs)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, d = x[:pairs], rng.normal(size=(pairs, 64))
    d -= (d * a).sum(1)[:, None] * a
    x[-pairs:] = 0.91 * a + np.sqrt(1 - 0.91 ** 2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    whole = [got[k].n_links == got[6000 - pairs + k].n_links == 1 and got[6000 - pairs + k].component_id == k for k in range(pairs)]
    assert np.mean(whole) >= 0.98 and sum(r.n_links for r in got.values()) <= 2 * pairs


def test_planted_rank_is_the_place_in_the_order():
    rng = np.random.default_rng(4)
    index = embedding_dedup.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    x, cell = rng.normal(size=(50, 6)), rng.integers(0, 35, 50)
    assert (index.order(x, 35)[np.arange(50), index.rank(x, cell)] == cell).all()
    for a, b in embedding_dedup.planted(x / np.linalg.norm(x, axis=1, keepdims=True), 0.9):
        assert np.allclose((a * b).sum(1), 0.9) and np.allclose((b * b).sum(1), 1)
    assert embedding_dedup.planted(np.ones((3, 1)), 0.9) == []


def test_embedding_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_multi_sequence_order_is_by_distance():
    rng = np.random.default_rng(3)
    index = embedding_dedup.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    x = rng.normal(size=(20, 6))
    order = index.order(x, 35)
    a, b = embedding_dedup.distances(x[:, :3], index.left), embedding_dedup.distances(x[:, 3:], index.right)
    for k in range(20):
        total = (a[k][:, None] + b[k][None, :]).ravel()
        assert (np.diff(total[order[k]]) >= -1e-12).all() and sorted(order[k]) == list(range(35))
        assert (index.order(x, 6)[k] == order[k][:6]).all()
    assert (order[:, 0] == index.cell(x)).all()


@pytest.mark.parametrize("rounds", [0, 2, 24])
def test_longest_previous_factors_are_the_definition(monkeypatch, rounds):
    monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds)
    rng = np.random.default_rng(rounds)
    for n, docs in ((1, 1), (60, 5), (200, 200), (200, 2)):
        c = rng.integers(97, 99, size=(n, 14)).astype(np.uint8)
        smallest = rng.integers(0, docs, n) if docs < n else np.arange(n)[::-1].copy()
        order = np.lexsort(c[:, ::-1].T)
        got = suffix_dedup.longest_previous(c, order, 0, smallest, 6)
        for place, i in enumerate(order):
            shared = [int(np.argmin(np.append(c[i, :6] == c[j, :6], False))) for j in range(n) if smallest[j] < smallest[i]]
            want = max(shared, default=0)
            # exact where the window is reached; below it only that it is not
            assert (got[place] >= 6) == (want >= 6)


def test_staircases_of_documents():
    up = np.concatenate([np.arange(1, 400), np.zeros(300, int), [5]])
    lcp = np.full(len(up), 9)
    lcp[0], lcp[650] = 0, 7
    got = suffix_dedup._nearest_smaller(up, lcp, 5)
    for i in range(len(up)):
        j = max((j for j in range(i) if up[j] < up[i]), default=None)
        assert got[i] == (0 if j is None else lcp[j + 1:i + 1].min())
