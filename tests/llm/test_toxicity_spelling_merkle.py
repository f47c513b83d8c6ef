"""Toxicity, spelling variants and the Merkle manifest against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import merkle, queries, spelling, toxicity

SF = "/root/testdata/sf0.01"


# -- toxicity -------------------------------------------------------------------------------

def grams(text):
    t = f" {(text or '').lower()} "
    return {t[i:i + k] for k in toxicity.ORDERS for i in range(len(t) - k + 1)}


def bucket_of(gram):
    points = np.array([ord(c) for c in gram], dtype="<u4")
    at = [(a, b) for a, b in toxicity.buckets(points, np.full(len(points), len(points)))]
    return int(at[len(gram) - 3][1][0])


def test_present_buckets_are_those_of_the_grams():
    texts = ["", None, "a", "ab", "Abc abc ABC", "naïve Ünder 日本語 𝔘nicode", " \n ", "aaaaaaaaaa"]
    row, bucket = toxicity.present(texts)
    for k, t in enumerate(texts):
        assert set(bucket[row == k].tolist()) == {bucket_of(g) for g in grams(t)}
    assert len(set(zip(row.tolist(), bucket.tolist()))) == len(row)


def test_long_texts_are_read_whole_in_parts(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé \n") for _ in range(n)) for n in (1, 50, 1000, 333, 64, 65, 66, 67, 68)]
    whole = [x.tolist() for x in toxicity.present(texts)]
    monkeypatch.setattr(toxicity, "PART", 64)
    assert [x.tolist() for x in toxicity.present(texts)] == whole


def test_counts_and_scores_are_the_definition(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (4, 0, "a"), (100, 1, "a"), (101, 0, "z"), (213, 1, "x"), (201, 0, "x"), (200, 0, "x"), (205, 2, "x"), (204, None, "x"), (None, 1, "x")],
                                   "doc_id long, toxic int, text string")
    marks = {1: 1, 4: 0, 100: 1, 101: 0, 213: 1, 201: 0, 200: 0}
    train = toxicity.labelled(docs, labels)
    want = [(i, t, marks[i]) for i, t in corpus if i in marks]
    assert Counter(map(tuple, train.collect())) == Counter(want)
    got = {r.bucket: (r.n0, r.n1) for r in toxicity.class_counts(train).collect()}
    plain = defaultdict(lambda: [0, 0])
    for _, t, k in want:
        plain[-1][k] += 1
        for b in {bucket_of(g) for g in grams(t)}:
            plain[b][k] += 1
    assert got == {k: tuple(v) for k, v in plain.items()}

    model = toxicity.fit(train, features=200)
    n0, n1 = plain.pop(-1)
    share = n1 / (n0 + n1)
    for b in np.flatnonzero(model.feature >= 0)[:20].tolist():
        c0, c1 = plain[b]
        ratio = math.log((c1 + toxicity.PRIOR * share) / n1) - math.log((c0 + toxicity.PRIOR * (1 - share)) / n0)
        w = model.weight[model.feature[b]]
        assert w == 0 or ratio != 0 and math.copysign(1, w) == math.copysign(1, ratio) or abs(w / ratio) < 50
    scored = Counter((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, model).collect())
    by_hand = Counter()
    for i, t in corpus:
        x = model.intercept + sum(model.weight[model.feature[b]] for b in {bucket_of(g) for g in grams(t)} if model.feature[b] >= 0)
        by_hand[i, round(1 / (1 + math.exp(-x)), 9)] += 1
    assert scored == by_hand
    assert toxicity.score(empty, model).count() == 0


def test_without_both_classes_the_share_is_the_score(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, toxic int")
    for rows, want in [(toxicity.labelled(docs, labels), 1.0), (toxicity.labelled(docs, labels.withColumn("toxic", F.lit(0))), 0.0), (toxicity.labelled(empty, labels), 0.0)]:
        got = toxicity.score(docs, toxicity.fit(rows))
        assert {round(r.score, 6) for r in got.collect()} == {want}


def test_toxic_documents_are_found_among_those_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    found = sum(r.predicted for r in got if r.toxic)
    assert right >= 0.96 * len(got) and found >= 0.78 * sum(r.toxic for r in got)


# -- spelling variants ----------------------------------------------------------------------

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(words):
    """``word -> (n_near, form, form_n, root)`` by comparing all words."""
    out = {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        ok = best is not None and words[best] >= 5 * n
        out[w] = (len(found), best if ok else None, words[best] if ok else None)
    def last(w):
        while out[w][1]:
            w = out[w][1]
        return w
    return {w: (*v, last(w)) for w, v in out.items()}


def plain_words(rows, change, least):
    words = Counter()
    for i, t in rows:
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for r in re.findall("[a-zÀ-ÿ]+", low):
            w = change(i, r)
            if len(w) >= 6:
                words[w] += 1
    return {w: n for w, n in words.items() if n >= least}


def some_words(seed, letters="abcé", n=400, front=""):
    rng = random.Random(seed)
    words = {front + "".join(rng.choice(letters) for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 26, 30, 155, 800]) for _ in range(n)}
    return words


@pytest.mark.parametrize("block", [1, 7, 64, spelling.BLOCK])
def test_near_words_are_all_of_one_edit(spark, block):
    words = some_words(3) | some_words(4, "ab", 120) | some_words(5, "abc", 80, front="prefix")
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df, block).collect()}
    want = {}
    for w in words:
        found = [x for x in words if near(w, x)]
        if found:
            best = min(found, key=lambda x: (-words[x], x))
            want[w] = (len(found), words[best], best)
    assert got == want and len(want) > 100


def test_variants_are_the_definition(spark, docs, corpus, empty):
    extra = [(1000 + k, " ".join([w.upper() if k % 2 else w] * (words[w] // 5 or 1))) for words in [some_words(9, "abÀ", 60)] for k, w in enumerate(words)]
    rows = corpus + extra + [(2000, "ÀÉÎ×÷ÿ " * 9), (2001, "x" * 300 + " " + "y" * 7), (2002, "straße " * 6 + "STRASSE " * 6)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling.group_variants(df, spelling.drop_a_letter)
    want = variants(plain_words(rows, spelling.drop_a_letter, 5))
    assert {r.word: (r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == want
    assert any(v[1] for v in want.values())
    assert spelling.group_variants(empty).count() == 0
    assert spelling.group_variants(docs.where("doc_id in (200, 201, 202)")).count() == 0


def test_roots_follow_long_chains(spark):
    pairs = [(f"w{k}", f"w{k + 1}") for k in range(21)] + [("a", "w20"), ("b", "c")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(pairs, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w21" for k in range(21)}, "a": "w21", "b": "c"}


def test_a_run_loses_one_letter_by_its_hash():
    found = [(i, f"lettersé{i}") for i in range(2000)]
    hit = [(i, r) for i, r in found if zlib.crc32(f"{i}:{r}".encode()) % 199 == 0]
    assert hit and all(len(spelling.drop_a_letter(i, r)) == len(r) - 1 for i, r in hit)
    i, r = hit[0]
    h = zlib.crc32(f"{i}:{r}".encode()) % len(r)
    assert spelling.drop_a_letter(i, r) == r[:h] + r[h + 1:]
    assert all(spelling.drop_a_letter(i, r) == r for i, r in found if (i, r) not in hit)


def test_long_texts_are_searched_in_parts(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abÀÿ7 .\n") for _ in range(4000))
    whole = [w for part in spelling.runs(text) for w in part]
    monkeypatch.setattr(spelling, "PART", 50)
    assert [w for part in spelling.runs(text) for w in part] == whole
    assert [w for part in spelling.runs("a" * 500) for w in part] == ["a" * 500]


# -- Merkle manifest ------------------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree, i, leaf):
    path = []
    for level in tree[:-1]:
        run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
        path.append([level[j] for j in run if j != i])
        leaf = H(*[leaf if j == i else level[j] for j in run])
        i //= 3
    return path, leaf


def plain_manifest(rows):
    """``rows``: (key, source, leaf, other)."""
    low = lambda x: (x is not None, x if x is not None else "")
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[s] = levels([r[2] for r in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        for i, (key, _, leaf, other) in enumerate(groups[s]):
            path, sub = climb(trees[s], i, other)
            above, folded = climb(top, k, sub)
            proof = H(*[d for level in climb(trees[s], i, leaf)[0] + above for d in level])
            out[key, s, leaf, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]] += 1
    return out


def check_manifest(spark, rows):
    df = spark.createDataFrame(rows, "key long, source string, leaf string, other string").repartition(5)
    got = merkle.manifest(df)
    assert got.columns == ["key", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_manifest_of_odd_documents_is_the_definition(spark, docs, corpus, empty):
    rng = random.Random(4)
    names = [None, "", "a", "B", "é", "日", "z"]
    rows = [(i, t, rng.choice(names), None if rng.random() < 0.2 else "en", rng.choice([None, 7]), "c", "d") for i, t in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, key string, other string").repartition(3)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.manifest(merkle.leaves(df, tampered=cut))
    plain = []
    for i, t, s, lang, n, _, _ in rows:
        bad = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        plain.append((i, s, digest([i, s, lang, n, t]), digest([i, s, lang, n, bad])))
    want = plain_manifest(plain)
    assert Counter(map(tuple, got.collect())) == want
    assert {r[-1] for r in want} == {True, False}
    none = merkle.manifest(merkle.leaves(df.where("false")))
    assert none.count() == 0 and none.columns == got.columns


def test_sources_over_one_block_and_ties(spark):
    rows = [(k // 2, "hot", H(str(k)), H(str(k + (k % 7 == 0)))) for k in range(2 * merkle.LEAVES + 10)]
    rows += [(5, "hot", H("same"), H("same"))] * 40 + [(k, "small", H("s", str(k)), H("s", str(k))) for k in range(11)] + [(None, None, H("n"), H("x"))]
    check_manifest(spark, rows)


def test_more_sources_than_one_block(spark):
    rows = [(k, f"s{k}", H(str(k)), H(str(k) if k % 3 else "bad")) for k in range(merkle.LEAVES + 50)] + [(k, "s77", H("x", str(k)), H("x", str(k))) for k in range(30)]
    check_manifest(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_source_of_few_rows(spark, n):
    check_manifest(spark, [(k, "s", H(str(k)), H(str(k))) for k in range(n)])


def test_proofs_verify(spark):
    rows = [(k, "ab"[k % 2], H(str(k)), H(str(k))) for k in range(40)]
    for r in merkle.manifest(spark.createDataFrame(rows, "key long, source string, leaf string, other string"), with_proof=True).collect():
        i, n = r.key // 2, 20
        places = []
        for _ in merkle.sizes(n)[:-1]:
            places.append(i % 3)
            i //= 3
        places.append("ab".index(r.source))
        assert merkle.verify(r.leaf, r.proof, places) == r.root
        assert H(*[d for level in r.proof for d in level]) == r.proof_sha256


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.data())
def test_octopus_asks_for_the_least_nodes(n, data):
    own = sorted(data.draw(st.sets(st.integers(0, n - 1), min_size=1, max_size=n)))
    tree = levels([H(str(k)) for k in range(n)])
    want = merkle.missing(own, n)
    # a node is needed if it is a sibling on some path and holds none of the own leaves
    below = lambda level, i: any(k // 3 ** level == i for k in own)
    need = set()
    for k in own:
        for level in range(len(tree) - 1):
            run = k // 3 ** (level + 1)
            need |= {(level, i) for i in range(3 * run, min(3 * run + 3, len(tree[level]))) if not below(level, i)}
    assert set(want) == need and len(want) == len(need)
    t = merkle.Tree(n)
    t.nodes = {(level, i): tree[level][i] for level, i in want} | {(0, k): tree[0][k] for k in own}
    t.derive(own, 0)
    assert t.root == tree[-1][0]
