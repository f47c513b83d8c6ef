"""Near-synonyms by context against plain Python, and the two forms of the lookup."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.operators import robust as H
from quillmark.operators import synonyms as SY
from quillmark.operators import tfidf as TF

TEXTS = ["the red car drove fast down the road", "the blue car drove slow down the road", "a red van drove fast", "a blue van drove slow today",
         "cats drink warm milk daily", "dogs drink cold milk daily", "cats like fish", "dogs like meat", "", None, "alone", "red red red red"]


def plain_vectors(texts, vocabulary, dim, window):
    bucket = lambda t: int(hashlib.md5(f"5-{t}".encode()).hexdigest()[:8], 16) % dim
    counts = Counter()
    for text in texts:
        w = [x for x in (text or "").lower().split() if len(x) >= 2]
        for i, t in enumerate(w):
            for d in range(1, window + 1):
                if i + d < len(w):
                    counts[t, bucket(w[i + d]) + dim] += 1
                    counts[w[i + d], bucket(t)] += 1
    counts = {k: c for k, c in counts.items() if k[0] in vocabulary}
    cw, cb = Counter(), Counter()
    for (t, b), c in counts.items():
        cw[t] += c
        cb[b] += c
    n = sum(cw.values())
    out = {t: np.zeros(2 * dim) for t in cw}
    for (t, b), c in counts.items():
        out[t][b] = max(0.0, math.log(c * n / (cw[t] * cb[b])))
    return out


def test_vectors_and_neighbours_equal_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    words = sorted({w for t in TEXTS for w in (t or "").split() if len(w) >= 2})
    vocabulary = spark.createDataFrame([(w,) for w in words + ["red", None, "unseen"]], "term string")
    vectors = SY.context_vectors(docs, vocabulary, dim=8)
    got = {r.word: np.array(r.emb) for r in vectors.collect()}
    want = plain_vectors(TEXTS, set(words), 8, 2)
    assert got.keys() == want.keys() and "alone" not in got
    assert all(np.allclose(got[t], want[t], atol=1e-12) for t in want)
    near = {r.word: (r.repl, r.similarity) for r in SY.near_synonyms(vectors, 0.3).collect()}
    some = {t: v / np.linalg.norm(v) for t, v in want.items() if v.any()}
    for t, v in some.items():
        best, other = min((round(1.0 - float(v @ u), 12), o) for o, u in some.items() if o != t)
        if 1.0 - best >= 0.3:
            assert near[t][0] == other and abs(near[t][1] - (1.0 - best)) < 1e-9
        else:
            assert t not in near
    assert near and all(s >= 0.3 for _, s in near.values())


def test_pairs_are_counted_in_matrices_and_equal_the_joined_ones(spark, monkeypatch):
    odd = ["Red, red-blue\u00a0car_1 2x x", "ΣΑΣ σας ΣΑΣ", "\n\t", "a\x1cred\x85van"] + TEXTS
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(3)
    vocabulary = spark.createDataFrame([(w,) for w in ("red", "blue", "car_1", "2x", "σας", "van", "drove", "red", "unseen", None)], "term string")
    monkeypatch.setattr(SY, "CHUNK", 3)
    monkeypatch.setattr(SY.TF, "SLICE", 40)
    asked = []
    pairs = SY.context_pairs
    monkeypatch.setattr(SY, "context_pairs", lambda *a: asked.append(a) or pairs(*a))
    one = {r.word: r.emb for r in SY.context_vectors(docs, vocabulary, dim=8).collect()}
    assert not asked  # no row per pair of neighbours
    monkeypatch.setattr(SY, "MOST_WORDS", 2)
    two = {r.word: r.emb for r in SY.context_vectors(docs, vocabulary, dim=8).collect()}
    assert asked and one.keys() == two.keys() and {"red", "car_1", "σας"} <= one.keys()
    assert all(np.allclose(one[w], two[w], atol=1e-12) for w in two)


def test_numbered_terms_equal_the_pattern(monkeypatch):
    texts = ["red, red-blue\u00a0car_1 2x x", "σας éa,b \U0001d4b3\U0001d4b4 ½½ _ __ a_", "", None, " \n", "x,y", "a\x1cred\x85van (van)", "don't 3.14 e.g. it's-me"]
    want = [(i, w) for i, t in enumerate(texts) for w in TF._TERM.findall(t or "")]
    terms, at, owner = TF.numbered_terms(pa.array(texts, pa.string()))
    assert list(zip(owner.tolist(), terms.take(pa.array(at)).to_pylist())) == want and len(set(terms.to_pylist())) == len(terms)
    terms, at, owner = TF.numbered_terms(pa.array([], pa.string()))
    assert len(terms) == len(at) == len(owner) == 0
    for size in (1, 10, 10 ** 6):
        monkeypatch.setattr(TF, "SLICE", size)
        assert [x for s in TF.slices(pa.array(texts, pa.string())) for x in s.to_pylist()] == texts
    assert TF.places(pa.array(["b", "c", "a"]), pa.array(["a", "b"])).tolist() == [1, -1, 0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vectors = SY.context_vectors(docs, spark.createDataFrame([], "term string"))
    assert vectors.count() == 0 and SY.near_synonyms(vectors).count() == 0


def test_hashed_lookup_equals_joined_words(spark):
    docs = spark.createDataFrame([(1, "the red car. A RED van!"), (2, ""), (3, None), (4, "nothing known")], "doc_id long, text string")
    pairs = [("red", "blue"), ("red", "azure"), ("car", "cart"), (None, "x"), ("van", None)] + [(f"w{i}", f"x{i}") for i in range(40)]
    syn = spark.createDataFrame(pairs, "word string, repl string")
    outs = []
    for limit in (100, 1):
        x, find = H.hashed_lookup(docs, syn, limit=limit)
        outs.append({r[0]: r[1] for r in x.select("doc_id", H.perturb_words_expr("text", "doc_id", find, 1.0)).collect()})
    x, find = H.hashed_lookup(docs, syn.limit(0))
    assert {r[0]: r[1] for r in x.select("doc_id", H.perturb_words_expr("text", "doc_id", find, 1.0)).collect()}[1] == "the red car. A RED van!"
    assert outs[0] == outs[1] and outs[0][1] == "the azure car. A azure van!"


def test_space_insertion_only_adds_spaces_inside_words(spark):
    df = spark.range(40).select("id", F.lit("a word inside").alias("text"))
    for r in df.select("text", H.map_sentences("text", lambda s, si: F.array_join(F.transform(F.split(s, " "), lambda x, wi: H.space_insert(x, "id", si, wi, 3)), " ")).alias("t")).collect():
        assert r.t.replace(" ", "") == "awordinside" and len(r.t.split(" ")) == 5


ODD = ["One. Two!  Three?\nfour... five", ". start. !!! x", "a.\u00a0b. c", "...", "   ", "", None, "x", "no end", "tail. ", "Pi is 3.14 e.g. this\x1cthat.", "\u00a0. \u2003", "ΣΑΣ İstanbul 𝒳𝒴 é. Ok!?", "red " * 300 + "car. " * 40]


def test_sentences_of_a_text_equal_the_expression(spark):
    from quillmark.functions.text import sentences
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in df.select("text", sentences("text").alias("s")).where("text is not null").collect():
        assert H.cut_sentences(r.text) == r.s, r.text


def test_edits_of_words_equal_the_expressions(spark):
    keys = [*range(len(ODD) - 1), None]
    df = spark.createDataFrame(list(zip(keys, ODD)), "doc_id long, text string")
    syn = spark.createDataFrame([("red", "blue"), ("red", "azure"), ("car", "cart"), ("five", "sechs"), (None, "x"), ("two", None)], "word string, repl string")
    x, find = H.hashed_lookup(df, syn)
    known = H.known_synonyms(syn)
    for share in (0.1, 0.5, 1.0, 0.0):
        pairs = {"w": (H.perturb_words_expr("text", "doc_id", find, share, 11), H.words_step(11)), "c": (H.perturb_chars_expr("text", "doc_id", share, 13), H.chars_step(13)),
                 "m": (H.perturb_mixed_expr("text", "doc_id", find, share, 17), H.mixed_steps(17)), "s": (H.perturb_mixed_expr("text", "doc_id", find, share, 19, spaces=True), H.mixed_steps(19, True))}
        for name, (expr, steps) in pairs.items():
            for r in x.select("text", expr.alias("a"), H.edited("text", "doc_id", steps, known, share).alias("b")).collect():
                assert r.a == r.b, (name, share, r.text)


def test_perturbed_columns_draw_in_tasks_and_large_tables_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "human") for i, t in enumerate(ODD)], "doc_id long, text string, source string")
    syn = spark.createDataFrame([("red", "azure"), ("car", "cart"), ("two", "zwei")], "word string, repl string")
    one = H.with_perturbations(df, syn, 0.5)
    assert "ArrowEvalPython" in one._jdf.queryExecution().executedPlan().toString()
    want = {r.doc_id: r for r in one.collect()}
    monkeypatch.setattr(H, "MAX_SYNONYM_MAP", 1)
    two = {r.doc_id: r for r in H.with_perturbations(df, syn, 0.5).collect()}
    assert want == two and len(want) == sum(t is not None and t.strip(" ") != "" for t in ODD)
