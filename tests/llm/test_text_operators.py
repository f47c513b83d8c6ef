"""Line dedup, byte BPE, language ID, fingerprints, packing and license scan against plain
Python, on the odd corpus."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillmark.llm import bpe_codec, fingerprint, language_id, license_scan, line_dedup, packing
from quillmark.llm.queries import RANKS, TOKENIZER

ENDS = " \t\n\v\f\r"
DOWN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    k = line.strip(ENDS).translate(DOWN)
    return k if len(k) >= 40 else None


def line_result(rows):
    held = defaultdict(set)  # documents are distinct ids
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            held[k] |= {i} - {None}
    keep = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup_is_the_definition(docs, corpus, empty):
    got = line_dedup.dedup(docs).select("doc_id", "n_lines", "n_dropped", "text")
    assert Counter(map(tuple, got.collect())) == line_result(corpus)
    assert sum(r[2] for r in line_result(corpus)) > 0
    assert line_dedup.dedup(empty).count() == 0


def test_line_dedup_keeps_columns(docs, corpus):
    got = line_dedup.dedup(docs, columns=docs.columns)
    assert got.columns == docs.columns and got.count() == len(corpus)


def test_rows_of_one_id_are_one_document_of_a_line(spark):
    line = "a shared line that is long enough to be counted"
    rows = [(1, line)] * 4 + [(2, line)] + [(None, line)] * 9
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.n_dropped for r in got.collect()} == {0} and got.count() == len(rows)
    rows += [(k, line) for k in (3, 4, 5)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_dropped) for r in got.collect()) == Counter({(1, 1): 4, (2, 1): 1, (3, 1): 1, (4, 1): 1, (5, 0): 1, (None, 0): 9})


ODD_NAMES = ["_id", "_keys", "_text", "_lang_pred", "_score", "_kept", "_node", "_first", "a.b", "a b`c", "_bucket", "_hash", "c0", "text_", "DOC_ID2"]


def test_columns_of_any_name_come_back(spark, corpus):
    from quillmark.llm import suffix_dedup

    rows = [(i, t, "xx" if k % 2 else None, *range(k, k + len(ODD_NAMES))) for k, (i, t) in enumerate(corpus)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", *ODD_NAMES]).repartition(3)
    want = Counter((r[0], *r[3:]) for r in rows)
    lines = line_dedup.dedup(df, columns=df.columns)
    passages = suffix_dedup.spans(df, columns=df.columns)
    langs = language_id.predict(df, language_id.fit(df), keep=True)
    for out in (lines, passages, langs):
        assert out.columns[:len(df.columns)] == df.columns
        assert Counter((r[0], *r[3:len(df.columns)]) for r in out.collect()) == want


def test_a_very_long_text_is_labelled_whole_in_bounded_memory(spark):
    import os

    import pyarrow as pa

    model = language_id.Model(["aa", "bb"], np.random.default_rng(1).normal(size=(language_id.BUCKETS, 2)).astype(np.float32), np.ones((len(language_id.SCRIPT_NAMES), 2), bool), np.zeros(2))
    text = ("wort für wort und noch ein wort mehr danach " * 120 + "\n") * 3200
    assert len(text) > 16_000_000
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    language_id._tables()

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def held():
        import threading
        import time
        most, stop = [resident()], []
        def watch():
            while not stop:
                most.append(resident())
                time.sleep(0.002)
        w = threading.Thread(target=watch)
        w.start()
        out = language_id.scored_words(model, data, off)
        label = language_id.label_words(out[0], out[3])
        stop.append(1)
        w.join()
        return out, label, max(most) - most[0]

    (score, s, e, row), label, extra = held()
    assert extra < 400 << 20, extra
    small = data[:off[1] // 40]
    small = small[:np.flatnonzero(small == 32)[-1] + 1]
    points, s0, e0, kind, row0 = language_id.words(small, np.array([0, len(small)]))
    n = len(s0)
    assert (s[:n] == s0).all() and (e[:n] == e0).all() and np.allclose(score[:n], language_id.word_scores(model, points, s0, e0, kind))
    assert int((e - s).sum()) == sum(map(len, text.split())) and len(label) == len(text.split())


def test_line_index_is_reversible(spark, docs, corpus):
    rows = [(i, t) for i, t in corpus if i is not None]
    late = {110, 111, 115, 100}
    schema = "doc_id long, text string"
    first = spark.createDataFrame([r for r in rows if r[0] not in late], schema)
    more = spark.createDataFrame([r for r in rows if r[0] in late], schema)
    table = lambda x: sorted(map(tuple, x.counts.select("k1", "k2", "n", "keeper").collect()))
    start = line_dedup.LineIndex.build(first)
    grown = start.insert(more)
    assert table(grown) == table(line_dedup.LineIndex.build(first.union(more)))
    assert table(grown.delete(more.select("doc_id"))) == table(start)


@pytest.mark.parametrize("shard_keys", [32_768, 4])
def test_line_index_filters_follow(spark, monkeypatch, docs, corpus, shard_keys):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    lines = [f"line number {k} that several documents hold, all of it" for k in range(60)]
    rows = [(i, t) for i, t in corpus if i is not None] + [(1000 + k, "\n".join(lines[k % 7:20 + 3 * k])) for k in range(12)]
    late = {110, 111, 115, 100} | {1000 + k for k in range(3, 11)}
    schema = "doc_id long, text string"
    whole = spark.createDataFrame(rows, schema)
    first = spark.createDataFrame([r for r in rows if r[0] not in late], schema)
    more = spark.createDataFrame([r for r in rows if r[0] in late], schema)
    start = line_dedup.LineIndex.build(first)
    grown = start.insert(more)
    back = grown.delete(more.select("doc_id"))
    sizes = []
    for index in (start, grown, back):
        keys = np.array([tuple(r) for r in index.repeated().select("k1", "k2").collect()], np.int64).reshape(-1, 2)
        filters = line_dedup.collected(index.filters, index.shards)
        shard = line_dedup.shard_of(keys[:, 0], index.shards)
        assert all(filters[s].contains(k[:1], k[1:]).all() for s, k in zip(shard, keys))
        assert sum((f.table > 0).sum() for f in filters if f) == len(keys)  # and no others
        sizes.append(len(keys))
    assert sizes[1] > sizes[0] == sizes[2]
    got = line_dedup.without_lines(whole, grown.drops(whole))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, line_dedup.dedup(whole).collect()))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    k = rng.integers(-2**62, 2**62, (5000, 2))
    f = line_dedup.CuckooFilter.of(k[:, 0], k[:, 1])
    assert f.contains(k[:, 0], k[:, 1]).all()
    other = rng.integers(-2**62, 2**62, (20000, 2))
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.002
    for a, b in k[:100].tolist():
        assert f.delete(a, b)
    assert f.contains(k[100:, 0], k[100:, 1]).all() and f.contains(k[:100, 0], k[:100, 1]).mean() < 0.05


def test_filters_and_exact_join_agree(docs, monkeypatch):
    whole = Counter(map(tuple, line_dedup.dedup(docs).collect()))
    monkeypatch.setattr(line_dedup, "FILTER_KEYS", 0)
    assert Counter(map(tuple, line_dedup.dedup(docs).collect())) == whole


@pytest.fixture(scope="module")
def codec():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_round_trip(docs, corpus, codec, empty):
    ids = {}
    want = Counter()
    for i, t in corpus:
        ids[t] = codec.encode_ordinary(t or "")
        want[(i, len(ids[t]), hashlib.sha256(",".join(map(str, ids[t])).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe_codec.round_trip(docs, RANKS, P.PATTERN).collect())) == want
    enc = bpe_codec.encode(docs, RANKS, P.PATTERN)
    assert sorted(map(repr, (r.ids for r in enc.collect()))) == sorted(repr(ids[t]) for _, t in corpus)
    dec = bpe_codec.decode(enc, RANKS, P.PATTERN)
    assert Counter((r.doc_id, bytes(r.data)) for r in dec.collect()) == Counter((i, (t or "").encode()) for i, t in corpus)
    assert bpe_codec.round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_long_texts_are_cut_where_no_match_crosses(codec, monkeypatch):
    texts = ["it's  a\n\n test 123 — don't!! " * 50, "x" * 5000, " " * 3000 + "a", "a \n b\t\tc " * 300, "'s 't" * 100]
    for t in texts:
        parts = bpe_codec.safe_pieces(t, 7)
        assert "".join(parts) == t
        assert [x for p in parts for x in codec.encode_ordinary(p)] == codec.encode_ordinary(t)


def labelled(spark):
    import random

    rng = random.Random(3)
    vocab = {"en": "the of and to in that with from this have".split(), "fr": "le la de et un une pour que dans est".split(), "ru": "это как его она был что тот для".split()}
    rows = []
    for k in range(300):
        lang = ["en", "fr", "ru"][k % 3]
        rows.append((k, " ".join(rng.choice(vocab[lang]) for _ in range(20)), lang))
    rows += [(1000, "the of and to in that with from " * 3 + "le la de et un une pour que dans est " * 6, None), (1001, None, "en"), (1002, "", "fr"), (1003, "12 !", "en"), (1004, "日本語", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id_held_out_accuracy_and_spans(spark, docs, empty):
    rows = labelled(spark)
    held = language_id.held_out()
    model = language_id.fit(rows.where(~held))
    assert model.langs == ["en", "fr", "ru"]
    got = {r.doc_id: r for r in language_id.predict(rows, model).collect()}
    truth = {r.doc_id: r.lang for r in rows.where(held & (F.col("doc_id") < 300)).collect()}
    assert np.mean([got[i].lang_pred == x for i, x in truth.items()]) == 1.0
    assert (got[1000].lang_pred, [s.lang for s in got[1000].spans]) == ("fr", ["en", "fr"]) and 0.5 < got[1000].score < 0.8
    assert got[1001].lang_pred == got[1002].lang_pred == got[1003].lang_pred == "und"
    assert got[1004].lang_pred in model.langs
    assert language_id.predict(empty, model).count() == 0
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_block_viterbi_is_the_plain_recursion():
    rng = np.random.default_rng(0)
    lens = [1, 3, 64, 65, 128, 200, 7, 333]
    score = rng.normal(0, 3, (sum(lens), 4))
    row = np.repeat(np.arange(len(lens)), lens)
    got = language_id.label_words(score, row, 4.0)
    a = 0
    for n in lens:
        s = score[a:a + n]
        best, back = s[0].copy(), []
        for x in s[1:]:
            to = best[None, :] - 4.0 * (1 - np.eye(4))
            back.append(to.argmax(1))
            best = to.max(1) + x
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[a:a + n].tolist() == path[::-1]
        a += n


def test_fingerprints_are_multisets():
    a, b, c = "one two three four", "five six seven", "eight"
    v = lambda t: fingerprint.vectors([t])
    same = lambda x, y: (x[0] == y[0]).all() and (x[1] == y[1]).all()
    assert same(v(f"{a}\n{b}\n{c}"), v(f"{c}\n{a}\n{b}"))
    assert same(fingerprint.add(v(f"{a}\n{b}"), v(c)), v(f"{a}\n{b}\n{c}"))
    assert same(fingerprint.remove(v(f"{a}\n{b}\n{c}"), v(b)), v(f"{a}\n{c}"))
    assert not same(v(a), v(f"{a}\n{a}")) and not same(v(""), v("\n"))
    assert fingerprint.likeness(v(""), v(""))[0] == 1 and fingerprint.likeness(v(""), v(a))[0] == 0


def test_fingerprint_query_is_the_definition(docs, corpus, empty):
    rows = sorted(((i, t or "") for i, t in corpus), key=lambda r: (-r[0] if r[0] is not None else float("inf"), r[1]))
    want = Counter()
    for (i, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
        k = len(t) // 3
        e = t[:len(t) - k] + nxt[:k]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.text_form(fingerprint.vectors([t]))[0], fingerprint.text_form(fingerprint.vectors([e]))[0])] += 1
    got = fingerprint.compare_with_edits(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])
    assert fingerprint.compare_with_edits(empty).count() == 0
    one = fingerprint.compare_with_edits(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.fingerprints(docs).count() == len(corpus)


def test_packing_is_whole_and_tight(docs, corpus, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    want = Counter()
    for i, t in corpus:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = packing.pack_documents(docs, TOKENIZER, capacity=64).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_words_encoded_together_are_those_encoded_alone():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    words = ["a", " b", " ", "\n", " c\nd", "e\n", " \n f", "\t", " x\ty", "'s", " 12", "é\u00a0", " <|endoftext|>", "\x1c", " a\x1cb", "a  b", "!\n?", "\u2028z", "日本"] * 3
    want = [np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert packing.encode_words(tok, words) == want
    text = " ".join(["The end.\nOf", "it's 42%", "naïve–é", "<|endoftext|>"] * 50)
    for t in (text, text + " ", " " + text, text.replace(" ", "  "), text + "\n\n" + text, "\n" + text + " \n"):
        assert packing.ids_of([t], open(TOKENIZER, encoding="utf-8").read())[0].tolist() == tok.encode(t, add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Best-two-fit bin by bin, for the plan of the histogram."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        room, bin_ = capacity, []
        for x in list(left):
            if x <= room:
                bin_.append(x)
                left.remove(x)
                room -= x
        if room and len(bin_) > 1:
            small = bin_[-1]
            best = max(((a + b, a, b) for i, a in enumerate(left) for b in left[i + 1:] if small < a + b <= room + small), default=None)
            if best:
                left.append(small)
                bin_[-1:] = best[1:]
                left.remove(best[1])
                left.remove(best[2])
                left.sort(reverse=True)
        bins += 1
    return bins


def test_plan_equals_bin_by_bin_run():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 41, rng.integers(1, 80)).tolist()
        plan = packing.plan(Counter(lengths), 40)
        used = Counter()
        for need, times in plan:
            assert sum(k * n for k, n in need.items()) <= 40
            for k, n in need.items():
                used[k] += n * times
        assert used == Counter(lengths)
        assert abs(sum(t for _, t in plan) - one_by_one(lengths, 40)) <= 1
    assert packing.plan({}, 40) == []


def test_license_scan_finds_planted_notices(spark, docs, empty):
    t = license_scan.TEMPLATES
    rows = [(1, "intro words here\n" + t["mit"]), (2, t["gpl-3.0"].upper()), (3, "see   the " + t["bsd"].replace(" ", "\n") + " and more"),
            (4, "license"), (5, None), (6, ""), (7, "x " * 3000 + t["apache-2.0-header"]), (8, "the license of the version"), (1, t["cc-by-nc-4.0"]), (9, t["bsd"].replace("binary", "other"))]
    df = spark.createDataFrame([(i, x, "z") for i, x in rows], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): r for r in license_scan.scan(df).collect()}
    assert {(1, "mit"), (2, "gpl-3.0"), (3, "bsd"), (7, "apache-2.0-header"), (1, "cc-by-nc-4.0")} <= set(got)
    assert not {k for k in got if k[0] in (4, 5, 6, 8)}
    assert all(r.containment >= 0.8 for r in got.values()) and (9, "bsd") not in got
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == 0


def test_license_anchors_change_nothing(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = Counter(map(tuple, license_scan.scan(df).collect()))
    monkeypatch.setattr(license_scan, "MOST_ANCHORS", -1)
    assert want and Counter(map(tuple, license_scan.scan(df).collect())) == want
