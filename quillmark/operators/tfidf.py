"""TF-IDF (E1, E2): vocabulary = top-k terms by corpus frequency (ties by term), smooth
idf, L2-normalised weights, kept sparse as long rows ``(key, term, w)``.

Fitting shuffles summaries of bounded size and the counts of candidates, not the
vocabulary; the result has at most ``max_features`` rows, so broadcasting it is bounded."""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# word characters in runs of two or more, lower-cased (default analyzer of the
# reference's vectorizer)
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
_TERM = regex.compile(TERM_PATTERN)


#: Words whose terms a task remembers, and their longest.
KNOWN_WORDS = 200_000
KNOWN_CHARS = 100


class WordTerms:
    """Terms of lower-cased texts word by word: white space is in no term, so a word's terms
    are found once, however often it comes."""

    def __init__(self, wanted=None):
        self.wanted = wanted
        self.known: dict[str, tuple] = {}

    def of(self, word: str) -> tuple:
        """The (wanted) terms of a word, in order."""
        found = self.known.get(word)
        if found is None:
            plain = word.isascii() and word.isalnum() and len(word) > 1
            found = (word,) if plain else tuple(_TERM.findall(word))
            if self.wanted is not None:
                found = tuple(t for t in found if t in self.wanted)
            if len(word) <= KNOWN_CHARS:
                if len(self.known) >= KNOWN_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def counts(self, words: Counter) -> dict[str, int]:
        """Occurrences of the (wanted) terms in words that occur so often."""
        out: dict[str, int] = {}
        of = self.of
        for word, n in words.items():
            for t in of(word):
                out[t] = out.get(t, 0) + n
        return out


#: A word of ASCII characters with one run of word characters, which is its only term.
_ONE_TERM = r"^[^A-Za-z0-9_]*(?P<t>[A-Za-z0-9_]{2,})[^A-Za-z0-9_]*$"
#: Bytes of text whose words are numbered at a time, and rows whose terms are weighed.
SLICE = 32 << 20
ROWS = 1000


def slices(texts: pa.Array):
    """Runs of texts of about ``SLICE`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(size[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + SLICE, side="right")))
        yield texts.slice(start, end - start).cast(pa.string())  # not the large kind
        start = end


def numbered_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of lower-cased texts and, for every occurrence in order, the number of
    its term and of its text.  White space is in no term, so words are told apart first and
    the terms of each distinct word found once."""
    split = pc.utf8_split_whitespace(texts)
    owner = pc.list_parent_indices(split).to_numpy()
    coded = split.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    one = pc.if_else(pc.string_is_ascii(words), pc.struct_field(pc.extract_regex(words, _ONE_TERM), "t"), pa.scalar(None, pa.string()))
    simple = one.is_valid().to_numpy(zero_copy_only=False)
    other = [_TERM.findall(w) for w in words.filter(one.is_null()).to_pylist()]
    size = np.ones(len(words), np.int64)
    size[~simple] = np.fromiter(map(len, other), np.int64, len(other))
    start = np.zeros(len(words), np.int64)  # where a word's terms begin, those of simple words first
    n = int(simple.sum())
    start[simple] = np.arange(n)
    start[~simple] = n + np.cumsum(size[~simple]) - size[~simple]
    found = pa.concat_arrays([one.drop_null(), pa.array(list(chain.from_iterable(other)), pa.string())]).dictionary_encode()
    each = size[code]
    word = np.repeat(np.arange(len(code)), each)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(each) - each, each)
    return found.dictionary, found.indices.to_numpy()[start[code[word]] + nth], owner[word]


def places(terms: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each term stands in ``among``, -1 for those that do not."""
    return pc.fill_null(pc.index_in(terms, value_set=among), -1).to_numpy(zero_copy_only=False)


def terms(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TERM_PATTERN), 0)


def tfidf_fit(docs: DataFrame, max_features: int = 5000, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """``(term, cnt, df, idf)`` for the top ``max_features`` terms: candidates from
    mergeable summaries, then one exact count of those (``heavy``)."""
    from .heavy import top_terms
    n = docs.select(F.count("*")).scalar()                  # scalar subquery
    top = top_terms(docs, max_features, text=text)
    return top.select("term", "cnt", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def all_term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, cnt, df`` of every term.

    Corpus frequency and document frequency are two word counts grouped by term only
    (occurrences, and distinct terms per text), so map-side combining shrinks each to
    about one row per (partition, term) before the exchange; no (text, term) pair is
    shuffled."""
    t = docs.select(terms(text).alias("_t"))
    cnt = t.select(F.explode("_t").alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))
    dfq = t.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return cnt.join(dfq, "term").select("term", F.col("cnt").cast("long").alias("cnt"), F.col("df").cast("long").alias("df"))


def tfidf_transform(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Long sparse rows ``(key, term, w)`` with sum(w^2) = 1 per key.

    A text is one row of numbers until its weights are known: the places of its terms in
    the vocabulary and their counts.  One exchange by key brings together texts that share
    one; no term row is shuffled."""
    # <= max_features rows
    rows = vocabulary.where("term is not null").select("term", "idf").collect()
    bound = docs.sparkSession.sparkContext.broadcast(([r["term"] for r in rows], np.array([float(r["idf"]) for r in rows])))

    def count(batches):
        given = pa.array(bound.value[0], pa.string())
        for b in batches:
            start = 0
            for some in slices(b.column(1)):
                found, at, owner = numbered_terms(some)
                place = places(found, given)[at]
                keep = place >= 0
                codes, n = np.unique(owner[keep].astype(np.int64) * max(len(given), 1) + place[keep], return_counts=True)
                owner, place = np.divmod(codes, max(len(given), 1))
                held, size = np.unique(owner, return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (place, n)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(held + start)), *lists], ["k", "at", "n"])
                start += len(some)

    def weigh(batches):
        given, idf = pa.array(bound.value[0], pa.string()), bound.value[1]
        size = max(len(given), 1)
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                some = b.slice(start, ROWS)
                owner = pc.list_parent_indices(some.column(1)).to_numpy().astype(np.int64)
                codes, back = np.unique(owner * size + some.column(1).flatten().to_numpy(), return_inverse=True)
                owner, place = np.divmod(codes, size)
                raw = np.bincount(back, weights=some.column(2).flatten().to_numpy(), minlength=len(codes)) * idf[place]
                w = raw / np.sqrt(np.bincount(owner, weights=raw * raw, minlength=some.num_rows))[owner]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner)), given.take(pa.array(place)), pa.array(w)], ["k", "term", "w"])

    x = docs.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("text")).where("text is not null")
    kind = T.StructType([T.StructField("k", x.schema["k"].dataType), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))])
    both = F.collect_list(F.struct("at", "n"))
    one = x.mapInArrow(count, kind).groupBy("k").agg(F.flatten(both["at"]).alias("at"), F.flatten(both["n"]).alias("n"))
    out = T.StructType([T.StructField("k", x.schema["k"].dataType), T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType())])
    return one.mapInArrow(weigh, out).withColumnRenamed("k", key)


def sparse_cosine(a: DataFrame, b: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """Cosine distance between L2-normalised sparse vectors ``(…, term, w)``: side ``a``
    rows grouped by ``keys`` are matched with side ``b`` on ``on`` + term; distance is
    1 - sum of w_a*w_b over shared terms (a pair with no shared term is absent: 1)."""
    on = on or keys
    j = (a.withColumnRenamed("w", "wa").join(b.withColumnRenamed("w", "wb"), [*on, "term"])
         .groupBy(*keys).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot")))
    return j.select(*keys, F.least(F.greatest(1.0 - F.col("dot"), F.lit(0.0)), F.lit(2.0)).alias("cos"))


def tfidf_cosines_inrow(df: DataFrame, vocabulary: DataFrame, text: str = "text",
                        variants: str = "variants", out: str = "tfidf_cos") -> DataFrame:
    """Block 5 inside each record: TF-IDF vectors of the original and of every variant
    (same vocabulary / idf as E1-E2) and their cosine distances, as
    ``ARRAY<DOUBLE>`` in variant order.  The vocabulary is at most ``max_features``
    rows (bounded), so it ships to the tasks with the function; no term row is
    shuffled."""
    idf = {r["term"]: float(r["idf"]) for r in vocabulary.select("term", "idf").collect()}
    words = WordTerms(idf)

    def vec(s):
        if s is None:
            return {}
        v = {t: n * idf[t] for t, n in words.counts(Counter(s.lower().split())).items()}
        nrm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / nrm for k, x in v.items()} if nrm > 0 else {}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def cos(orig: pd.Series, vs: pd.Series) -> pd.Series:
        res = []
        for o, lst in zip(orig, vs):
            a = vec(o)
            row = []
            for v in (lst if lst is not None else []):
                if v is None:  # a missing rewrite has no distance
                    row.append(None)
                    continue
                b = vec(v)
                small, big = (a, b) if len(a) < len(b) else (b, a)
                d = sum(x * big.get(k, 0.0) for k, x in small.items())
                row.append(min(max(1.0 - d, 0.0), 2.0))
            res.append(row)
        return pd.Series(res)
    return df.withColumn(out, cos(F.col(text), F.transform(variants, lambda v: v["text"])))
