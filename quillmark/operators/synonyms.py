"""Near-synonyms of a vocabulary from the corpus itself (H3).

Words are alike if they stand next to the same words.  A word's vector holds, for the words
seen up to ``window`` places to its left and, apart from them, to its right, hashed into
``dim`` buckets a side, the positive pointwise mutual information between the word and the
bucket.  A task knows the vocabulary and adds the pairs of neighbours of its texts to one
matrix of counts, whose rows are then summed (a vocabulary above ``MOST_WORDS`` is joined to
the pairs instead); only words of the vocabulary keep rows, so a word has at most
``2 * dim`` of them and the hottest word is as cheap as any.  The nearest other word comes from the exact pivot search, and it is a
near-synonym only if its cosine similarity reaches the floor.

Defined results: null and empty texts add nothing; a word that occurs alone in every text has
no vector and no synonym; ties go to the smaller word; repeated vocabulary words count once."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import h32
from ..session import stored
from . import neighbours as NB
from . import tfidf as TF
from .corpus import dense_index

DIM = 64
WINDOW = 2
FLOOR = 0.5
#: Cells of the search.  Context vectors hardly cluster, so a word must look into nearly all
#: cells, and each costs it a copy of its vector; the cells' own blocks bound a task's work.
PIVOTS = 4
#: The largest vocabulary that the tasks get, and counts that a task sends at a time.
MOST_WORDS = 20_000
CHUNK = 500_000


def context_pairs(text, window: int = WINDOW, dim: int = DIM, seed=5) -> Column:
    """``array<struct<term, bucket>>``: every term with the bucket of each neighbour; those
    to its right have the buckets from ``dim`` on."""
    def pairs(marked):
        n = F.size(marked)
        steps = []
        for d in range(1, window + 1):
            rest = F.greatest(n - d, F.lit(0))
            left, right = F.slice(marked, 1, rest), F.slice(marked, F.lit(1 + d), rest)
            steps.append(F.flatten(F.zip_with(left, right, lambda a, b: F.array(
                F.struct(a["t"].alias("term"), (b["b"] + dim).alias("bucket")),
                F.struct(b["t"].alias("term"), a["b"].alias("bucket"))))))
        return F.concat(*steps)

    marked = F.transform(TF.terms(text), lambda t: F.struct(t.alias("t"), F.pmod(h32(seed, t), F.lit(dim)).cast("int").alias("b")))
    # bound once as a lambda variable: every slice would otherwise find the terms again
    return F.flatten(F.transform(F.array(marked), pairs))


def _counted_pairs(docs: DataFrame, vocabulary: list[str], window: int, dim: int, seed, text: str) -> DataFrame:
    """``term, bucket, c``: how often the buckets stand next to the terms of ``vocabulary``; a
    task sends at most ``2 * dim`` rows per term."""
    bound = docs.sparkSession.sparkContext.broadcast(sorted(vocabulary))
    width = 2 * dim

    def run(batches):
        words = pa.array(bound.value, pa.string())
        counts = np.zeros(len(words) * width, np.int64)
        for b in batches:
            for some in TF.slices(b.column(0)):
                terms, at, owner = TF.numbered_terms(some)
                buckets = np.array([int.from_bytes(md5(f"{seed}-{t}".encode()).digest()[:4], "big") % dim for t in terms.to_pylist()], np.int64)
                row, bucket = TF.places(terms, words).astype(np.int64)[at], buckets[at]
                for d in range(1, window + 1):
                    near = owner[:-d] == owner[d:]  # no pair reaches over the end of a text
                    for term, other in ((row[:-d], bucket[d:] + dim), (row[d:], bucket[:-d])):
                        counts += np.bincount((term * width + other)[near & (term >= 0)], minlength=len(counts))
        at = np.flatnonzero(counts)
        for i in range(0, len(at), CHUNK):
            some = at[i:i + CHUNK]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(some // width)), pa.array((some % width).astype("int32")), pa.array(counts[some])], ["term", "bucket", "c"])

    lowered = docs.select(F.lower(F.col(text)).alias("text")).where("text is not null")
    return lowered.mapInArrow(run, "term string, bucket int, c long").groupBy("term", "bucket").agg(F.sum("c").alias("c"))


def context_vectors(docs: DataFrame, vocabulary: DataFrame, window: int = WINDOW, dim: int = DIM, seed=5, text: str = "text") -> DataFrame:
    """``(word, emb array<double> of 2 * dim)`` for the words of ``vocabulary (term)``."""
    known = stored(vocabulary.where("term is not null").select("term").distinct())
    few = [r["term"] for r in known.limit(MOST_WORDS + 1).collect()]
    if len(few) <= MOST_WORDS:
        counts = stored(_counted_pairs(docs, few, window, dim, seed, text))
    else:
        seen = docs.select(F.explode(context_pairs(text, window, dim, seed)).alias("p")).select("p.term", "p.bucket")
        counts = stored(seen.groupBy("term", "bucket").agg(F.count(F.lit(1)).alias("c")).join(known, "term"))
    of_term = counts.groupBy("term").agg(F.sum("c").alias("cw"), F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("m"))  # at most 2 * dim entries
    of_bucket = counts.groupBy("bucket").agg(F.sum("c").alias("cb"))  # at most 2 * dim rows
    shared = of_bucket.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cb"))).alias("cb"), F.sum("cb").alias("n")).select(F.struct("*")).scalar()
    x = of_term.withColumn("_s", shared)

    def cell(k):
        c = F.try_element_at("m", k).cast("double")
        gain = F.log(c * F.col("_s.n") / (F.col("cw").cast("double") * F.try_element_at(F.col("_s.cb"), k)))
        return F.when(c.isNotNull(), F.greatest(gain, F.lit(0.0))).otherwise(F.lit(0.0))

    return x.select(F.col("term").alias("word"), F.transform(F.sequence(F.lit(0), F.lit(2 * dim - 1)), cell).alias("emb"))


def near_synonyms(vectors: DataFrame, floor: float = FLOOR) -> DataFrame:
    """``(word, repl, similarity)``: of ``(word, emb)`` every word whose nearest other word
    has a cosine similarity of at least ``floor``, with that word.  Of several vectors of a
    word the first in order counts; words with a zero vector have no neighbour."""
    v = vectors.where("word is not null and emb is not null").groupBy("word").agg(F.min("emb").alias("emb"))
    v = v.where(F.exists("emb", lambda e: e != 0))
    named = stored(dense_index(v, ["word"], "id", bucket=F.substring("word", 1, 2)).select(F.col("id").cast("long").alias("id"), "word", "emb"))
    near = NB.neighbours(named.select("id", "emb"), 1, PIVOTS).where(F.lit(1.0) - F.col("dist") >= F.lit(float(floor)))
    names = named.select("id", "word")
    other = names.select(F.col("id").alias("dst"), F.col("word").alias("repl"))
    return (near.join(names.withColumnRenamed("id", "src"), "src").join(other, "dst")
            .select("word", "repl", (F.lit(1.0) - F.col("dist")).alias("similarity")))
