"""Document fingerprints: a homomorphic multiset hash of paragraphs (operator 7).

Every paragraph (text between line feeds) is hashed to a wide vector and a document's
fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of two.  The
order of paragraphs does not matter, and adding or deleting a paragraph adds or subtracts
its vector.  A vector has two parts:

* ``EXACT`` 64-bit lanes (modulo 2^64) from BLAKE2b of the paragraph, for equality;
* ``LANES`` 16-bit lanes (modulo 2^16) that count the paragraph's word pairs with hashed
  lane and sign, for likeness: the squared distance of two such parts estimates how many
  word pairs differ, and ``likeness`` is ``1 - |a-b|^2 / (|a|^2 + |b|^2)``, kept in 0..1.

Defined results: a null text is an empty text, which has one empty paragraph; equal
fingerprints have likeness 1; repeated rows and ids are kept, ids that are equal follow
each other by text, null ids come last; a single document is its own next document; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, SLICE_BYTES, U64, WHITE, mix, run_hashes, shuffle_partitions, word_runs

EXACT = 8
LANES = 128
_LINE = np.zeros(256, dtype=bool)
_LINE[10] = True


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the texts: exact lanes (uint64) and likeness lanes (int16)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    paragraphs = [r.split(b"\n") for r in raw]
    counts = np.array([len(p) for p in paragraphs], dtype=np.int64)
    digests = b"".join([hashlib.blake2b(q, digest_size=8 * EXACT).digest() for p in paragraphs for q in p])
    exact = np.add.reduceat(np.frombuffer(digests, dtype="<u8").reshape(-1, EXACT), np.cumsum(counts) - counts, axis=0) if len(raw) else np.zeros((0, EXACT), np.uint64)
    lanes = np.zeros((len(raw), LANES), np.int64)
    a = 0
    while a < len(raw):  # a few texts at a time
        b, size = a, 0
        while b < len(raw) and (b == a or size + len(raw[b]) <= SLICE_BYTES):
            size += len(raw[b])
            b += 1
        lanes[a:b] = _lanes(raw[a:b])
        a = b
    return exact, lanes.astype(np.int16)


def _lanes(raw: list[bytes]) -> np.ndarray:
    out = np.zeros(len(raw) * LANES, np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    s, e = word_runs(data, off)
    if len(s):
        h = run_hashes(LOWER[data], s, e)
        # a word that opens a text or paragraph has no word before it
        lines = np.concatenate([[0], np.cumsum(_LINE[data])])
        row = np.searchsorted(off, s, side="right") - 1
        opens = np.concatenate([[True], (row[1:] != row[:-1]) | (lines[s[1:]] != lines[s[:-1]])])
        before = np.concatenate([h[:1], h[:-1]])
        before[opens] = 0
        unit = mix(before * U64(0xD6E8FEB86659FD93) + h)
        sign = np.where((unit >> U64(32)) & U64(1), 1, -1)
        lane = (unit % U64(LANES)).astype(np.int64)
        out += np.bincount(row * LANES + lane, weights=sign, minlength=len(out)).astype(np.int64)
    return out.reshape(len(raw), LANES)


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the paragraphs of both."""
    return a[0] + b[0], (a[1] + b[1]).astype(np.int16)


def remove(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return a[0] - b[0], (a[1] - b[1]).astype(np.int16)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    far = ((a[1] - b[1]).astype(np.int16).astype(np.float64) ** 2).sum(1)  # modulo 2^16
    size = (x ** 2).sum(1) + (y ** 2).sum(1)
    out = np.clip(1 - far / np.where(size > 0, size, 1), 0, 1)
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(same, 1.0, np.where(size > 0, out, 0.0))


def text_form(a: tuple[np.ndarray, np.ndarray]) -> list[str]:
    return [base64.b64encode(x.astype("<u8").tobytes() + y.astype("<i2").tobytes()).decode() for x, y in zip(*a)]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                r = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays([r.column(0), pa.array(text_form(vectors(r.column(1).to_pylist())), pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt to ranges of descending ids, each range also holding the first row of
    the next one (``_extra`` 1; the last range: that of the first), and sorted.

    The ranges come from id quantiles, so no range is much larger than another; at most
    one number per range reaches the driver."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_at", F.coalesce(F.col("doc_id"), F.lit(-2**63)).cast("double"))
    ranges = 4 * n  # several a partition, so that hashing them to partitions comes out even
    cuts = rows.approxQuantile("_at", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    cuts = sorted(set(cuts))
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(rows).withColumn("_bucket", F.col("_bucket").cast("int"))
    heads = {r["_bucket"]: r["m"] for r in rows.groupBy("_bucket").agg(F.max("_at").alias("m")).collect()}
    used = sorted(heads, reverse=True)
    if not used:
        return rows.withColumn("_extra", F.lit(0))
    before = {b: used[i - 1] for i, b in enumerate(used)}  # the head of b also goes here
    head = F.create_map(*[x for b in used for x in (F.lit(b), F.lit(heads[b]))])[F.col("_bucket")]
    home = F.create_map(*[x for b in used for x in (F.lit(b), F.lit(before[b]))])[F.col("_bucket")]
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("x"))
    dealt = F.when(F.col("_at") == head, F.array(own, F.struct(home.alias("b"), F.lit(1).alias("x")))).otherwise(F.array(own))
    rows = rows.withColumn("_to", F.explode(dealt)).select("doc_id", "text", F.col("_to.b").alias("_bucket"), F.col("_to.x").alias("_extra"))
    return rows.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_extra", F.col("doc_id").desc_nulls_last(), "text")


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``: each text against itself with its last third replaced by the start of
    the next document (by descending id), and against the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def flush(ids, texts, follows):
        """Results of consecutive rows; the row after the last one is in ``follows``."""
        edited = []
        for t, nxt in zip(texts, follows):
            k = len(t) // 3
            edited.append(t[:len(t) - k] + nxt[:k])
        exact, lanes = vectors([*texts, follows[-1]])
        own, nxt = (exact[:-1], lanes[:-1]), (exact[1:], lanes[1:])
        ed = vectors(edited)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([
            ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            text_form(own), text_form(ed), likeness(own, ed), likeness(own, nxt)], types)], names)

    def run(batches):
        ids, texts, size, bucket, done = [], [], 0, None, False
        for b in batches:
            for a in range(0, b.num_rows, 256):
                r = b.slice(a, 256)
                for i, t, k, x in zip(*[r.column(j).to_pylist() for j in range(4)]):
                    if k != bucket:
                        bucket, done, ids, texts, size = k, False, [], [], 0
                    if done:
                        continue
                    if ids and (x or size > SLICE_BYTES):
                        yield flush(ids, texts, [*texts[1:], t])
                        ids, texts, size = [], [], 0
                    if x:
                        done = True  # further extras are rows with the same id
                        continue
                    ids.append(i)
                    texts.append(t)
                    size += len(t)

    return with_next(docs, key, text).select("doc_id", "text", "_bucket", "_extra").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
