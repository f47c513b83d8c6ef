"""Helpers shared by the operators: tables, shared scratch tables, Arrow text slices and
vectorised word hashing.

Texts reach Python as Arrow batches; the helpers work on the UTF-8 buffer of a slice
(a few MB) with numpy, so memory per task depends on the slice, not on the partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy code.
SLICE_BYTES = 1 << 20

#: The white space of the contracts: space and 0x09-0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Unset (local tests only) a scratch
    folder is made and recorded; on any other master an unset folder is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="qm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: its lineage ends
    there and a lost executor loses nothing.  The deployment clears the folder."""
    path = f"{shared_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def two_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` only (other columns, whatever their names, are left out)."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def plain_names(docs: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """``docs`` with every column but ``own`` renamed by its position, so that no name can
    clash with one inside an operator or needs quoting; ``toDF`` gives the names back."""
    return docs.toDF(*[n if n in own else f"extra_{i}" for i, n in enumerate(docs.columns)])


# -- Arrow slices -----------------------------------------------------------------------

def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows of about ``most`` bytes."""
    if batch.num_rows == 0:
        return
    data, off = string_buffers(batch.column(batch.schema.get_field_index(column)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        b = min(b, batch.num_rows)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


# -- word hashing -----------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), element by element."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run ``[start, end)`` (ascending, not empty, apart)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    pos = np.arange(total) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    v = _BYTE_HASH[data[at]] * powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(v, first) + lens.astype(np.uint64))


def word_runs(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``breaks``; runs end at the
    borders of rows (``off``)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    word = ~breaks[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, A-Z lower-cased, and the
    index of each row's first word (one more at the end).  Long rows are handled in
    blocks cut at white space, so temporary memory does not grow with a text."""
    hashes, counts, n = [], np.zeros(len(off), np.int64), len(data)
    a = 0
    while a < n:
        b = min(n, a + SLICE_BYTES)
        if b < n:
            white = np.flatnonzero(WHITE[data[a:b]])
            if len(white):
                b = a + int(white[-1]) + 1
            else:
                after = np.flatnonzero(WHITE[data[b:]])
                b = b + int(after[0]) + 1 if len(after) else n
        d = data[a:b]
        inner = off[(off >= a) & (off <= b)] - a
        s, e = word_runs(d, inner)
        hashes.append(run_hashes(LOWER[d] if lower else d, s, e))
        counts += np.bincount(np.searchsorted(off, s + a, side="right") - 1, minlength=len(off))
        a = b
    first = np.zeros(len(off), np.int64)
    first[1:] = np.cumsum(counts[:-1])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), first


def give_back() -> None:
    """Return freed memory to the system: a worker that is done with a large block would
    keep it otherwise, beside the JVM and the other workers of its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def record(names_types: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=t)
                                       for c, (_, t) in zip(columns, names_types)], names=[n for n, _ in names_types])
