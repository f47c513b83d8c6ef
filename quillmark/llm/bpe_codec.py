"""Byte-level BPE encoding and decoding (operator 5).

``encode`` turns every whole text into the ids that the tiktoken library gives for a
local rank file, without special tokens; ``decode`` turns ids back into raw bytes (never
through text, so an id that holds half a character decodes to exactly its bytes).

Long texts are cut before a space or line end that follows a non-space character: no
match of the split pattern holds a non-space followed by white space, and none looks
behind its start, so the matches on both sides are those of the whole text.

Defined results: null and empty texts give no ids and decode to no bytes; repeated rows
are kept, one result each; an empty table gives an empty table; other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import two_columns

#: Characters of a text that are handed to the library at once.
PIECE_CHARS = 1 << 16
_BORDER = re.compile(r"(?<=\S)(?=[ \n])")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces of about ``size`` characters, cut only where no match crosses."""
    if len(text) <= size:
        return [text]
    out, a = [], 0
    while len(text) - a > size:
        m = _BORDER.search(text, a + size)
        if not m:
            break
        out.append(text[a:m.start()])
        a = m.start()
    return [*out, text[a:]]


def read_ranks(path: str) -> bytes:
    """The rank file, read once on the driver; its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def _codec(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_texts(codec, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of each text as an array."""
    out = []
    for t in texts:
        parts = [codec.encode_to_numpy(p, disallowed_special=()) for p in safe_pieces(t or "")]
        out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
    return out


def _runs(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every text."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for b in batches:
            for r in _runs(b):
                ids = encode_texts(codec, r.column(1).to_pylist())
                off = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([r.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc_id", "ids"])

    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, data binary`` from ``doc_id, ids``; null ids decode to no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for b in batches:
            for r in _runs(b):
                data = [codec.decode_bytes(i or []) for i in r.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([r.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``.  The ids go to the digests without leaving the task."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches):
        codec = _codec(ranks.value, pattern)
        words = [str(i) for i in range(codec.n_vocab)]
        for b in batches:
            for r in _runs(b):
                n, ids_sha, data_sha = [], [], []
                for ids in encode_texts(codec, r.column(1).to_pylist()):
                    ids = ids.tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join([words[i] for i in ids]).encode()).hexdigest())
                    data_sha.append(hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([r.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return two_columns(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
