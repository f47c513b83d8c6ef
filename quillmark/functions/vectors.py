"""Vector Column functions (F1-F3, E4, E5, E9, E10): array expressions evaluated
row-locally on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sampling import u01, pick_index

# Special token ids of the byte-level BPE vocabulary the style model uses
# (<s>, <pad>, </s>, <mask>).
BOS_ID, PAD_ID, EOS_ID, MASK_ID = 0, 1, 2, 50264


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_d(a), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def euclidean(a, b) -> Column:
    """F1."""
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """cosine distance; a zero vector has distance 1; clipped to [0, 2]."""
    na, nb = norm(a), norm(b)
    sim = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return F.least(F.greatest(F.lit(1.0) - sim, F.lit(0.0)), F.lit(2.0))


def manhattan(a, b) -> Column:
    """F3."""
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def vec_add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vec_scale(a, k) -> Column:
    return F.transform(_c(a), lambda x: x * k)


def pool_tokens(tok_emb, how: str = "cls") -> Column:
    """First token row, or the mean of the token rows."""
    t = _c(tok_emb)
    if how == "cls":
        return F.element_at(t, 1).cast("array<double>")
    if how == "mean":
        first = F.element_at(t, 1).cast("array<double>")
        zero = F.transform(first, lambda x: F.lit(0.0))
        total = F.aggregate(t, zero, lambda acc, r: vec_add(acc, r.cast("array<double>")))
        return vec_scale(total, F.lit(1.0) / F.size(t))
    raise ValueError("pool type must be 'cls' or 'mean'")


def masked_mean_pool(tok_emb, mask) -> Column:
    """E5: sum(mask * e) / max(sum(mask), 1e-9)."""
    t, m = _c(tok_emb), _c(mask)
    first = F.element_at(t, 1).cast("array<double>")
    zero = F.transform(first, lambda x: F.lit(0.0))
    pairs = F.arrays_zip(t.alias("e"), m.alias("m"))
    total = F.aggregate(pairs, zero, lambda acc, p: vec_add(acc, vec_scale(p["e"].cast("array<double>"),
                                                                            p["m"].cast("double"))))
    denom = F.greatest(F.aggregate(m, F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(1e-9))
    return vec_scale(total, F.lit(1.0) / denom)


def token_window(ids, key, length: int = 32, seed=42) -> Column:
    """A window of ``length-2`` ids starting at a seeded offset, wrapped in <s> ..
    </s>; shorter inputs are padded with <pad> to ``length``."""
    x = _c(ids)
    inner = length - 2
    n = F.size(x)
    start = pick_index(seed, F.greatest(n - inner + 1, F.lit(1)), key)
    win = F.slice(x, start, inner)
    body = F.concat(F.array(F.lit(BOS_ID)), win, F.array(F.lit(EOS_ID)))
    pad = F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(length) - F.size(body), F.lit(0)))
    return F.concat(body, pad)


def attention_mask(ids) -> Column:
    return F.transform(_c(ids), lambda x: F.when(x == PAD_ID, 0).otherwise(1))


def mask_tokens(ids, key, p: float = 0.15, seed=42) -> Column:
    """Each non-special id is replaced by <mask> with probability p (seeded per
    (key, position))."""
    x = _c(ids)
    return F.transform(x, lambda v, i: F.when(
        (~v.isin(BOS_ID, PAD_ID, EOS_ID)) & (u01(seed, key, i) < F.lit(float(p))), F.lit(MASK_ID))
        .otherwise(v))


def token_ids(toks, vocab: int = 50000) -> Column:
    """Deterministic id per token (md5 bucket, offset past the special ids); stands in
    for a subword tokenizer, which is outside the engine."""
    return F.transform(_c(toks), lambda t: (F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10)
                                                   .cast("long"), F.lit(vocab)) + 4).cast("int"))
