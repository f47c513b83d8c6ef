"""Deterministic hashing for samples, splits and shuffles.

Everything keys off ``md5("<seed>-<key>")``: independent of partitioning and task
retries (a re-run task draws the same values), and reproducible in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hkey(seed, *keys) -> Column:
    """md5 hex of ``seed-key1-key2...``; lexicographic order of the hex is a seeded
    pseudo-random order."""
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("-", *parts))


def h32(seed, *keys) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of ``hkey``."""
    return F.conv(F.substring(hkey(seed, *keys), 1, 8), 16, 10).cast("long")


def u01(seed, *keys) -> Column:
    """Uniform [0, 1) draw."""
    return h32(seed, *keys) / F.lit(float(2 ** 32))


def pick_index(seed, n, *keys) -> Column:
    """1-based index in [1, n] (n > 0)."""
    return (F.pmod(h32(seed, *keys), _c(n).cast("long")) + 1).cast("int")
