"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from . import q_corpus, q_density, q_eval, q_features, q_ops, q_robust, q_text, q_vectors  # noqa: F401
from .registry import IDS, ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def operator_ids():
    return dict(IDS)
