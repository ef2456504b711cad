"""Registered queries over the star-schema tables."""

from __future__ import annotations

import importlib

MODULES = (
    "flagship",
    "source_queries",
    "select_queries",
    "join_queries",
    "aggregate_queries",
    "window_queries",
    "fill_queries",
    "label_queries",
    "split_queries",
    "evaluate_queries",
    "impute_queries",
    "vector_queries",
    "model_queries",
)


def load_queries() -> tuple[dict, dict]:
    """All registered queries and SQL texts."""
    for name in MODULES:
        importlib.import_module(f"chronopanel.plans.{name}")
    from chronopanel.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
