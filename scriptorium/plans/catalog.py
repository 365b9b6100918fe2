"""Registry of every query the engine exposes, with its SQL oracle."""

from __future__ import annotations

import importlib

_MODULES = [
    "scriptorium.plans.q_geo",
    "scriptorium.plans.q_text",
    "scriptorium.plans.q_trends",
    "scriptorium.plans.q_chem",
    "scriptorium.plans.q_vectors",
    "scriptorium.plans.q_citations",
    "scriptorium.plans.q_topics",
    "scriptorium.plans.q_embed",
    "scriptorium.plans.q_stream",
    "scriptorium.plans.q_files",
]


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        for key in mod.QUERIES:
            if key in queries:
                raise ValueError(f"duplicate query {key}")
        queries.update(mod.QUERIES)
        oracle.update(getattr(mod, "ORACLE", {}))
    missing = set(oracle) - set(queries)
    if missing:
        raise ValueError(f"oracle without query: {sorted(missing)}")
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
