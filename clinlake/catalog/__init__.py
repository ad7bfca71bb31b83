"""Registered queries over the driver tables.

Each submodule defines ``QUERIES`` (name -> callable(spark, sf_dir) ->
DataFrame) and ``ORACLE`` (name -> DuckDB SQL over the same tables).  Every
query reads the given tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

import importlib

_MODULES = [
    "frames", "cleaning", "profiles", "drift", "panel", "evaluation",
    "text", "graph", "genomics", "signal", "streams", "models", "sources", "analytics", "linkage",
]


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(f"clinlake.catalog.{name}")
        queries.update(mod.QUERIES)
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracle_sql():
    return _load()[1]
