"""Training-data operators.  Nothing else in the library imports this package.

``queries()`` and ``oracle_sql()`` gather the registered queries of its modules."""

from __future__ import annotations

import importlib

MODULES = ["quality_rules", "sharding", "warc", "html_text", "fingerprints", "quality_model", "packing", "mixing", "jaccard_join", "pii_spans",
           "fill_middle", "source_audit", "graph_search"]


def _gather(name: str) -> dict:
    out = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"clinlake.llm.{m}"), name, {}))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
