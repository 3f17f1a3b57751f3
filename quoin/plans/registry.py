"""All registered queries of the library proper, and their SQL twins."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``(spark, sf_dir) -> DataFrame`` under an operator's id, with its DuckDB twin."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for _family in ("questions", "ranking", "structure", "graph", "extraction", "retrieval", "more", "streams", "audits", "lookups", "typed"):
    importlib.import_module(f"quoin.plans.{_family}")
