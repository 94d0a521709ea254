"""Every query by name, and SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) under a name; sql gives the same rows in DuckDB."""
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add
