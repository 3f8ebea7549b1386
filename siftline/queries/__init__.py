"""One query per operator on the shared test tables, with an independent SQL twin where SQL can say it."""

from __future__ import annotations

from siftline.queries import columns, entities, profiles, rows, stores, texts, values

MODULES = [values, columns, profiles, rows, texts, entities, stores]


def all_queries() -> dict:
    """Query name to ``(spark, folder) -> DataFrame``."""
    return {name: build for m in MODULES for name, build in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    """Query name to SQL on the same tables."""
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
