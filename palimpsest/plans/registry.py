"""Registry of the versioned-record queries and the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


from . import blocks, catalog, disk, integrity, records, space, streams  # noqa: E402,F401  they register themselves
