"""Registered queries: a DataFrame over the given tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from foliospark.plans.bindings import Tables
from foliospark.plans.oracle import sql as with_views


class Query(NamedTuple):
    build: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under a name, with the SQL that must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, with_views(sql) if sql else None)
        return build

    return register
