"""Every registered query with the SQL that states its result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "flagship_ia_micro_f"
MODULES = ("staging", "dag", "evaluation", "similarity", "blending", "analysis", "learning", "files", "pools", "evidence", "codes", "lookups")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; sql is the same result in DuckDB's dialect, where SQL can state it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"rankloom.plans.{name}")
