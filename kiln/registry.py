"""Key -> (Spark query, DuckDB oracle SQL) registry.

Every registered query takes ``(spark, sf_dir)`` and returns a DataFrame
computed from the whole driver tables. The oracle SQL, when given, is an
independent statement over the same tables; ``None`` marks operators whose
output is not SQL-expressible (trained models, streams) and that are checked
by row count only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    section: str


_REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None, section: str = ""):
    def deco(fn):
        if key in _REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        _REGISTRY[key] = Entry(key, fn, sql.strip() if sql else None, section)
        return fn
    return deco


def _load_all() -> None:
    # importing the plan modules registers their queries
    from kiln.plans import catalog  # noqa: F401


def entries() -> dict[str, Entry]:
    _load_all()
    return dict(_REGISTRY)


def _utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Run a query with the session time zone pinned to UTC (hour-of-day,
    zone conversion and epoch rules are defined in UTC), whatever session
    the caller brings."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _utc(e.fn) for k, e in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in entries().items() if e.sql}
