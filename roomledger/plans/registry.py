"""Registry of runnable queries and their DuckDB oracle text.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle is an independent
SQL formulation of the result (not of our plan) that runs on the base parquet
views; booking tables are built by the same
mapping text as on the Spark side (see ``sources.fixtures``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roomledger.sources.fixtures import Fixtures, oracle_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parameters of the registered queries.  The report period spans every order
# date in the inputs, so each report reads and aggregates the whole table.
PERIOD = ("1995-01-01", "2001-12-31")
AUDIT_PERIOD = ("2024-01-01", "2024-01-31")
AS_OF = dt.datetime(1998, 6, 15, 12, 0, 0)
AS_OF_SQL = "TIMESTAMP '1998-06-15 12:00:00'"


def register(name: str, oracle: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn`` under ``name``; ``oracle`` is SQL over ``tables``."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle_with(oracle, *tables)
        return fn

    return deco


_FX_CACHE: dict[tuple[str, str], Fixtures] = {}


def fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FX_CACHE or _FX_CACHE[key].spark is not spark:  # frames belong to one session
        _FX_CACHE[key] = Fixtures(spark, sf_dir)
    return _FX_CACHE[key]


# ---------------------------------------------------------------- SQL snippets (oracle side)

def date_between(c: str, period=PERIOD) -> str:
    return f"CAST({c} AS DATE) BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'"


def s_pct(num: str, den: str) -> str:
    return (f"CASE WHEN ({den}) > 0 THEN CAST(FLOOR((({num}) * 20000 + ({den})) / (2 * ({den}))) AS DOUBLE) / 100 "
            f"ELSE 0.0 END")


def s_round2(num: str, den: str) -> str:
    return (f"CASE WHEN ({den}) > 0 THEN CAST(FLOOR((({num}) * 200 + ({den})) / (2 * ({den}))) AS DOUBLE) / 100 "
            f"ELSE 0.0 END")


def s_ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN CAST(({num}) AS DOUBLE) / ({den}) ELSE 0.0 END"


def s_secs(a: str = "start_time", b: str = "end_time") -> str:
    return f"date_diff('second', {a}, {b})"


def s_avg_hours(sum_sec: str, n: str) -> str:
    return f"CASE WHEN ({n}) > 0 THEN CAST(({sum_sec}) AS DOUBLE) / (({n}) * 3600) ELSE 0.0 END"


def s_hours(sum_sec: str) -> str:
    return f"COALESCE(CAST(({sum_sec}) AS DOUBLE) / 3600, 0.0)"
