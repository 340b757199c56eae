"""Where the plans register their queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The events table as ticks; what sources.ticks.events_as_ticks gives.
TICKS = """ticks AS (
  SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS time_ms, value * (1 + k / 1e5) AS ask,
    value * (1 - k / 1e5) AS bid, value AS mid, CAST(k AS DOUBLE) AS ask_vol, CAST(100 - k AS DOUBLE) AS bid_vol
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its twin in SQL."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits don't differ; minus zero becomes zero.

    A little is added first, so that decimals that end in 5 aren't decided by the last bits.
    """
    return df.withColumns({c: F.round(F.col(c) + F.lit(nudge(digits)), digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def nudge(digits: int) -> float:
    return float(f"1.37e-{digits + 3}")


def rounded_sql(sql: str, doubles: str, digits: int = 6) -> str:
    """The same for the named columns of a SQL query."""
    columns = ", ".join(f"round(CAST({c} AS DOUBLE) + {nudge(digits)}, {digits}) + 0.0 AS {c}" for c in doubles.split())
    return f"SELECT * REPLACE ({columns}) FROM (\n{sql}\n) AS rounded"
