"""All registered queries, their DuckDB twins, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import ledger, market, scans, study  # noqa: F401  (they register their queries)
from tickloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["momentum_rule_stats"](spark, sf_dir)
