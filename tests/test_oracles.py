"""Every query with a DuckDB twin gives the same rows; the others give rows."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from settings import SMALL
from tickloom.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return con


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return str(int(v)) if v == int(v) else f"{float(v):.9g}"
    return str(v)


def table(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    return pd.DataFrame({c: [norm(v) for v in df[c].tolist()] for c in cols}).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = table(QUERIES[name](spark, SMALL).toPandas())
    want = table(duck.execute(ORACLES[name]).fetch_df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    # bar features start after 240 bars of a symbol
    folder = SMALL.replace("0.001", "0.01") if name == "hypothesis_families" else SMALL
    assert QUERIES[name](spark, folder).count() > 0


def written_events(spark, folder, rows):
    """A folder with events of rows (event_id, milliseconds, event_type, value)."""
    e = spark.createDataFrame(rows, "event_id long, ms long, event_type string, value double")
    e = e.selectExpr("event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, ms / 1000) AS ts", "event_id AS user_id", "event_type", "value", "concat('{\"k\": ', event_id % 100, '}') AS props")
    e.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_guard_of_odd_prices(spark, tmp_path):
    values = [1.0, 0.0, -1.0, 3.0, math.nan, None, math.inf, -0.0, 100.0]
    folder = written_events(spark, str(tmp_path), [(k, k, "A", x) for k, x in enumerate(values * 2)])
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    name = "finite_guard_and_clamp"
    want = con.execute(f"select symbol, seq, x, z from ({ORACLES[name]}) order by seq").fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, folder).select("symbol", "seq", "x", "z").orderBy("seq").collect()]
    assert str(got) == str(want) and got[1][2] == -math.inf


def test_flagship(spark):
    assert catalog.flagship(spark, SMALL).count() > 0
