"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to Spark's noop sink, so all its rows and columns are
computed; the first run warms up, the better of the next two counts.  After them, one
symbol of LONG ticks is timed, once each, at which the work and not the start dominates.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tickloom.operators import bars, features
from tickloom.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Ticks to bars, bar merges, features, labels, joins on time, ledgers, statistics, searches.
HEADLINES = (
    "bars_hourly", "bars_wide", "bars_from_partials", "tick_repair", "features_quote", "features_returns", "features_levels", "features_recursive", "window_samples", "triple_barrier",
    "leader_panel", "as_of_leader", "ticks_in_gaps", "momentum_rule_stats", "cooldown_trades", "trade_statistics", "shift_controls", "grid_search", "hypothesis_families", "chart_signals",
)


#: Ticks of the long series.
LONG = int(os.environ.get("BENCH_LONG", "4000000"))


def long_series(spark: SparkSession, folder: str) -> dict:
    """Seconds and ticks a second for one long symbol: hourly bars, and all features."""
    noise = lambda k: f"pmod(xxhash64(id, {k}), 1000)"
    ticks = spark.range(LONG).selectExpr("'X' AS symbol", "id AS seq", f"1700000000000 + id * 500 + {noise(1)} DIV 4 AS time_ms", f"2000 + sin(id / 5000) * 5 + {noise(2)} / 50000 AS mid", f"1D + {noise(3)} AS ask_vol", f"1D + {noise(4)} AS bid_vol")
    ticks.selectExpr("*", "mid + 0.02 AS ask", "mid - 0.02 AS bid").write.parquet(f"{folder}/long")
    out = {"ticks": LONG}
    for name, make in (("bars", lambda d: bars.bars(d, 3_600_000)), ("features", features.tick_features)):
        began = time.perf_counter()
        make(spark.read.parquet(f"{folder}/long")).write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - began, 2)
        out[f"{name}_ticks_per_sec"] = round(LONG / out[name])
    return out


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", folder)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds = catalog.queries(), {}
    for name in sys.argv[1:] or HEADLINES:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs[1:]), 3)
    ticks = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0), "ticks": ticks, "bars_ticks_per_sec": round(ticks / seconds.get("bars_hourly", float("inf"))), "long": long_series(spark, folder)}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
