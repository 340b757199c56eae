"""Checks and repairs of ticks, clocks and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.sources.ticks import by_symbol

MID_TOLERANCE = 1e-8


def problems() -> dict[str, Column]:
    """Why a tick is rejected, by reason; a tick may have several."""
    numbers = [F.col(c) for c in ("ask", "bid", "mid", "ask_vol", "bid_vol")]
    bad = F.lit(False)
    for x in numbers:
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    no = lambda x: F.coalesce(x, F.lit(False))
    return {
        "nonfinite": bad,
        "nonpositive_price": no((F.col("ask") <= 0) | (F.col("bid") <= 0) | (F.col("mid") <= 0)),
        "crossed_quote": no(F.col("bid") > F.col("ask")),
        "negative_volume": no((F.col("ask_vol") < 0) | (F.col("bid_vol") < 0)),
        "mid_mismatch": no(F.abs(F.col("mid") - (F.col("ask") + F.col("bid")) / 2) > MID_TOLERANCE),
    }


def problem_counts(ticks: DataFrame) -> DataFrame:
    """Per symbol: rows, how many have each problem, and how many none."""
    found = problems()
    any_ = F.lit(False)
    for x in found.values():
        any_ = any_ | x
    return ticks.groupBy("symbol").agg(F.count("*").alias("rows"), *(F.count_if(x).alias(name) for name, x in found.items()), F.count_if(~any_).alias("valid"))


def valid_ticks(ticks: DataFrame) -> DataFrame:
    for x in problems().values():
        ticks = ticks.filter(~x)
    return ticks


def repaired(ticks: DataFrame) -> DataFrame:
    """Ticks with bad prices replaced by the last good ones of their symbol (0 before any), the mid
    rebuilt and bad volumes 0; repaired tells which rows were changed."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    quote = good("ask") & good("bid") & (F.col("ask") > 0) & (F.col("bid") > 0) & (F.col("bid") <= F.col("ask"))
    over = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.coalesce(F.last(F.when(quote, F.col(c)), ignorenulls=True).over(over), F.lit(0.0))
    volume = lambda c: F.when(good(c) & (F.col(c) >= 0), F.col(c)).otherwise(0.0)
    bad_volume = F.coalesce(~(good("ask_vol") & (F.col("ask_vol") >= 0) & good("bid_vol") & (F.col("bid_vol") >= 0)), F.lit(True))
    out = ticks.withColumns({"_ask": carried("ask"), "_bid": carried("bid"), "repaired": ~F.coalesce(quote, F.lit(False)) | bad_volume})
    return out.withColumns({"ask": F.col("_ask"), "bid": F.col("_bid"), "mid": (F.col("_ask") + F.col("_bid")) / 2, "ask_vol": volume("ask_vol"), "bid_vol": volume("bid_vol")}).drop("_ask", "_bid")


def unwrapped_clock(df: DataFrame, group: str = "source_group", modulus: int = 1 << 32) -> DataFrame:
    """elapsed_ms from a clock that starts again at modulus: a step back where the source group changes is one turn.

    wrapped marks those rows.  A step back inside a group is no turn; clock_fault marks it.
    """
    order = Window.partitionBy("symbol").orderBy("seq")
    back = F.col("clock_ms") < F.lag("clock_ms").over(order)
    new_group = F.col(group) != F.lag(group).over(order)
    out = df.withColumns({"wrapped": F.coalesce(back & new_group, F.lit(False)), "clock_fault": F.coalesce(back & ~new_group, F.lit(False))})
    return out.withColumn("elapsed_ms", F.col("clock_ms") + F.sum(F.col("wrapped").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) * F.lit(modulus))


#: Names and lengths in milliseconds of the gaps that are counted.
GAPS = {"over_1s": 1_000, "over_1m": 60_000, "over_1h": 3_600_000, "over_1d": 86_400_000, "over_7d": 604_800_000}


def gap_counts(df: DataFrame, time: str = "time_ms") -> DataFrame:
    """Per symbol: how many gaps are longer than each of GAPS, and the longest."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy("symbol").orderBy(time))
    return df.withColumn("_gap", gap).groupBy("symbol").agg(*(F.count_if(F.col("_gap") > ms).alias(name) for name, ms in GAPS.items()), F.max("_gap").alias("max_gap_ms"))
