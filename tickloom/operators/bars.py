"""Bars: tumbling windows over ticks, their roll-up, gaps and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bucket(time: Column, width_ms: int) -> Column:
    return F.floor(time / width_ms).cast("long") * F.lit(width_ms)


def bars(ticks: DataFrame, width_ms: int, seqs: bool = False) -> DataFrame:
    """OHLC of the mid, mean spread, volumes and tick count; buckets without ticks are left out.

    First and last are by (time, seq), so partial aggregation combines them in any order.
    With seqs also first_seq and last_seq, theirs, by which merged_bars() orders parts
    whose first or last ticks share a time.
    """
    when = F.struct("time_ms", "seq")
    extra = [F.min_by("seq", when).alias("first_seq"), F.max_by("seq", when).alias("last_seq")] if seqs else []
    return ticks.groupBy("symbol", bucket(F.col("time_ms"), width_ms).alias("bucket_ms")).agg(
        F.min_by("mid", when).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", when).alias("close"),
        F.avg(F.col("ask") - F.col("bid")).alias("spread"),
        F.sum("ask_vol").alias("ask_vol"),
        F.sum("bid_vol").alias("bid_vol"),
        F.count("*").alias("ticks"),
        F.min("time_ms").alias("first_tick_ms"),
        F.max("time_ms").alias("last_tick_ms"),
        *extra,
    )


PRICES = ("bid", "ask", "mid", "spread")


def wide_bars(ticks: DataFrame, width_ms: int = 60_000) -> DataFrame:
    """Bars with OHLC of bid, ask, mid and spread, volume means, and gaps before and inside the bar.

    Where ticks carry source_group and wrapped, their changes are counted too.
    """
    order = Window.partitionBy("symbol").orderBy("time_ms", "seq")
    out = ticks.withColumns({"spread": F.col("ask") - F.col("bid"), "_gap": F.col("time_ms") - F.lag("time_ms").over(order)})
    extra = []
    if "source_group" in ticks.columns:
        out = out.withColumn("_changed", F.coalesce((F.col("source_group") != F.lag("source_group").over(order)).cast("int"), F.lit(0)))
        extra.append(F.sum("_changed").cast("long").alias("source_boundary_count"))
    if "wrapped" in ticks.columns:
        extra.append(F.sum(F.col("wrapped").cast("int")).cast("long").alias("raw_clock_wrap_count"))
    when = F.struct("time_ms", "seq")
    prices = [f(c, *a).alias(f"{c}_{n}") for c in PRICES for n, f, a in (("open", F.min_by, (when,)), ("high", F.max, ()), ("low", F.min, ()), ("close", F.max_by, (when,)))]
    made = out.groupBy("symbol", bucket(F.col("time_ms"), width_ms).alias("bucket_ms")).agg(
        F.min("time_ms").alias("first_tick_ms"), F.max("time_ms").alias("last_tick_ms"), F.max("_gap").alias("max_tick_gap_ms"), F.count("*").alias("tick_count"), *extra, *prices,
        F.avg("spread").alias("spread_mean"), F.avg("bid_vol").alias("bid_vol_mean"), F.avg("ask_vol").alias("ask_vol_mean"),
    )
    by_bar = Window.partitionBy("symbol").orderBy("bucket_ms")
    return made.withColumns({"bar_index": (F.row_number().over(by_bar) - 1).cast("long"), "gap_before_ms": F.col("first_tick_ms") - F.lag("last_tick_ms").over(by_bar)})


def merged_bars(partial: DataFrame, flags_all: tuple[str, ...] = (), flags_any: tuple[str, ...] = ()) -> DataFrame:
    """Partial bars of one bucket as one: first open, extremes, last close, means weighted by ticks.

    With first_seq and last_seq, first and last are those of the ticks in order; without
    them parts that share a time come in any order.
    """
    seqs = "first_seq" in partial.columns and "last_seq" in partial.columns
    first, last = (F.struct(f"{x}_tick_ms", *([f"{x}_seq"] if seqs else [])) for x in ("first", "last"))
    extra = [F.min_by("first_seq", first).alias("first_seq"), F.max_by("last_seq", last).alias("last_seq")] if seqs else []
    mean = lambda c: (F.sum(F.col(c) * F.col("ticks")) / F.sum("ticks")).alias(c)
    return partial.groupBy("symbol", "bucket_ms").agg(
        F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", last).alias("close"), mean("spread"),
        F.sum("ask_vol").alias("ask_vol"), F.sum("bid_vol").alias("bid_vol"), F.sum("ticks").alias("ticks"), F.min("first_tick_ms").alias("first_tick_ms"), F.max("last_tick_ms").alias("last_tick_ms"),
        F.count("*").alias("parts"), *extra, *(F.bool_and(c).alias(c) for c in flags_all), *(F.bool_or(c).alias(c) for c in flags_any),
    )


def rolled_up(bars: DataFrame, width_ms: int, weighted: bool = True) -> DataFrame:
    """Bars of a larger width from smaller ones; unweighted, the spread is the mean of the bars' means."""
    spread = F.sum(F.col("spread") * F.col("ticks")) / F.sum("ticks") if weighted else F.avg("spread")
    return bars.groupBy("symbol", bucket(F.col("bucket_ms"), width_ms).alias("bucket_ms")).agg(
        F.min_by("open", "bucket_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket_ms").alias("close"), spread.alias("spread"),
        F.sum("ask_vol").alias("ask_vol"), F.sum("bid_vol").alias("bid_vol"), F.sum("ticks").alias("ticks"), F.min("first_tick_ms").alias("first_tick_ms"), F.max("last_tick_ms").alias("last_tick_ms"),
    )


def with_gaps(bars: DataFrame, width_ms: int) -> DataFrame:
    """gap_before_ms (start to start) and missing_ms (whole buckets left out before a bar)."""
    gap = F.col("bucket_ms") - F.lag("bucket_ms").over(Window.partitionBy("symbol").orderBy("bucket_ms"))
    return bars.withColumns({"gap_before_ms": gap, "missing_ms": F.greatest(gap - width_ms, F.lit(0))})


def missing_intervals(bars: DataFrame, width_ms: int, core_weekdays: bool = False) -> DataFrame:
    """Half-open intervals [start_ms, end_ms) without bars; with core_weekdays only those of an hour or more inside one weekday."""
    out = with_gaps(bars, width_ms).filter("missing_ms > 0").select("symbol", (F.col("bucket_ms") - F.col("missing_ms")).alias("start_ms"), F.col("bucket_ms").alias("end_ms"))
    if core_weekdays:
        day = lambda c: F.floor(F.col(c) / 86_400_000)
        weekday = F.pmod(day("start_ms") + 3, F.lit(7))  # 1970-01-01 was a Thursday; Monday is 0
        out = out.filter((day("start_ms") == day("end_ms")) & (weekday < 5) & (F.col("end_ms") - F.col("start_ms") >= 3_600_000))
    return out


def hours_of(intervals: DataFrame) -> DataFrame:
    """A row for each hour that an interval touches."""
    hour = 3_600_000
    first, last = bucket(F.col("start_ms"), hour), bucket(F.col("end_ms") - 1, hour)
    return intervals.withColumn("hour_ms", F.explode(F.sequence(first, last, F.lit(hour).cast("long"))))


def calendar_filled(daily: DataFrame, day: str, value: str, *keys: str) -> DataFrame:
    """One row for each day from a key's first to its last, value 0 where there was none."""
    span = daily.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).withColumn(day, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    return span.join(daily, [*keys, day], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def elapsed_cascade(ticks: DataFrame, widths_ms: tuple[int, ...] = (1_000, 60_000, 300_000, 3_600_000)) -> DataFrame:
    """Candles that close once their width has passed since their own first tick, at several widths at once.

    Not aligned to the clock: where a candle starts depends on where the one before
    ended, so a symbol is walked in order, one task for each.
    """
    import pandas as pd

    def walk(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["time_ms", "seq"])
        rows = []
        for width in widths_ms:
            time, mid, vol = df.time_ms.to_numpy(), df.mid.to_numpy(), (df.ask_vol + df.bid_vol).to_numpy()
            at = 0
            while at < len(time):
                end = int(time.searchsorted(time[at] + width))
                end = max(end, at + 1)
                part = mid[at:end]
                rows.append((df.symbol.iloc[0], width, int(time[at]), float(part[0]), float(part.max()), float(part.min()), float(part[-1]), float(vol[at:end].sum()), end - at))
                at = end
        return pd.DataFrame(rows, columns=["symbol", "width_ms", "start_ms", "open", "high", "low", "close", "volume", "ticks"])

    return ticks.select("symbol", "seq", "time_ms", "mid", "ask_vol", "bid_vol").groupBy("symbol").applyInPandas(walk, "symbol string, width_ms long, start_ms long, open double, high double, low double, close double, volume double, ticks long")


def cycle_scores(groups: DataFrame, reference: DataFrame, cycles: int, cycle_ms: int = 1 << 32) -> DataFrame:
    """For each source group and each number of clock turns: mean distance of its prices from a daily reference.

    groups: source_group, clock_ms, price; reference: day, price.  Gives the best and the
    second best cycle and the margin between their scores.
    """
    moved = groups.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    dated = moved.withColumn("day", F.floor((F.col("clock_ms") + F.col("cycle").cast("long") * F.lit(cycle_ms).cast("long")) / 86_400_000).cast("long"))
    scored = dated.join(reference.select("day", F.col("price").alias("expected")), "day").groupBy("source_group", "cycle").agg(F.avg(F.abs(F.col("price") / F.col("expected") - 1)).alias("score"), F.count("*").alias("days"))
    rank = F.row_number().over(Window.partitionBy("source_group").orderBy("score", "cycle"))
    top = scored.withColumn("rank", rank).filter("rank <= 2").groupBy("source_group").agg(
        F.max(F.when(F.col("rank") == 1, F.col("cycle"))).alias("cycle"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score")
    )
    return top.withColumn("margin", F.col("second_score") - F.col("score"))


def evenly_spaced(df: DataFrame, key: str, order: tuple[str, ...], most: int = 301) -> DataFrame:
    """At most `most` rows of each key, evenly spaced, first and last among them."""
    whole = Window.partitionBy(key)
    out = df.withColumns({"_i": F.row_number().over(whole.orderBy(*order)) - 1, "_n": F.count("*").over(whole)})
    step = F.greatest(F.col("_n") - 1, F.lit(1)) / (most - 1)
    # the row is taken if a multiple of step, rounded down, falls on it
    taken = F.floor(F.ceil(F.col("_i") / step) * step) == F.col("_i")
    return out.filter((F.col("_n") <= most) | taken).drop("_i", "_n")
