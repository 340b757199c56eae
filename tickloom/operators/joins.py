"""Joins on the time axis and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def panel(leaders: DataFrame, target: DataFrame, time: str = "bucket_ms") -> DataFrame:
    """Leader closes in wide form, joined to the target's bars of the same time."""
    return target.join(wide(leaders, time), time)


def wide(leaders: DataFrame, time: str = "bucket_ms", symbols: Sequence[str] | None = None) -> DataFrame:
    """One row for each time and one close column for each symbol; without symbols they are looked up first."""
    grouped = leaders.groupBy(time)
    return (grouped.pivot("symbol", list(symbols)) if symbols else grouped.pivot("symbol")).agg(F.first("close"))


def long_closes(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of (time, symbol, close) in one, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def filled_forward(df: DataFrame, columns: Sequence[str], order: str, limit: int, key: str | None = None) -> DataFrame:
    """Nulls take the last value at most `limit` rows back."""
    window = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(order).rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})


def inside_intervals(points: DataFrame, intervals: DataFrame, time: str = "time_ms", width_ms: int = 3_600_000, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Points in half-open intervals [start_ms, end_ms): an equi-join on the hours touched, then the exact test."""
    hours = intervals.withColumn("_hour", F.explode(F.sequence(F.floor(F.col("start_ms") / width_ms), F.floor((F.col("end_ms") - 1) / width_ms))))
    dated = points.withColumn("_hour", F.floor(F.col(time) / width_ms))
    return dated.join(hours, [*keys, "_hour"]).filter((F.col(time) >= F.col("start_ms")) & (F.col(time) < F.col("end_ms"))).drop("_hour")


def as_of(left: DataFrame, right: DataFrame, value: str, time: str = "time_ms", key: str = "symbol", tolerance_ms: int | None = None) -> DataFrame:
    """Each left row with the last right value at or before its time: one union and one running last, no range join."""
    l, r = left.withColumn("_side", F.lit(1)), right.select(key, time, F.col(value).alias(f"_{value}")).withColumn("_side", F.lit(0))  # noqa: E741
    both = r.withColumn("_t", F.col(time)).unionByName(l, allowMissingColumns=True)
    over = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found, since = F.last(F.col(f"_{value}"), ignorenulls=True).over(over), F.last("_t", ignorenulls=True).over(over)
    out = both.withColumns({value: found, "_since": since}).filter("_side = 1")
    if tolerance_ms is not None:
        out = out.withColumn(value, F.when(F.col(time) - F.col("_since") <= tolerance_ms, F.col(value)))
    return out.select(*left.columns, value)


def previous_session(bars: DataFrame, minute: Column, date: Column, start: int, end: int, prefix: str, key: str = "symbol") -> DataFrame:
    """High and low of the session before each bar's own, by session date; a session may pass midnight.

    By windows over session dates, so the bars are used once.
    """
    over_night = start >= end
    active = ((minute >= start) | (minute < end)) if over_night else ((minute >= start) & (minute < end))
    own = F.when(minute >= start, date).otherwise(F.date_sub(date, 1)) if over_night else date
    inside = F.when(active, F.struct(F.col("high").alias("h"), F.col("low").alias("l")))
    dated = bars.withColumns({"_day": F.unix_date(own), "_in": inside})
    session = Window.partitionBy(key, "_day")
    level = F.when(F.count("_in").over(session) > 0, F.struct(F.max("_in.h").over(session).alias("h"), F.min("_in.l").over(session).alias("l")))
    before = F.last("_level", ignorenulls=True).over(Window.partitionBy(key).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1))
    out = dated.withColumn("_level", level).withColumn("_before", F.when(F.col("_level").isNotNull(), before))
    return out.withColumns({f"{prefix}_prev_high": F.col("_before.h"), f"{prefix}_prev_low": F.col("_before.l")}).drop("_day", "_in", "_level", "_before")


def first_known(*columns: str) -> Column:
    """Precedence among sources: the first that isn't null."""
    return F.coalesce(*columns)


def merged_by_priority(frames: Sequence[tuple[DataFrame, dict]], keys: Sequence[str]) -> DataFrame:
    """Frames in falling priority, united by name with defaults for missing columns; one row for each key."""
    out = None
    for rank, (df, defaults) in enumerate(frames):
        df = df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns}).withColumn("_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))
    return out.withColumn("_first", first).filter("_first = 1").drop("_first", "_rank")


def grid(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All combinations of small parameter tables."""
    for df in more:
        first = first.join(F.broadcast(df), how="cross")
    return first


def pairs_of(rows: DataFrame, order: str, differs: str, columns: Sequence[str]) -> DataFrame:
    """Pairs of a short list, each once, whose `differs` isn't the same."""
    a, b = rows.select(*[F.col(c).alias(f"{c}_a") for c in columns]), rows.select(*[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(F.broadcast(b), (F.col(f"{order}_a") < F.col(f"{order}_b")) & (F.col(f"{differs}_a") != F.col(f"{differs}_b")))


def leave_one_out(rows: DataFrame, model: str, sums: dict[str, Column]) -> DataFrame:
    """Sums over the rows of all other models, for each model left out: the totals less its own; a model alone gives no row.

    No row is copied.  sums are by name; a mean is the quotient of two of them.
    """
    own = rows.groupBy(F.col(model).alias("left_out")).agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in sums.items()))
    whole = own.agg(*(F.sum(n).alias(f"_{n}") for n in ("rows", *sums)))  # one row
    return own.join(F.broadcast(whole)).filter("_rows > rows").select("left_out", *((F.col(f"_{n}") - F.col(n)).alias(n) for n in ("rows", *sums)))


def common_to(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_semi")


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


def unique_matches(rows: DataFrame, archive: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Groups of rows that match the archive by their fingerprint with exactly one value of `group`."""
    found = rows.join(archive, list(keys))
    return found.groupBy(group).agg(F.count("*").alias("matches"), F.countDistinct("archive_id").alias("archives"), F.min("archive_id").alias("archive_id")).filter("archives = 1").drop("archives")


def overridden(rows: DataFrame, overrides: Sequence[DataFrame], key: str, column: str) -> DataFrame:
    """column replaced by the last override that has the key; source tells which one (0: none)."""
    out = rows.withColumn("source", F.lit(0))
    for n, df in enumerate(overrides, 1):
        out = out.join(df.select(key, F.col(column).alias("_new")), key, "left").withColumns({"source": F.when(F.col("_new").isNotNull(), n).otherwise(F.col("source")), column: F.coalesce("_new", column)}).drop("_new")
    return out
