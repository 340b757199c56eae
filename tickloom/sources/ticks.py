"""Quote ticks: their schema, scans, checks at the scan, and the adapter from the `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

TICK = T.StructType(
    [
        T.StructField("ask", T.DoubleType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("mid", T.DoubleType()),
        T.StructField("ask_vol", T.FloatType()),
        T.StructField("bid_vol", T.FloatType()),
        T.StructField("time", T.LongType()),
    ]
)
#: Plausible times: 2000-01-01 up to 2100-01-01, in milliseconds.
FIRST_MS, LAST_MS = 946_684_800_000, 4_102_444_800_000
#: The order of ticks: time, and the sequence number among equal times.
ORDER = ("time_ms", "seq")


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy(*ORDER)


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts.cast("timestamp_ntz")) / F.lit(1000)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Tick files with their declared schema; only the columns used are read."""
    return spark.read.schema(TICK).parquet(path)


def events_as_ticks(events: DataFrame) -> DataFrame:
    """symbol, seq, time_ms, ask, bid, mid, ask_vol, bid_vol from events: the value is the mid price, k of props the half spread and the volumes."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("seq"),
        F.floor(millis(F.col("ts"))).cast("long").alias("time_ms"),
        (F.col("value") * (1 + k / 1e5)).alias("ask"),
        (F.col("value") * (1 - k / 1e5)).alias("bid"),
        F.col("value").alias("mid"),
        k.cast("double").alias("ask_vol"),
        (100 - k).cast("double").alias("bid_vol"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def skip_take(df: DataFrame, skip: int, take: int, order: tuple[str, ...] = ORDER, width_ms: int = 3_600_000) -> DataFrame:
    """Rows skip+1 to skip+take in order, which begins with time_ms.

    Hours are counted first, and only those that hold wanted rows are sorted, each on its own.
    """
    hour = F.floor(F.col("time_ms") / width_ms).cast("long")
    counts = df.groupBy(hour.alias("hour")).agg(F.count("*").alias("rows"))
    # one task adds up the hours: a row for each hour of the series
    placed = counts.withColumn("at", F.sum("rows").over(Window.partitionBy().orderBy("hour")) - F.col("rows"))
    wanted = placed.filter((F.col("at") < skip + take) & (F.col("at") + F.col("rows") > skip)).select("hour", "at")
    rank = F.col("at") + F.row_number().over(Window.partitionBy("hour").orderBy(*order))
    out = df.withColumn("hour", hour).join(wanted, "hour").withColumn("_rank", rank)
    return out.filter((F.col("_rank") > skip) & (F.col("_rank") <= skip + take)).select(*df.columns)


def scan_problems(df: DataFrame) -> DataFrame:
    """Per symbol: rows, steps back in time and times out of range.  Equal times are allowed."""
    before = F.lag("time_ms").over(Window.partitionBy("symbol").orderBy("seq"))
    return df.withColumn("_before", before).groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("time_ms") < F.col("_before")).alias("steps_back"),
        F.count_if((F.col("time_ms") < FIRST_MS) | (F.col("time_ms") >= LAST_MS)).alias("out_of_range"),
    )


def checked(df: DataFrame) -> DataFrame:
    """df, failing while it runs if a time steps back or is out of range."""
    before = F.lag("time_ms").over(Window.partitionBy("symbol").orderBy("seq"))
    good = (F.coalesce(before, F.col("time_ms")) <= F.col("time_ms")) & (F.col("time_ms") >= FIRST_MS) & (F.col("time_ms") < LAST_MS)
    return df.withColumn("_before", before).withColumn("time_ms", F.when(good, F.col("time_ms")).otherwise(F.raise_error(F.lit("tick times step back or are out of range")))).drop("_before")


def with_source_group(df: DataFrame, rows: int) -> DataFrame:
    """source_group: the number of the block of `rows` sequence numbers a tick comes from."""
    return df.withColumn("source_group", F.floor(F.col("seq") / rows).cast("long"))


def with_file(df: DataFrame) -> DataFrame:
    """source_file of rows just read from files."""
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def with_halo(df: DataFrame, width_ms: int, before: int, after: int = 0) -> DataFrame:
    """A long series cut into time ranges that can be windowed on their own.

    Adds `range` and `inside`.  Every range also gets up to `before` rows ahead of it
    and `after` rows behind it (inside false), so row frames that short see the same
    rows as in the whole series.  Filter inside afterwards.  Each range finds its
    neighbours from counts per range, not from one sort of the series; so `before`
    and `after` may span several sparse ranges.
    """
    own = df.withColumn("range", F.floor(F.col("time_ms") / width_ms).cast("long"))
    counts = own.groupBy("symbol", "range").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("symbol").orderBy("range")
    totals = counts.select("symbol", "range", "rows", (F.sum("rows").over(order) - F.col("rows")).alias("at"))
    ranked = own.join(totals, ["symbol", "range"]).withColumn("_rn", F.col("at") + F.row_number().over(Window.partitionBy("symbol", "range").orderBy(*ORDER)) - 1)
    wanted = totals.select("symbol", F.col("range").alias("to"), F.col("at").alias("low"), (F.col("at") + F.col("rows")).alias("high"))
    # which ranges lend rows to which: few, found on the counts alone
    lends = totals.alias("a").join(wanted.alias("b"), (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.at") + F.col("a.rows") > F.col("b.low") - before) & (F.col("a.at") < F.col("b.high") + after)).select("a.symbol", "a.range", "b.to", "b.low", "b.high")
    out = ranked.drop("at", "rows").join(lends, ["symbol", "range"]).filter((F.col("_rn") >= F.col("low") - before) & (F.col("_rn") < F.col("high") + after))
    return out.withColumn("inside", (F.col("_rn") >= F.col("low")) & (F.col("_rn") < F.col("high"))).drop("range", "_rn", "low", "high").withColumnRenamed("to", "range")


def in_chunks(df: DataFrame, before: int, rows: int = 1 << 15, width_ms: int = 3_600_000, turns: bool = False) -> DataFrame:
    """Series cut into chunks of about `rows` ticks, each with at least `before` ticks ahead of it.

    Adds chunk, inside (false for the ticks lent from before) and rows_before (how many
    ticks of the symbol stand before the first one of this chunk, lent ones included).
    Partition windows by symbol and chunk and keep the rows that are inside: row frames
    of up to `before` see what they see in the whole series.

    Chunks are made of whole hours (width_ms), so the ticks are neither sorted nor
    numbered for it: the hours are counted, the counts place and lend the hours, and the
    ticks are moved once, for the windows.  With `turns` the lent hours also reach back
    to one in which mid has certainly moved both up and down, so that the last
    direction, and where its run began, lie inside too (or the series begins there).
    """
    hour = F.floor(F.col("time_ms") / width_ms).cast("long")
    when = F.struct(*ORDER)
    ends = [F.min_by("mid", when).alias("a"), F.max_by("mid", when).alias("z"), F.min("mid").alias("low"), F.max("mid").alias("high")] if turns else []
    counts = df.groupBy("symbol", hour.alias("hour")).agg(F.count("*").alias("ticks"), *ends)
    order = Window.partitionBy("symbol").orderBy("hour")
    turned = (F.col("high") > F.greatest("a", "z")) | (F.col("low") < F.least("a", "z")) if turns else F.lit(True)
    hours = counts.withColumns({"at": F.sum("ticks").over(order) - F.col("ticks"), "k": F.row_number().over(order)})
    # the last hour before each one that a chunk which needs its first tick may start from
    hours = hours.withColumn("from_k", F.max(F.when(turned, F.col("k"))).over(order.rowsBetween(Window.unboundedPreceding, -1)) if turns else F.col("k"))
    hours = hours.select("symbol", "hour", "k", "at", F.coalesce("from_k", F.lit(1)).alias("from_k"), F.floor(F.col("at") / rows).cast("long").alias("chunk"))
    # a chunk asks for the hour that holds the tick `before` ahead of its first
    asks = hours.groupBy("symbol", "chunk").agg(F.min("at").alias("at"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))
    asks = asks.select("symbol", "chunk", "first_k", "last_k", F.greatest(F.col("at") - before, F.lit(0)).alias("at"))
    both = hours.select("symbol", "at", "from_k").unionByName(asks, allowMissingColumns=True)
    found = F.last("from_k", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("at", F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    spans = both.withColumn("low_k", found).filter("chunk is not null").select("symbol", "chunk", "first_k", F.explode(F.sequence(F.least("low_k", "first_k"), F.col("last_k"))).alias("k"))
    placed = spans.join(hours.select("symbol", "hour", "k", "at"), ["symbol", "k"])
    placed = placed.select("symbol", "hour", "chunk", (F.col("k") >= F.col("first_k")).alias("inside"), F.min("at").over(Window.partitionBy("symbol", "chunk")).alias("rows_before"))
    return df.withColumn("hour", hour).join(placed, ["symbol", "hour"]).drop("hour")
