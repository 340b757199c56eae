"""Tick streams: bars over watermarked windows, sinks by micro-batch."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.sources.ticks import events_as_ticks

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """Ticks of event files as they arrive in a folder; `ts` is their time as a timestamp.

    bytes_per_trigger bounds a batch by the size of its files instead of their number.
    """
    most = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    raw = spark.readStream.schema(EVENTS).option(*most).parquet(path)
    return events_as_ticks(raw).withColumn("ts", F.timestamp_millis("time_ms"))


def streaming_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLC bars of a stream; ticks later than the watermark are dropped."""
    when = F.struct("time_ms", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("mid", when).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", when).alias("close"), F.avg(F.col("ask") - F.col("bid")).alias("spread"), F.count("*").alias("ticks"))
        .select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "spread", "ticks")
    )


def streaming_sessions(ticks: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs of ticks without a pause longer than gap."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("ticks"), F.min("mid").alias("low"), F.max("mid").alias("high")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks", "low", "high")


def sliding_means(ticks: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, step).alias("w")).agg(F.avg("mid").alias("mean"), F.count("*").alias("ticks")).select("symbol", F.col("w.start").alias("start"), "mean", "ticks")


def to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends finished rows as Parquet, exactly once, and stops when the input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that all executors share; it goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; its folder then stays  # noqa: BLE001
        return


def drained(stream: DataFrame) -> DataFrame:
    """What an append stream over all files there are gives in the end, through files: no row passes the driver."""
    folder = shared_folder(stream.sparkSession)
    to_parquet(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update"):
    """Start a query that hands every micro-batch and its number to write."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
