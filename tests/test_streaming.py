"""Streams over event files give what the batch operators give."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from settings import SMALL
from tickloom.operators import bars as b
from tickloom.operators import simulate
from tickloom.plans import catalog
from tickloom.sources import ticks as t
from tickloom.streaming import bars, stateful


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in four files, in the order of time."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    for k in range(4):
        e.filter(F.col("event_id").between(k * 250, k * 250 + 249)).coalesce(1).write.mode("append").parquet(path)
    return path


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_bars_of_a_stream(spark, folder, tmp_path):
    stream = bars.streaming_bars(bars.event_stream(spark, folder, 4), "1 day")
    q = bars.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = b.bars(t.ticks(spark, SMALL), 86_400_000)
    joined = got.withColumn("bucket_ms", F.unix_millis("start")).alias("s").join(batch.alias("b"), ["symbol", "bucket_ms"])
    assert got.count() > 50 and joined.count() == got.count()
    assert joined.filter("s.close != b.close or s.ticks != b.ticks or s.open != b.open").count() == 0


def test_windows_sessions_and_batches(spark, folder, tmp_path):
    run(bars.sliding_means(bars.event_stream(spark, folder, 4), "2 days", "1 day"), "slides")
    run(bars.streaming_sessions(bars.event_stream(spark, folder, 4), "12 hours"), "sessions")
    assert spark.table("slides").count() > 0 and spark.table("sessions").agg(F.sum("ticks")).first()[0] > 0
    seen = []
    q = bars.each_batch(bars.streaming_bars(bars.event_stream(spark, folder, 4), "1 day"), str(tmp_path / "cp2"), lambda df, k: seen.append((k, df.count())))
    q.awaitTermination()
    assert sum(n for _, n in seen) > 0


def test_state_carries_over_batches(spark, folder):
    run(stateful.streaming_ema(bars.event_stream(spark, folder), (16,)), "emas")
    got = spark.table("emas").orderBy("symbol", "seq").toPandas()
    for symbol, own in t.ticks(spark, SMALL).orderBy("time_ms").toPandas().groupby("symbol"):
        y, want = own.mid.iloc[0], []
        for m in own.mid:
            y += 2 / 17 * (m - y)
            want.append(y)
        mine = got[got.symbol == symbol].set_index("seq").loc[own.seq]
        assert np.allclose(mine.ema_16, want)


def test_drained_means_come_from_files_in_order(spark, tmp_path):
    """Later events in the first file: the batch puts them in order, and the rows don't pass the driver."""
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    for part in ("event_id % 2 = 1", "event_id % 2 = 0"):
        e.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    out = catalog.queries()["stream_means"](spark, str(tmp_path))
    assert out.inputFiles()
    got = {(r["symbol"], r["seq"]): r["ema_16"] for r in out.collect()}
    assert len(got) == e.count()
    for symbol, own in t.ticks(spark, SMALL).orderBy("time_ms", "seq").toPandas().groupby("symbol"):
        y = own.mid.iloc[0]
        for seq, m in zip(own.seq, own.mid, strict=True):
            y += 2 / 17 * (m - y)
            assert abs(got[symbol, seq] - y) < 1e-6


def test_count_windows_and_levels(spark, folder, tmp_path):
    run(stateful.streaming_count_windows(bars.event_stream(spark, folder), 16), "counted")
    n = t.ticks(spark, SMALL).groupBy("symbol").count().agg(F.sum(F.floor(F.col("count") / 16))).first()[0]
    assert spark.table("counted").count() == n
    batch = b.bars(t.ticks(spark, SMALL), 86_400_000)
    path = str(tmp_path / "bars")
    batch.repartitionByRange(3, "bucket_ms").write.parquet(path)
    whole = simulate.level_context(batch, 0.5).filter("support is not null").count()
    stream = spark.readStream.schema(batch.schema).parquet(path)
    run(stateful.streaming_levels(stream, 0.5), "levels")
    assert spark.table("levels").filter("support is not null").count() == whole
