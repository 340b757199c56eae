"""Synthetic ticks: driftless random walks, and block-resampled returns of real ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.operators.resample import unit


def random_walk(spark: SparkSession, rows: int, seed: int, volatility: float = 1.2e-5, spread: float = 1e-4, start: float = 2000.0, series: int = 1) -> DataFrame:
    """Driftless geometric walks of quotes 100 ms apart, `series` of them with `rows` ticks each."""
    ids = spark.range(rows * series).select(F.concat(F.lit("null_"), F.floor(F.col("id") / rows).cast("string")).alias("symbol"), F.pmod("id", F.lit(rows)).alias("seq"))
    u, v = F.greatest(unit("symbol", "seq", F.lit(seed)), F.lit(1e-12)), unit("symbol", "seq", F.lit(seed + 1))
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)
    walk = F.sum("_s").over(Window.partitionBy("symbol").orderBy("seq"))
    out = ids.withColumn("_s", normal * volatility - volatility * volatility / 2).withColumn("mid", start * F.exp(walk))
    half = F.col("mid") * (spread / 2)
    return out.select("symbol", "seq", (F.lit(1_704_067_200_000) + F.col("seq") * 100).alias("time_ms"), (F.col("mid") + half).alias("ask"), (F.col("mid") - half).alias("bid"), "mid", F.lit(1.0).alias("ask_vol"), F.lit(1.0).alias("bid_vol"))


def block_resampled(ticks: DataFrame, block: int, seed: int) -> DataFrame:
    """Ticks whose log returns come from blocks of the real ones in another order: blocks are drawn with replacement."""
    w = Window.partitionBy("symbol").orderBy("time_ms", "seq")
    real = ticks.withColumns({"pos": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("symbol")), "ret": F.coalesce(F.log("mid") - F.log(F.lag("mid").over(w)), F.lit(0.0)), "first": F.first("mid").over(w)})
    source = F.pmod(F.floor(unit("symbol", F.floor(F.col("pos") / block), F.lit(seed)) * F.col("n")) + F.pmod("pos", F.lit(block)), F.col("n"))
    drawn = real.withColumn("_from", source).join(real.select("symbol", F.col("pos").alias("_from"), F.col("ret").alias("_ret")), ["symbol", "_from"])
    walk = F.sum("_ret").over(Window.partitionBy("symbol").orderBy("pos"))
    return drawn.withColumn("mid", F.col("first") * F.exp(walk)).select("symbol", "seq", "time_ms", "mid")
