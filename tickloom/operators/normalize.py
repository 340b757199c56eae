"""Standardising columns: on all rows so far, or by statistics of a training prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def expanding_z(df: DataFrame, columns: Sequence[str], key: str, order: Sequence[str], least_var: float = 1e-8) -> DataFrame:
    """z of each column by mean and sample variance of all rows up to its own; unit scale while the variance is tiny."""
    over = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = {}
    for c in columns:
        var = F.coalesce(F.var_samp(c).over(over), F.lit(0.0))
        made[f"{c}_z"] = (F.col(c) - F.avg(c).over(over)) / F.when(var > least_var, F.sqrt(var)).otherwise(1.0)
    return df.withColumns(made)


def prefix_stats(df: DataFrame, columns: Sequence[str], prefix: Column, seed: float = 1.0) -> DataFrame:
    """One row: <c>_mean and <c>_sd over the rows where prefix holds, sd = sqrt((seed + SS) / n + 1e-8).

    seed 1 is what a sum of squares started at 1 gives; 0 is the population sd.
    """
    kept = df.filter(prefix)
    aggs = []
    for c in columns:
        ss = F.var_pop(c) * F.count(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.sqrt((seed + ss) / F.count(c) + 1e-8).alias(f"{c}_sd")]
    return kept.agg(*aggs)


def standardised(df: DataFrame, columns: Sequence[str], stats: DataFrame, clip: float = 8.0) -> DataFrame:
    """Columns as clipped z by stats, which is one row."""
    out = df.join(F.broadcast(stats), how="cross")
    z = lambda c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")))
    return out.withColumns({f"{c}_z": z(c) for c in columns}).drop(*stats.columns)


def frozen_after(df: DataFrame, columns: Sequence[str], key: str, order: Sequence[str], rows: int) -> DataFrame:
    """As expanding_z, but statistics stop growing after the first `rows` rows of a key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    over = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out, made = df.withColumn("_n", n), {}
    for c in columns:
        own = F.when(F.col("_n") <= rows, F.col(c))
        var = F.coalesce(F.var_samp(own).over(over), F.lit(0.0))
        made[f"{c}_z"] = (F.col(c) - F.avg(own).over(over)) / F.when(var > 1e-8, F.sqrt(var)).otherwise(1.0)
    return out.withColumns(made).drop("_n")
