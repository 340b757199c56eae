"""Grid search: parameter tables joined to features, statistics of all candidates in one aggregate, gates, picks."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def parameter_table(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations of the given values; grids are data."""
    rows = list(itertools.product(*values.values()))
    return spark.createDataFrame(rows, list(values))


def melted(rows: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row for each row and feature: feature, x."""
    return rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("_m")).select(*keep, "_m.*")


def thresholds(rows: DataFrame, qs: Sequence[float], by: Sequence[str], train: Column) -> DataFrame:
    """Quantiles of |x| over the training rows: by, q, threshold."""
    found = rows.filter(train).groupBy(*by).agg(F.percentile(F.abs("x"), F.array(*[F.lit(float(q)) for q in qs])).alias("_t"))
    return found.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in qs]).alias("q"), F.col("_t").alias("t"))).alias("_z")).select(*by, F.col("_z.q").alias("q"), F.col("_z.t").alias("threshold"))


def candidate_trades(rows: DataFrame, cuts: DataFrame, modes: Sequence[str], move: str, cost: Column, by: Sequence[str]) -> DataFrame:
    """Trades of all candidates (by, q, mode): rows beyond the threshold, with or against the feature."""
    joined = rows.join(F.broadcast(cuts), list(by)).filter(F.abs(F.col("x")) > F.col("threshold")).filter(F.col(move).isNotNull())
    out = joined.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    side = F.signum("x") * F.when(F.col("mode") == "fade", -1).otherwise(1)
    return out.withColumns({"direction": side.cast("int"), "pnl": side * F.col(move) - cost})


def candidate_stats(trades: DataFrame, by: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """One row for each candidate: trades, pnl, win rate, profit factor and Sharpe in every part."""
    p = F.col("pnl")
    made = []
    for name in parts:
        own = F.when(F.col("part") == name, p)
        loss = -F.sum(F.when(own < 0, own))
        made += [F.count(own).alias(f"{name}_trades"), F.coalesce(F.sum(own), F.lit(0.0)).alias(f"{name}_pnl"), F.avg((own > 0).cast("double")).alias(f"{name}_win_rate"), F.coalesce(F.sum(F.when(own > 0, own)) / F.nullif(loss, F.lit(0.0)), F.lit(0.0)).alias(f"{name}_pf"), F.coalesce(F.avg(own) / F.nullif(F.stddev_samp(own), F.lit(0.0)) * F.sqrt(F.count(own)), F.lit(0.0)).alias(f"{name}_sharpe")]
    return trades.groupBy(*by).agg(*made)


def qualifies(parts: Sequence[str], least: int, most: int) -> Column:
    """Profit in every part and a number of trades within bounds."""
    out = F.lit(True)
    for name in parts:
        out = out & (F.col(f"{name}_pnl") > 0) & F.col(f"{name}_trades").between(least, most)
    return out


def best(candidates: DataFrame, parts: Sequence[str], n: int, ties: Sequence[str]) -> DataFrame:
    """The n candidates whose worst part has the highest Sharpe."""
    worst = F.least(*[F.col(f"{p}_sharpe") for p in parts]) if len(parts) > 1 else F.col(f"{parts[0]}_sharpe")
    return candidates.withColumn("score", worst).orderBy(F.col("score").desc_nulls_last(), *ties).limit(n)


def diversified(candidates: DataFrame, kinds: Sequence[str], score: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n best of which no two are of one kind."""
    first = F.row_number().over(Window.partitionBy(*kinds).orderBy(F.col(score).desc_nulls_last(), *ties))
    return candidates.withColumn("_f", first).filter("_f = 1").drop("_f").orderBy(F.col(score).desc_nulls_last(), *ties).limit(n)


def perturbed(parameters: DataFrame, window: str, quantile: str, horizon: str) -> DataFrame:
    """Each parameter set with its neighbours: window and horizon a fifth, quantile a tenth up and down."""
    steps = [("base", 1.0, 1.0, 1.0)]
    steps += [(f"{n}_{d}", *(f if n == m else 1.0 for m in ("window", "quantile", "horizon"))) for n, r in (("window", 0.2), ("quantile", 0.1), ("horizon", 0.2)) for d, f in (("down", 1 - r), ("up", 1 + r))]
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("change"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, a, b, c in steps]))
    out = parameters.withColumn("_s", table)
    return out.withColumns({"change": F.col("_s.change"), window: F.greatest(F.lit(1), F.round(F.col(window) * F.col("_s.a"))).cast("int"), quantile: F.least(F.lit(0.999), F.col(quantile) * F.col("_s.b")), horizon: F.greatest(F.lit(1), F.round(F.col(horizon) * F.col("_s.c"))).cast("int")}).drop("_s")


def cliff(results: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Whether a set falls off a cliff: more than half of its neighbours lose while it gains."""
    base = F.max(F.when(F.col("change") == "base", F.col(value)))
    losing = F.avg(F.when(F.col("change") != "base", (F.col(value) <= 0).cast("double")))
    return results.groupBy(*key).agg(base.alias("base"), losing.alias("losing"), F.coalesce((base > 0) & (losing > 0.5), F.lit(False)).alias("cliff"))


def decision(stats: DataFrame, t: str, n_eff: str, edge: str, q: str) -> DataFrame:
    """GO, WATCH or NO: significant after correction with enough trades and an edge; one of the two; neither."""
    sure, paid = (F.col(q) <= 0.05) & (F.col(n_eff) >= 30), (F.col(edge) > 0) & (F.col(t) > 2)
    return stats.withColumn("decision", F.when(sure & paid, "GO").when(sure | paid, "WATCH").otherwise("NO"))


def reasons(**rules: Column) -> Column:
    """Names of the rules that hold, as an array."""
    return F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in rules.items()]), lambda x: x.isNotNull())
