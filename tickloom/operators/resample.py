"""Bootstraps, permutations and shifts: seeded by hashes, so a trial's draws don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def unit(*keys: Column | str) -> Column:
    """A number in [0, 1) that the keys decide."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)


def numbered(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """pos (from 0) and n of each row within its key."""
    whole = Window.partitionBy(*key)
    return rows.withColumns({"pos": (F.row_number().over(whole.orderBy(*order)) - 1).cast("long"), "n": F.count("*").over(whole)})


def bootstrap_sums(rows: DataFrame, key: Sequence[str], pnl: str, trials: int, seed: int) -> DataFrame:
    """Sum of each trial in which every row counts a Poisson(1) number of times.

    The Poisson bootstrap needs no draw to see another row, so trials are a partial
    aggregate; it agrees with drawing n of n as n grows.
    """
    trial = F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))
    drawn = rows.withColumn("trial", trial).withColumn("_u", unit("trial", "pos", F.lit(seed)))
    # inverse of the Poisson(1) distribution function, up to 8
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(9):
        total += term
        steps.append(total)
        term /= k + 1
    times = sum((F.when(F.col("_u") >= s, 1).otherwise(0) for s in steps), F.lit(0))
    return drawn.groupBy(*key, "trial").agg(F.sum(F.col(pnl) * times).alias("total"))


def block_bootstrap_sums(rows: DataFrame, key: Sequence[str], pnl: str, block: int, trials: int, seed: int) -> DataFrame:
    """Sum of each trial made of circular blocks: a trial's block is a difference of running sums, so no row is copied.

    rows must be numbered().  Each trial takes ceil(n / block) starts; the last block is cut to length.
    """
    run = rows.withColumn("_cum", F.sum(pnl).over(Window.partitionBy(*key).orderBy("pos")))
    ends = run.select(*key, (F.col("pos") + 1).alias("_at"), F.col("_cum"))
    sizes = rows.groupBy(*key).agg(F.max("n").alias("n"), F.sum(pnl).alias("_all"))
    starts = sizes.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1)))
    starts = starts.withColumns({"_a": F.floor(unit("trial", "j", F.lit(seed)) * F.col("n")).cast("long"), "_len": F.least(F.lit(block), F.col("n") - F.col("j") * block)})
    starts = starts.withColumns({"_b": F.pmod(F.col("_a") + F.col("_len"), F.col("n")), "_turn": F.floor((F.col("_a") + F.col("_len")) / F.col("n"))})
    left, right = ends.withColumnsRenamed({"_at": "_a", "_cum": "_ca"}), ends.withColumnsRenamed({"_at": "_b", "_cum": "_cb"})
    both = starts.join(left, [*key, "_a"], "left").join(right, [*key, "_b"], "left")
    part = F.coalesce("_cb", F.lit(0.0)) - F.coalesce("_ca", F.lit(0.0)) + F.col("_turn") * F.col("_all")
    return both.groupBy(*key, "trial").agg(F.sum(part).alias("total"))


def quantiles(trials: DataFrame, key: Sequence[str], value: str = "total", qs: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    return trials.groupBy(*key).agg(F.count("*").alias("trials"), F.avg(value).alias("mean"), *(F.percentile(value, q).alias(f"q{str(q)[2:]}") for q in qs), F.avg((F.col(value) > 0).cast("double")).alias("positive"))


def rolled(rows: DataFrame, column: str, shift: int | Column, key: Sequence[str]) -> DataFrame:
    """column taken from the row `shift` places before, going round at the ends; rows must be numbered()."""
    moved = rows.select(*key, F.pmod(F.col("pos") + shift, F.col("n")).alias("pos"), F.col(column).alias(f"{column}_rolled"))
    return rows.join(moved, [*key, "pos"])


def shift_controls(rows: DataFrame, signal: str, move: str, key: Sequence[str], shifts: Sequence[int]) -> DataFrame:
    """For each shift of the signal against the moves: total result; shift 0 is the real one, with its rank in percent.

    Signals that aren't 0 are what is copied for each shift, not the moves.
    """
    signals = rows.filter(F.col(signal) != 0).withColumn("shift", F.explode(F.array(*[F.lit(s) for s in (0, *shifts)])))
    signals = signals.select(*key, "shift", F.pmod(F.col("pos") + F.col("shift"), F.col("n")).alias("pos"), signal)
    totals = signals.join(rows.select(*key, "pos", move), [*key, "pos"]).groupBy(*key, "shift").agg(F.sum(F.col(signal) * F.col(move)).alias("total"))
    real = totals.filter("shift = 0").select(*key, F.col("total").alias("real"))
    return totals.filter("shift != 0").join(real, list(key)).groupBy(*key).agg(F.first("real").alias("real"), F.count("*").alias("controls"), F.avg("total").alias("control_mean"), (100 * F.avg((F.col("total") < F.col("real")).cast("double"))).alias("rank_percent"))


def permutation_p(rows: DataFrame, label: str, value: str, key: Sequence[str], trials: int, seed: int) -> DataFrame:
    """(b + 1) / (T + 1): how often labels put in another order give as large a mean of label times value.

    A trial's order is a hash of the position; labels meet values by rank.  Work is trials times rows.
    """
    several = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials))))
    order = Window.partitionBy(*key, "trial").orderBy(F.when(F.col("trial") == 0, F.col("pos").cast("double")).otherwise(unit("trial", "pos", F.lit(seed))), "pos")
    ranked = several.withColumn("_r", F.row_number().over(order) - 1).select(*key, "trial", F.col("_r").alias("pos"), label)
    stat = ranked.join(rows.select(*key, "pos", value), [*key, "pos"]).groupBy(*key, "trial").agg(F.avg(F.col(label) * F.col(value)).alias("s"))
    real = stat.filter("trial = 0").select(*key, F.col("s").alias("real"))
    return stat.filter("trial != 0").join(real, list(key)).groupBy(*key).agg(F.first("real").alias("real"), F.count("*").alias("trials"), ((F.count_if(F.col("s") >= F.col("real")) + 1) / (F.count("*") + 1)).alias("p"))


def random_portfolios(models: DataFrame, value: str, pick: int, draws: int, seed: int) -> DataFrame:
    """Sum over `pick` models chosen at random, for each draw; models are few."""
    drawn = models.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    rank = F.row_number().over(Window.partitionBy("draw").orderBy(unit("draw", "id", F.lit(seed)), "id"))
    return drawn.withColumn("_r", rank).filter(F.col("_r") <= pick).groupBy("draw").agg(F.sum(value).alias("total"))


def walk_forward(samples: DataFrame, folds: int, window: int, horizon: int, embargo: int, key: str = "symbol", time: str = "t_index") -> DataFrame:
    """role (train, validate) of each sample in every fold: training is all before the fold's block, without samples
    that reach into it, and without `embargo` after earlier blocks.

    Block bounds are positions i*n//(folds+1); a sample meets every fold, which is a small table.
    """
    whole = Window.partitionBy(key)
    placed = samples.withColumns({"_i": F.row_number().over(whole.orderBy(time)) - 1, "_n": F.count("*").over(whole)})
    own = F.floor(((F.col("_i") + 1) * (folds + 1) - 1) / F.col("_n"))  # 0 is the first training block
    placed = placed.withColumn("_block", own)
    bounds = placed.groupBy(key, "_block").agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    starts = bounds.filter("_block > 0").select(key, F.col("_block").alias("fold"), F.col("_from").alias("val_start"))
    out = placed.join(F.broadcast(starts), key)
    after = bounds.filter("_block > 0").select(key, F.col("_block").alias("_own"), F.col("_to").alias("_prev_end"))
    out = out.join(F.broadcast(after.withColumn("_block", F.col("_own") + 1).drop("_own")), [key, "_block"], "left")
    purged = F.col(time) + window + horizon >= F.col("val_start")
    embargoed = F.coalesce((F.col("_block") < F.col("fold")) & (F.col(time) <= F.col("_prev_end") + embargo), F.lit(False))
    role = F.when(F.col("_block") == F.col("fold"), "validate").when((F.col("_block") < F.col("fold")) & ~purged & ~embargoed, "train")
    return out.withColumn("role", role).filter("role is not null").drop("_i", "_n", "_block", "_prev_end")
