"""Statistics of trades, predictions and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import normal_cdf, normal_ppf


def running(key: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def equity(trades: DataFrame, key: Sequence[str], order: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """equity, peak (of it and 0) and drawdown of trades in order."""
    over = running(key, order)
    out = trades.withColumn("equity", F.sum(pnl).over(over))
    out = out.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(over)))
    return out.withColumn("drawdown", F.col("peak") - F.col("equity"))


def trade_stats(trades: DataFrame, key: Sequence[str], order: Sequence[str], block: float = 1.0, pnl: str = "net") -> DataFrame:
    """Twelve figures of a block of trades; losses are trades that aren't above 0.

    Trades of one key are ordered in one task for the drawdown; the rest is a plain aggregate.
    """
    run = equity(trades, key, order, pnl)
    x = F.col(pnl)
    gain, loss = F.sum(F.when(x > 0, x).otherwise(0.0)), -F.sum(F.when(x <= 0, x).otherwise(0.0))
    wins = F.avg((x > 0).cast("double"))
    out = run.groupBy(*key).agg(F.count("*").alias("trades"), wins.alias("win_rate"), F.avg(x).alias("edge"), gain.alias("_gain"), loss.alias("_loss"), F.count_if(x > 0).alias("_w"), F.max("drawdown").alias("max_drawdown"), F.stddev_pop(x).alias("_sd"), F.sum(x).alias("total"))
    n_eff = F.greatest(F.lit(1.0), F.col("trades") / block)
    out = out.withColumns({"profit_factor": F.when(F.col("_loss") > 1e-12, F.col("_gain") / F.col("_loss")).when(F.col("_gain") > 0, 999.0).otherwise(0.0), "n_eff": n_eff})
    ratio = F.when((F.col("_w") > 0) & (F.col("trades") > F.col("_w")) & (F.col("_loss") > 0), (F.col("_gain") / F.col("_w")) / (F.col("_loss") / (F.col("trades") - F.col("_w")))).otherwise(0.0)
    se = F.col("_sd") / F.sqrt("n_eff")
    out = out.withColumns({"kelly": F.when(ratio > 0, F.col("win_rate") - (1 - F.col("win_rate")) / (ratio + 1e-12)).otherwise(0.0), "t_stat": F.when(se > 0, F.col("edge") / se).otherwise(0.0), "sharpe": F.when(F.col("_sd") > 0, F.col("edge") / F.col("_sd")).otherwise(0.0), "ci_low": F.col("edge") - 1.96 * se, "ci_high": F.col("edge") + 1.96 * se})
    return out.drop("_gain", "_loss", "_w", "_sd")


def daily_sharpe(trades: DataFrame, key: Sequence[str], day: Column, pnl: str = "net") -> DataFrame:
    """Mean over population sd of daily sums times sqrt(252), days without trades as 0; 0 for fewer than two days.

    Days without trades add nothing to the sums, so they need not be made: their number does.
    """
    daily = trades.groupBy(*key, day.alias("_day")).agg(F.sum(pnl).alias("_x"))
    whole = daily.groupBy(*key).agg((F.max("_day") - F.min("_day") + 1).alias("days"), F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"))
    mean = F.col("_s") / F.col("days")
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("days") - mean * mean, F.lit(0.0)))
    return whole.withColumn("daily_sharpe", F.when((F.col("days") < 2) | (sd < 1e-12), 0.0).otherwise(mean / sd * F.sqrt(F.lit(252.0)))).drop("_s", "_q")


def sharpe_robustness(trades: DataFrame, key: Sequence[str], block: float, trials: int, pnl: str = "net") -> DataFrame:
    """Probabilistic and deflated Sharpe ratios (0 with fewer than four trades or effective trades)."""
    x = F.col(pnl)
    out = trades.groupBy(*key).agg(F.count("*").alias("n"), (F.avg(x) / F.stddev_pop(x)).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))
    n_eff = F.greatest(F.lit(1.0), F.col("n") / block)
    se = F.sqrt(F.greatest(1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe"), F.lit(1e-12)) / F.greatest(n_eff - 1, F.lit(1e-12)))
    euler = 0.5772156649015329
    chance = se * ((1 - euler) * normal_ppf(F.lit(1 - 1 / trials)) + euler * normal_ppf(F.lit(1 - 1 / (trials * 2.718281828459045)))) if trials > 1 else F.lit(0.0)
    enough = (F.col("n") >= 4) & (n_eff >= 4)
    return out.withColumns({"psr": F.when(enough, normal_cdf(F.col("sharpe") / se)).otherwise(0.0), "dsr": F.when(enough, normal_cdf((F.col("sharpe") - chance) / se)).otherwise(0.0)})


def research_stats(trades: DataFrame, key: Sequence[str], order: str, pnl: str = "pnl", seconds: Column | None = None) -> DataFrame:
    """trades, trades a day over their span, pnl, win rate, profit factor (0 without loss), Sharpe by the sample
    sd times sqrt(n), and the drawdown below the peak before each trade (so it may be negative)."""
    x, time = F.col(pnl), seconds if seconds is not None else F.col(order) / 1000
    run = trades.withColumn("_eq", F.sum(pnl).over(running(key, [order, *([] if "seq" not in trades.columns else ["seq"])])))
    before = Window.partitionBy(*key).orderBy(order, *([] if "seq" not in trades.columns else ["seq"])).rowsBetween(Window.unboundedPreceding, -1)
    run = run.withColumn("_dd", F.greatest(F.lit(0.0), F.coalesce(F.max("_eq").over(before), F.lit(0.0))) - F.col("_eq"))
    days = F.greatest((F.max(time) - F.min(time)) / 86_400, F.lit(1e-9))
    loss = -F.sum(F.when(x < 0, x).otherwise(0.0))
    sd = F.stddev_samp(x)
    return run.groupBy(*key).agg(
        F.count("*").alias("trades"), (F.count("*") / days).alias("trades_per_day"), F.sum(x).alias("pnl"), F.avg((x > 0).cast("double")).alias("win_rate"),
        F.when(loss > 0, F.sum(F.when(x > 0, x).otherwise(0.0)) / loss).otherwise(0.0).alias("profit_factor"),
        F.when(F.coalesce(sd, F.lit(0.0)) > 0, F.avg(x) / sd * F.sqrt(F.count("*"))).otherwise(0.0).alias("sharpe"), F.max("_dd").alias("drawdown"), F.median(x).alias("median"),
    )


def per_trade_sharpe(trades: DataFrame, key: Sequence[str], pnl: str = "pnl") -> DataFrame:
    sd = F.stddev_samp(pnl)
    return trades.groupBy(*key).agg(F.when(sd > 0, F.avg(pnl) / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"))


def confusion(rows: DataFrame, truth: str, predicted: str, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """One row: n, accuracy, precision of each class, and counts truth x predicted."""
    hit = F.col(truth) == F.col(predicted)
    cells = [F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(f"c{t}{p}") for t in classes for p in classes]
    precision = [F.coalesce(F.count_if(hit & (F.col(predicted) == p)) / F.nullif(F.count_if(F.col(predicted) == p), F.lit(0)), F.lit(0.0)).alias(f"precision_{p}") for p in classes]
    return rows.agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"), *precision, *cells)


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of confidence."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins))
    by_bin = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return by_bin.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def folds(rows: DataFrame, k: int, order: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """fold 0..k-1 by position: fold i holds positions i*n//k up to (i+1)*n//k."""
    whole = Window.partitionBy(*key)
    i, n = F.row_number().over(whole.orderBy(*order)) - 1, F.count("*").over(whole)
    return rows.withColumns({"_i": i, "_n": n}).withColumn("fold", (F.floor(((F.col("_i") + 1) * k - 1) / F.col("_n"))).cast("int")).drop("_i", "_n")


def parts(rows: DataFrame, cuts: Sequence[float], names: Sequence[str], order: Sequence[str], key: Sequence[str] = (), purge: int = 0) -> DataFrame:
    """part of each row by position; `purge` rows before each cut belong to none."""
    whole = Window.partitionBy(*key)
    out = rows.withColumns({"_i": F.row_number().over(whole.orderBy(*order)) - 1, "_n": F.count("*").over(whole)})
    bounds = [F.floor(F.col("_n") * c) for c in cuts]
    part = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names, strict=False))):
        part = F.when(F.col("_i") < bound - purge, name).when(F.col("_i") < bound, F.lit(None)).otherwise(part)
    return out.withColumn("part", part).drop("_i", "_n")


def benjamini_hochberg(rows: DataFrame, p: str = "p", key: Sequence[str] = ()) -> DataFrame:
    """q_bh and q_holm beside p: step-up and step-down adjusted p-values, ties by id."""
    whole = Window.partitionBy(*key)
    out = rows.withColumns({"_r": F.row_number().over(whole.orderBy(p, "id")), "_m": F.count("*").over(whole)})
    up = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(whole.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    down = F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumns({"q_bh": up, "q_holm": down}).drop("_r", "_m")


def empirical_p(rows: DataFrame, null: DataFrame, x: str, value: str, bins: int = 4096) -> DataFrame:
    """p_share: share of null values at or above x; p_add_one: (1 + their number) / (1 + all).

    Values are cut into bins between the null's extremes; a running count over the bins,
    which are few, and one inside each bin replace the join by inequality and the sort of
    everything in one task.
    """
    whole = null.filter(F.col(value).isNotNull()).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_all"))  # one row
    at = F.floor((F.col("v") - F.col("_low")) / F.greatest((F.col("_high") - F.col("_low")) / bins, F.lit(1e-300)))
    both = rows.select(F.col("id"), F.col(x).alias("v"), F.lit(1).alias("is_row")).unionByName(null.filter(F.col(value).isNotNull()).select(F.lit(None).cast("long").alias("id"), F.col(value).alias("v"), F.lit(0).alias("is_row")))
    both = both.join(F.broadcast(whole)).withColumn("bin", F.least(F.greatest(F.coalesce(at, F.lit(0)), F.lit(-1)), F.lit(bins)).cast("int"))
    # bins -1 and `bins` are for rows beyond the null's values
    bin_order = Window.partitionBy().orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    higher = both.groupBy("bin").agg(F.sum(1 - F.col("is_row")).alias("_n")).select("bin", F.coalesce(F.sum("_n").over(bin_order), F.lit(0)).alias("_higher"))
    inside = F.sum(1 - F.col("is_row")).over(Window.partitionBy("bin").orderBy(F.col("v").desc(), "is_row").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_inside", inside).filter("is_row = 1").join(higher, "bin").withColumn("n_above", F.col("_inside") + F.col("_higher"))
    return out.select("id", F.col("v").alias(x), "n_above", (F.col("n_above") / F.greatest(F.col("_all"), F.lit(1)).cast("double")).alias("p_share"), ((1 + F.col("n_above")) / (1.0 + F.col("_all"))).alias("p_add_one"))


def fold_stability(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    x = F.col(value)
    return rows.groupBy(*key).agg(F.count(x).alias("folds"), F.avg((x > 0).cast("double")).alias("positive"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max")).withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("folds"))))


def nearest_rank(rows: DataFrame, key: Sequence[str], value: str, q: float) -> DataFrame:
    """The value at 0-based position floor(q * (n - 1) + 0.5)."""
    whole = Window.partitionBy(*key)
    out = rows.filter(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(whole.orderBy(value)) - 1, "_n": F.count("*").over(whole)})
    return out.filter(F.col("_i") == F.floor(q * (F.col("_n") - 1) + 0.5)).select(*key, F.col(value).alias("quantile"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins, values outside in the first and the last; empty bins too."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)))).cast("int")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * ((high - low) / bins)).alias("from"), F.coalesce("n", F.lit(0)).alias("n"))


def correlations(rows: DataFrame, a: str, b: str, order: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Pearson correlation of two columns' levels and of their log returns."""
    over = Window.partitionBy(*key).orderBy(*order)
    step = lambda c: F.log(F.col(c)) - F.log(F.lag(c).over(over))
    out = rows.withColumns({"_a": step(a), "_b": step(b)})
    return out.groupBy(*key).agg(F.count("*").alias("n"), F.corr(a, b).alias("level_corr"), F.corr("_a", "_b").alias("return_corr"))


def effective_bets(daily: DataFrame, model: str, day: str, pnl: str) -> DataFrame:
    """Participation ratio and Kaiser count of the eigenvalues of the models' daily correlations.

    Models are few; their correlation matrix is computed in the cluster, its eigenvalues on the driver.
    """
    import numpy as np

    names = [r[0] for r in daily.select(model).distinct().orderBy(model).collect()]
    table = daily.groupBy(day).pivot(model, names).agg(F.sum(pnl)).fillna(0.0)
    cells = [F.coalesce(F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")), F.lit(0.0)) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = iter(table.agg(*cells).first()) if cells else iter(())
    matrix = np.eye(len(names))
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            matrix[i, j] = matrix[j, i] = next(found)
    values = np.linalg.eigvalsh(matrix) if len(names) else np.zeros(0)
    ratio = float(values.sum() ** 2 / (values**2).sum()) if len(values) else 0.0
    return daily.sparkSession.createDataFrame([(len(names), ratio, int((values > 1).sum()))], "models int, effective_bets double, kaiser int")


def factor_effects(rows: DataFrame, knobs: Sequence[str], value: str) -> DataFrame:
    """Mean, median and positive share of value for every setting of every knob."""
    long = rows.select(value, F.explode(F.array(*[F.struct(F.lit(k).alias("knob"), F.col(k).cast("string").alias("setting")) for k in knobs])).alias("k")).select("k.*", value)
    return long.groupBy("knob", "setting").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.avg((F.col(value) > 0).cast("double")).alias("positive"))


def interactions(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Means over both knobs, each alone, and all (grouping sets)."""
    return rows.cube(a, b).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.avg(value).alias("mean"))


def monotonicity(effects: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Share of steps up among the steps between neighbouring settings, and whether all go one way."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return effects.withColumn("_s", step).filter("_s is not null").groupBy(key).agg(F.count("*").alias("steps"), F.avg((F.col("_s") > 0).cast("double")).alias("up"), (F.bool_and(F.col("_s") >= 0) | F.bool_and(F.col("_s") <= 0)).alias("monotone"))


def lower_bound(rows: DataFrame, key: Sequence[str], pnl: str) -> DataFrame:
    """Sum minus 1.96 sd sqrt(n); minus infinity isn't given: null for one trade."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), (F.sum(pnl) - 1.96 * F.stddev_samp(pnl) * F.sqrt(F.count("*"))).alias("lower_bound"))


def subperiods(rows: DataFrame, key: Sequence[str], order: Sequence[str], pnl: str, periods: int = 4) -> DataFrame:
    """Sums of equal parts by position: how many are negative, the largest share, and whether that passes."""
    summed = folds(rows, periods, order, key).groupBy(*key, "fold").agg(F.sum(pnl).alias("s"))
    out = summed.groupBy(*key).agg(F.sum("s").alias("total"), F.count_if(F.col("s") < 0).alias("negatives"), F.max("s").alias("_top"))
    share = F.when(F.col("total") > 0, F.col("_top") / F.col("total"))
    return out.withColumns({"max_share": share, "passes": F.coalesce((F.col("total") > 0) & (F.col("negatives") <= 1) & (share <= 0.75), F.lit(False))}).drop("_top")


def verdict(stats: DataFrame) -> DataFrame:
    """edge_verdict of trade_stats rows: a positive lower bound and Kelly, 30 effective trades, and profit factor above 1."""
    good = (F.col("ci_low") > 0) & (F.col("kelly") > 0) & (F.col("n_eff") >= 30) & (F.col("profit_factor") > 1)
    return stats.withColumn("edge_verdict", F.when(good, "yes").otherwise("no"))


def regime_distances(rows: DataFrame, vector: str, label: str, q: float = 0.99) -> DataFrame:
    """Nearest class by diagonal Mahalanobis distance, and whether it lies beyond the q quantile of all distances.

    Class means and variances are by component (few classes, fixed length).
    """
    long = rows.select("id", F.col(label).alias("class"), F.posexplode(vector).alias("i", "x"))
    fitted = long.groupBy("class", "i").agg(F.avg("x").alias("m"), (1 / (F.var_pop("x") + 1e-6)).alias("w"))
    scored = long.drop("class").join(F.broadcast(fitted), "i").groupBy("id", "class").agg(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")) * F.col("w")).alias("d"))
    best = scored.groupBy("id").agg(F.min(F.struct(F.round("d", 9).alias("d"), "class")).alias("b")).select("id", F.col("b.class").alias("regime"), F.col("b.d").alias("distance"))
    cut = best.agg(F.percentile("distance", q).alias("cut"))
    return best.join(F.broadcast(cut), how="cross").withColumn("out", F.col("distance") > F.col("cut")).drop("cut")


def directional_loss(p: Column, truth: Column, wrong: float = 3.0) -> Column:
    """Cross entropy of probabilities [up, neutral, down]; a call of the opposite side counts `wrong` times."""
    own = -F.log(F.greatest(F.element_at(p, truth + 1), F.lit(1e-12)))
    called = F.array_position(p, F.array_max(p)) - 1
    return own * F.when(F.abs(called - truth) == 2, wrong).otherwise(1.0)


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.greatest(level * (y - q), (level - 1) * (y - q))


def huber(error: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(error) <= delta, 0.5 * error * error).otherwise(delta * (F.abs(error) - 0.5 * delta))


def triplet(near: Column, far: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), near - far + margin)


def trader_loss(call: Column, profit: Column, cost: Column, wrong: float = 3.0, missed: float = 0.1) -> Column:
    """Loss of a call (1, -1, 0) whose side would have earned profit: losses count `wrong` times, a missed profit a little."""
    net = F.abs(call) * (profit - cost)
    return F.when(call == 0, missed * F.greatest(profit - cost, F.lit(0.0))).when(net < 0, -wrong * net).otherwise(-net)


def sharpe_loss(pnl: str) -> Column:
    sd = F.stddev_samp(pnl)
    return -F.coalesce(F.avg(pnl) / F.nullif(sd, F.lit(0.0)), F.lit(0.0))


def environment_penalty(rows: DataFrame, env: str, gradient: Column) -> DataFrame:
    """Sum over environments of the squared mean gradient."""
    return rows.groupBy(env).agg(F.avg(gradient).alias("_g")).agg(F.sum(F.col("_g") * F.col("_g")).alias("penalty"))


def mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """How many values of each column differ by more than tolerance between two tables of the same keys."""
    both = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns]).join(b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns]), list(keys))
    return both.agg(F.count("*").alias("rows"), *(F.count_if(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) > tolerance).alias(c) for c in columns))
