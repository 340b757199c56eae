"""Windows of ticks as samples, their forward labels and their weights."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import ratio
from tickloom.shipping import ship
from tickloom.sources.ticks import by_symbol, in_chunks

#: The session regimes of a sample, first match wins: name of the bound, first and last hour.
SESSIONS = ((0, 7, 12), (1, 13, 17), (2, 23, 28))


def ahead(a: int, b: int) -> Window:
    return by_symbol().rowsBetween(a, b)


SAMPLE = "symbol string, t_index long, entry_time_ms long, entry_mid double, exit_mid double, entry_spread double, future_spread double, future_sd double, ret2 double, rets long, path_high double, path_low double"
#: Samples whose windows are laid side by side at once.
_AT_ONCE = 2048


def samples(ticks: DataFrame, window: int = 512, stride: int = 64, horizon: int = 128, chunk_rows: int = 1 << 16, width_ms: int = 3_600_000) -> DataFrame:
    """One row for each window of `window` ticks that `horizon` ticks follow, every `stride` ticks.

    t_index is the first tick of the window; entry is the tick after the window, exit
    the last of the horizon.  ret2 is the sum of squared log returns inside the window.
    A sample belongs to the chunk its last tick lies in, and only the windows of samples
    are looked at, not those of all ticks.
    """
    reach = window + horizon - 1

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("time_ms", "ascending"), ("seq", "ascending")])
        time, mid, ask, bid = (table.column(x).to_numpy() for x in ("time_ms", "mid", "ask", "bid"))
        spread, step = ask - bid, np.diff(np.log(mid + 1e-8), prepend=np.nan) ** 2
        first = table.column("rows_before")[0].as_py()
        start = first + np.arange(len(mid)) - reach
        end = np.flatnonzero(table.column("inside").to_numpy() & (start >= 0) & (start % stride == 0))
        parts = []
        for at in (end[k : k + _AT_ONCE] for k in range(0, len(end), _AT_ONCE)):
            path = at[:, None] + np.arange(1 - horizon, 1)
            entry, ahead = path[:, 0], mid[path]
            inner = at[:, None] + np.arange(1 - reach, 1 - horizon)
            parts.append(
                pa.table(
                    {
                        "symbol": table.column("symbol").take(pa.array(at)), "t_index": start[at], "entry_time_ms": time[entry], "entry_mid": mid[entry], "exit_mid": mid[at], "entry_spread": spread[entry],
                        "future_spread": spread[path].mean(axis=1), "future_sd": ahead.std(axis=1), "ret2": step[inner].sum(axis=1), "rets": np.full(len(at), window - 1), "path_high": ahead.max(axis=1), "path_low": ahead.min(axis=1),
                    }
                )
            )
        return pa.concat_tables(parts) if parts else pa.table({x: pa.array([], t) for x, t in _SAMPLE_TYPES.items()})

    ship(ticks.sparkSession)
    chunks = in_chunks(ticks.select("symbol", "seq", "time_ms", "mid", "ask", "bid"), reach, chunk_rows, width_ms)
    return chunks.groupBy("symbol", "chunk").applyInArrow(run, SAMPLE)


_SAMPLE_TYPES = {x.split()[0]: {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in SAMPLE.split(", ")}


def numbered(ticks: DataFrame, chunk_rows: int = 1 << 16, width_ms: int = 3_600_000) -> DataFrame:
    """ticks with pos, the place in the symbol from 0; chunks are numbered side by side."""
    over = Window.partitionBy("symbol", "chunk").orderBy("time_ms", "seq")
    own = in_chunks(ticks, 0, chunk_rows, width_ms).withColumn("pos", F.col("rows_before") + F.row_number().over(over) - 1)
    return own.filter("inside").drop("chunk", "inside", "rows_before")


def soft_direction(move: Column, threshold: Column, floor: float = 0.4) -> Column:
    """[up, neutral, down]: sure of a direction as the move passes the threshold, at least `floor` neutral inside it."""
    sure = F.least(F.lit(1.0), 0.5 + 0.5 * (F.abs(move) - threshold) / threshold)
    inside = F.greatest(F.lit(floor), 1 - F.abs(move) / threshold)
    rest = (1 - sure) / 2
    return F.when(move > threshold, F.array(sure, rest, rest)).when(move < -threshold, F.array(rest, rest, sure)).otherwise(F.array((1 - inside) / 2, inside, (1 - inside) / 2))


def triple_barrier(ticks: DataFrame, sampled: DataFrame, window: int, horizon: int, k: float = 1.0, cost_mult: float = 1.5) -> DataFrame:
    """tb_label (0 up, 1 neither, 2 down), tb_ret and exit_mid of samples by which barrier the path touches first.

    Both barriers stand max(entry * sigma * sqrt(horizon) * k, cost_mult * mean spread)
    away.  Whether a path touches at all is known from its extremes; only the samples
    that do are matched with their horizon's ticks, by symbol and position.  An entry
    at 0 has an infinite tb_ret and tb_cost (NaN where the move or the spread is 0 too).
    """
    sigma = F.sqrt(F.col("ret2") / F.col("rets"))
    barred = sampled.withColumn("barrier", F.greatest(F.col("entry_mid") * sigma * (horizon**0.5) * k, cost_mult * F.col("future_spread")))
    touching = barred.filter((F.col("path_high") - F.col("entry_mid") >= F.col("barrier")) | (F.col("entry_mid") - F.col("path_low") >= F.col("barrier")))
    # a horizon covers few blocks of positions; ticks meet samples in equal blocks
    at = numbered(ticks.select("symbol", "seq", "time_ms", F.col("mid").alias("path_mid"))).select("symbol", "pos", "path_mid").withColumn("block", F.floor(F.col("pos") / horizon))
    spans = touching.select("symbol", "t_index", "entry_mid", "barrier").withColumn("block", F.explode(F.sequence(F.floor((F.col("t_index") + window) / horizon), F.floor((F.col("t_index") + window + horizon - 1) / horizon))))
    inside = (F.col("pos") >= F.col("t_index") + window) & (F.col("pos") < F.col("t_index") + window + horizon)
    hit = F.abs(F.col("path_mid") - F.col("entry_mid")) >= F.col("barrier")
    first = spans.join(at, ["symbol", "block"]).filter(inside & hit).groupBy("symbol", "t_index").agg(F.min_by("path_mid", "pos").alias("touch_mid"), F.min("pos").alias("touch_pos"))
    out = barred.join(first, ["symbol", "t_index"], "left")
    end = F.coalesce("touch_mid", "exit_mid")
    return out.withColumns({"tb_label": F.when(F.col("touch_mid").isNull(), 1).when(F.col("touch_mid") > F.col("entry_mid"), 0).otherwise(2), "tb_ret": ratio(end - F.col("entry_mid"), F.col("entry_mid")), "exit_mid": end, "tb_cost": ratio(F.col("future_spread"), F.col("entry_mid"))})


def environment(hour: Column, rv: Column, difficulty: Column) -> Column:
    """Regime of a sample: the sessions, then by volatility, then by difficulty."""
    out = F.when(rv > 1e-3, 3).when(rv < 1e-4, 4).when(difficulty < 2, 5).otherwise(6)
    for name, a, b in reversed(SESSIONS):
        inside = (hour >= a) & (hour < b) if b <= 24 else (hour >= a) | (hour < b - 24)
        out = F.when(inside, name).otherwise(out)
    return out


def trade_target(ticks: DataFrame, horizon: int) -> DataFrame:
    """Best long and short exit over the horizon after half the spread, their adverse moves, and the better side."""
    order = by_symbol()
    path = ahead(1, horizon - 1)
    half = (F.col("ask") - F.col("bid")) / 2
    out = ticks.withColumns({"high": F.max("mid").over(path), "low": F.min("mid").over(path), "_n": F.count("mid").over(path)}).filter(F.col("_n") == horizon - 1)
    out = out.withColumns({"long_mfe": F.col("high") - F.col("mid") - half, "short_mfe": F.col("mid") - F.col("low") - half, "long_mae": F.col("mid") - F.col("low") + half, "short_mae": F.col("high") - F.col("mid") + half})
    return out.withColumns({"side": F.when(F.greatest("long_mfe", "short_mfe") <= 0, 0).when(F.col("long_mfe") >= F.col("short_mfe"), 1).otherwise(-1), "reward_to_risk": F.greatest("long_mfe", "short_mfe") / F.when(F.col("long_mfe") >= F.col("short_mfe"), F.col("long_mae")).otherwise(F.col("short_mae"))}).select("symbol", "seq", "time_ms", "long_mfe", "short_mfe", "long_mae", "short_mae", "side", "reward_to_risk")


def with_path(rows: DataFrame, hold: int, order: Window) -> DataFrame:
    """_path: the closes of the next `hold` rows; rows without any go.  The hold is short, so a path fits in a row."""
    return rows.withColumn("_path", F.collect_list("close").over(order.rowsBetween(1, hold))).filter(F.size("_path") > 0)


def exit_pnl(direction: Column, stop: Column, target: Column) -> Column:
    """pnl of entering at close by direction, out at stop or target, whichever a close of _path passes first, else at its end."""
    moves = F.transform("_path", lambda x: (x - F.col("close")) * direction)
    first = F.try_element_at(F.filter(moves, lambda m: (m >= target) | (m <= -stop)), F.lit(1))
    return F.when(first >= target, target).when(first.isNotNull(), -stop).otherwise(F.element_at(moves, -1))


def stop_target_exit(rows: DataFrame, direction: Column, stop: Column, target: Column, hold: int, order: Window) -> DataFrame:
    """direction and pnl of every row that enters, under with_path() and exit_pnl()."""
    out = with_path(rows, hold, order).withColumn("direction", direction).filter("direction != 0")
    return out.withColumn("pnl", exit_pnl(F.col("direction"), stop, target)).drop("_path")


def window_summary(ticks: DataFrame, columns: tuple[str, ...], window: int, stride: int, recent: tuple[int, int] = (64, 16)) -> DataFrame:
    """Of each column over each window: mean and sd over all and the last ticks, last value, slope over time, and the ratio of means."""
    order = by_symbol()
    out = ticks.withColumn("k", F.row_number().over(order))
    made: dict[str, Column] = {}
    for c in columns:
        for n in (window, *recent):
            over = order.rowsBetween(-(n - 1), 0)
            made[f"{c}_mean_{n}"] = F.avg(c).over(over)
            made[f"{c}_sd_{n}"] = F.sqrt(F.var_pop(c).over(over) + 1e-8)
        made[f"{c}_last"] = F.col(c)
        made[f"{c}_slope"] = F.regr_slope(F.col(c), F.col("k")).over(order.rowsBetween(-(window - 1), 0))
    out = out.withColumns(made).filter((F.col("k") >= window) & ((F.col("k") - window) % stride == 0))
    for c in columns:
        ratio = F.col(f"{c}_mean_{recent[1]}") / F.col(f"{c}_mean_{window}")
        out = out.withColumn(f"{c}_ratio", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.when(F.abs(F.col(f"{c}_mean_{window}")) > 1e-12, ratio).otherwise(0.0))))
    return out.select("symbol", (F.col("k") - window).cast("long").alias("t_index"), *made, *(f"{c}_ratio" for c in columns))


def uniqueness(entries: DataFrame, horizon: int, key: str = "symbol", entry: str = "t_index") -> DataFrame:
    """weight: mean of 1 / (how many samples are open) over a sample's span [entry, entry + horizon).

    A sweep over starts and ends gives the number open in each elementary interval and
    a running sum of length / open; a sample's weight is the difference of that sum at
    its two ends over the horizon.
    """
    starts = entries.groupBy(key, F.col(entry).cast("long").alias("at")).agg(F.count("*").alias("delta"))
    ends = starts.select(key, (F.col("at") + horizon).alias("at"), (-F.col("delta")).alias("delta"))
    points = starts.union(ends).groupBy(key, "at").agg(F.sum("delta").alias("delta"))
    order = Window.partitionBy(key).orderBy("at")
    run = points.withColumns({"open": F.sum("delta").over(order), "length": F.lead("at").over(order) - F.col("at")})
    share = F.when(F.col("open") > 0, F.col("length") / F.col("open")).otherwise(0.0)
    sums = run.withColumn("until", F.coalesce(F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select(key, "at", "until")
    a, b = sums.withColumnsRenamed({"at": "_a", "until": "_from"}), sums.withColumnsRenamed({"at": "_b", "until": "_to"})
    out = entries.withColumns({"_a": F.col(entry).cast("long"), "_b": F.col(entry).cast("long") + horizon}).join(a, [key, "_a"]).join(b, [key, "_b"])
    return out.withColumn("weight", (F.col("_to") - F.col("_from")) / horizon).drop("_a", "_b", "_from", "_to")


def time_decay(rows: DataFrame, key: str, order: str, tail: float = 0.5) -> DataFrame:
    """decay: from tail at the oldest row to 1 at the newest, linear in rank."""
    return rows.withColumn("decay", tail + (1 - tail) * F.percent_rank().over(Window.partitionBy(key).orderBy(order)))


def scaled_to_mean_one(rows: DataFrame, weight: Column, key: str, name: str = "weight") -> DataFrame:
    whole = Window.partitionBy(key)
    return rows.withColumn("_w", weight).withColumn(name, F.col("_w") * F.count("*").over(whole) / F.sum("_w").over(whole)).drop("_w")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Inverse frequency over its mean, at least a quarter of the largest."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # one row for each class
    inverse = 1 / F.col("n")
    out = counts.withColumn("weight", inverse / F.avg(inverse).over(whole))
    return out.withColumn("weight", F.greatest(F.col("weight"), F.max("weight").over(whole) / 4))


def weighted_draws(rows: DataFrame, weight: str, draws: int, seed: int, key: str = "t_index") -> DataFrame:
    """`draws` rows with replacement, in proportion to weight: each row as often as its share asks for, with a seeded
    remainder.

    Shares are split into a whole part and a chance, so no draw looks at other rows.
    """
    total = rows.agg(F.sum(weight)).first()[0] or 1.0
    share = F.col(weight) * draws / total
    luck = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor(share) + (luck < share - F.floor(share)).cast("int")).cast("int")
    return rows.withColumn("_t", times).filter("_t > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t")


Augment = Callable[[Column, Column], Column]


def augmented(rows: DataFrame, column: str, seed: int, scale: float = 0.1, noise: float = 0.01, dropout: float = 0.05) -> DataFrame:
    """A seeded copy of an array column: scaled as a whole, with noise, some entries 0."""
    unit = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << 30)) / float(1 << 30)
    factor = 1 + scale * (2 * unit(F.col("t_index"), F.lit(seed)) - 1)

    def change(x: Column, i: Column) -> Column:
        shaken = x * factor + noise * (2 * unit(F.col("t_index"), i, F.lit(seed + 1)) - 1)
        return F.when(unit(F.col("t_index"), i, F.lit(seed + 2)) < dropout, 0.0).otherwise(shaken)

    return rows.withColumn(column, F.transform(column, change))
