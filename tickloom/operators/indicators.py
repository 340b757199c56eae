"""Bar features, cross-market features, hypothesis families and chart signals.

Bars come as symbol, bucket_ms, open, high, low, close, spread, ticks (and volumes).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import utc_hour


def order() -> Window:
    return Window.partitionBy("symbol").orderBy("bucket_ms")


def back(n: int) -> Window:
    """The n bars before the current one."""
    return order().rowsBetween(-n, -1)


def bar_features(bars: DataFrame, warm: int = 240, ahead: int = 24) -> DataFrame:
    """Thirty-two features of a bar; means and ranges look at the bars before it only.

    Rows start after `warm` bars and end `ahead` bars before the last.
    """
    o = order()
    close, spread = F.col("close"), F.col("spread")
    i = F.row_number().over(o) - 1
    out = bars.withColumns({"_i": i, "_n": F.count("*").over(Window.partitionBy("symbol")), "_range": F.col("high") - F.col("low")})
    out = out.withColumns({f"_ma{n}": F.avg("close").over(back(n)) for n in (3, 12, 48, 144)} | {f"_atr{n}": F.avg("_range").over(back(n)) for n in (12, 48, 144)} | {f"_r{n}": close - F.lag("close", n).over(o) for n in (1, 3, 12, 48, 144)} | {"_spr48": F.avg("spread").over(back(48))})
    out = out.withColumns({"_ma12p": F.lag("_ma12", 12).over(o), "_ma48p": F.lag("_ma48", 12).over(o)})
    hour = utc_hour(F.col("bucket_ms"))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    side = lambda x: F.when(x, 1.0).otherwise(-1.0)
    ratio = lambda a, b, other: F.when(b > 1e-8, a / b).otherwise(other)
    c = lambda name: F.col(f"_{name}")
    made = {f"r{n}": c(f"r{n}") * 100 for n in (1, 3, 12, 48, 144)}
    made |= {f"ma_dev{n}": (close - c(f"ma{n}")) * 100 for n in (3, 12, 48, 144)}
    made |= {"ma12_48": (c("ma12") - c("ma48")) * 100, "ma48_144": (c("ma48") - c("ma144")) * 100, "ma12_slope": (c("ma12") - c("ma12p")) * 100, "ma48_slope": (c("ma48") - c("ma48p")) * 100}
    made |= {"range": c("range") * 100, "atr12": c("atr12") * 100, "atr48": c("atr48") * 100, "atr144": c("atr144") * 100}
    made |= {"range_atr48": ratio(c("range"), c("atr48"), 0.0), "atr48_144": ratio(c("atr48"), c("atr144"), 0.0), "close_place": ratio(close - F.col("low"), c("range"), 0.5)}
    made |= {"spread_pips": F.greatest(F.lit(0.0), spread * 100), "spread_rel": ratio(spread, c("spr48"), 1.0), "tick_count": F.col("ticks").cast("double"), "imbalance": (F.col("ask_vol") - F.col("bid_vol")) / (F.col("ask_vol") + F.col("bid_vol") + 1e-8)}
    made |= {"liquid": flag((hour >= 7) & (hour < 17)), "london": flag((hour >= 7) & (hour < 12)), "new_york": flag((hour >= 13) & (hour < 17)), "hour_sin": F.sin(hour / 24.0 * 2 * math.pi), "hour_cos": F.cos(hour / 24.0 * 2 * math.pi)}
    made |= {"agree": side(c("r12") * c("r48") >= 0), "above48": side(close > c("ma48")), "above144": side(close > c("ma144"))}
    out = out.withColumns({f"x_{k}": v for k, v in made.items()})
    return out.filter((F.col("_i") >= warm) & (F.col("_i") + ahead < F.col("_n"))).select("symbol", "bucket_ms", "close", F.col("spread"), *(f"x_{k}" for k in made))


#: Hypothesis families: what must hold for a long, as (feature, relation, bound).  A bound is a number or one of the
#: rule's thresholds a and b.  For a short the features marked as signed change their sign; `fade` swaps the sides.
#: Which features and relations make each family.
FAMILIES: dict[str, dict] = {
    "pullback": {"long": [("+ma48_144", ">", "a"), ("+ma48_slope", ">", 0), ("-ma_dev12", ">", "b")]},
    "compression_breakout": {"when": [("-atr48_144", ">", "a"), ("spread_rel", "<", "b")], "long": [("+r12", ">", 0), ("+ma12_48", ">", 0)]},
    "exhaustion": {"fade": True, "long": [("+r48", ">", "a"), ("+close_place", ">", "b")]},
    "session_trend": {"sessions": ("london", "new_york"), "long": [("+ma12_48", ">", "a"), ("+r12", ">", "b")]},
    "toxic_flow": {"when": [("spread_rel", "<", "b")], "long": [("+imbalance", ">", "a")]},
    "tight_spread_flow": {"when": [("spread_pips", "<", "b"), ("range_atr48", ">", 0)], "long": [("+imbalance", ">", "a")]},
    "tick_shock": {"when": [("tick_count", ">", "a")], "long": [("+r12", ">", "b"), ("+close_place", ">", 0.5)]},
    "burst_without_move": {"fade": True, "when": [("tick_count", ">", "a"), ("|r12", "<", "b")], "long": [("+close_place", ">", 0.5)]},
    "liquid_momentum": {"when": [("spread_rel", "<", "b"), ("tick_count", ">", 0)], "long": [("+r12", ">", "a")]},
    "fragile_flow": {"when": [("atr48_144", ">", "a")], "long": [("+imbalance", ">", "b")]},
    "autocorrelated": {"when": [("agree", ">", 0), ("range_atr48", ">", "b")], "long": [("+r12", ">", "a")]},
    "anticorrelated": {"fade": True, "when": [("-agree", ">", 0)], "long": [("+r12", ">", "a"), ("+close_place", ">", "b")]},
    "london_drift": {"sessions": ("london",), "long": [("+ma12_48", ">", "a"), ("+imbalance", ">", "b")]},
    "new_york_fade": {"fade": True, "sessions": ("new_york",), "long": [("+r48", ">", "a"), ("+close_place", ">", "b")]},
    "spread_normalised": {"when": [("-spread_rel", ">", "a")], "long": [("+r12", ">", "b")]},
    "spread_widened": {"fade": True, "when": [("spread_rel", ">", "a")], "long": [("+r48", ">", "b")]},
    "volume_clock": {"when": [("tick_count", ">", "a"), ("spread_rel", "<", 1)], "long": [("+imbalance", ">", "b")]},
    "high_vol_trend": {"when": [("atr48_144", ">", "a")], "long": [("+ma12_48", ">", 0), ("+r12", ">", "b")]},
    "low_vol_reversion": {"fade": True, "when": [("-atr48_144", ">", "a")], "long": [("+ma_dev12", ">", "b")]},
    "close_location": {"long": [("+imbalance", ">", "a"), ("+close_place", ">", "b"), ("+r12", ">", 0)]},
}


def family_direction(name: str, a: Column | float, b: Column | float, prefix: str = "x_", suffix: str = "_z") -> Column:
    """1, -1 or 0 by a family over standardised features; nothing trades outside the liquid hours."""
    family, bounds = FAMILIES[name], {"a": a, "b": b}
    feature = lambda n: F.col(f"{prefix}{n}{suffix}")

    def holds(conditions: Sequence[tuple], sign: int) -> Column:
        out = F.lit(True)
        for what, relation, bound in conditions:
            x = feature(what.lstrip("+-|"))
            x = F.abs(x) if what[0] == "|" else -x if what[0] == "-" else x
            # in `long`, a leading + or - marks a signed feature; in `when` a - only turns the comparison
            x = x * sign if what[0] in "+-" and conditions is family["long"] else x
            value = bounds.get(bound, bound) if isinstance(bound, str) else bound
            value = value if isinstance(value, Column) else F.lit(float(value))
            out = out & ((x > value) if relation == ">" else (x < value))
        return out

    usable = feature("liquid") >= 0
    if "sessions" in family:
        session = F.lit(False)
        for s in family["sessions"]:
            session = session | (feature(s) >= 0)
        usable = usable & session
    usable = usable & holds(family.get("when", ()), 1)
    side = -1 if family.get("fade") else 1
    return F.when(usable & holds(family["long"], 1), side).when(usable & holds(family["long"], -1), -side).otherwise(0)


def rule_direction(x: Column, mode: str, low: Column | float, high: Column | float) -> Column:
    """Six single-feature rules: one-sided above or below a bound, with the feature, or against it."""
    above, below = x >= high, x <= low
    return {
        "long_high": F.when(above, 1).otherwise(0),
        "short_high": F.when(above, -1).otherwise(0),
        "long_low": F.when(below, 1).otherwise(0),
        "short_low": F.when(below, -1).otherwise(0),
        "trend": F.when(above, 1).when(below, -1).otherwise(0),
        "reversal": F.when(above, -1).when(below, 1).otherwise(0),
    }[mode]


def both_agree(a: Column, b: Column) -> Column:
    """A direction only where two rules give the same one."""
    return F.when((a != 0) & (a == b), a).otherwise(0)


def momentum(x: str, w: Window, n: int) -> Column:
    """Sum of the last n log returns, the current bar left out."""
    return F.sum(x).over(w.rowsBetween(-n, -1))


def cross_features(panel: DataFrame, leader: str, target: str, n: int, vol: int = 48) -> DataFrame:
    """raw, volz, divergence and momentum ratio of a leader against a target; null where a denominator is 0."""
    w = Window.partitionBy("symbol").orderBy("bucket_ms")
    step = lambda c: F.log(c) - F.log(F.lag(c).over(w))
    out = panel.withColumns({"_l": step(leader), "_t": step(target)})
    full = lambda c: F.when(F.count(c).over(w.rowsBetween(-vol, -1)) == vol, F.stddev_samp(c).over(w.rowsBetween(-vol, -1)))
    mom = lambda c: F.when(F.count(c).over(w.rowsBetween(-n, -1)) == n, momentum(c, w, n))
    out = out.withColumns({"raw": mom("_l"), "_tm": mom("_t"), "_ls": full("_l"), "_ts": full("_t")})
    z = lambda m, s: F.col(m) / F.nullif(F.col(s) * (n**0.5), F.lit(0.0))
    return out.withColumns({"volz": z("raw", "_ls"), "divergence": z("raw", "_ls") - z("_tm", "_ts"), "momentum_ratio": F.col("raw") / F.nullif(F.abs("_tm"), F.lit(0.0))}).drop("_l", "_t", "_tm", "_ls", "_ts")


def self_features(bars: DataFrame, n: int, vol: int = 48) -> DataFrame:
    """A symbol's own momentum over its volatility (also in liquid hours only), its ratio to the one before, and RSI over n closes.

    RSI is by plain sums of gains and losses, so it stays a window expression.
    """
    w = order()
    out = bars.withColumn("_s", F.log("close") - F.log(F.lag("close").over(w)))
    over, before = w.rowsBetween(-n, -1), w.rowsBetween(-vol, -1)
    full = lambda over, k: F.count("_s").over(over) == k
    mom = F.when(full(over, n), F.sum("_s").over(over))
    sd = F.when(full(before, vol), F.stddev_samp("_s").over(before))
    out = out.withColumns({"raw": mom, "_sd": sd, "_up": F.sum(F.greatest("_s", F.lit(0.0))).over(over), "_down": F.sum(F.greatest(-F.col("_s"), F.lit(0.0))).over(over)})
    hour = utc_hour(F.col("bucket_ms"))
    volz = F.col("raw") / F.nullif(F.col("_sd") * (n**0.5), F.lit(0.0))
    out = out.withColumns({"volz": volz, "session_volz": F.when((hour >= 7) & (hour < 17), volz), "ratio": F.col("raw") / F.nullif(F.abs(F.lag("raw", n).over(w)), F.lit(0.0)), "rsi": F.col("_up") / F.nullif(F.col("_up") + F.col("_down"), F.lit(0.0))})
    return out.select("symbol", "bucket_ms", "raw", "volz", "session_volz", "ratio", "rsi")


def ew_spread_z(panel: DataFrame, a: str, b: str, span: int) -> DataFrame:
    """z of the log price ratio of two closes by exponential mean and deviation (recursive: a symbol is one group)."""
    import numpy as np
    import pandas as pd

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("bucket_ms")
        x = pd.Series(np.log(df[a].to_numpy(float) / df[b].to_numpy(float)))
        ew = x.ewm(span=span, adjust=False, min_periods=max(2, span // 2))
        return pd.DataFrame({"symbol": df.symbol.to_numpy(), "bucket_ms": df.bucket_ms.to_numpy(), "ew_z": ((x - ew.mean()) / ew.std().where(lambda s: s > 0)).to_numpy()})

    return panel.select("symbol", "bucket_ms", a, b).groupBy("symbol").applyInPandas(run, "symbol string, bucket_ms long, ew_z double")


# --- chart signals ---------------------------------------------------------------------------


def crossed_up(x: Column, level: Column, w: Window) -> Column:
    return F.coalesce((x > level) & (F.lag(x).over(w) <= F.lag(level).over(w)), F.lit(False))


def crossed_down(x: Column, level: Column, w: Window) -> Column:
    return F.coalesce((x < level) & (F.lag(x).over(w) >= F.lag(level).over(w)), F.lit(False))


def sided(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def true_range(w: Window) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def rolling_mean(x: str | Column, w: Window, n: int, least: int) -> Column:
    over = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(over) >= least, F.avg(x).over(over))


def pivots(bars: DataFrame, left: int, right: int, high: str = "pivot_high", low: str = "pivot_low") -> DataFrame:
    """Highs and lows of the bars around them, known `right` bars later; null elsewhere."""
    w = order()
    around = w.rowsBetween(-left, right)
    whole = F.count("*").over(around) == left + right + 1
    out = bars.withColumns({"_h": F.when(whole & (F.col("high") >= F.max("high").over(around)), F.col("high")), "_l": F.when(whole & (F.col("low") <= F.min("low").over(around)), F.col("low"))})
    return out.withColumns({high: F.lag("_h", right).over(w), low: F.lag("_l", right).over(w)}).drop("_h", "_l")


def last_known(x: str | Column, w: Window) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def structure(bars: DataFrame, left: int, right: int, name: str) -> DataFrame:
    """Breaks of the last pivot: with the trend (bos), against it (choch), and pivots at equal prices (equal)."""
    w = order()
    out = pivots(bars, left, right, "_ph", "_pl")
    out = out.withColumns({"_lh": last_known("_ph", w), "_ll": last_known("_pl", w), "_atr": rolling_mean(F.col("_tr"), w, 14, 7)})
    out = out.withColumn("_raw", sided(crossed_up(F.col("close"), F.col("_lh"), w), crossed_down(F.col("close"), F.col("_ll"), w)))
    before = F.coalesce(F.last(F.nullif(F.col("_raw"), F.lit(0)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumns({"_trend": before, "_first": F.row_number().over(w) == 1})
    # on the very first bar there is no trend yet to go with
    out = out.withColumns({f"{name}_bos": F.when(F.col("_first"), 0).otherwise(sided((F.col("_raw") == 1) & (F.col("_trend") >= 0), (F.col("_raw") == -1) & (F.col("_trend") <= 0))), f"{name}_choch": sided((F.col("_raw") == 1) & (F.col("_trend") < 0), (F.col("_raw") == -1) & (F.col("_trend") > 0))})
    near = lambda p, last: F.coalesce(F.col(p).isNotNull() & (F.abs(F.col(p) - F.lag(last).over(w)) <= F.col("_atr") * 0.1), F.lit(False)).cast("int")
    return out.withColumn(f"{name}_equal", near("_ph", "_lh") - near("_pl", "_ll")).drop("_ph", "_pl", "_lh", "_ll", "_atr", "_raw", "_trend", "_first")


#: Kill zones in New York minutes: start and end.
KILL_ZONES = {"asia": (1200, 1440), "london": (120, 300), "nyam": (570, 660), "nypm": (810, 960)}
OPENINGS = {"true_day_open": 0, "six_open": 360, "ten_open": 600, "fourteen_open": 840}


def in_zone(minute: Column, zone: str) -> Column:
    a, b = KILL_ZONES[zone]
    return (minute >= a) & (minute < b)


def chart_signals(bars: DataFrame, new_york: Column) -> DataFrame:
    """Signals of -1, 0 and 1 on every bar: pivot breaks, trendlines, structure, gaps, order blocks, kill zones, openings.

    new_york is the bar's local time.  The volume oscillator compares the 5- and 10-bar
    exponential means of the tick count, for which a symbol is one group.
    """
    from tickloom.operators.joins import previous_session
    from tickloom.operators.recursive import bar_means

    w = order()
    col = F.col
    out = bar_means(bars, "ticks", (5, 10)).withColumns({"_tr": true_range(w), "_body": F.abs(col("close") - col("open")), "_ny": new_york})
    # true ranges of the first bar have no close before
    out = out.withColumn("_tr", F.coalesce(col("_tr"), col("high") - col("low")))
    out = out.withColumns({"_atr14": rolling_mean(col("_tr"), w, 14, 7), "_body5": rolling_mean(col("_body"), w, 5, 3)})
    osc = 100 * (col("ticks_ema5") - col("ticks_ema10")) / F.nullif(col("ticks_ema10"), F.lit(0.0))

    out = pivots(out, 15, 15, "_ph", "_pl").withColumns({"_res": last_known("_ph", w), "_sup": last_known("_pl", w)})
    up, down = crossed_up(col("close"), col("_res"), w), crossed_down(col("close"), col("_sup"), w)
    bull, bear = (col("open") - col("low")) > (col("close") - col("open")), (col("open") - col("close")) < (col("high") - col("open"))
    out = out.withColumns({"sr_break_volume": sided(up & (osc > 20) & ~bull, down & (osc > 20) & ~bear), "sr_wick_break": sided(up & bull, down & bear)}).drop("_ph", "_pl", "_res", "_sup")

    # a trendline falls or rises from its pivot by the slope known there, bar by bar
    out = pivots(out, 14, 14, "_ph", "_pl").withColumns({"_i": F.row_number().over(w), "_slope": F.coalesce(col("_atr14") / 14, F.lit(0.0))})
    at = lambda p: last_known(F.when(col(p).isNotNull(), F.struct(col(p).alias("p"), col("_slope").alias("s"), col("_i").alias("i"))), w)
    out = out.withColumns({"_u": at("_ph"), "_d": at("_pl")})
    out = out.withColumns({"_upper": col("_u.p") - col("_u.s") * (col("_i") - col("_u.i")), "_lower": col("_d.p") + col("_d.s") * (col("_i") - col("_d.i"))})
    out = out.withColumn("trendline_break", sided(crossed_up(col("close"), col("_upper"), w), crossed_down(col("close"), col("_lower"), w))).drop("_ph", "_pl", "_u", "_d", "_upper", "_lower", "_slope")

    for left, right, name in ((5, 5, "internal"), (10, 1, "mss"), (50, 50, "swing")):
        out = structure(out, left, right, name)

    lag = lambda c, n=1: F.lag(c, n).over(w)
    solid = lag("_body") > lag("_body5") * 0.36
    gap_up = F.coalesce((col("low") > lag("high", 2)) & (lag("close") > lag("high", 2)) & solid, F.lit(False))
    gap_down = F.coalesce((col("high") < lag("low", 2)) & (lag("close") < lag("low", 2)) & solid, F.lit(False))
    out = out.withColumn("gap_create", sided(gap_up, gap_down))
    middle = F.when(col("gap_create") == 1, (col("low") + lag("high", 2)) / 2).when(col("gap_create") == -1, (col("high") + lag("low", 2)) / 2)
    out = out.withColumns({"_mid": last_known(middle, w), "_bias": F.coalesce(last_known(F.nullif(col("gap_create"), F.lit(0)), w), F.lit(0))})
    touched = F.coalesce((col("low") <= col("_mid")) & (col("high") >= col("_mid")), F.lit(False))
    out = out.withColumn("gap_touch", F.when(touched, col("_bias")).otherwise(0)).drop("_mid", "_bias")

    # order block: the last candle of the other colour among the ten before a break
    ten = w.rowsBetween(-10, -1)
    half = (col("high") + col("low")) / 2
    out = out.withColumns({"_fell": F.last(F.when(col("close") < col("open"), half), ignorenulls=True).over(ten), "_rose": F.last(F.when(col("close") > col("open"), half), ignorenulls=True).over(ten)})
    block = F.when(col("internal_bos") == 1, col("_fell")).when(col("internal_bos") == -1, col("_rose"))
    out = out.withColumns({"_mid": last_known(block, w), "_bias": F.coalesce(last_known(F.when(block.isNotNull(), col("internal_bos")), w), F.lit(0))})
    touched = F.coalesce((col("low") <= col("_mid")) & (col("high") >= col("_mid")), F.lit(False))
    out = out.withColumn("block_touch", F.when(touched, col("_bias")).otherwise(0)).drop("_mid", "_bias", "_fell", "_rose")

    minute, date = F.hour("_ny") * 60 + F.minute("_ny"), F.to_date("_ny")
    made = []
    for zone, (a, b) in KILL_ZONES.items():
        out = previous_session(out, minute, date, a, b, zone)
        hi, lo = col(f"{zone}_prev_high"), col(f"{zone}_prev_low")
        sweep = F.when((col("high") > hi) & (col("close") < hi), -1).when((col("low") < lo) & (col("close") > lo), 1).otherwise(0)
        out = out.withColumns({f"{zone}_break": sided(crossed_up(col("close"), hi, w), crossed_down(col("close"), lo, w)), f"{zone}_sweep": sweep}).drop(f"{zone}_prev_high", f"{zone}_prev_low")
        made += [f"{zone}_break", f"{zone}_sweep"]
    for name, at_minute in OPENINGS.items():
        out = out.withColumn("_level", last_known(F.when(minute == at_minute, col("open")), w))
        out = out.withColumn(name, sided(crossed_up(col("close"), col("_level"), w), crossed_down(col("close"), col("_level"), w))).drop("_level")
        made.append(name)
    names = ["sr_break_volume", "sr_wick_break", "trendline_break", *(f"{s}_{k}" for s in ("internal", "mss", "swing") for k in ("bos", "choch", "equal")), "gap_create", "gap_touch", "block_touch", *made]
    return out.select("symbol", "bucket_ms", "close", "spread", *names)
