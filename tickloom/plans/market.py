"""Queries over features, bars, joins on time, labels and chart signals."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.operators import bars as b
from tickloom.operators import features, indicators, joins, labels, normalize, recursive
from tickloom.plans.feature_twins import QUOTES, features_sql
from tickloom.plans.registry import TICKS, query, rounded, rounded_sql
from tickloom.plans.scans import table
from tickloom.sources import ticks as t
from tickloom.streaming import bars as streaming

HOUR, DAY = 3_600_000, 86_400_000


def bars_sql(width: int, source: str = "ticks", name: str = "bars") -> str:
    return f"""{name} AS (SELECT symbol, (time_ms // {width}) * {width} AS bucket_ms, arg_min(mid, (time_ms, seq)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (time_ms, seq)) AS close,
  avg(ask - bid) AS spread, sum(ask_vol) AS ask_vol, sum(bid_vol) AS bid_vol, count(*) AS ticks, min(time_ms) AS first_tick_ms, max(time_ms) AS last_tick_ms FROM {source} GROUP BY ALL)"""


BAR_DOUBLES = "open high low close spread ask_vol bid_vol"


def ticks_of(spark: SparkSession, sf_dir: str, one: bool = False) -> DataFrame:
    """Ticks by event type, or all as one symbol."""
    d = t.ticks(spark, sf_dir)
    return d.withColumn("symbol", F.lit("ALL")) if one else d


ONE = TICKS.replace("event_type AS symbol", "'ALL' AS symbol")


# --- features --------------------------------------------------------------------------------


def quotes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes near 2,000 whose spreads are as wide as their moves and whose volumes vary."""
    d = t.ticks(spark, sf_dir)
    k, mid = F.col("ask_vol"), 2000 + F.col("mid") / 100
    half = (k + 1) / 100
    return d.select("symbol", "seq", "time_ms", (mid + half).alias("ask"), (mid - half).alias("bid"), mid.alias("mid"), (1 + k).alias("ask_vol"), (1 + (F.col("seq") * 37 + k) % 97).alias("bid_vol"))


def _feature_query(name: str, names: list[str]) -> None:
    def run(spark, sf_dir):
        return rounded(features.tick_features(quotes_of(spark, sf_dir), names))

    run.__name__ = name
    query(rounded_sql(features_sql(names), " ".join(f"f_{n}" for n in names)))(run)


_NAMES = list(features.FEATURES)
GROUPS = {
    "features_quote": _NAMES[: _NAMES.index("rv_16")],
    "features_micro": _NAMES[_NAMES.index("rv_16") : _NAMES.index("mom_8")],
    "features_returns": _NAMES[_NAMES.index("mom_8") : _NAMES.index("donch_32")],
    "features_levels": _NAMES[_NAMES.index("donch_32") : _NAMES.index("fracup_64")],
    "features_shape": _NAMES[_NAMES.index("fracup_64") :],
}
for _name, _names in GROUPS.items():
    _feature_query(_name, _names)


_EMA = {f"e{n}": ("mid", "mid", 2 / (n + 1)) for n in recursive.SPANS} | {f"{x}{n}": (v, v, 1 / n) for n in recursive.PERIODS for x, v in (("g", "up"), ("l", "down"))} | {"m": ("rate", "0.0", 0.001), "q": ("rate * rate", "0.0", 0.001)}
_FIRST = ", ".join(f"{start} + ({x} - {start}) * {alpha!r} AS {name}" for name, (x, start, alpha) in _EMA.items())
_NEXT = ", ".join(f"e.{name} + ({re.sub(r'(mid|up|down|rate)', r'n.\1', x)} - e.{name}) * {alpha!r}" for name, (x, _, alpha) in _EMA.items())
_DEVIATIONS = ", ".join([f"(mid - e{n}) / (mid + 1e-9) AS emadev_{n}" for n in recursive.SPANS] + [f"(e{a} - e{z}) / (mid + 1e-9) AS emax_{a}_{z}" for a, z in zip(recursive.SPANS, recursive.SPANS[1:], strict=False)] + [f"1 - 1 / (1 + g{n} / (l{n} + 1e-12)) AS rsi_{n}" for n in recursive.PERIODS])


@query(rounded_sql(f"""WITH RECURSIVE {QUOTES}, a AS (SELECT symbol, seq, time_ms, mid, row_number() OVER w AS k, mid - coalesce(lag(mid) OVER w, 0) AS step, CASE WHEN lag(time_ms) OVER w IS NULL THEN 0.1 ELSE greatest(0.001, (time_ms - lag(time_ms) OVER w) / 1000.0) END AS gap FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq)),
n AS (SELECT *, greatest(step, 0) AS up, greatest(-step, 0) AS down, least(1 / gap, 1000) AS rate FROM a),
e AS (SELECT symbol, seq, time_ms, mid, rate, k, {_FIRST} FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.seq, n.time_ms, n.mid, n.rate, n.k, {_NEXT} FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1)
SELECT symbol, seq, time_ms, {_DEVIATIONS}, greatest(-5, least(5, (rate - m) / sqrt(greatest(q - m * m, 0) + 1e-10))) AS vol_clock_dev FROM e""", " ".join(recursive.RECURSIVE)))
def features_recursive(spark, sf_dir):
    """Exponential means and crosses, Wilder's RSI, volume clock."""
    return rounded(recursive.recursive_features(quotes_of(spark, sf_dir)))


@query(rounded_sql(f"""WITH RECURSIVE {TICKS}, n AS (SELECT symbol, seq, time_ms, mid, row_number() OVER (PARTITION BY symbol ORDER BY time_ms, seq) AS k FROM ticks),
e AS (SELECT symbol, seq, k, mid AS ema FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.seq, n.k, e.ema + (n.mid - e.ema) * (2 / 17.0) FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1)
SELECT symbol, seq, ema FROM e""", "ema"))
def ema_by_ranges(spark, sf_dir):
    """An exponential mean of a long series, its days computed side by side."""
    d = t.ticks(spark, sf_dir).select("symbol", "seq", "time_ms", "mid")
    return rounded(recursive.exponential_mean(d, 2 / 17.0, chunk_rows=256).select("symbol", "seq", "ema"))


@query(rounded_sql(f"""WITH RECURSIVE {TICKS}, n AS (SELECT symbol, seq, time_ms, mid, row_number() OVER (PARTITION BY symbol ORDER BY time_ms, seq) AS k FROM ticks),
f AS (SELECT symbol, seq, time_ms, k, mid, mid AS level, 1 + 1e-5 AS prior FROM n WHERE k = 1
  UNION ALL SELECT n.symbol, n.seq, n.time_ms, n.k, n.mid, f.level + x.prior / (x.prior + 1e-2) * (n.mid - f.level), x.prior FROM f JOIN n ON n.symbol = f.symbol AND n.k = f.k + 1, LATERAL (SELECT f.prior * (1 - f.prior / (f.prior + 1e-2)) + 1e-5 AS prior) x)
SELECT symbol, seq, time_ms, mid, level, prior / (prior + 1e-2) AS gain FROM f""", "mid level gain"))
def kalman_levels(spark, sf_dir):
    """A filtered level; chunks of a series side by side."""
    return rounded(recursive.kalman_level(t.ticks(spark, sf_dir).select("symbol", "seq", "time_ms", "mid"), "mid", chunk_rows=512))


@query(rounded_sql(f"WITH {ONE} SELECT symbol, seq, avg(mid) OVER (PARTITION BY symbol ORDER BY time_ms, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m FROM ticks", "m"))
def halo_windows(spark, sf_dir):
    """A row frame over one long series, its days side by side, each with the 99 ticks before it."""
    d = t.with_halo(ticks_of(spark, sf_dir, True), DAY, 99)
    over = Window.partitionBy("symbol", "range").orderBy("time_ms", "seq").rowsBetween(-99, 0)
    return rounded(d.withColumn("m", F.avg("mid").over(over)).filter("inside").select("symbol", "seq", "m"))


# --- bars ------------------------------------------------------------------------------------


@query(rounded_sql(f"WITH {TICKS}, {bars_sql(HOUR)} SELECT * FROM bars", BAR_DOUBLES))
def bars_hourly(spark, sf_dir):
    return rounded(b.bars(ticks_of(spark, sf_dir), HOUR))


_WIDE = ", ".join(f"arg_min({c}, (time_ms, seq)) AS {c}_open, max({c}) AS {c}_high, min({c}) AS {c}_low, arg_max({c}, (time_ms, seq)) AS {c}_close" for c in b.PRICES)


@query(rounded_sql(f"""WITH {TICKS}, x AS (SELECT *, ask - bid AS spread, time_ms - lag(time_ms) OVER w AS gap, coalesce(CAST(CAST(floor(seq / 1000.0) AS BIGINT) <> lag(CAST(floor(seq / 1000.0) AS BIGINT)) OVER w AS INT), 0) AS changed FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq)),
g AS (SELECT symbol, (time_ms // {HOUR}) * {HOUR} AS bucket_ms, min(time_ms) AS first_tick_ms, max(time_ms) AS last_tick_ms, max(gap) AS max_tick_gap_ms, count(*) AS tick_count, CAST(sum(changed) AS BIGINT) AS source_boundary_count, {_WIDE},
  avg(spread) AS spread_mean, avg(bid_vol) AS bid_vol_mean, avg(ask_vol) AS ask_vol_mean FROM x GROUP BY ALL)
SELECT *, row_number() OVER w - 1 AS bar_index, first_tick_ms - lag(last_tick_ms) OVER w AS gap_before_ms FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)""", " ".join(f"{c}_{n}" for c in b.PRICES for n in ("open", "high", "low", "close")) + " spread_mean bid_vol_mean ask_vol_mean", 8))
def bars_wide(spark, sf_dir):
    """Bars of all four prices with gaps and source boundaries."""
    return rounded(b.wide_bars(t.with_source_group(ticks_of(spark, sf_dir), 1000), HOUR), 8)


@query(rounded_sql(f"""WITH {TICKS}, {bars_sql(HOUR)} SELECT symbol, (bucket_ms // {DAY}) * {DAY} AS bucket_ms, arg_min(open, bucket_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, bucket_ms) AS close, sum(spread * ticks) / sum(ticks) AS spread,
  sum(ask_vol) AS ask_vol, sum(bid_vol) AS bid_vol, CAST(sum(ticks) AS BIGINT) AS ticks, min(first_tick_ms) AS first_tick_ms, max(last_tick_ms) AS last_tick_ms FROM bars GROUP BY ALL""", BAR_DOUBLES))
def bars_rolled_up(spark, sf_dir):
    """Hourly bars to days, spreads weighted by ticks."""
    return rounded(b.rolled_up(b.bars(ticks_of(spark, sf_dir), HOUR), DAY))


@query(rounded_sql(f"""WITH {TICKS}, {bars_sql(HOUR)} SELECT symbol, (bucket_ms // {DAY}) * {DAY} AS bucket_ms, avg(spread) AS spread, CAST(sum(ticks) AS BIGINT) AS ticks FROM bars GROUP BY ALL""", "spread"))
def bars_mean_of_means(spark, sf_dir):
    """The second level of the archive bars: means of means, unweighted."""
    return rounded(b.rolled_up(b.bars(ticks_of(spark, sf_dir), HOUR), DAY, weighted=False).select("symbol", "bucket_ms", "spread", "ticks"))


@query(rounded_sql(f"""WITH {TICKS}, p AS (SELECT symbol, seq % 3 AS part, (time_ms // {HOUR}) * {HOUR} AS bucket_ms, arg_min(mid, (time_ms, seq)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (time_ms, seq)) AS close, avg(ask - bid) AS spread, count(*) AS ticks, min(time_ms) AS a, max(time_ms) AS z FROM ticks GROUP BY ALL)
SELECT symbol, bucket_ms, arg_min(open, a) AS open, max(high) AS high, min(low) AS low, arg_max(close, z) AS close, sum(spread * ticks) / sum(ticks) AS spread, CAST(sum(ticks) AS BIGINT) AS ticks, count(*) AS parts, bool_and(ticks > 1) AS all_busy, bool_or(ticks > 2) AS any_busy FROM p GROUP BY ALL""", "open high low close spread"))
def bars_from_partials(spark, sf_dir):
    """Partial bars of three sources, made one; where parts begin or end at one time, by seq, which the twin leaves open."""
    d = ticks_of(spark, sf_dir)
    out = None
    for k in range(3):
        part = b.bars(d.filter(F.col("seq") % 3 == k), HOUR, seqs=True)
        out = part if out is None else out.unionByName(part)
    flags = out.withColumns({"all_busy": F.col("ticks") > 1, "any_busy": F.col("ticks") > 2})
    return rounded(b.merged_bars(flags, ("all_busy",), ("any_busy",)).select("symbol", "bucket_ms", "open", "high", "low", "close", "spread", "ticks", "parts", "all_busy", "any_busy"))


@query(f"""WITH {TICKS}, {bars_sql(HOUR)}, g AS (SELECT symbol, bucket_ms, bucket_ms - lag(bucket_ms) OVER (PARTITION BY symbol ORDER BY bucket_ms) AS gap FROM bars),
i AS (SELECT symbol, bucket_ms - (gap - {HOUR}) AS start_ms, bucket_ms AS end_ms FROM g WHERE gap > {HOUR})
SELECT symbol, start_ms, end_ms, unnest(range((start_ms // {HOUR}) * {HOUR}, end_ms, {HOUR})) AS hour_ms FROM i
WHERE start_ms // {DAY} = end_ms // {DAY} AND (start_ms // {DAY} + 3) % 7 < 5 AND end_ms - start_ms >= {HOUR}""")
def missing_hours(spark, sf_dir):
    """Hours without bars inside one weekday."""
    return b.hours_of(b.missing_intervals(b.bars(ticks_of(spark, sf_dir), HOUR), HOUR, core_weekdays=True))


@query(rounded_sql(f"""WITH {TICKS}, d AS (SELECT symbol, time_ms // {DAY} AS day, arg_max(mid, (time_ms, seq)) AS close FROM ticks GROUP BY ALL) SELECT symbol, strftime(make_timestamp(day * 86400000000), '%Y-%m') AS month, avg(close) AS price, count(*) AS days FROM d GROUP BY ALL""", "price"))
def monthly_means(spark, sf_dir):
    """Daily closes, then monthly means."""
    when = F.struct("time_ms", "seq")
    daily = ticks_of(spark, sf_dir).groupBy("symbol", F.floor(F.col("time_ms") / DAY).alias("day")).agg(F.max_by("mid", when).alias("close"))
    month = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM")
    return rounded(daily.groupBy("symbol", month.alias("month")).agg(F.avg("close").alias("price"), F.count("*").alias("days")))


@query(rounded_sql("""WITH d AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice * (0.05 - l_discount)) AS pnl FROM lineitem GROUP BY ALL),
s AS (SELECT symbol, unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS at FROM d GROUP BY symbol),
f AS (SELECT s.symbol, CAST(s.at AS DATE) AS day, coalesce(d.pnl, 0.0) AS pnl FROM s LEFT JOIN d ON d.symbol = s.symbol AND d.day = CAST(s.at AS DATE))
SELECT symbol, CAST(datediff('day', DATE '1970-01-01', day) // 7 AS BIGINT) AS week, sum(pnl) AS pnl, count(*) AS days FROM f GROUP BY ALL""", "pnl", 3))
def weekly_filled(spark, sf_dir):
    """Daily results with empty days as zero, by seven-day buckets."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("pnl"))
    filled = b.calendar_filled(d, "day", "pnl", "symbol")
    return rounded(filled.groupBy("symbol", F.floor(F.unix_date("day") / 7).cast("long").alias("week")).agg(F.sum("pnl").alias("pnl"), F.count("*").alias("days")), 3)


@query()
def candle_cascade(spark, sf_dir):
    """Candles by time since their own first tick, at four widths."""
    return b.elapsed_cascade(ticks_of(spark, sf_dir), (HOUR, 4 * HOUR, DAY, 7 * DAY))


# --- joins -----------------------------------------------------------------------------------

_SYMBOLS = ("click", "error", "purchase", "signup", "view")


@query(rounded_sql(f"""WITH {TICKS}, {bars_sql(HOUR)}, w AS (SELECT bucket_ms, {", ".join(f"max(close) FILTER (symbol = '{s}') AS {s}" for s in _SYMBOLS)} FROM bars GROUP BY bucket_ms),
f AS (SELECT bucket_ms, {", ".join(f"coalesce({s}, lag({s}, 1) OVER o, lag({s}, 2) OVER o, lag({s}, 3) OVER o) AS {s}" for s in _SYMBOLS)} FROM w WINDOW o AS (ORDER BY bucket_ms))
SELECT f.*, b.close AS target, b.ticks FROM f JOIN (SELECT bucket_ms, close, ticks FROM bars WHERE symbol = 'view') b USING (bucket_ms)""", " ".join(_SYMBOLS) + " target"))
def leader_panel(spark, sf_dir):
    """Closes of all symbols side by side, filled forward up to three bars, joined to one symbol's bars."""
    bars = b.bars(ticks_of(spark, sf_dir), HOUR)
    wide = joins.filled_forward(joins.wide(bars.select("bucket_ms", "symbol", "close"), symbols=_SYMBOLS), _SYMBOLS, "bucket_ms", 3)
    target = bars.filter("symbol = 'view'").select("bucket_ms", F.col("close").alias("target"), "ticks")
    return rounded(wide.join(target, "bucket_ms"))


@query(f"""WITH {TICKS}, {bars_sql(HOUR)}, g AS (SELECT symbol, bucket_ms, bucket_ms - lag(bucket_ms) OVER (PARTITION BY symbol ORDER BY bucket_ms) AS gap FROM bars),
i AS (SELECT symbol, bucket_ms - (gap - {HOUR}) AS start_ms, bucket_ms AS end_ms FROM g WHERE gap > {HOUR})
SELECT i.symbol, i.start_ms, count(*) AS ticks, min(t.seq) AS first_seq FROM i JOIN ticks t ON t.symbol <> i.symbol AND t.time_ms >= i.start_ms AND t.time_ms < i.end_ms GROUP BY ALL""")
def ticks_in_gaps(spark, sf_dir):
    """Ticks of other symbols inside the hours that a symbol misses."""
    d = ticks_of(spark, sf_dir)
    gaps = b.missing_intervals(b.bars(d, HOUR), HOUR).withColumnRenamed("symbol", "missing")
    found = joins.inside_intervals(d, gaps, keys=()).filter("symbol != missing")
    return found.groupBy(F.col("missing").alias("symbol"), "start_ms").agg(F.count("*").alias("ticks"), F.min("seq").alias("first_seq"))


@query(rounded_sql(f"""WITH {TICKS}, l AS (SELECT seq, time_ms, mid FROM ticks WHERE symbol = 'view'), r AS (SELECT seq, time_ms, mid FROM ticks WHERE symbol = 'click')
SELECT l.seq, l.mid, CASE WHEN l.time_ms - r.time_ms <= {HOUR} THEN r.mid END AS leader FROM l ASOF LEFT JOIN r ON l.time_ms >= r.time_ms""", "mid leader"))
def as_of_leader(spark, sf_dir):
    """Each tick with the last one of another symbol, at most an hour old."""
    d = ticks_of(spark, sf_dir).withColumn("k", F.lit(1))
    l, r = d.filter("symbol = 'view'").select("k", "seq", "time_ms", "mid"), d.filter("symbol = 'click'").select("k", "time_ms", F.col("mid").alias("leader"))  # noqa: E741
    return rounded(joins.as_of(l, r, "leader", key="k", tolerance_ms=HOUR).select("seq", "mid", "leader"))


@query(rounded_sql(f"""WITH {TICKS}, d AS (SELECT symbol, time_ms // {DAY} AS day, arg_max(mid, (time_ms, seq)) AS close, avg(mid) AS ref FROM ticks GROUP BY ALL),
s AS (SELECT *, ln(close) - ln(lag(close) OVER w) AS a, ln(ref) - ln(lag(ref) OVER w) AS b FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, count(*) AS n, corr(close, ref) AS level_corr, corr(a, b) AS return_corr FROM s GROUP BY symbol""", "level_corr return_corr"))
def source_correlation(spark, sf_dir):
    """Daily closes against daily means: correlation of levels and of log returns."""
    from tickloom.operators import stats

    when = F.struct("time_ms", "seq")
    daily = ticks_of(spark, sf_dir).groupBy("symbol", F.floor(F.col("time_ms") / DAY).alias("day")).agg(F.max_by("mid", when).alias("close"), F.avg("mid").alias("ref"))
    return rounded(stats.correlations(daily, "close", "ref", ["day"], ["symbol"]))


@query(rounded_sql(f"""WITH {TICKS}, {bars_sql(HOUR)}, m AS (SELECT *, (bucket_ms // {HOUR}) % 24 AS h, bucket_ms // {DAY} AS day FROM bars),
s AS (SELECT *, CASE WHEN h >= 20 THEN day ELSE day - 1 END AS session FROM m), l AS (SELECT symbol, session, max(high) AS hi, min(low) AS lo FROM s WHERE h >= 20 OR h < 2 GROUP BY ALL),
p AS (SELECT symbol, session, lag(hi) OVER w AS night_prev_high, lag(lo) OVER w AS night_prev_low FROM l WINDOW w AS (PARTITION BY symbol ORDER BY session))
SELECT s.symbol, s.bucket_ms, night_prev_high, night_prev_low FROM s LEFT JOIN p USING (symbol, session)""", "night_prev_high night_prev_low"))
def previous_night(spark, sf_dir):
    """Each bar with the range of the night session before its own; the session passes midnight."""
    bars = b.bars(ticks_of(spark, sf_dir), HOUR)
    minute = F.pmod(F.floor(F.col("bucket_ms") / HOUR), F.lit(24)) * 60
    date = F.date_from_unix_date(F.floor(F.col("bucket_ms") / DAY).cast("int"))
    return rounded(joins.previous_session(bars, minute, date, 1200, 120, "night").select("symbol", "bucket_ms", "night_prev_high", "night_prev_low"))


# --- labels ----------------------------------------------------------------------------------

WINDOW, STRIDE, HORIZON = 64, 16, 32
SAMPLES = f"""x AS (SELECT *, row_number() OVER w - 1 AS k, ask - bid AS spread, ln((mid + 1e-8) / (lag(mid) OVER w + 1e-8)) AS ret FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq)),
y AS (SELECT symbol, k AS t_index, lead(time_ms, {WINDOW}) OVER w AS entry_time_ms, lead(mid, {WINDOW}) OVER w AS entry_mid, lead(mid, {WINDOW + HORIZON - 1}) OVER w AS exit_mid, lead(spread, {WINDOW}) OVER w AS entry_spread,
  avg(spread) OVER f AS future_spread, stddev_pop(mid) OVER f AS future_sd, sum(ret * ret) OVER i AS ret2, count(ret) OVER i AS rets, max(mid) OVER f AS path_high, min(mid) OVER f AS path_low, count(mid) OVER f AS future_n
  FROM x WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq), f AS (PARTITION BY symbol ORDER BY time_ms, seq ROWS BETWEEN {WINDOW} FOLLOWING AND {WINDOW + HORIZON - 1} FOLLOWING), i AS (PARTITION BY symbol ORDER BY time_ms, seq ROWS BETWEEN 1 FOLLOWING AND {WINDOW - 1} FOLLOWING)),
samples AS (SELECT * EXCLUDE (future_n) FROM y WHERE future_n = {HORIZON} AND t_index % {STRIDE} = 0)"""


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.samples(ticks_of(spark, sf_dir), WINDOW, STRIDE, HORIZON)


@query(rounded_sql(f"WITH {TICKS}, {SAMPLES} SELECT * FROM samples", "entry_mid exit_mid entry_spread future_spread future_sd ret2 path_high path_low"))
def window_samples(spark, sf_dir):
    return rounded(samples_of(spark, sf_dir))


@query(rounded_sql(f"""WITH {TICKS}, {SAMPLES}, m AS (SELECT symbol, t_index, exit_mid - entry_mid AS move, 1.5 * future_spread AS thr FROM samples WHERE future_spread > 0)
SELECT symbol, t_index, CASE WHEN abs(move) > thr THEN CASE WHEN move > 0 THEN least(1.0, 0.5 + 0.5 * (abs(move) - thr) / thr) ELSE (1 - least(1.0, 0.5 + 0.5 * (abs(move) - thr) / thr)) / 2 END ELSE (1 - greatest(0.4, 1 - abs(move) / thr)) / 2 END AS up,
  CASE WHEN abs(move) > thr THEN (1 - least(1.0, 0.5 + 0.5 * (abs(move) - thr) / thr)) / 2 ELSE greatest(0.4, 1 - abs(move) / thr) END AS neutral FROM m""", "up neutral"))
def soft_labels(spark, sf_dir):
    s = samples_of(spark, sf_dir).filter("future_spread > 0")
    y = labels.soft_direction(F.col("exit_mid") - F.col("entry_mid"), 1.5 * F.col("future_spread"))
    return rounded(s.select("symbol", "t_index", y[0].alias("up"), y[1].alias("neutral")))


@query(rounded_sql(f"""WITH {TICKS}, {SAMPLES}, b AS (SELECT *, greatest(entry_mid * sqrt(ret2 / rets) * sqrt({HORIZON}.0) * 0.2, 1.5 * future_spread) AS barrier FROM samples),
n AS (SELECT symbol, mid, row_number() OVER (PARTITION BY symbol ORDER BY time_ms, seq) - 1 AS pos FROM ticks),
h AS (SELECT b.symbol, b.t_index, arg_min(n.mid, n.pos) AS touch FROM b JOIN n ON n.symbol = b.symbol AND n.pos >= b.t_index + {WINDOW} AND n.pos < b.t_index + {WINDOW + HORIZON} AND abs(n.mid - b.entry_mid) >= b.barrier GROUP BY ALL)
SELECT b.symbol, b.t_index, barrier, CASE WHEN touch IS NULL THEN 1 WHEN touch > entry_mid THEN 0 ELSE 2 END AS tb_label, (coalesce(touch, exit_mid) - entry_mid) / entry_mid AS tb_ret, coalesce(touch, exit_mid) AS exit_mid, future_spread / entry_mid AS tb_cost FROM b LEFT JOIN h USING (symbol, t_index)""", "barrier tb_ret exit_mid tb_cost"))
def triple_barrier(spark, sf_dir):
    out = labels.triple_barrier(ticks_of(spark, sf_dir), samples_of(spark, sf_dir), WINDOW, HORIZON, k=0.2)
    return rounded(out.select("symbol", "t_index", "barrier", "tb_label", "tb_ret", "exit_mid", "tb_cost"))


@query(f"""WITH {TICKS}, {SAMPLES}, e AS (SELECT symbol, t_index, (entry_time_ms % {DAY}) // {HOUR} AS h, sqrt(ret2) / 1000 AS rv, future_sd / nullif(future_spread, 0) AS d FROM samples)
SELECT symbol, t_index, CASE WHEN h >= 7 AND h < 12 THEN 0 WHEN h >= 13 AND h < 17 THEN 1 WHEN h >= 23 OR h < 4 THEN 2 WHEN rv > 1e-3 THEN 3 WHEN rv < 1e-4 THEN 4 WHEN d < 2 THEN 5 ELSE 6 END AS env_id FROM e""")
def environments(spark, sf_dir):
    from tickloom.functions.columns import utc_hour

    s = samples_of(spark, sf_dir)
    return s.select("symbol", "t_index", labels.environment(utc_hour(F.col("entry_time_ms")), F.sqrt("ret2") / 1000, F.col("future_sd") / F.nullif("future_spread", F.lit(0.0))).alias("env_id"))


@query(rounded_sql(f"""WITH {TICKS}, p AS (SELECT *, max(mid) OVER f AS high, min(mid) OVER f AS low, count(mid) OVER f AS n FROM ticks WINDOW f AS (PARTITION BY symbol ORDER BY time_ms, seq ROWS BETWEEN 1 FOLLOWING AND 31 FOLLOWING)),
q AS (SELECT symbol, seq, time_ms, high - mid - (ask - bid) / 2 AS long_mfe, mid - low - (ask - bid) / 2 AS short_mfe, mid - low + (ask - bid) / 2 AS long_mae, high - mid + (ask - bid) / 2 AS short_mae FROM p WHERE n = 31)
SELECT symbol, seq, time_ms, long_mfe, short_mfe, long_mae, short_mae, CASE WHEN greatest(long_mfe, short_mfe) <= 0 THEN 0 WHEN long_mfe >= short_mfe THEN 1 ELSE -1 END AS side FROM q""", "long_mfe short_mfe long_mae short_mae"))
def trade_targets(spark, sf_dir):
    return rounded(labels.trade_target(ticks_of(spark, sf_dir), 32).drop("reward_to_risk"))


@query(rounded_sql(f"""WITH {TICKS}, {SAMPLES}, e AS (SELECT symbol, unnest(range(t_index, t_index + {HORIZON})) AS pos, t_index FROM samples), o AS (SELECT symbol, pos, count(*) AS c FROM e GROUP BY ALL)
SELECT e.symbol, e.t_index, avg(1.0 / o.c) AS weight FROM e JOIN o USING (symbol, pos) GROUP BY ALL""", "weight"))
def uniqueness_weights(spark, sf_dir):
    """Mean share of a sample over its horizon, by a sweep; the twin counts every position."""
    return rounded(labels.uniqueness(samples_of(spark, sf_dir), HORIZON).select("symbol", "t_index", "weight"))


@query(rounded_sql(f"""WITH {TICKS}, {SAMPLES}, d AS (SELECT symbol, t_index, (0.5 + 0.5 * percent_rank() OVER (PARTITION BY symbol ORDER BY t_index)) AS decay FROM samples)
SELECT symbol, t_index, decay, decay * count(*) OVER (PARTITION BY symbol) / sum(decay) OVER (PARTITION BY symbol) AS weight FROM d""", "decay weight"))
def decay_weights(spark, sf_dir):
    d = labels.time_decay(samples_of(spark, sf_dir).select("symbol", "t_index"), "symbol", "t_index")
    return rounded(labels.scaled_to_mean_one(d, F.col("decay"), "symbol"))


@query(rounded_sql("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT label, n, (1.0 / n) / avg(1.0 / n) OVER () AS weight FROM c) SELECT label, n, greatest(weight, max(weight) OVER () / 4) AS weight FROM w""", "weight"))
def class_weights(spark, sf_dir):
    return rounded(labels.class_weights(table(spark, sf_dir, "embeddings"), "label"))


@query()
def weighted_resample(spark, sf_dir):
    weighted = labels.uniqueness(samples_of(spark, sf_dir), HORIZON)
    return labels.weighted_draws(weighted.select("symbol", "t_index", "weight"), "weight", 1000, seed=3)


@query()
def augmented_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t_index"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return labels.augmented(e, "x", seed=5)


@query(rounded_sql(f"""WITH {TICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time_ms, seq) AS k FROM ticks),
a AS (SELECT *, avg(mid) OVER w AS mid_mean_64, sqrt(var_pop(mid) OVER w + 1e-8) AS mid_sd_64, avg(mid) OVER v AS mid_mean_16, sqrt(var_pop(mid) OVER v + 1e-8) AS mid_sd_16, regr_slope(mid, k) OVER w AS mid_slope FROM r
  WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq ROWS 63 PRECEDING), v AS (PARTITION BY symbol ORDER BY time_ms, seq ROWS 15 PRECEDING))
SELECT symbol, k - 64 AS t_index, mid_mean_64, mid_sd_64, mid_mean_16, mid_sd_16, mid AS mid_last, mid_slope, greatest(-3.0, least(3.0, mid_mean_16 / mid_mean_64)) AS mid_ratio FROM a WHERE k >= 64 AND (k - 64) % 16 = 0""", "mid_mean_64 mid_sd_64 mid_mean_16 mid_sd_16 mid_last mid_slope mid_ratio"))
def window_summaries(spark, sf_dir):
    return rounded(labels.window_summary(ticks_of(spark, sf_dir), ("mid",), 64, 16, (64, 16)).drop("k"))


# --- normalising -----------------------------------------------------------------------------


@query(rounded_sql(f"""WITH {TICKS}, v AS (SELECT symbol, seq, mid, avg(mid) OVER w AS m, coalesce(var_samp(mid) OVER w, 0) AS v FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq))
SELECT symbol, seq, (mid - m) / CASE WHEN v > 1e-8 THEN sqrt(v) ELSE 1.0 END AS mid_z FROM v""", "mid_z"))
def expanding_z(spark, sf_dir):
    return rounded(normalize.expanding_z(ticks_of(spark, sf_dir), ["mid"], "symbol", ["time_ms", "seq"]).select("symbol", "seq", "mid_z"))


@query(rounded_sql(f"""WITH {TICKS}, s AS (SELECT avg(mid) AS m, sqrt((1 + var_pop(mid) * count(*)) / count(*) + 1e-8) AS s1, sqrt(var_pop(mid) + 1e-8) AS s0 FROM ticks WHERE seq < 5000)
SELECT seq, greatest(-8.0, least(8.0, (mid - m) / s1)) AS seeded, greatest(-8.0, least(8.0, (mid - m) / s0)) AS plain FROM ticks, s""", "seeded plain"))
def prefix_z(spark, sf_dir):
    """z by a training prefix, with the sum of squares started at one and at zero."""
    d = ticks_of(spark, sf_dir)
    one = normalize.standardised(d, ["mid"], normalize.prefix_stats(d, ["mid"], F.col("seq") < 5000, 1.0)).select("seq", F.col("mid_z").alias("seeded"), "mid")
    return rounded(normalize.standardised(one, ["mid"], normalize.prefix_stats(d, ["mid"], F.col("seq") < 5000, 0.0)).select("seq", "seeded", F.col("mid_z").alias("plain")))


@query(rounded_sql(f"""WITH {TICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time_ms, seq) AS k FROM ticks), f AS (SELECT *, CASE WHEN k <= 500 THEN mid END AS x FROM r),
v AS (SELECT symbol, seq, mid, avg(x) OVER w AS m, coalesce(var_samp(x) OVER w, 0) AS v FROM f WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq)) SELECT symbol, seq, (mid - m) / CASE WHEN v > 1e-8 THEN sqrt(v) ELSE 1.0 END AS mid_z FROM v""", "mid_z"))
def frozen_z(spark, sf_dir):
    return rounded(normalize.frozen_after(ticks_of(spark, sf_dir), ["mid"], "symbol", ["time_ms", "seq"], 500).select("symbol", "seq", "mid_z"))


# --- bar features and chart signals ----------------------------------------------------------


@query(rounded_sql(f"""WITH {TICKS}, {bars_sql(HOUR)}, o AS (SELECT *, high - low AS rg, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)),
f AS (SELECT *, close - lag(close, 12) OVER w AS r12, avg(close) OVER b12 AS ma12, avg(close) OVER b48 AS ma48, avg(rg) OVER b48 AS atr48, avg(rg) OVER b144 AS atr144, avg(spread) OVER b48 AS s48 FROM o
  WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms), b12 AS (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), b48 AS (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), b144 AS (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 144 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, lag(ma12, 12) OVER (PARTITION BY symbol ORDER BY bucket_ms) AS ma12p FROM f)
SELECT symbol, bucket_ms, r12 * 100 AS x_r12, (close - ma12) * 100 AS x_ma_dev12, (ma12 - ma48) * 100 AS x_ma12_48, (ma12 - ma12p) * 100 AS x_ma12_slope, atr48 * 100 AS x_atr48, CASE WHEN atr144 > 1e-8 THEN atr48 / atr144 ELSE 0.0 END AS x_atr48_144,
  CASE WHEN rg > 1e-8 THEN (close - low) / rg ELSE 0.5 END AS x_close_place, CASE WHEN s48 > 1e-8 THEN spread / s48 ELSE 1.0 END AS x_spread_rel, (ask_vol - bid_vol) / (ask_vol + bid_vol + 1e-8) AS x_imbalance, CASE WHEN (bucket_ms // {HOUR}) % 24 BETWEEN 7 AND 16 THEN 1.0 ELSE 0.0 END AS x_liquid
FROM g WHERE i >= 240 AND i + 24 < n""", "x_r12 x_ma_dev12 x_ma12_48 x_ma12_slope x_atr48 x_atr48_144 x_close_place x_spread_rel x_imbalance x_liquid", 5))
def bar_features(spark, sf_dir):
    x = indicators.bar_features(b.bars(ticks_of(spark, sf_dir), HOUR))
    return rounded(x.select("symbol", "bucket_ms", *(f"x_{n}" for n in ("r12", "ma_dev12", "ma12_48", "ma12_slope", "atr48", "atr48_144", "close_place", "spread_rel", "imbalance", "liquid"))), 5)


@query()
def hypothesis_families(spark, sf_dir):
    """Trades of all twenty families: their directions, stop and target exits, and totals."""
    x = indicators.bar_features(b.bars(ticks_of(spark, sf_dir), HOUR))
    names = [c for c in x.columns if c.startswith("x_")]
    z = normalize.standardised(x, names, normalize.prefix_stats(x, names, F.lit(True)))
    # dealt anew by symbol, as the paths below need it, so that the features aren't written out again in every family
    z = z.repartition("symbol")
    sides = F.array(*[F.struct(F.lit(n).alias("family"), indicators.family_direction(n, 0.3, 0.3).alias("direction")) for n in indicators.FAMILIES])
    paths = labels.with_path(z.select("symbol", "bucket_ms", "close", "spread", F.filter(sides, lambda x: x["direction"] != 0).alias("sides")), 24, indicators.order())
    trades = paths.withColumn("_s", F.explode("sides")).withColumns({"family": F.col("_s.family"), "direction": F.col("_s.direction"), "_stop": F.greatest(F.col("spread"), F.lit(0.0)) * 2 + 0.08})
    pnl = labels.exit_pnl(F.col("direction"), F.col("_stop"), F.col("_stop") * 1.5) - F.col("spread")
    return trades.groupBy("family").agg(F.count("*").alias("trades"), F.round(F.sum(pnl), 6).alias("pnl"))


@query(rounded_sql(f"""WITH {TICKS}, {bars_sql(HOUR)}, p AS (SELECT symbol, bucket_ms, CASE WHEN count(*) OVER a = 7 AND high >= max(high) OVER a THEN high END AS h, CASE WHEN count(*) OVER a = 7 AND low <= min(low) OVER a THEN low END AS l, close FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
k AS (SELECT symbol, bucket_ms, close, lag(h, 3) OVER w AS pivot_high, lag(l, 3) OVER w AS pivot_low FROM p WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)),
r AS (SELECT *, last_value(pivot_high IGNORE NULLS) OVER w AS resistance FROM k WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms))
SELECT symbol, bucket_ms, pivot_high, pivot_low, resistance, coalesce(close > resistance AND lag(close) OVER w <= lag(resistance) OVER w, false) AS broke FROM r WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)""", "pivot_high pivot_low resistance"))
def pivot_breaks(spark, sf_dir):
    """Confirmed pivots, the last one carried on, and closes that cross it."""
    w = indicators.order()
    p = indicators.pivots(b.bars(ticks_of(spark, sf_dir), HOUR), 3, 3).withColumn("resistance", indicators.last_known("pivot_high", w))
    return rounded(p.select("symbol", "bucket_ms", "pivot_high", "pivot_low", "resistance", indicators.crossed_up(F.col("close"), F.col("resistance"), w).alias("broke")))


@query()
def chart_signals(spark, sf_dir):
    """All chart signals on hourly bars, sessions by New York time."""
    bars = b.bars(ticks_of(spark, sf_dir), HOUR)
    new_york = F.from_utc_timestamp(F.timestamp_seconds(F.col("bucket_ms") / 1000), "America/New_York")
    return indicators.chart_signals(bars, new_york)


@query(rounded_sql(f"""WITH {TICKS}, {bars_sql(HOUR)}, p AS (SELECT 'ALL' AS symbol, v.bucket_ms, v.close AS target, c.close AS leader FROM bars v JOIN bars c ON c.bucket_ms = v.bucket_ms AND v.symbol = 'view' AND c.symbol = 'click'),
s AS (SELECT *, ln(leader) - ln(lag(leader) OVER w) AS l, ln(target) - ln(lag(target) OVER w) AS t FROM p WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)),
m AS (SELECT bucket_ms, CASE WHEN count(l) OVER a = 6 THEN sum(l) OVER a END AS raw, CASE WHEN count(t) OVER a = 6 THEN sum(t) OVER a END AS tm, CASE WHEN count(l) OVER v = 48 THEN stddev_samp(l) OVER v END AS ls, CASE WHEN count(t) OVER v = 48 THEN stddev_samp(t) OVER v END AS ts FROM s
  WINDOW a AS (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))
SELECT bucket_ms, raw, raw / nullif(ls * sqrt(6.0), 0) AS volz, raw / nullif(ls * sqrt(6.0), 0) - tm / nullif(ts * sqrt(6.0), 0) AS divergence FROM m""", "raw volz divergence"))
def cross_market_features(spark, sf_dir):
    """Momentum of a leader, scaled by its volatility, and against the target's."""
    bars = b.bars(ticks_of(spark, sf_dir), HOUR)
    v, k = bars.filter("symbol = 'view'").select("bucket_ms", F.col("close").alias("target")), bars.filter("symbol = 'click'").select("bucket_ms", F.col("close").alias("leader"))
    p = v.join(k, "bucket_ms").withColumn("symbol", F.lit("ALL"))
    return rounded(indicators.cross_features(p, "leader", "target", 6).select("bucket_ms", "raw", "volz", "divergence"))


@query()
def regimes(spark, sf_dir):
    """Likeliest hidden state of every bar."""
    import numpy as np

    bars = b.bars(ticks_of(spark, sf_dir), HOUR).withColumn("range", F.col("high") - F.col("low"))
    return recursive.regime_filter(bars.select("symbol", "bucket_ms", "close", "range"), ["range"], np.full((3, 3), 0.05) + 0.85 * np.eye(3), np.array([[2.0], [8.0], [20.0]]), 4.0)




# --- streams ---------------------------------------------------------------------------------


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream over all files there are gives in the end."""
    name = f"stream_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.event_stream(spark, f"{sf_dir}/events*.parquet")


@query(rounded_sql(f"WITH {TICKS}, {bars_sql(DAY)} SELECT symbol, bucket_ms, open, high, low, close, spread, ticks FROM bars", "open high low close spread"))
def stream_bars(spark, sf_dir):
    """Daily bars of the events as a stream, all windows given."""
    return rounded(_drained(streaming.streaming_bars(_stream(spark, sf_dir), "1 day"), "complete").withColumn("bucket_ms", F.unix_millis("start")).drop("start"))


@query(rounded_sql(f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN time_ms - lag(time_ms) OVER w < {HOUR // 2} THEN 0 ELSE 1 END AS fresh FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY time_ms, seq) AS k FROM g)
SELECT symbol, min(time_ms) AS start_ms, max(time_ms) + {HOUR // 2} AS end_ms, count(*) AS ticks, min(mid) AS low, max(mid) AS high FROM s GROUP BY symbol, k""", "low high"))
def stream_sessions(spark, sf_dir):
    """Runs of ticks without a pause of half an hour, of the events as a stream."""
    out = _drained(streaming.streaming_sessions(_stream(spark, sf_dir), "30 minutes"), "complete")
    return rounded(out.withColumns({"start_ms": F.unix_millis("start"), "end_ms": F.unix_millis("end")}).drop("start", "end"))


@query(rounded_sql(f"""WITH {TICKS}, p AS (SELECT *, unnest([0, 1]) AS k FROM ticks) SELECT symbol, (time_ms // {DAY} - k) * {DAY} AS start_ms, avg(mid) AS mean, count(*) AS ticks FROM p GROUP BY ALL""", "mean"))
def stream_sliding_means(spark, sf_dir):
    """Means over two days, every day, of the events as a stream."""
    return rounded(_drained(streaming.sliding_means(_stream(spark, sf_dir), "2 days", "1 day"), "complete").withColumn("start_ms", F.unix_millis("start")).drop("start"))


@query(rounded_sql(f"""WITH RECURSIVE {TICKS}, n AS (SELECT symbol, seq, mid, row_number() OVER (PARTITION BY symbol ORDER BY time_ms, seq) AS k FROM ticks),
e AS (SELECT symbol, seq, k, mid AS ema FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.seq, n.k, e.ema + (n.mid - e.ema) * (2 / 17.0) FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1)
SELECT symbol, seq, ema AS ema_16 FROM e""", "ema_16"))
def stream_means(spark, sf_dir):
    """Exponential means whose state outlives the micro-batches; files are taken up to 256 MB at a time."""
    from tickloom.streaming import stateful

    ticks = streaming.event_stream(spark, f"{sf_dir}/events*.parquet", bytes_per_trigger=256 << 20)
    return rounded(streaming.drained(stateful.streaming_ema(ticks, (16,))).select("symbol", "seq", "ema_16"))
