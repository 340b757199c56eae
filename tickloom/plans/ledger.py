"""Queries over signals, trade ledgers and simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.functions.columns import tri_state
from tickloom.operators import bars as b
from tickloom.operators import simulate as sim
from tickloom.operators import stats
from tickloom.plans.market import HOUR, bars_sql, ticks_of
from tickloom.plans.registry import TICKS, query, rounded, rounded_sql
from tickloom.plans.scans import table

HOLD = 6
#: Hourly bars with their move, the signal of the last six moves against its 0.65 quantile on the first half.
SIGNALS = f"""{bars_sql(HOUR)}, m AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n, ln(close) - ln(lag(close) OVER w) AS step FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)),
s AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS mom FROM m), q AS (SELECT symbol, quantile_cont(abs(mom), 0.65) AS cut FROM s WHERE pos * 2 < n GROUP BY symbol),
signals AS (SELECT s.symbol, bucket_ms, pos, close, spread, CASE WHEN mom > cut THEN 1 WHEN mom < -cut THEN -1 ELSE 0 END AS signal FROM s JOIN q ON s.symbol = q.symbol)"""
TRADES = f"""trades AS (SELECT symbol, bucket_ms, pos, exit_time, signal AS direction, entry, exit, signal * (exit - entry) AS gross, greatest(coalesce(spread, 0), 0) * 1.0 AS cost, signal * (exit - entry) - greatest(coalesce(spread, 0), 0) * 1.0 AS pnl FROM (
  SELECT *, close AS entry, lead(close, {HOLD}) OVER w AS exit, lead(bucket_ms, {HOLD}) OVER w AS exit_time FROM signals WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)) WHERE signal <> 0 AND exit IS NOT NULL)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with pos and the momentum signal; thresholds come from each symbol's first half."""
    w = Window.partitionBy("symbol").orderBy("bucket_ms")
    m = b.bars(ticks_of(spark, sf_dir), HOUR).withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy("symbol")), "step": F.log("close") - F.log(F.lag("close").over(w))})
    m = m.withColumn("mom", F.sum("step").over(w.rowsBetween(-6, -1)))
    cut = m.filter(F.col("pos") * 2 < F.col("n")).groupBy("symbol").agg(F.percentile(F.abs("mom"), 0.65).alias("cut"))
    return m.join(cut, "symbol").select("symbol", "bucket_ms", "pos", "close", "spread", tri_state(F.col("mom"), F.col("cut")).alias("signal"))


def ledger(spark: SparkSession, sf_dir: str, latency: int = 0) -> DataFrame:
    return sim.overlapping(signals(spark, sf_dir), "signal", HOLD, 1.0, latency=latency)


@query(rounded_sql(f"WITH {TICKS}, {SIGNALS} SELECT symbol, bucket_ms, pos, close, signal FROM signals", "close"))
def momentum_signals(spark, sf_dir):
    return rounded(signals(spark, sf_dir).drop("spread"))


@query(rounded_sql(f"WITH {TICKS}, {SIGNALS}, {TRADES} SELECT symbol, bucket_ms, exit_time, direction, entry, exit, gross, cost, pnl FROM trades", "entry exit gross cost pnl"))
def overlapping_trades(spark, sf_dir):
    return rounded(ledger(spark, sf_dir))


@query(rounded_sql(f"""WITH {TICKS}, {SIGNALS}, x AS (SELECT *, lead(close, 2) OVER w AS entry, lead(close, {HOLD + 2}) OVER w AS exit FROM signals WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms))
SELECT symbol, bucket_ms, entry, exit, signal * (exit - entry) - greatest(spread, 0) AS pnl FROM x WHERE signal <> 0 AND exit IS NOT NULL""", "entry exit pnl"))
def late_trades(spark, sf_dir):
    """Entries two bars late."""
    return rounded(ledger(spark, sf_dir, 2).select("symbol", "bucket_ms", "entry", "exit", "pnl"))


@query(rounded_sql(f"""WITH RECURSIVE {TICKS}, {SIGNALS}, {TRADES}, t AS (SELECT symbol, pos, pnl FROM trades),
f AS (SELECT symbol, min(pos) AS pos FROM t GROUP BY symbol UNION ALL SELECT f.symbol, (SELECT min(t.pos) FROM t WHERE t.symbol = f.symbol AND t.pos >= f.pos + {HOLD}) AS pos FROM f WHERE f.pos IS NOT NULL)
SELECT t.symbol, t.pos, t.pnl FROM t JOIN f ON f.symbol = t.symbol AND f.pos = t.pos""", "pnl"))
def cooldown_trades(spark, sf_dir):
    """Trades without overlap: the next may start six bars later."""
    s = signals(spark, sf_dir)
    trades = sim.overlapping(s, "signal", HOLD, 1.0).join(s.select("symbol", "bucket_ms", "pos"), ["symbol", "bucket_ms"])
    return rounded(sim.with_cooldown(trades, "pos", HOLD).select("symbol", "pos", "pnl"))


@query(rounded_sql(f"""WITH {TICKS}, {SIGNALS}, p AS (SELECT *, CAST(greatest(-1, least(1, sum(signal) OVER (PARTITION BY symbol ORDER BY bucket_ms ROWS {HOLD - 1} PRECEDING))) AS INTEGER) AS position FROM signals),
t AS (SELECT *, abs(position - coalesce(lag(position) OVER w, 0)) AS turnover, lead(close) OVER w - close AS move FROM p WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms))
SELECT symbol, bucket_ms, position, turnover, position * move - turnover * greatest(spread, 0) / 2 AS pnl FROM t WHERE move IS NOT NULL AND (position <> 0 OR turnover <> 0)""", "pnl"))
def netted_positions(spark, sf_dir):
    out = sim.netted(signals(spark, sf_dir), "signal", HOLD, 1.0)
    return rounded(out.withColumns({"position": F.col("position").cast("int"), "turnover": F.col("turnover").cast("int")}))


@query(rounded_sql(f"WITH {TICKS}, {SIGNALS}, {TRADES}, u AS (SELECT *, 0 AS rule FROM trades UNION ALL SELECT * REPLACE (-pnl AS pnl), 1 AS rule FROM trades WHERE direction = 1) SELECT symbol, rule, count(*) AS trades, sum(pnl / 2) AS pnl FROM u GROUP BY ALL", "pnl"))
def rule_ensemble(spark, sf_dir):
    t = ledger(spark, sf_dir)
    return rounded(sim.ensemble([t, t.filter("direction = 1").withColumn("pnl", -F.col("pnl"))]).groupBy("symbol", "rule").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl")))


@query(rounded_sql(f"""WITH {TICKS}, {SIGNALS}, {TRADES}, e AS (SELECT bucket_ms AS t, 1 AS s, entry AS d FROM trades UNION ALL SELECT exit_time, 0, -entry FROM trades), g AS (SELECT t, s, sum(d) AS d FROM e GROUP BY ALL),
r AS (SELECT sum(d) OVER (ORDER BY t, s) AS o FROM g) SELECT 'all' AS portfolio, greatest(max(o), 0.0) AS peak, count(*) AS events FROM r""", "peak"))
def exposure_peak(spark, sf_dir):
    t = ledger(spark, sf_dir).withColumn("portfolio", F.lit("all"))
    return rounded(sim.exposure(t, ["portfolio"], "bucket_ms", "exit_time", "entry"))


@query()
def capped_portfolio(spark, sf_dir):
    """Fills under a cap on what is open, by the models' rank of mean result."""
    t = ledger(spark, sf_dir).withColumns({"portfolio": F.lit("all"), "trade": F.concat_ws("/", "symbol", "bucket_ms")})
    ranked = sim.allocation_rank(t, "edge_rank", "symbol", "pnl")
    return rounded(sim.gross_cap(ranked, 100.0, "portfolio", "bucket_ms", "exit_time", "entry", "rank", "trade").select("trade", "rank", "entry", "filled"))


@query(f"""WITH {TICKS}, {SIGNALS}, {TRADES}, a AS (SELECT symbol, avg(pnl) AS e, stddev_samp(pnl) AS v FROM trades GROUP BY symbol) SELECT symbol, CAST(dense_rank() OVER (ORDER BY e DESC) AS INTEGER) AS edge_rank, CAST(dense_rank() OVER (ORDER BY v) AS INTEGER) AS inverse_vol, CAST(dense_rank() OVER (ORDER BY symbol) AS INTEGER) AS name_order FROM a""")
def allocation_ranks(spark, sf_dir):
    t = ledger(spark, sf_dir)
    out = None
    for policy in ("edge_rank", "inverse_vol", "name_order"):
        own = sim.allocation_rank(t, policy, "symbol", "pnl").select("symbol", F.col("rank").alias(policy)).distinct()
        out = own if out is None else out.join(own, "symbol")
    return out


#: Predictions from the vectors: the softmax of the first three components, a move and a cost.
PREDICTIONS = """z AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 20 AS a, CAST(embedding[2] AS DOUBLE) * 20 AS b, CAST(embedding[3] AS DOUBLE) * 20 AS c, CAST(embedding[4] AS DOUBLE) AS ret, abs(CAST(embedding[5] AS DOUBLE)) / 10 AS cost FROM embeddings),
predictions AS (SELECT vec_id, label, ret, cost, exp(a) / (exp(a) + exp(b) + exp(c)) AS p_up, exp(b) / (exp(a) + exp(b) + exp(c)) AS p_neutral, exp(c) / (exp(a) + exp(b) + exp(c)) AS p_down FROM z)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = lambda k: F.col("embedding")[k].cast("double")
    z = e.select("vec_id", "label", F.exp(v(0) * 20).alias("a"), F.exp(v(1) * 20).alias("b"), F.exp(v(2) * 20).alias("c"), v(3).alias("ret"), (F.abs(v(4)) / 10).alias("cost"))
    total = F.col("a") + F.col("b") + F.col("c")
    return z.select("vec_id", "label", "ret", "cost", (F.col("a") / total).alias("p_up"), (F.col("b") / total).alias("p_neutral"), (F.col("c") / total).alias("p_down"))


@query(rounded_sql(f"""WITH {PREDICTIONS}, d AS (SELECT *, CASE WHEN p_neutral >= p_up AND p_neutral >= p_down THEN 0 WHEN p_up >= p_down THEN 1 ELSE -1 END AS direction, greatest(p_up, p_neutral, p_down) AS confidence FROM predictions)
SELECT vec_id, direction, confidence, direction * ret - (cost * 1.5 + 0.001) AS net FROM d WHERE direction <> 0 AND confidence >= 0.5""", "confidence net"))
def after_cost_ledger(spark, sf_dir):
    return rounded(sim.after_cost(predictions(spark, sf_dir), ("p_up", "p_neutral", "p_down"), "ret", "cost", 0.5, 0.5, 0.001).select("vec_id", "direction", "confidence", "net"))


@query(rounded_sql(f"""WITH {TICKS}, {SIGNALS}, {TRADES}, c(scenario, m, c, s) AS (VALUES ('low', 0.5, 0.0, 0.0), ('base', 1.0, 0.02, 0.01), ('stress', 2.0, 0.05, 0.05))
SELECT scenario, count(*) AS trades, sum((cost * m + c + s) * 2.0) AS cost, sum(gross * 2.0 - (cost * m + c + s) * 2.0) AS net FROM trades, c GROUP BY scenario""", "cost net", 4))
def cost_scenarios(spark, sf_dir):
    t = ledger(spark, sf_dir).withColumnRenamed("cost", "paid")
    return rounded(sim.cost_scenarios(t, "paid", F.lit(2.0), "gross").groupBy("scenario").agg(F.count("*").alias("trades"), F.sum("cost").alias("cost"), F.sum("net").alias("net")), 4)


@query(rounded_sql(f"""WITH {PREDICTIONS}, d AS (SELECT vec_id, ret - cost AS net, greatest(p_up, p_neutral, p_down) AS confidence FROM predictions),
k AS (SELECT avg(CAST(net > 0 AS INT)) AS w, avg(net) FILTER (net > 0) AS g, -avg(net) FILTER (net <= 0) AS l FROM d WHERE vec_id % 2 = 0)
SELECT vec_id, greatest(0.0, least(0.25, coalesce(w - (1 - w) / (g / l + 1e-12), 0.0))) * greatest(0.0, least(1.0, (confidence - 0.4) / 0.6)) AS size FROM d, k""", "size"))
def kelly_sizes(spark, sf_dir):
    d = predictions(spark, sf_dir).select("vec_id", (F.col("ret") - F.col("cost")).alias("net"), F.greatest("p_up", "p_neutral", "p_down").alias("confidence"))
    return rounded(sim.kelly_size(d, F.col("vec_id") % 2 == 0, "net", "confidence", 0.4, 0.25).select("vec_id", "size"))


@query()
def strategy_simulation(spark, sf_dir):
    """A strategy with cooldowns, streaks, daily limits and confidence sizing, over ten blocks of predictions."""
    p = predictions(spark, sf_dir).withColumn("block", (F.col("vec_id") % 10).cast("int"))
    o = p.select("block", F.col("vec_id").alias("t_index"), (F.lit(1_704_067_200_000) + F.col("vec_id") * 600_000).alias("time_ms"), "p_up", "p_neutral", "p_down", "ret", "cost", F.col("cost").alias("spread"), F.abs("ret").alias("rv"), F.lit(1.0).alias("tick_rate"), F.col("ret").alias("momentum"))
    knobs = sim.Strategy(conf_gate=0.4, size_mode="confidence", cooldown_after_loss=2, win_streak_cap=3, daily_trade_cap=20, dd_derisk=5.0, flip_block=1)
    return rounded(sim.simulate(o, knobs))


@query()
def price_levels(spark, sf_dir):
    """Support and resistance known before each bar."""
    return rounded(sim.level_context(b.bars(ticks_of(spark, sf_dir), HOUR), 0.5))


@query(rounded_sql(f"""WITH {TICKS}, {SIGNALS}, {TRADES}, e AS (SELECT symbol, bucket_ms, pnl, sum(pnl) OVER (PARTITION BY symbol ORDER BY bucket_ms) AS equity FROM trades), p AS (SELECT *, greatest(0.0, max(equity) OVER (PARTITION BY symbol ORDER BY bucket_ms)) AS peak FROM e)
SELECT symbol, bucket_ms, equity, peak, peak - equity AS drawdown FROM p""", "equity peak drawdown"))
def equity_curves(spark, sf_dir):
    return rounded(stats.equity(ledger(spark, sf_dir), ["symbol"], ["bucket_ms"]).select("symbol", "bucket_ms", "equity", "peak", "drawdown"))


#: The statistics that research_stats gives, over a relation of trades (symbol, bucket_ms, pnl).
RESEARCH = """e AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY bucket_ms) AS eq FROM trades), p AS (SELECT *, greatest(0.0, coalesce(max(eq) OVER (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) - eq AS dd FROM e)
SELECT symbol, count(*) AS trades, count(*) / greatest((max(bucket_ms) - min(bucket_ms)) / 1000 / 86400, 1e-9) AS trades_per_day, sum(pnl) AS pnl, avg(CAST(pnl > 0 AS INT)) AS win_rate, CASE WHEN sum(pnl) FILTER (pnl < 0) < 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0) ELSE 0.0 END AS profit_factor,
  CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(count(*)) ELSE 0.0 END AS sharpe, max(dd) AS drawdown, median(pnl) AS median FROM p GROUP BY symbol"""
RESEARCH_DOUBLES = "trades_per_day pnl win_rate profit_factor sharpe drawdown median"


@query(rounded_sql(f"WITH {TICKS}, {SIGNALS}, {TRADES}, {RESEARCH}", RESEARCH_DOUBLES))
def momentum_rule_stats(spark, sf_dir):
    """Ticks to bars, momentum, a fitted threshold, trades and their statistics: the whole path in built-in functions."""
    return rounded(stats.research_stats(ledger(spark, sf_dir), ["symbol"], "bucket_ms"))
