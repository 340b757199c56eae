"""Queries over statistics, resampling, search and model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.columns import normal_cdf, normal_ppf
from tickloom.operators import joins, resample, scoring, search, simulate, stats
from tickloom.operators import bars as b
from tickloom.plans.ledger import HOLD, PREDICTIONS, SIGNALS, TRADES, ledger, predictions, signals
from tickloom.plans.market import HORIZON, HOUR, SAMPLES, WINDOW, samples_of, ticks_of
from tickloom.plans.registry import TICKS, query, rounded, rounded_sql
from tickloom.plans.scans import table

DAY = 86_400_000
LEDGER = f"{TICKS}, {SIGNALS}, {TRADES}"

TRADE_STATS = """e AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY bucket_ms) AS eq FROM trades), d AS (SELECT *, greatest(0.0, max(eq) OVER (PARTITION BY symbol ORDER BY bucket_ms)) - eq AS dd FROM e),
g AS (SELECT symbol, count(*) AS trades, avg(CAST(pnl > 0 AS INT)) AS win_rate, avg(pnl) AS edge, coalesce(sum(pnl) FILTER (pnl > 0), 0.0) AS gain, coalesce(-sum(pnl) FILTER (pnl <= 0), 0.0) AS loss, count(*) FILTER (pnl > 0) AS w, max(dd) AS max_drawdown, stddev_pop(pnl) AS sd, sum(pnl) AS total FROM d GROUP BY symbol),
h AS (SELECT *, greatest(1.0, trades / 6.0) AS n_eff, CASE WHEN w > 0 AND trades > w AND loss > 0 THEN (gain / w) / (loss / (trades - w)) ELSE 0.0 END AS ratio FROM g),
stats AS (SELECT symbol, trades, win_rate, edge, max_drawdown, total, CASE WHEN loss > 1e-12 THEN gain / loss WHEN gain > 0 THEN 999.0 ELSE 0.0 END AS profit_factor, n_eff, CASE WHEN ratio > 0 THEN win_rate - (1 - win_rate) / (ratio + 1e-12) ELSE 0.0 END AS kelly,
  CASE WHEN sd > 0 THEN edge / (sd / sqrt(n_eff)) ELSE 0.0 END AS t_stat, CASE WHEN sd > 0 THEN edge / sd ELSE 0.0 END AS sharpe, edge - 1.96 * sd / sqrt(n_eff) AS ci_low, edge + 1.96 * sd / sqrt(n_eff) AS ci_high FROM h)"""
TRADE_DOUBLES = "win_rate edge max_drawdown total profit_factor n_eff kelly t_stat sharpe ci_low ci_high"


@query(rounded_sql(f"WITH {LEDGER}, {TRADE_STATS} SELECT *, CASE WHEN ci_low > 0 AND kelly > 0 AND n_eff >= 30 AND profit_factor > 1 THEN 'yes' ELSE 'no' END AS edge_verdict FROM stats", TRADE_DOUBLES))
def trade_statistics(spark, sf_dir):
    return rounded(stats.verdict(stats.trade_stats(ledger(spark, sf_dir), ["symbol"], ["bucket_ms"], 6.0, "pnl")))


@query(rounded_sql(f"""WITH {LEDGER}, d AS (SELECT symbol, exit_time // {DAY} AS day, sum(pnl) AS x FROM trades GROUP BY ALL), r AS (SELECT symbol, min(day) AS a, max(day) AS z FROM d GROUP BY symbol),
f AS (SELECT r.symbol, coalesce(d.x, 0.0) AS x FROM (SELECT symbol, unnest(range(a, z + 1)) AS day FROM r) r LEFT JOIN d USING (symbol, day))
SELECT symbol, count(*) AS days, CASE WHEN count(*) < 2 OR stddev_pop(x) < 1e-12 THEN 0.0 ELSE avg(x) / stddev_pop(x) * sqrt(252.0) END AS daily_sharpe FROM f GROUP BY symbol""", "daily_sharpe"))
def daily_sharpe(spark, sf_dir):
    """Sharpe of calendar days, those without trades as zero; the twin makes the days, the query counts them."""
    return rounded(stats.daily_sharpe(ledger(spark, sf_dir), ["symbol"], F.floor(F.col("exit_time") / DAY).cast("long"), "pnl"))


@query()
def sharpe_robustness(spark, sf_dir):
    return rounded(stats.sharpe_robustness(ledger(spark, sf_dir), ["symbol"], 6.0, 20, "pnl"))


@query(rounded_sql(f"WITH {LEDGER} SELECT symbol, CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252.0) ELSE 0.0 END AS sharpe FROM trades GROUP BY symbol", "sharpe"))
def per_trade_sharpe(spark, sf_dir):
    return rounded(stats.per_trade_sharpe(ledger(spark, sf_dir), ["symbol"]))


_CELLS = ", ".join(f"count(*) FILTER (t = {t} AND p = {p}) AS c{t}{p}" for t in range(3) for p in range(3))
_PRECISION = ", ".join(f"coalesce(count(*) FILTER (t = p AND p = {p}) / nullif(count(*) FILTER (p = {p}), 0), 0.0) AS precision_{p}" for p in range(3))


@query(rounded_sql(f"""WITH {PREDICTIONS}, d AS (SELECT label % 3 AS t, CASE WHEN p_up >= p_neutral AND p_up >= p_down THEN 0 WHEN p_neutral >= p_down THEN 1 ELSE 2 END AS p FROM predictions)
SELECT count(*) AS n, avg(CAST(t = p AS INT)) AS accuracy, {_PRECISION}, {_CELLS} FROM d""", "accuracy precision_0 precision_1 precision_2"))
def prediction_confusion(spark, sf_dir):
    p = predictions(spark, sf_dir)
    d = p.select((F.col("label") % 3).alias("t"), F.when((F.col("p_up") >= F.col("p_neutral")) & (F.col("p_up") >= F.col("p_down")), 0).when(F.col("p_neutral") >= F.col("p_down"), 1).otherwise(2).alias("p"))
    return rounded(stats.confusion(d, "t", "p"))


@query(rounded_sql(f"""WITH {PREDICTIONS}, d AS (SELECT greatest(p_up, p_neutral, p_down) AS c, CAST(label % 3 = CASE WHEN p_up >= p_neutral AND p_up >= p_down THEN 0 WHEN p_neutral >= p_down THEN 1 ELSE 2 END AS INT) AS ok FROM predictions),
b AS (SELECT least(9, floor(c * 10)) AS bin, count(*) AS n, avg(c) AS c, avg(ok) AS a FROM d GROUP BY 1) SELECT sum(n * abs(a - c)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b""", "ece"))
def calibration_error(spark, sf_dir):
    p = predictions(spark, sf_dir)
    called = F.when((F.col("p_up") >= F.col("p_neutral")) & (F.col("p_up") >= F.col("p_down")), 0).when(F.col("p_neutral") >= F.col("p_down"), 1).otherwise(2)
    return rounded(stats.calibration_error(p.select(F.greatest("p_up", "p_neutral", "p_down").alias("c"), (F.col("label") % 3 == called).cast("int").alias("ok")), "c", "ok"))


@query(rounded_sql(f"""WITH {LEDGER}, h AS (SELECT CASE WHEN (bucket_ms // {HOUR}) % 24 BETWEEN 7 AND 11 THEN 'london' WHEN (bucket_ms // {HOUR}) % 24 BETWEEN 13 AND 16 THEN 'new_york' ELSE 'rest' END AS session, pnl FROM trades)
SELECT session, count(*) AS trades, sum(pnl) AS pnl, avg(CAST(pnl > 0 AS INT)) AS win_rate FROM h GROUP BY session""", "pnl win_rate"))
def session_stats(spark, sf_dir):
    h = F.pmod(F.floor(F.col("bucket_ms") / HOUR), F.lit(24))
    t = ledger(spark, sf_dir).withColumn("session", F.when(h.between(7, 11), "london").when(h.between(13, 16), "new_york").otherwise("rest"))
    return rounded(t.groupBy("session").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate")))


@query(rounded_sql(f"""WITH {LEDGER}, i AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY bucket_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM trades), k AS (SELECT symbol, unnest(range(8)) AS fold, any_value(n) AS n FROM i GROUP BY symbol)
SELECT k.symbol, CAST(k.fold AS INTEGER) AS fold, count(*) AS trades, sum(pnl) AS pnl FROM k JOIN i ON i.symbol = k.symbol AND i.i >= k.fold * k.n // 8 AND i.i < (k.fold + 1) * k.n // 8 GROUP BY ALL""", "pnl"))
def fold_stats(spark, sf_dir):
    """Eight contiguous folds, cut at i * n // 8."""
    return rounded(stats.folds(ledger(spark, sf_dir), 8, ["bucket_ms"], ["symbol"]).groupBy("symbol", "fold").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl")))


@query(rounded_sql(f"""WITH {LEDGER}, i AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY bucket_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM trades),
p AS (SELECT *, CASE WHEN i < floor(n * 0.6) - 10 THEN 'train' WHEN i < floor(n * 0.6) THEN NULL WHEN i < floor(n * 0.8) - 10 THEN 'val' WHEN i < floor(n * 0.8) THEN NULL ELSE 'test' END AS part FROM i) SELECT symbol, part, count(*) AS trades, sum(pnl) AS pnl FROM p GROUP BY ALL""", "pnl"))
def purged_parts(spark, sf_dir):
    """60, 20 and 20 percent, ten rows purged before each cut."""
    return rounded(stats.parts(ledger(spark, sf_dir), (0.6, 0.8), ("train", "val", "test"), ["bucket_ms"], ["symbol"], 10).groupBy("symbol", "part").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl")))


@query(rounded_sql("SELECT l_returnflag, quantile_cont(abs(l_extendedprice * (0.05 - l_discount)), 0.65) AS q65, quantile_cont(abs(l_extendedprice * (0.05 - l_discount)), 0.9) AS q90, median(l_quantity) AS median FROM lineitem GROUP BY ALL", "q65 q90 median"))
def linear_quantiles(spark, sf_dir):
    x = F.abs(F.col("l_extendedprice") * (0.05 - F.col("l_discount")))
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile(x, 0.65).alias("q65"), F.percentile(x, 0.9).alias("q90"), F.median("l_quantity").alias("median")))


@query(rounded_sql("""WITH i AS (SELECT p_brand, p_retailprice AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, x AS quantile FROM i WHERE i = floor(0.9 * (n - 1) + 0.5)""", "quantile"))
def nearest_rank_quantiles(spark, sf_dir):
    return rounded(stats.nearest_rank(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 0.9))


@query(rounded_sql("""WITH p AS (SELECT s_suppkey AS id, (s_acctbal + 1000) / 11000 AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM p)
SELECT id, p, least(1.0, min(p * m / r) OVER (ORDER BY r DESC)) AS q_bh, least(1.0, max(p * (m - r + 1)) OVER (ORDER BY r)) AS q_holm FROM r""", "p q_bh q_holm"))
def multiple_testing(spark, sf_dir):
    """Benjamini-Hochberg and Holm over one p-value for each supplier."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_acctbal") + 1000) / 11000).alias("p"))
    return rounded(stats.benjamini_hochberg(s))


@query(rounded_sql("""SELECT s_suppkey AS id, s_acctbal AS x, (SELECT count(*) FROM customer WHERE c_acctbal >= s_acctbal) AS n_above, (SELECT count(*) FROM customer WHERE c_acctbal >= s_acctbal) / (SELECT CAST(count(*) AS DOUBLE) FROM customer) AS p_share,
  (1 + (SELECT count(*) FROM customer WHERE c_acctbal >= s_acctbal)) / (1.0 + (SELECT count(*) FROM customer)) AS p_add_one FROM supplier""", "x p_share p_add_one"))
def empirical_p_values(spark, sf_dir):
    """Suppliers' balances against customers' as the null, by one sort of both."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return rounded(stats.empirical_p(s, table(spark, sf_dir, "customer"), "x", "c_acctbal"))


@query(rounded_sql("""WITH f AS (SELECT c_nationkey AS model, c_custkey % 5 AS fold, avg(c_acctbal) - 4500 AS edge FROM customer GROUP BY ALL) SELECT model, count(edge) AS folds, avg(CAST(edge > 0 AS INT)) AS positive, avg(edge) AS mean, stddev_samp(edge) AS sd, min(edge) AS min, max(edge) AS max,
  CASE WHEN stddev_samp(edge) > 0 THEN avg(edge) / (stddev_samp(edge) / sqrt(count(edge))) END AS t FROM f GROUP BY model""", "positive mean sd min max t"))
def fold_stability(spark, sf_dir):
    f = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("model"), (F.col("c_custkey") % 5).alias("fold")).agg((F.avg("c_acctbal") - 4500).alias("edge"))
    return rounded(stats.fold_stability(f, ["model"], "edge"))


@query(rounded_sql("""WITH u AS (SELECT 'p_brand' AS knob, p_brand AS setting, p_retailprice - 1000 AS x FROM part UNION ALL SELECT 'p_type', p_type, p_retailprice - 1000 FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), p_retailprice - 1000 FROM part)
SELECT knob, setting, count(*) AS n, avg(x) AS mean, median(x) AS median, avg(CAST(x > 0 AS INT)) AS positive FROM u GROUP BY ALL""", "mean median positive"))
def factor_effects(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("x", F.col("p_retailprice") - 1000)
    return rounded(stats.factor_effects(p, ["p_brand", "p_type", "p_size"], "x"))


@query(rounded_sql("SELECT p_brand, p_type, CAST(grouping_id(p_brand, p_type) AS BIGINT) AS level, count(*) AS n, avg(p_retailprice) AS mean FROM part GROUP BY CUBE (p_brand, p_type)", "mean"))
def factor_interactions(spark, sf_dir):
    return rounded(stats.interactions(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_retailprice"))


@query(rounded_sql("""WITH e AS (SELECT p_type AS knob, p_size AS setting, avg(p_retailprice) AS mean FROM part GROUP BY ALL), s AS (SELECT knob, mean - lag(mean) OVER (PARTITION BY knob ORDER BY setting) AS s FROM e)
SELECT knob, count(*) AS steps, avg(CAST(s > 0 AS INT)) AS up, bool_and(s >= 0) OR bool_and(s <= 0) AS monotone FROM s WHERE s IS NOT NULL GROUP BY knob""", "up"))
def factor_monotonicity(spark, sf_dir):
    e = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("knob"), F.col("p_size").alias("setting")).agg(F.avg("p_retailprice").alias("mean"))
    return rounded(stats.monotonicity(e, "knob", "setting", "mean"))


@query("""SELECT p_type, p_brand, count(*) AS models, count(*) FILTER (p_retailprice > 1500) AS edge_yes, arg_max(p_partkey, (p_retailprice, p_partkey)) AS best FROM part GROUP BY ALL""")
def registry_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("models"), F.count_if(F.col("p_retailprice") > 1500).alias("edge_yes"), F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"))


@query("""WITH m AS (SELECT p_partkey AS id, p_retailprice AS pf FROM part), meta AS (SELECT p_partkey AS id, p_retailprice + 1 AS pf FROM part WHERE p_partkey % 2 = 0), rep AS (SELECT p_partkey AS id, p_retailprice + 2 AS pf FROM part WHERE p_partkey % 3 = 0)
SELECT id, coalesce(rep.pf, meta.pf, m.pf) AS pf, CASE WHEN rep.pf IS NOT NULL THEN 'report' WHEN meta.pf IS NOT NULL THEN 'meta' ELSE 'manifest' END AS origin FROM m LEFT JOIN meta USING (id) LEFT JOIN rep USING (id)""")
def registry_precedence(spark, sf_dir):
    """Manifest, metadata and report of a model: the report's value first."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("pf"))
    meta, rep = p.filter("id % 2 = 0").select("id", (F.col("pf") + 1).alias("meta")), p.filter("id % 3 = 0").select("id", (F.col("pf") + 2).alias("report"))
    j = p.join(meta, "id", "left").join(rep, "id", "left")
    return j.select("id", joins.first_known("report", "meta", "pf").alias("pf"), F.when(F.col("report").isNotNull(), "report").when(F.col("meta").isNotNull(), "meta").otherwise("manifest").alias("origin"))


@query(rounded_sql("""WITH b AS (SELECT unnest(range(18)) AS bin), h AS (SELECT CAST(greatest(0, least(17, floor((s_acctbal + 1000) / (11000 / 18.0)))) AS INTEGER) AS bin, count(*) AS n FROM supplier GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, -1000.0 + b.bin * (11000 / 18.0) AS "from", coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bin)""", '"from"', 4))
def histogram(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "supplier"), "s_acctbal", -1000.0, 10000.0, 18), 4)


@query(rounded_sql(f"""WITH {LEDGER} SELECT symbol, count(*) AS n, sum(pnl) - 1.96 * stddev_samp(pnl) * sqrt(count(*)) AS lower_bound FROM trades GROUP BY symbol""", "lower_bound"))
def normal_lower_bounds(spark, sf_dir):
    return rounded(stats.lower_bound(ledger(spark, sf_dir), ["symbol"], "pnl"))


@query(rounded_sql(f"""WITH {LEDGER}, i AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY bucket_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM trades), f AS (SELECT symbol, ((i + 1) * 4 - 1) // n AS k, sum(pnl) AS s FROM i GROUP BY ALL),
g AS (SELECT symbol, sum(s) AS total, count(*) FILTER (s < 0) AS negatives, max(s) AS top FROM f GROUP BY symbol) SELECT symbol, total, negatives, CASE WHEN total > 0 THEN top / total END AS max_share, coalesce(total > 0 AND negatives <= 1 AND top / total <= 0.75, false) AS passes FROM g""", "total max_share"))
def subperiod_checks(spark, sf_dir):
    return rounded(stats.subperiods(ledger(spark, sf_dir), ["symbol"], ["bucket_ms"], "pnl"))


@query()
def effective_bets(spark, sf_dir):
    """Participation ratio and Kaiser count of the symbols' daily results."""
    d = ledger(spark, sf_dir).withColumn("day", F.floor(F.col("exit_time") / DAY))
    return rounded(stats.effective_bets(d, "symbol", "day", "pnl"))


@query(rounded_sql("""WITH x AS (SELECT vec_id AS id, label AS class, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)), f AS (SELECT class, i, avg(x) AS m, 1 / (var_pop(x) + 1e-6) AS w FROM x GROUP BY ALL),
s AS (SELECT x.id, f.class, round(sum((x.x - m) * (x.x - m) * w), 9) AS d FROM x JOIN f USING (i) GROUP BY ALL), b AS (SELECT id, min(d) AS distance, arg_min(class, (d, class)) AS regime FROM s GROUP BY id)
SELECT id, regime, distance, distance > (SELECT quantile_cont(distance, 0.99) FROM b) AS out FROM b""", "distance"))
def regime_detector(spark, sf_dir):
    """Nearest class by diagonal Mahalanobis distance and the far one percent."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(stats.regime_distances(e, "v", "label"))


@query(rounded_sql(f"""WITH {PREDICTIONS}, d AS (SELECT *, label % 3 AS t, CASE WHEN p_up >= p_neutral AND p_up >= p_down THEN 0 WHEN p_neutral >= p_down THEN 1 ELSE 2 END AS c, CASE label % 3 WHEN 0 THEN p_up WHEN 1 THEN p_neutral ELSE p_down END AS own FROM predictions)
SELECT avg(-ln(greatest(own, 1e-12)) * CASE WHEN abs(c - t) = 2 THEN 3.0 ELSE 1.0 END) AS directional, avg(greatest(0.9 * (ret - cost), -0.1 * (ret - cost))) AS pinball, avg((ret - cost) * (ret - cost)) AS mse, avg(CASE WHEN abs(ret) <= 0.1 THEN 0.5 * ret * ret ELSE 0.1 * (abs(ret) - 0.05) END) AS huber FROM d""", "directional pinball mse huber"))
def losses(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("p", F.array("p_up", "p_neutral", "p_down"))
    e = F.col("ret") - F.col("cost")
    return rounded(p.agg(F.avg(stats.directional_loss(F.col("p"), (F.col("label") % 3).cast("int"))).alias("directional"), F.avg(stats.pinball(F.col("ret"), F.col("cost"), 0.9)).alias("pinball"), F.avg(e * e).alias("mse"), F.avg(stats.huber(F.col("ret"), 0.1)).alias("huber")))


@query(rounded_sql(f"WITH {PREDICTIONS}, g AS (SELECT label, avg(p_up - ret) AS g FROM predictions GROUP BY label) SELECT sum(g * g) AS penalty FROM g", "penalty"))
def environment_penalty(spark, sf_dir):
    return rounded(stats.environment_penalty(predictions(spark, sf_dir), "label", F.col("p_up") - F.col("ret")))


@query(f"""WITH {TICKS} SELECT count(*) AS rows, 0 AS mid, count(*) FILTER (seq % 50 = 0 AND abs((ask - bid) - (ask - bid) * 1.01) > 1e-9) AS spread FROM ticks""")
def feature_recheck(spark, sf_dir):
    """Stored features against their direct formula: how many differ."""
    d = ticks_of(spark, sf_dir).withColumn("spread", F.col("ask") - F.col("bid"))
    stored = d.withColumn("spread", F.when(F.col("seq") % 50 == 0, F.col("spread") * 1.01).otherwise(F.col("spread")))
    return stats.mismatches(stored, d, ["symbol", "seq"], ["mid", "spread"], 1e-9).withColumn("mid", F.col("mid").cast("int"))


# --- resampling and controls -----------------------------------------------------------------


def numbered_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.numbered(ledger(spark, sf_dir), ["symbol"], ["bucket_ms"])


@query()
def bootstrap_totals(spark, sf_dir):
    return rounded(resample.quantiles(resample.bootstrap_sums(numbered_trades(spark, sf_dir), ["symbol"], "pnl", 200, 11), ["symbol"]))


@query()
def block_bootstrap_totals(spark, sf_dir):
    return rounded(resample.quantiles(resample.block_bootstrap_sums(numbered_trades(spark, sf_dir), ["symbol"], "pnl", 8, 500, 11), ["symbol"]))


_MOVES = f"{TICKS}, {SIGNALS}, moves AS (SELECT symbol, pos, signal, lead(close, {HOLD}) OVER w - close AS move, count(*) OVER (PARTITION BY symbol) AS n FROM signals WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms))"


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = signals(spark, sf_dir)
    return s.withColumns({"move": F.lead("close", HOLD).over(Window.partitionBy("symbol").orderBy("bucket_ms")) - F.col("close"), "n": F.count("*").over(Window.partitionBy("symbol"))})


@query(rounded_sql(f"""WITH {_MOVES}, sh(shift) AS (VALUES (0), (37), (101), (211), (307), (401)), t AS (SELECT mv.symbol, sh.shift, sum(mv.signal * x.move) AS total FROM moves mv, sh, moves x WHERE mv.signal <> 0 AND x.symbol = mv.symbol AND x.pos = (mv.pos + sh.shift) % mv.n GROUP BY ALL), r AS (SELECT symbol, total AS real FROM t WHERE shift = 0)
SELECT t.symbol, real, count(*) AS controls, avg(total) AS control_mean, 100 * avg(CAST(total < real AS INT)) AS rank_percent FROM t JOIN r USING (symbol) WHERE shift <> 0 GROUP BY t.symbol, real""", "real control_mean rank_percent"))
def shift_controls(spark, sf_dir):
    """The signal against circularly shifted moves."""
    return rounded(resample.shift_controls(moves(spark, sf_dir), "signal", "move", ["symbol"], (37, 101, 211, 307, 401)))


@query()
def permutation_tests(spark, sf_dir):
    return rounded(resample.permutation_p(moves(spark, sf_dir).filter("move is not null"), "signal", "move", ["symbol"], 50, 13))


@query()
def random_portfolios(spark, sf_dir):
    """Sums over ten random suppliers, five hundred times."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return rounded(resample.quantiles(resample.random_portfolios(s, "s_acctbal", 10, 500, 17).withColumn("k", F.lit("all")), ["k"]))


@query(rounded_sql(f"""WITH {_MOVES} SELECT m.symbol, m.pos, x.close AS close_rolled FROM signals m JOIN (SELECT symbol, count(*) AS n FROM signals GROUP BY symbol) c USING (symbol) JOIN signals x ON x.symbol = m.symbol AND x.pos = (m.pos - 5 + c.n) % c.n""", "close_rolled"))
def rolled_closes(spark, sf_dir):
    """A circular shift by five."""
    return rounded(resample.rolled(moves(spark, sf_dir), "close", 5, ["symbol"]).select("symbol", "pos", "close_rolled"))


@query(f"""WITH {TICKS}, {SAMPLES}, i AS (SELECT symbol, t_index, row_number() OVER (PARTITION BY symbol ORDER BY t_index) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM samples), b AS (SELECT *, ((i + 1) * 5 - 1) // n AS block FROM i),
v AS (SELECT symbol, block AS fold, min(t_index) AS val_start FROM b WHERE block > 0 GROUP BY ALL), e AS (SELECT symbol, block + 1 AS block, max(t_index) AS ended FROM b WHERE block > 0 GROUP BY ALL),
r AS (SELECT b.symbol, v.fold, CASE WHEN b.block = v.fold THEN 'validate' WHEN b.block < v.fold AND t_index + {WINDOW + HORIZON} < val_start AND NOT coalesce(t_index <= ended + 40, false) THEN 'train' END AS role FROM b JOIN v USING (symbol) LEFT JOIN e ON e.symbol = b.symbol AND e.block = b.block)
SELECT symbol, CAST(fold AS BIGINT) AS fold, role, count(*) AS samples FROM r WHERE role IS NOT NULL GROUP BY ALL""")
def walk_forward_roles(spark, sf_dir):
    """Anchored folds, purged before each block and embargoed after earlier ones."""
    out = resample.walk_forward(samples_of(spark, sf_dir), 4, WINDOW, HORIZON, 40)
    return out.groupBy("symbol", F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("samples"))


# --- search ----------------------------------------------------------------------------------

_GRID_FEATURES = ("mom3", "mom12", "range")
_GRID = f"""{TICKS}, {SIGNALS}, g AS (SELECT symbol, bucket_ms, spread, pos, n, coalesce(step, 0) AS step, high - low AS range, ln(close) - ln(lag(close, 3) OVER w) AS mom3, ln(close) - ln(lag(close, 12) OVER w) AS mom12, lead(close, 6) OVER w - close AS move FROM m WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)),
l AS (SELECT symbol, bucket_ms, pos, n, spread, move, 'mom3' AS feature, mom3 AS x FROM g UNION ALL SELECT symbol, bucket_ms, pos, n, spread, move, 'mom12', mom12 FROM g UNION ALL SELECT symbol, bucket_ms, pos, n, spread, move, 'range', range FROM g),
c AS (SELECT symbol, feature, 0.7::DOUBLE AS q, quantile_cont(abs(x), 0.7) AS threshold FROM l WHERE pos * 2 < n GROUP BY symbol, feature UNION ALL SELECT symbol, feature, 0.9::DOUBLE, quantile_cont(abs(x), 0.9) FROM l WHERE pos * 2 < n GROUP BY symbol, feature),
t AS (SELECT l.symbol, l.feature, c.q, mo.mode, CASE WHEN pos * 2 < n THEN 'train' ELSE 'test' END AS part, sign(x) * CASE WHEN mo.mode = 'fade' THEN -1 ELSE 1 END * move - greatest(spread, 0) AS pnl FROM l JOIN c USING (symbol, feature), (VALUES ('follow'), ('fade')) mo(mode) WHERE abs(x) > threshold AND move IS NOT NULL),
candidates AS (SELECT symbol, feature, q, mode, {", ".join(f"count(pnl) FILTER (part = '{p}') AS {p}_trades, coalesce(sum(pnl) FILTER (part = '{p}'), 0.0) AS {p}_pnl, coalesce(avg(pnl) FILTER (part = '{p}') / nullif(stddev_samp(pnl) FILTER (part = '{p}'), 0) * sqrt(count(pnl) FILTER (part = '{p}')), 0.0) AS {p}_sharpe" for p in ("train", "test"))} FROM t GROUP BY ALL)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w, whole = Window.partitionBy("symbol").orderBy("bucket_ms"), Window.partitionBy("symbol")
    m = b.bars(ticks_of(spark, sf_dir), HOUR).withColumns({"pos": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "range": F.col("high") - F.col("low"), "mom3": F.log("close") - F.log(F.lag("close", 3).over(w)), "mom12": F.log("close") - F.log(F.lag("close", 12).over(w)), "move": F.lead("close", 6).over(w) - F.col("close")})
    m = m.withColumn("part", F.when(F.col("pos") * 2 < F.col("n"), "train").otherwise("test"))
    rows = search.melted(m, ("symbol", "part", "spread", "move"), _GRID_FEATURES)
    cuts = search.thresholds(rows, (0.7, 0.9), ("symbol", "feature"), F.col("part") == "train")
    trades = search.candidate_trades(rows, cuts, ("follow", "fade"), "move", F.greatest("spread", F.lit(0.0)), ("symbol", "feature"))
    return search.candidate_stats(trades, ("symbol", "feature", "q", "mode"), ("train", "test"))


_GRID_DOUBLES = "q train_pnl train_sharpe test_pnl test_sharpe"
_GRID_COLUMNS = "symbol, feature, q, mode, train_trades, train_pnl, train_sharpe, test_trades, test_pnl, test_sharpe"


@query(rounded_sql(f"WITH {_GRID} SELECT {_GRID_COLUMNS} FROM candidates", _GRID_DOUBLES, 5))
def grid_search(spark, sf_dir):
    """Symbols, features, quantiles and sides: statistics of all candidates in one aggregate."""
    return rounded(candidates(spark, sf_dir).select(*_GRID_COLUMNS.split(", ")), 5)


@query(rounded_sql(f"WITH {_GRID} SELECT symbol, feature, q, mode, train_pnl, test_pnl FROM candidates WHERE train_pnl > 0 AND test_pnl > 0 AND train_trades BETWEEN 20 AND 100000 AND test_trades BETWEEN 20 AND 100000", "q train_pnl test_pnl", 5))
def grid_gates(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return rounded(c.filter(search.qualifies(("train", "test"), 20, 100_000)).select("symbol", "feature", "q", "mode", "train_pnl", "test_pnl"), 5)


@query(rounded_sql(f"WITH {_GRID} SELECT symbol, feature, q, mode, least(train_sharpe, test_sharpe) AS score FROM candidates ORDER BY score DESC, symbol, feature, q, mode LIMIT 10", "q score", 5))
def grid_best(spark, sf_dir):
    """The ten candidates with the best worse half."""
    return rounded(search.best(candidates(spark, sf_dir), ("train", "test"), 10, ("symbol", "feature", "q", "mode")).select("symbol", "feature", "q", "mode", "score"), 5)


@query(rounded_sql(f"""WITH {_GRID}, sc AS (SELECT *, least(train_sharpe, test_sharpe) AS score FROM candidates), fi AS (SELECT *, row_number() OVER (PARTITION BY symbol, feature ORDER BY score DESC, q, mode) AS k FROM sc)
SELECT symbol, feature, q, mode, score FROM fi WHERE k = 1 ORDER BY score DESC, symbol, feature LIMIT 5""", "q score", 5))
def grid_diversified(spark, sf_dir):
    """The five best, no two of one symbol and feature."""
    c = candidates(spark, sf_dir).withColumn("score", F.least("train_sharpe", "test_sharpe"))
    return rounded(search.diversified(c, ("symbol", "feature"), "score", 5, ("symbol", "feature", "q", "mode")).select("symbol", "feature", "q", "mode", "score"), 5)


@query(f"""WITH {_GRID}, sc AS (SELECT symbol, feature, mode, max(least(train_sharpe, test_sharpe)) AS score FROM candidates GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, symbol, feature, mode) AS i FROM sc)
SELECT a.i AS i_a, b.i AS i_b, a.symbol AS symbol_a, b.symbol AS symbol_b FROM r a JOIN r b ON a.i < b.i AND a.feature <> b.feature WHERE a.i <= 8 AND b.i <= 8""")
def candidate_pairs(spark, sf_dir):
    """Pairs of the eight best candidates that use different features."""
    from pyspark.sql import Window

    c = candidates(spark, sf_dir).groupBy("symbol", "feature", "mode").agg(F.max(F.least("train_sharpe", "test_sharpe")).alias("score"))
    top = c.orderBy(F.col("score").desc(), "symbol", "feature", "mode").limit(8)
    ranked = top.withColumn("i", F.row_number().over(Window.partitionBy().orderBy(F.col("score").desc(), "symbol", "feature", "mode")).cast("long"))
    return joins.pairs_of(ranked, "i", "feature", ("i", "feature", "symbol")).select("i_a", "i_b", "symbol_a", "symbol_b")


@query(rounded_sql("""WITH p(w, q, h) AS (VALUES (24, 0.85::DOUBLE, 12), (42, 0.79::DOUBLE, 24)), s(change, a, b, c) AS (VALUES ('base', 1.0, 1.0, 1.0), ('window_down', 0.8, 1.0, 1.0), ('window_up', 1.2, 1.0, 1.0), ('quantile_down', 1.0, 0.9, 1.0), ('quantile_up', 1.0, 1.1, 1.0), ('horizon_down', 1.0, 1.0, 0.8), ('horizon_up', 1.0, 1.0, 1.2))
SELECT change, CAST(greatest(1, round(w * a)) AS INTEGER) AS w, least(0.999, q * b) AS q, CAST(greatest(1, round(h * c)) AS INTEGER) AS h FROM p, s""", "q"))
def perturbed_parameters(spark, sf_dir):
    return rounded(search.perturbed(spark.createDataFrame([(24, 0.85, 12), (42, 0.79, 24)], "w int, q double, h int"), "w", "q", "h").select("change", "w", "q", "h"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_acctbal / 2000 AS t, CAST(s_suppkey % 60 AS DOUBLE) AS n_eff, s_acctbal AS edge, (s_suppkey % 20) / 100.0 AS q FROM supplier)
SELECT id, CASE WHEN q <= 0.05 AND n_eff >= 30 AND edge > 0 AND t > 2 THEN 'GO' WHEN (q <= 0.05 AND n_eff >= 30) OR (edge > 0 AND t > 2) THEN 'WATCH' ELSE 'NO' END AS decision, list_filter([CASE WHEN edge <= 0 THEN 'no edge' END, CASE WHEN n_eff < 30 THEN 'few trades' END, CASE WHEN q > 0.05 THEN 'not significant' END], lambda x: x IS NOT NULL)::VARCHAR AS reasons FROM s""")
def decisions(spark, sf_dir):
    """GO, WATCH or NO, and the rules against it."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 2000).alias("t"), (F.col("s_suppkey") % 60).cast("double").alias("n_eff"), F.col("s_acctbal").alias("edge"), ((F.col("s_suppkey") % 20) / 100.0).alias("q"))
    why = search.reasons(**{"no edge": F.col("edge") <= 0, "few trades": F.col("n_eff") < 30, "not significant": F.col("q") > 0.05})
    return search.decision(s, "t", "n_eff", "edge", "q").select("id", "decision", F.concat(F.lit("["), F.array_join(why, ", "), F.lit("]")).alias("reasons"))


@query(rounded_sql(f"""WITH {LEDGER}, lo AS (SELECT DISTINCT symbol AS left_out FROM trades), t AS (SELECT left_out AS symbol, bucket_ms, pnl FROM trades, lo WHERE symbol <> left_out)
SELECT symbol AS left_out, count(*) AS trades, sum(pnl) AS pnl, avg(CAST(pnl > 0 AS INT)) AS win_rate FROM t GROUP BY symbol""", "pnl win_rate"))
def leave_one_out(spark, sf_dir):
    """All trades but one symbol's, for each symbol."""
    t = ledger(spark, sf_dir)
    out = joins.leave_one_out(t, "symbol", {"pnl": F.col("pnl"), "wins": (F.col("pnl") > 0).cast("long")})
    return rounded(out.select("left_out", F.col("rows").alias("trades"), "pnl", (F.col("wins") / F.col("rows")).alias("win_rate")))


# --- scoring ---------------------------------------------------------------------------------

_W = [[((k * 7 + i * 3) % 11 - 5) / 10 for i in range(64)] for k in range(3)]
_LOGITS = ", ".join("list_inner_product(e, [" + ", ".join(f"{x}::DOUBLE" for x in w) + f"]) + {k / 10} AS z{k}" for k, w in enumerate(_W))


@query(rounded_sql(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), z AS (SELECT vec_id, {_LOGITS} FROM v)
SELECT vec_id, exp(z0) / (exp(z0) + exp(z1) + exp(z2)) AS p0, exp(z1) / (exp(z0) + exp(z1) + exp(z2)) AS p1, exp(z2) / (exp(z0) + exp(z1) + exp(z2)) AS p2 FROM z""", "p0 p1 p2"))
def linear_scores(spark, sf_dir):
    """A linear model with fixed weights, softmax in the JVM."""
    e = table(spark, sf_dir, "embeddings").withColumn("p", scoring.linear_probabilities(F.col("embedding"), _W, [0.0, 0.1, 0.2]))
    return rounded(e.select("vec_id", *(F.col("p")[k].alias(f"p{k}") for k in range(3))))


@query(rounded_sql(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), z AS (SELECT vec_id, {_LOGITS} FROM v), h AS (SELECT vec_id, greatest(z0, 0) AS a, greatest(z1, 0) AS b, greatest(z2, 0) AS c FROM z)
SELECT vec_id, exp(a - b) / (exp(a - b) + exp(c)) AS p0 FROM h""", "p0"))
def mlp_scores(spark, sf_dir):
    """A perceptron with one hidden layer, Arrow batches at a time."""
    import numpy as np

    layers = [(np.array(_W).T, np.array([0.0, 0.1, 0.2])), (np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]]), np.zeros(2))]
    out = scoring.mlp_probabilities(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", layers)
    return rounded(out.select("vec_id", F.col("p")[0].alias("p0")))


@query("""WITH v AS (SELECT vec_id, sign(embedding[1]) AS a, sign(embedding[2]) AS b, sign(embedding[3]) AS c FROM embeddings)
SELECT vec_id, CASE WHEN CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(c > 0 AS INT) > 1.5 THEN 1 WHEN CAST(a < 0 AS INT) + CAST(b < 0 AS INT) + CAST(c < 0 AS INT) > 1.5 THEN -1 ELSE 0 END AS side, greatest(CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(c > 0 AS INT), CAST(a < 0 AS INT) + CAST(b < 0 AS INT) + CAST(c < 0 AS INT)) AS agree FROM v""")
def model_vote(spark, sf_dir):
    side, agree = scoring.vote([F.col("embedding")[k] for k in range(3)])
    return table(spark, sf_dir, "embeddings").select("vec_id", side.alias("side"), agree.alias("agree"))


@query()
def fitted_models(spark, sf_dir):
    """A temperature and a logistic regression fitted by aggregates; one row."""
    e = table(spark, sf_dir, "embeddings").select("label", *(F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(4)), F.array(*(F.col("embedding")[k].cast("double") * 20 for k in range(3))).alias("z"))
    w, bias = scoring.logistic_fit(e.withColumn("y", (F.col("label") == 0).cast("int")), [f"x{k}" for k in range(4)], "y")
    t = scoring.temperature(e.withColumn("t", (F.col("label") % 3).cast("int")), "z", "t")
    return spark.createDataFrame([(round(t, 6), round(bias, 6), [round(float(x), 6) for x in w], scoring.formula(w, [f"x{k}" for k in range(4)]))], "temperature double, bias double, weights array<double>, formula string")


@query()
def normal_functions(spark, sf_dir):
    """Normal distribution function and its inverse at many points."""
    d = spark.range(1, 200).select((F.col("id") / 200).alias("p"))
    return rounded(d.select("p", normal_ppf(F.col("p")).alias("z"), normal_cdf(normal_ppf(F.col("p"))).alias("back")))




# --- controls and studies --------------------------------------------------------------------


@query(rounded_sql(f"""WITH {PREDICTIONS}, d AS (SELECT CASE WHEN p_up >= p_neutral AND p_up >= p_down THEN 1 WHEN p_neutral >= p_down THEN 0 ELSE -1 END AS call, ret, cost, p_up, p_down FROM predictions), l AS (SELECT *, CASE WHEN call = 0 THEN abs(ret) ELSE call * ret END AS profit FROM d)
SELECT avg(CASE WHEN call = 0 THEN 0.1 * greatest(profit - cost, 0.0) WHEN profit - cost < 0 THEN -3.0 * (profit - cost) ELSE -(profit - cost) END) AS trader, -avg(call * ret - cost) / stddev_samp(call * ret - cost) AS sharpe, avg(greatest(0.0, p_up - p_down + 1.0)) AS triplet FROM l""", "trader sharpe triplet"))
def trading_losses(spark, sf_dir):
    """Profit-based loss, Sharpe loss and triplet loss."""
    p = predictions(spark, sf_dir)
    call = F.when((F.col("p_up") >= F.col("p_neutral")) & (F.col("p_up") >= F.col("p_down")), 1).when(F.col("p_neutral") >= F.col("p_down"), 0).otherwise(-1)
    d = p.withColumn("call", call).withColumns({"profit": F.when(F.col("call") == 0, F.abs("ret")).otherwise(F.col("call") * F.col("ret")), "net": F.col("call") * F.col("ret") - F.col("cost")})
    return rounded(d.agg(F.avg(stats.trader_loss(F.col("call"), F.col("profit"), F.col("cost"))).alias("trader"), stats.sharpe_loss("net").alias("sharpe"), F.avg(stats.triplet(F.col("p_up"), F.col("p_down"))).alias("triplet")))


@query(rounded_sql(f"""WITH {TICKS}, {SIGNALS}, x AS (SELECT symbol, signal, spread, latency, CASE latency WHEN 0 THEN close WHEN 1 THEN lead(close, 1) OVER w WHEN 2 THEN lead(close, 2) OVER w ELSE lead(close, 3) OVER w END AS entry, CASE latency WHEN 0 THEN lead(close, {HOLD}) OVER w WHEN 1 THEN lead(close, {HOLD + 1}) OVER w WHEN 2 THEN lead(close, {HOLD + 2}) OVER w ELSE lead(close, {HOLD + 3}) OVER w END AS exit
  FROM signals, (VALUES (0), (1), (2), (3)) d(latency) WINDOW w AS (PARTITION BY symbol, latency ORDER BY bucket_ms))
SELECT latency, cost_mult, count(*) AS trades, sum(signal * (exit - entry) - greatest(spread, 0) * cost_mult) AS pnl FROM x, (VALUES (1), (2), (3), (4), (5)) c(cost_mult) WHERE signal <> 0 AND entry IS NOT NULL AND exit IS NOT NULL GROUP BY ALL""", "pnl", 4))
def cost_latency_grid(spark, sf_dir):
    """One to five times the cost, up to three bars late; costs are a column of the aggregate, not copies of the trades."""
    out = None
    s = signals(spark, sf_dir)
    for latency in range(4):
        t = simulate.overlapping(s, "signal", HOLD, 1.0, latency=latency)
        own = t.groupBy(F.lit(latency).alias("latency")).agg(F.count("*").alias("trades"), F.sum("gross").alias("g"), F.sum("cost").alias("c"))
        out = own if out is None else out.union(own)
    out = out.withColumn("cost_mult", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return rounded(out.select("latency", "cost_mult", "trades", (F.col("g") - F.col("c") * F.col("cost_mult")).alias("pnl")), 4)


@query(rounded_sql(f"""WITH {LEDGER}, f(fold, a, b) AS (VALUES (1, 1704067200000, 1704671700000), (2, 1704672000000, 1705276500000), (3, 1705276800000, 1705881300000), (4, 1705881600000, 1706486100000))
SELECT fold, count(*) AS trades, sum(pnl) AS pnl, coalesce(sum(pnl) > 0 AND count(*) >= 50, false) AS passes FROM trades JOIN f ON bucket_ms BETWEEN a AND b GROUP BY fold""", "pnl"))
def date_folds(spark, sf_dir):
    """Weeks as folds, each up to its last five minutes; all folds at once, none stopped early."""
    week = 7 * DAY
    f = spark.createDataFrame([(k + 1, 1_704_067_200_000 + k * week, 1_704_067_200_000 + (k + 1) * week - 300_000) for k in range(4)], "fold int, a long, b long")
    t = ledger(spark, sf_dir).join(F.broadcast(f), F.col("bucket_ms").between(F.col("a"), F.col("b")))
    return rounded(t.groupBy("fold").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"), F.coalesce((F.sum("pnl") > 0) & (F.count("*") >= 50), F.lit(False)).alias("passes")))


@query()
def null_study(spark, sf_dir):
    """Statistics of the momentum rule on twenty driftless series: their percentiles."""
    from pyspark.sql import Window

    from tickloom.sources import synthetic

    d = synthetic.random_walk(spark, 600, 23, volatility=1e-3, series=20)
    w = Window.partitionBy("symbol").orderBy("seq")
    x = d.withColumns({"step": F.log("mid") - F.log(F.lag("mid").over(w)), "spread": F.col("ask") - F.col("bid"), "bucket_ms": F.col("time_ms"), "close": F.col("mid")})
    x = x.withColumn("signal", F.coalesce(F.signum(F.sum("step").over(w.rowsBetween(-6, -1))), F.lit(0.0)).cast("int"))
    s = stats.trade_stats(simulate.overlapping(x, "signal", HOLD, 1.0), ["symbol"], ["bucket_ms"], 6.0, "pnl")
    return rounded(s.agg(F.count("*").alias("series"), *(F.percentile(c, q).alias(f"{c}_{int(q * 100)}") for c in ("profit_factor", "edge", "t_stat") for q in (0.05, 0.5, 0.95))))


@query("SELECT CAST(count(*) AS BIGINT) AS configs, count(DISTINCT (a, h)) AS models FROM (VALUES ('mlp'), ('linear')) x(a), (VALUES (64), (128), (256), (512), (1024), (2048)) y(h), (VALUES (1.0), (1.5), (2.0)) z(c), (VALUES (0.5), (1.0), (2.0)) k(k), (VALUES (1), (2), (3)) s(s)")
def sweep_configurations(spark, sf_dir):
    """All settings of a sweep as a table."""
    t = search.parameter_table(spark, arch=["mlp", "linear"], horizon=[64, 128, 256, 512, 1024, 2048], cost=[1.0, 1.5, 2.0], barrier=[0.5, 1.0, 2.0], seed=[1, 2, 3])
    return t.agg(F.count("*").alias("configs"), F.countDistinct("arch", "horizon").alias("models"))


@query("""SELECT id, t, row_number() OVER (ORDER BY t DESC NULLS LAST, id) AS place FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS t FROM supplier)""")
def ranking_nulls_last(spark, sf_dir):
    """Models by falling statistic, those without one last."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("t"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.col("t").desc_nulls_last(), "id")).cast("long"))


@query(rounded_sql(f"""WITH {TICKS}, {SIGNALS}, s2 AS (SELECT symbol, bucket_ms, close, ln(close) - ln(lag(close) OVER w) AS st FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bucket_ms)),
f AS (SELECT symbol, bucket_ms, CASE WHEN count(st) OVER a = 8 THEN sum(st) OVER a END AS raw, CASE WHEN count(st) OVER v = 48 THEN stddev_samp(st) OVER v END AS sd, sum(greatest(st, 0)) OVER a AS up, sum(greatest(-st, 0)) OVER a AS down FROM s2 WINDOW a AS (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY symbol ORDER BY bucket_ms ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))
SELECT symbol, bucket_ms, raw, raw / nullif(sd * sqrt(8.0), 0) AS volz, CASE WHEN (bucket_ms // {HOUR}) % 24 BETWEEN 7 AND 16 THEN raw / nullif(sd * sqrt(8.0), 0) END AS session_volz, raw / nullif(abs(lag(raw, 8) OVER (PARTITION BY symbol ORDER BY bucket_ms)), 0) AS ratio, up / nullif(up + down, 0) AS rsi FROM f""", "raw volz session_volz ratio rsi", 5))
def self_features(spark, sf_dir):
    """A symbol's own momentum features."""
    from tickloom.operators import indicators

    return rounded(indicators.self_features(b.bars(ticks_of(spark, sf_dir), HOUR), 8), 5)


@query()
def spread_z_scores(spark, sf_dir):
    """Exponential z of the price ratio of two symbols."""
    from tickloom.operators import indicators

    bars = b.bars(ticks_of(spark, sf_dir), HOUR)
    v, k = bars.filter("symbol = 'view'").select("bucket_ms", F.col("close").alias("a")), bars.filter("symbol = 'click'").select("bucket_ms", F.col("close").alias("b"))
    return rounded(indicators.ew_spread_z(v.join(k, "bucket_ms").withColumn("symbol", F.lit("ALL")), "a", "b", 24))
