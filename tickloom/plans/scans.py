"""Queries over scans, checks, filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.functions import columns as c
from tickloom.operators import bars as b
from tickloom.operators import joins, quality
from tickloom.plans.registry import TICKS, query, rounded, rounded_sql
from tickloom.sources import files, synthetic, ticks as t

#: Ticks with one fault by rule in some rows.
DIRTY = """dirty AS (
  SELECT symbol, seq, time_ms, CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 89 = 0 THEN -ask ELSE ask END AS ask,
    CASE WHEN seq % 83 = 0 THEN bid * 3 ELSE bid END AS bid, CASE WHEN seq % 79 = 0 THEN mid + 0.5 ELSE mid END AS mid,
    CASE WHEN seq % 73 = 0 THEN -1.0 ELSE ask_vol END AS ask_vol, bid_vol FROM ticks)"""


def dirty_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return t.ticks(spark, sf_dir).withColumns(
        {
            "ask": F.when(s % 97 == 0, None).when(s % 89 == 0, -F.col("ask")).otherwise(F.col("ask")),
            "bid": F.when(s % 83 == 0, F.col("bid") * 3).otherwise(F.col("bid")),
            "mid": F.when(s % 79 == 0, F.col("mid") + 0.5).otherwise(F.col("mid")),
            "ask_vol": F.when(s % 73 == 0, -1.0).otherwise(F.col("ask_vol")),
        }
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(rounded_sql(f"WITH {TICKS} SELECT symbol, seq, time_ms, ask, bid, mid, ask_vol, bid_vol FROM ticks", "ask bid mid ask_vol bid_vol", 8))
def tick_scan(spark, sf_dir):
    return rounded(t.ticks(spark, sf_dir), 8)


@query(rounded_sql(f"WITH {TICKS} SELECT symbol, seq, time_ms, mid FROM ticks ORDER BY time_ms, seq LIMIT 400 OFFSET 300", "mid"))
def tick_skip_take(spark, sf_dir):
    return rounded(t.skip_take(t.ticks(spark, sf_dir), 300, 400).select("symbol", "seq", "time_ms", "mid"))


@query(f"""WITH {TICKS}, x AS (SELECT *, lag(time_ms) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM ticks)
SELECT symbol, count(*) AS rows, count(*) FILTER (time_ms < before) AS steps_back,
  count(*) FILTER (time_ms < 946684800000 OR time_ms >= 4102444800000) AS out_of_range FROM x GROUP BY symbol""")
def tick_scan_problems(spark, sf_dir):
    return t.scan_problems(t.ticks(spark, sf_dir))


@query(f"WITH {TICKS} SELECT symbol, CAST(floor(seq / 1000.0) AS BIGINT) AS source_group, count(*) AS rows, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM ticks GROUP BY ALL")
def source_groups(spark, sf_dir):
    return t.with_source_group(t.ticks(spark, sf_dir), 1000).groupBy("symbol", "source_group").agg(F.count("*").alias("rows"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))


@query("""SELECT n_name, CASE WHEN n_name LIKE 'XAU%' OR n_name LIKE 'XAG%' OR contains(n_name, 'JPY') THEN 1000.0 ELSE 100000.0 END AS scale
FROM (SELECT n_name FROM nation UNION ALL SELECT 'XAU' || n_name FROM nation UNION ALL SELECT n_name || 'JPY' FROM nation)""")
def price_scales(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name")
    names = n.union(n.select(F.concat(F.lit("XAU"), "n_name"))).union(n.select(F.concat("n_name", F.lit("JPY"))))
    return names.select("n_name", files.price_scale(F.col("n_name")).alias("scale"))


@query(rounded_sql(f"""WITH {TICKS}, r AS (SELECT (time_ms // 3600000) * 3600000 AS hour_ms, round(ask * 1e6) / 1e6 AS ask, round(bid * 1e6) / 1e6 AS bid FROM ticks)
SELECT hour_ms, count(*) AS ticks, max(ask) AS ask, min(bid) AS bid FROM r GROUP BY hour_ms""", "ask bid", 4))
def archive_round_trip(spark, sf_dir):
    """Ticks written as hourly LZMA archives and read back."""
    back = files.read_archives(files.write_archives(t.ticks(spark, sf_dir), 1e6), 1e6)
    return rounded(back.groupBy("hour_ms").agg(F.count("*").alias("ticks"), F.max("ask").alias("ask"), F.min("bid").alias("bid")), 4)


@query("SELECT label, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y') || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE 'M' END || strftime(o_orderdate, '%m') AS label FROM orders) WHERE regexp_matches(label, '^\\d{4}M\\d{2}$') GROUP BY label")
def monthly_reference_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    lines = o.select(F.concat(F.date_format(d, "yyyy"), F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise("M"), F.date_format(d, "MM")).alias("label"))
    return files.monthly_rows(lines, "label").groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT p_partkey, json_object('id', p_partkey, 'metrics', json_object('pf', p_retailprice, 'trades', p_size)) AS meta FROM part)
SELECT p_partkey, CAST(json_extract(meta, '$.metrics.pf') AS DOUBLE) AS pf, CAST(json_extract(meta, '$.metrics.trades') AS BIGINT) AS trades FROM j""")
def nested_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    meta = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.struct(F.col("p_retailprice").alias("pf"), F.col("p_size").alias("trades")).alias("metrics")))
    got = p.select("p_partkey", F.from_json(meta, "id long, metrics struct<pf:double,trades:long>").alias("m"))
    return got.select("p_partkey", F.col("m.metrics.pf").alias("pf"), F.col("m.metrics.trades").alias("trades"))


@query("""WITH lines AS (SELECT CAST(p_partkey // 40 AS VARCHAR) AS source, p_partkey AS line_no, 'fold' || (p_partkey % 4) AS part, p_size AS trades, p_retailprice AS pf FROM part),
last AS (SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY line_no DESC) AS k FROM lines)
SELECT source, part, CAST(trades AS DOUBLE) AS trades, pf FROM last WHERE k = 1""")
def report_lines(spark, sf_dir):
    """Text report lines built from parts and parsed again: the last line of each part of a source."""
    p = table(spark, sf_dir, "part")
    zeros = [F.lit("0.0")] * 8
    line = F.concat_ws(" ", F.concat(F.lit("fold"), F.col("p_partkey") % 4, F.lit(":")), F.col("p_size"), F.lit("nan"), F.lit("0.5"), F.col("p_retailprice"), *zeros)
    lines = p.select((F.floor(F.col("p_partkey") / 40)).cast("string").alias("source"), F.col("p_partkey").alias("line_no"), line.alias("value"))
    return files.parse_reports(lines).select("source", "part", "trades", "pf")


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_size % 7 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END AS size_json FROM part""")
def finite_json(spark, sf_dir):
    """Values that JSON has no number for become null."""
    p = table(spark, sf_dir, "part")
    odd = F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    size = F.when(F.col("p_size") % 7 == 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    made = files.sanitised(p.select("p_partkey", odd.alias("price"), "p_size", size.alias("bad")))
    return made.select("p_partkey", "price", F.when(F.col("bad").isNull(), "null").otherwise(F.col("p_size").cast("string")).alias("size_json"))


@query("""WITH raw AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '' WHEN 2 THEN ' ' || CAST(s_suppkey AS VARCHAR) || '.5 ' WHEN 3 THEN 'None' ELSE 'x' || s_suppkey END AS raw, s_name FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 2 THEN s_suppkey + 0.5 END AS value, regexp_replace(s_name, '[^A-Za-z0-9]', '_', 'g') AS symbol FROM raw""")
def tolerant_numbers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    raw = F.when(k % 5 == 0, "nan").when(k % 5 == 1, "").when(k % 5 == 2, F.concat(F.lit(" "), k, F.lit(".5 "))).when(k % 5 == 3, "None").otherwise(F.concat(F.lit("x"), k))
    return s.select("s_suppkey", c.to_float(raw).alias("value"), c.safe_symbol(F.col("s_name")).alias("symbol"))


@query()
def random_walk_ticks(spark, sf_dir):
    """Driftless synthetic ticks, as many as there are events."""
    n = table(spark, sf_dir, "events").count()
    return synthetic.random_walk(spark, max(1, n // 5), seed=7, series=5)


@query()
def block_resampled_ticks(spark, sf_dir):
    return synthetic.block_resampled(t.ticks(spark, sf_dir), block=64, seed=7)


# --- checks and repair -----------------------------------------------------------------------

_BAD = {
    "nonfinite": "ask IS NULL OR bid IS NULL OR mid IS NULL OR ask_vol IS NULL OR bid_vol IS NULL",
    "nonpositive_price": "coalesce(ask <= 0 OR bid <= 0 OR mid <= 0, false)",
    "crossed_quote": "coalesce(bid > ask, false)",
    "negative_volume": "coalesce(ask_vol < 0 OR bid_vol < 0, false)",
    "mid_mismatch": "coalesce(abs(mid - (ask + bid) / 2) > 1e-8, false)",
}


@query(f"""WITH {TICKS}, {DIRTY} SELECT symbol, count(*) AS rows, {", ".join(f"count(*) FILTER ({x}) AS {n}" for n, x in _BAD.items())},
  count(*) FILTER (NOT ({" OR ".join(f"({x})" for x in _BAD.values())})) AS valid FROM dirty GROUP BY symbol""")
def tick_problem_counts(spark, sf_dir):
    return quality.problem_counts(dirty_ticks(spark, sf_dir))


@query(rounded_sql(f"""WITH {TICKS}, {DIRTY}, j AS (SELECT *, coalesce(ask > 0 AND bid > 0 AND bid <= ask, false) AS ok FROM dirty),
f AS (SELECT symbol, seq, time_ms, ok, coalesce(last_value(CASE WHEN ok THEN ask END IGNORE NULLS) OVER w, 0.0) AS ask, coalesce(last_value(CASE WHEN ok THEN bid END IGNORE NULLS) OVER w, 0.0) AS bid,
  CASE WHEN ask_vol >= 0 THEN ask_vol ELSE 0.0 END AS ask_vol, bid_vol, coalesce(ask_vol < 0, true) AS bad_vol FROM j WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq))
SELECT symbol, seq, time_ms, ask, bid, (ask + bid) / 2 AS mid, ask_vol, bid_vol, NOT ok OR bad_vol AS repaired FROM f""", "ask bid mid ask_vol bid_vol", 8))
def tick_repair(spark, sf_dir):
    return rounded(quality.repaired(dirty_ticks(spark, sf_dir)).select("symbol", "seq", "time_ms", "ask", "bid", "mid", "ask_vol", "bid_vol", "repaired"), 8)


@query(f"""WITH {TICKS}, m AS (SELECT symbol, seq, CAST(floor(seq / 100.0) AS BIGINT) AS source_group, time_ms % 400000000 AS clock_ms FROM ticks),
l AS (SELECT *, lag(clock_ms) OVER w AS p, lag(source_group) OVER w AS g FROM m WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
f AS (SELECT *, coalesce(clock_ms < p AND source_group <> g, false) AS wrapped, coalesce(clock_ms < p AND source_group = g, false) AS clock_fault FROM l)
SELECT symbol, seq, wrapped, clock_fault, CAST(clock_ms + sum(CAST(wrapped AS INT)) OVER (PARTITION BY symbol ORDER BY seq) * 400000000 AS BIGINT) AS elapsed_ms FROM f""")
def clock_unwrap(spark, sf_dir):
    """Ticks by a clock that starts again every 400,000 seconds."""
    m = t.with_source_group(t.ticks(spark, sf_dir), 100).withColumn("clock_ms", F.col("time_ms") % 400_000_000)
    return quality.unwrapped_clock(m, modulus=400_000_000).select("symbol", "seq", "wrapped", "clock_fault", "elapsed_ms")


@query(f"""WITH {TICKS}, g AS (SELECT symbol, time_ms - lag(time_ms) OVER (PARTITION BY symbol ORDER BY time_ms) AS gap FROM ticks)
SELECT symbol, {", ".join(f"count(*) FILTER (gap > {ms}) AS {n}" for n, ms in quality.GAPS.items())}, max(gap) AS max_gap_ms FROM g GROUP BY symbol""")
def tick_gaps(spark, sf_dir):
    return quality.gap_counts(t.ticks(spark, sf_dir))


# --- filters and projections -----------------------------------------------------------------


@query(rounded_sql(f"WITH {TICKS} SELECT symbol, seq, CASE WHEN seq % 11 = 0 THEN 0.0 ELSE ln(mid) END AS x, least(greatest((mid - 5) / 2, -2.0), 2.0) AS z FROM ticks", "x z"))
def finite_guard_and_clamp(spark, sf_dir):
    """Planted infinities guarded, the logarithms beside them as they are: minus infinity of a mid of 0."""
    d = t.ticks(spark, sf_dir)
    x = F.when(F.col("seq") % 11 == 0, c.finite(F.lit(float("inf")))).otherwise(c.ln(F.col("mid")))
    return rounded(d.select("symbol", "seq", x.alias("x"), c.clamp((F.col("mid") - 5) / 2, -2.0, 2.0).alias("z")))


@query(f"""WITH {TICKS}, h AS (SELECT *, CAST((time_ms % 86400000) // 3600000 AS INTEGER) AS hour FROM ticks)
SELECT hour, count(*) AS ticks, count(*) FILTER (hour >= 7 AND hour < 16) AS london, count(*) FILTER (hour >= 13 AND hour < 21) AS new_york,
  count(*) FILTER (hour >= 13 AND hour < 16) AS overlap, count(*) FILTER (hour < 7) AS asia, count(*) FILTER ((CAST(10485760 AS BIGINT) >> hour) & 1 = 1) AS masked FROM h GROUP BY hour""")
def session_masks(spark, sf_dir):
    """Sessions by hour, and a bit mask of hours."""
    d = t.ticks(spark, sf_dir).withColumn("hour", c.utc_hour(F.col("time_ms")))
    h = F.col("hour")
    return d.groupBy("hour").agg(F.count("*").alias("ticks"), F.count_if((h >= 7) & (h < 16)).alias("london"), F.count_if((h >= 13) & (h < 21)).alias("new_york"), F.count_if((h >= 13) & (h < 16)).alias("overlap"), F.count_if(h < 7).alias("asia"), F.count_if(c.bit_of(10485760, h)).alias("masked"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate <= TIMESTAMP '1999-12-31 23:55:00' AND l_discount = 0.0 AND l_tax IS NOT NULL GROUP BY ALL""")
def fold_slice(spark, sf_dir):
    """Rows of a date fold, its last day included up to its last five minutes, with quality predicates."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate").between(F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1999-12-31 23:55:00").cast("timestamp_ntz")))
    return li.filter((F.col("l_discount") == 0.0) & F.col("l_tax").isNotNull()).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(f"""WITH {TICKS}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time_ms, seq) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ticks), q AS (SELECT symbol, quantile_cont(ask - bid, 0.6) AS cut FROM p WHERE k * 2 <= n GROUP BY symbol)
SELECT t.symbol, count(*) AS kept, min(t.seq) AS first_seq FROM ticks t JOIN q ON t.symbol = q.symbol WHERE t.ask - t.bid <= q.cut GROUP BY t.symbol""")
def regime_quantile_filter(spark, sf_dir):
    """Ticks whose spread is at or below the 0.6 quantile fitted on the first half."""
    d = t.ticks(spark, sf_dir).withColumn("spread", F.col("ask") - F.col("bid"))
    first = d.withColumns({"k": F.row_number().over(t.by_symbol()), "n": F.count("*").over(Window.partitionBy("symbol"))}).filter("k * 2 <= n")
    cut = first.groupBy("symbol").agg(F.percentile("spread", 0.6).alias("cut"))
    return d.join(cut, "symbol").filter(F.col("spread") <= F.col("cut")).groupBy("symbol").agg(F.count("*").alias("kept"), F.min("seq").alias("first_seq"))


@query(rounded_sql(f"""WITH {TICKS}, d AS (SELECT symbol, time_ms // 86400000 AS day, count(DISTINCT time_ms // 3600000) AS hours FROM ticks GROUP BY ALL)
SELECT symbol, count(*) AS days, avg(hours / 24.0) AS coverage, count(*) FILTER (hours / 24.0 >= 0.8) AS covered FROM d WHERE (day + 3) % 7 < 5 GROUP BY symbol""", "coverage"))
def weekday_coverage(spark, sf_dir):
    """Share of the hours of weekdays that have ticks."""
    d = t.ticks(spark, sf_dir).select("symbol", c.utc_day(F.col("time_ms")).alias("day"), F.floor(F.col("time_ms") / 3_600_000).alias("hour")).distinct()
    daily = d.groupBy("symbol", "day").agg(F.count("*").alias("hours")).filter(F.pmod(F.col("day") + 3, F.lit(7)) < 5)
    share = F.col("hours") / 24.0
    return rounded(daily.groupBy("symbol").agg(F.count("*").alias("days"), F.avg(share).alias("coverage"), F.count_if(share >= 0.8).alias("covered")))


@query(f"""WITH {TICKS}, m AS (SELECT symbol, seq, mid - lag(mid) OVER (PARTITION BY symbol ORDER BY time_ms, seq) AS x FROM ticks)
SELECT symbol, seq, CASE WHEN x > 4 THEN 1 WHEN x < -4 THEN -1 ELSE 0 END AS follow, -(CASE WHEN x > 4 THEN 1 WHEN x < -4 THEN -1 ELSE 0 END) AS fade,
  CASE WHEN x >= 3 THEN 1 ELSE 0 END AS long_high, CASE WHEN x >= 3 THEN -1 ELSE 0 END AS short_high, CASE WHEN x <= -3 THEN 1 ELSE 0 END AS long_low,
  CASE WHEN x <= -3 THEN -1 ELSE 0 END AS short_low, CASE WHEN x >= 3 THEN 1 WHEN x <= -3 THEN -1 ELSE 0 END AS trend, CASE WHEN x >= 3 THEN -1 WHEN x <= -3 THEN 1 ELSE 0 END AS reversal,
  CASE WHEN x > 4 THEN 1 WHEN x < -4 THEN -1 ELSE 0 END AS agreed FROM m""")
def threshold_signals(spark, sf_dir):
    """Tri-state, follow and fade, the six one-feature rules and the agreement of two rules."""
    from tickloom.operators.indicators import both_agree, rule_direction

    x = F.col("mid") - F.lag("mid").over(t.by_symbol())
    d = t.ticks(spark, sf_dir).withColumn("x", x)
    follow = c.tri_state(F.col("x"), 4.0)
    rules = {m: rule_direction(F.col("x"), m, -3.0, 3.0) for m in ("long_high", "short_high", "long_low", "short_low", "trend", "reversal")}
    return d.select("symbol", "seq", follow.alias("follow"), (follow * F.lit(-1)).alias("fade"), *(v.alias(k) for k, v in rules.items()), both_agree(follow, rules["trend"]).alias("agreed"))


@query(rounded_sql("""SELECT vec_id, list_sum(list_transform(p, lambda x: x)) AS total, p[1] AS p0, lse, sg, sp FROM (
  SELECT vec_id, list_transform(z, lambda x: exp(x - m) / list_sum(list_transform(z, lambda y: exp(y - m)))) AS p, m + ln(list_sum(list_transform(z, lambda y: exp(y - m)))) AS lse,
    1 / (1 + exp(-z[1])) AS sg, ln(1 + exp(z[1])) AS sp
  FROM (SELECT vec_id, z, list_max(z) AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS z FROM embeddings)))""", "total p0 lse sg sp"))
def stable_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("z"))
    p = c.softmax(F.col("z"))
    return rounded(e.select("vec_id", F.aggregate(p, F.lit(0.0), lambda a, x: a + x).alias("total"), p[0].alias("p0"), c.log_sum_exp(F.col("z")).alias("lse"), c.sigmoid(F.col("z")[0]).alias("sg"), c.softplus(F.col("z")[0]).alias("sp")))


@query(rounded_sql("""WITH x AS (SELECT s_suppkey, s_acctbal / 2000 AS x FROM supplier) SELECT s_suppkey, greatest(x, 0.0) AS relu, CASE WHEN x > 0 THEN x ELSE 0.01 * x END AS leaky_relu,
  CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END AS elu, x / (1 + exp(-x)) AS silu, 0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))) AS gelu, tanh(x) AS tanh FROM x""", "relu leaky_relu elu silu gelu tanh"))
def activations(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 2000).alias("x"))
    return rounded(d.select("s_suppkey", *(c.ACTIVATIONS[n](F.col("x")).alias(n) for n in ("relu", "leaky_relu", "elu", "silu", "gelu", "tanh"))))


@query("""WITH o AS (SELECT CAST(epoch_ms(o_orderdate) AS BIGINT) AS ms, o_orderdate AS ts FROM orders)
SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, min(CAST(isodow(ts) AS INTEGER)) AS first_weekday, max(CAST(hour(ts) AS INTEGER)) AS last_hour, max(ms) - min(ms) AS span_ms FROM o GROUP BY 1""")
def calendar_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate", F.floor(t.millis(F.col("o_orderdate"))).cast("long").alias("ms"))
    d = F.col("o_orderdate")
    return o.groupBy(F.date_format(d, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min(F.weekday(d) + 1).alias("first_weekday"), F.max(F.hour(d)).alias("last_hour"), (F.max("ms") - F.min("ms")).alias("span_ms"))


@query("""SELECT l_returnflag, count(*) FILTER (l_discount = 0) AS undiscounted, count(*) FILTER (l_quantity > 25 AND l_tax < 0.05) AS large, bool_and(l_quantity >= 1) AS all_positive, bool_or(l_tax > 0.07) AS any_taxed, CAST(sum(l_linenumber) FILTER (l_linestatus = 'O') AS BIGINT) AS open_lines
FROM lineitem GROUP BY l_returnflag""")
def filtered_aggregates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q, x = F.col("l_quantity"), F.col("l_tax")
    return li.groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") == 0).alias("undiscounted"), F.count_if((q > 25) & (x < 0.05)).alias("large"), F.bool_and(q >= 1).alias("all_positive"), F.bool_or(x > 0.07).alias("any_taxed"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("open_lines"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderdate AS placed FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v, o_orderdate AS placed, true AS filled FROM orders WHERE o_orderkey % 2 = 0),
u AS (SELECT k, v, placed, false AS filled, 0 AS r FROM a UNION ALL BY NAME SELECT k, v, placed, filled, 1 AS r FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r) AS n FROM u)
SELECT k, v, filled FROM f WHERE n = 1""")
def priority_merge(spark, sf_dir):
    """A master table and its gap fills, by name, the master first for each key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("placed"))
    fills = o.filter("k % 2 = 0").withColumns({"v": F.col("v") * 2, "filled": F.lit(True)})
    return joins.merged_by_priority([(o.filter("k % 3 != 0"), {"filled": False}), (fills, {})], ["k"]).select("k", "v", "filled")


@query("""WITH a AS (SELECT c_nationkey, c_mktsegment FROM customer), s AS (SELECT s_nationkey AS c_nationkey FROM supplier WHERE s_acctbal > 5000)
SELECT c_nationkey, count(*) FILTER (c_nationkey IN (SELECT c_nationkey FROM s)) AS common, count(*) FILTER (c_nationkey NOT IN (SELECT c_nationkey FROM s)) AS only_a FROM a GROUP BY c_nationkey""")
def symbol_sets(spark, sf_dir):
    """Keys in both of two tables, and only in the first."""
    a = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    both, only = joins.common_to(a, s, ["c_nationkey"]).withColumn("w", F.lit(1)), joins.only_in(a, s, ["c_nationkey"]).withColumn("w", F.lit(0))
    return both.union(only).groupBy("c_nationkey").agg(F.count_if(F.col("w") == 1).alias("common"), F.count_if(F.col("w") == 0).alias("only_a"))


@query(rounded_sql(f"""WITH {TICKS}, g AS (SELECT CAST(floor(seq / 1000.0) AS BIGINT) AS source_group, time_ms % 864000000 AS clock_ms, mid AS price FROM ticks),
r AS (SELECT time_ms // 86400000 AS day, avg(mid) AS price FROM ticks GROUP BY 1), m AS (SELECT g.*, c.range AS cycle FROM g, range(1971, 1977) c),
s AS (SELECT source_group, cycle, avg(abs(m.price / r.price - 1)) AS score FROM m JOIN r ON r.day = (clock_ms + cycle * 864000000) // 86400000 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY source_group ORDER BY score, cycle) AS n FROM s)
SELECT source_group, CAST(max(CASE WHEN n = 1 THEN cycle - 1971 END) AS INTEGER) AS cycle, max(CASE WHEN n = 1 THEN score END) AS score, max(CASE WHEN n = 2 THEN score END) AS second_score FROM k WHERE n <= 2 GROUP BY source_group""", "score second_score"))
def clock_cycles(spark, sf_dir):
    """How often a ten-day clock had turned when a group was written, by distance from daily prices."""
    ten = 864_000_000
    g = t.with_source_group(t.ticks(spark, sf_dir), 1000).select("source_group", (F.col("time_ms") % ten + 1971 * ten).alias("clock_ms"), F.col("mid").alias("price"))
    r = t.ticks(spark, sf_dir).groupBy(c.utc_day(F.col("time_ms")).alias("day")).agg(F.avg("mid").alias("price"))
    return rounded(b.cycle_scores(g, r, 6, ten).drop("margin"))


@query("""WITH x AS (SELECT o_orderpriority AS g, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT g, k FROM x WHERE n <= 301 OR floor(ceil(i / (greatest(n - 1, 1) / 300.0)) * (greatest(n - 1, 1) / 300.0)) = i""")
def evenly_spaced_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"))
    return b.evenly_spaced(o, "g", ("k",))


@query("""WITH m AS (SELECT o_orderkey AS k, o_custkey AS v FROM orders), f AS (SELECT o_orderkey AS k, o_custkey + 1 AS v FROM orders WHERE o_orderkey % 4 = 0), g AS (SELECT o_orderkey AS k, o_custkey + 2 AS v FROM orders WHERE o_orderkey % 6 = 0)
SELECT m.k, coalesce(g.v, f.v, m.v) AS v, CASE WHEN g.v IS NOT NULL THEN 2 WHEN f.v IS NOT NULL THEN 1 ELSE 0 END AS source FROM m LEFT JOIN f USING (k) LEFT JOIN g USING (k)""")
def verification_overrides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    first, second = o.filter("k % 4 = 0").withColumn("v", F.col("v") + 1), o.filter("k % 6 = 0").withColumn("v", F.col("v") + 2)
    return joins.overridden(o, [first, second], "k", "v")


@query("""WITH r AS (SELECT l_orderkey AS source_group, l_partkey AS p FROM lineitem), a AS (SELECT CAST(p_size AS BIGINT) AS archive_id, p_partkey AS p FROM part)
SELECT source_group, count(*) AS matches, min(archive_id) AS archive_id FROM r JOIN a USING (p) GROUP BY source_group HAVING count(DISTINCT archive_id) = 1""")
def fingerprint_matches(spark, sf_dir):
    """Orders whose lines all meet one archive: the size of their parts."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_group"), F.col("l_partkey").alias("p"))
    a = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("archive_id"), F.col("p_partkey").alias("p"))
    return joins.unique_matches(r, a, ["p"], "source_group")
