"""Restatements in numpy and plain Python, closed forms, causality, and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns as c
from tickloom.operators import bars, features, indicators, joins, labels, normalize, quality, recursive, resample, scoring, search, simulate, stats
from tickloom.sources import files, synthetic, ticks as t


def make_ticks(spark, n=400, seed=1, symbol="A"):
    rng = np.random.default_rng(seed)
    mid = 100 + np.cumsum(rng.normal(0, 0.05, n))
    time = 1_704_067_200_000 + np.cumsum(rng.integers(0, 4000, n))
    df = pd.DataFrame({"symbol": symbol, "seq": np.arange(n), "time_ms": time, "ask": mid + 0.02, "bid": mid - 0.02, "mid": mid, "ask_vol": rng.integers(1, 50, n).astype(float), "bid_vol": rng.integers(1, 50, n).astype(float)})
    return spark.createDataFrame(df), df


def test_every_feature_is_causal(spark):
    """Cutting the future off changes no earlier row."""
    whole, _ = make_ticks(spark, 300)
    cut = whole.filter("seq < 200")
    for make in (features.tick_features, recursive.recursive_features):
        a = make(whole).filter("seq < 200").orderBy("seq").toPandas()
        b = make(cut).orderBy("seq").toPandas()
        pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, atol=1e-9)


def test_features_against_numpy(spark):
    d, df = make_ticks(spark, 300)
    got = features.tick_features(d, ["mom_64", "rv_32", "rv_256", "skew_64", "donch_32", "midz_64", "corr_ro_64", "kyle_hasbrouck", "dir_run", "ac2_64"]).orderBy("seq").toPandas()
    mid = df.mid.to_numpy()
    ret = np.r_[0, np.log((mid[1:] + 1e-8) / (mid[:-1] + 1e-8))]
    i = 250
    w = ret[i - 63 : i + 1]
    assert got.f_mom_64[i] == pytest.approx(w.sum(), abs=1e-9)
    assert got.f_rv_32[i] == pytest.approx(np.sqrt((ret[i - 31 : i + 1] ** 2).sum()), abs=1e-9)
    assert got.f_rv_256[i] == 0 and got.f_rv_256[255] == pytest.approx(np.sqrt((ret[:256] ** 2).sum()))
    m = w - w.mean()
    assert got.f_skew_64[i] == pytest.approx((m**3).mean() / (m**2).mean() ** 1.5, rel=1e-6)
    assert got.f_donch_32[i] == pytest.approx((mid[i] - mid[i - 31 : i + 1].min()) / np.ptp(mid[i - 31 : i + 1]))
    ofi = ((df.ask_vol - df.bid_vol) / (df.ask_vol + df.bid_vol + 1e-8)).to_numpy()
    assert got.f_corr_ro_64[i] == pytest.approx(np.corrcoef(w, ofi[i - 63 : i + 1])[0, 1], rel=1e-6)
    dmid, sv = np.r_[mid[0], np.diff(mid)], (df.ask_vol - df.bid_vol).to_numpy()
    assert got.f_kyle_hasbrouck[i] == pytest.approx(np.polyfit(sv[i - 63 : i + 1], dmid[i - 63 : i + 1], 1)[0], rel=1e-6)
    assert got.f_ac2_64[i] == pytest.approx((w[2:] * w[:-2]).sum() / (w**2).sum(), rel=1e-6)
    run, runs = 0, []
    for x in np.sign(dmid):
        run = run + int(x) if x and np.sign(run) == x else int(x) if x else run
        runs.append(run)
    assert got.f_dir_run.astype(int).tolist() == runs


def test_all_127_features_exist():
    own = len(features.FEATURES)
    rec = len(recursive.SPANS) + len(recursive.SPANS) - 1 + len(recursive.PERIODS) + 1
    assert own + rec == 127


def test_recursive_against_a_loop(spark):
    d, df = make_ticks(spark, 120)
    got = recursive.recursive_features(d).orderBy("seq").toPandas()
    e = g = l = None  # noqa: E741
    prev = 0.0
    for i, m in enumerate(df.mid):
        e = m if e is None else e
        e += 2 / 17 * (m - e)
        step = m - prev
        prev = m
        up, down = max(step, 0), max(-step, 0)
        g, l = (up, down) if g is None else (g, l)  # noqa: E741
        g += (up - g) / 14
        l += (down - l) / 14  # noqa: E741
        assert got.emadev_16[i] == pytest.approx((m - e) / (m + 1e-9), abs=1e-9)
        assert got.rsi_14[i] == pytest.approx(1 - 1 / (1 + g / (l + 1e-12)), abs=1e-9)
    own = d.select("symbol", "seq", "time_ms", "mid")
    chunked = recursive.exponential_mean(own, 2 / 17, chunk_rows=20, width_ms=10_000).orderBy("seq").toPandas()
    assert chunked.ema.iloc[-1] == pytest.approx(e)
    pd.testing.assert_frame_equal(recursive.recursive_features(d, 20, 10_000).orderBy("seq").toPandas(), got, rtol=1e-12)
    level, variance, levels = df.mid[0], 1.0, []
    for m in df.mid:
        gain = (variance + 1e-5) / (variance + 1e-5 + 1e-2)
        level, variance = level + gain * (m - level), (variance + 1e-5) * (1 - gain)
        levels.append(level)
    assert np.allclose(recursive.kalman_level(own, "mid", chunk_rows=20, width_ms=10_000).orderBy("seq").toPandas().level, levels)
    assert recursive.kalman_gains(np.arange(10**7 - 3, 10**7), 1e-5, 1e-2)[-1] == pytest.approx(recursive.kalman_gains(np.arange(1, 5000), 1e-5, 1e-2)[-1])


def test_features_of_a_long_series_near_2000(spark):
    """Chunks give what the whole series gives, bit for bit, and no digit goes on the way; long runs of one direction too."""
    rng = np.random.default_rng(5)
    n = 30_000
    step = rng.normal(0, 0.01, n)
    step[8000:14_000] = 0.01  # one run over many chunks
    step[20_000:23_000] = 0
    mid = 2000 + np.cumsum(step)
    df = pd.DataFrame({"symbol": "A", "seq": np.arange(n), "time_ms": 1_704_067_200_000 + np.cumsum(rng.integers(0, 4000, n)), "ask": mid + 0.02, "bid": mid - 0.02, "mid": mid, "ask_vol": rng.integers(1, 50, n).astype(float), "bid_vol": rng.integers(1, 50, n).astype(float)})
    d = spark.createDataFrame(df)
    got = features.tick_features(d, chunk_rows=2000).orderBy("seq").toPandas()
    pd.testing.assert_frame_equal(got, features.tick_features(d, chunk_rows=1 << 30).orderBy("seq").toPandas(), check_exact=True)
    for k in (64, 256, 1024):
        for i in range(1500, n, 613):
            w = mid[i - k + 1 : i + 1]
            if w.std() > 1e-6:
                assert got[f"f_midz_{k}"][i] == pytest.approx(np.clip((mid[i] - w.mean()) / w.std(), -6, 6), rel=1e-6, abs=1e-6)
    assert got.f_dir_run[13_999] >= 6000 and not got.isna().any().any()


def test_halo_gives_the_frames_of_the_whole_series(spark):
    from pyspark.sql import Window

    d, df = make_ticks(spark, 300)
    h = t.with_halo(d, 60_000, 20, 5)
    over = Window.partitionBy("symbol", "range").orderBy("time_ms", "seq").rowsBetween(-20, 5)
    got = h.withColumn("m", F.avg("mid").over(over)).filter("inside").orderBy("seq").toPandas()
    want = [df.mid[max(0, i - 20) : i + 6].mean() for i in range(len(df))]
    assert np.allclose(got.m, want) and len(got) == len(df)


def test_repair_and_counts_on_empty_and_leading_bad(spark):
    d, _ = make_ticks(spark, 5)
    bad = d.withColumn("ask", F.when(F.col("seq") < 2, None).otherwise(F.col("ask")))
    rows = quality.repaired(bad).orderBy("seq").collect()
    assert rows[0]["mid"] == 0 and rows[1]["repaired"] and not rows[2]["repaired"]
    assert quality.problem_counts(d.filter("seq < 0")).count() == 0
    assert quality.problem_counts(bad).first()["nonfinite"] == 2


def test_clock_turns_only_at_group_borders(spark):
    rows = [("A", 0, 0, 10), ("A", 1, 0, 90), ("A", 2, 1, 5), ("A", 3, 1, 3), ("A", 4, 2, 1)]
    d = spark.createDataFrame(rows, "symbol string, seq long, source_group long, clock_ms long")
    got = quality.unwrapped_clock(d, modulus=100).orderBy("seq").collect()
    assert [r["elapsed_ms"] for r in got] == [10, 90, 105, 103, 201]
    assert [r["clock_fault"] for r in got] == [False, False, False, True, False]


def test_bars_do_not_depend_on_partitioning(spark):
    d, _ = make_ticks(spark, 300)
    a = bars.bars(d.repartition(7), 60_000).orderBy("bucket_ms").toPandas()
    b = bars.bars(d.coalesce(1), 60_000).orderBy("bucket_ms").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert (a.high >= a[["open", "close"]].max(axis=1)).all() and (a.low <= a[["open", "close"]].min(axis=1)).all()


def test_cascade_closes_on_elapsed_time(spark):
    rows = [("A", i, 1000 * i, 10.0 + i, 1.0, 1.0) for i in range(7)]
    d = spark.createDataFrame(rows, "symbol string, seq long, time_ms long, mid double, ask_vol double, bid_vol double")
    got = bars.elapsed_cascade(d, (3000,)).orderBy("start_ms").collect()
    assert [(r["start_ms"], r["ticks"], r["close"]) for r in got] == [(0, 3, 12.0), (3000, 3, 15.0), (6000, 1, 16.0)]


def test_partial_bars_that_share_a_time(spark):
    """Parts that begin or end in one millisecond merge to the bar of all their ticks, however they come."""
    d, df = make_ticks(spark, 120)
    d = d.withColumn("time_ms", F.col("time_ms") - F.col("time_ms") % 20_000)
    whole = bars.bars(d, 20_000).orderBy("bucket_ms").toPandas()
    for order in ((0, 1, 2), (2, 1, 0)):
        parts = [bars.bars(d.filter(F.col("seq") % 3 == k), 20_000, seqs=True) for k in order]
        got = bars.merged_bars(parts[0].unionByName(parts[1]).unionByName(parts[2]).coalesce(1)).orderBy("bucket_ms").toPandas()
        assert (got.parts > 1).any() and got.open.tolist() == whole.open.tolist() and got.close.tolist() == whole.close.tolist()


def test_triple_barrier_against_a_loop(spark):
    d, df = make_ticks(spark, 300)
    w, h = 64, 32
    s = labels.samples(d, w, 16, h)
    got = labels.triple_barrier(d, s, w, h, 0.3).orderBy("t_index").toPandas()
    mid = df.mid.to_numpy()
    for r in got.itertuples():
        path, entry = mid[r.t_index + w : r.t_index + w + h], mid[r.t_index + w]
        hit = next((x for x in path if abs(x - entry) >= r.barrier), None)
        assert r.tb_label == (1 if hit is None else 0 if hit > entry else 2)
    assert len(got) == len(range(0, 300 - w - h + 1, 16))


def test_triple_barrier_of_an_entry_at_zero(spark):
    mid = [5.0] * 4 + [0.0, 1.0, 2.0] + [0.0] * 3
    rows = [("A", i, 1000 * i, x + 0.01 * x, x - 0.01 * x, x) for i, x in enumerate(mid)]
    d = spark.createDataFrame(rows, "symbol string, seq long, time_ms long, ask double, bid double, mid double")
    got = {r["t_index"]: r for r in labels.triple_barrier(d, labels.samples(d, 2, 1, 3), 2, 3).collect()}
    assert got[2]["tb_label"] == 0 and got[2]["exit_mid"] == 1.0 and got[2]["tb_ret"] == got[2]["tb_cost"] == math.inf
    assert math.isnan(got[5]["tb_ret"]) and math.isnan(got[5]["tb_cost"])
    assert got[0]["tb_ret"] == -1.0


def test_uniqueness_of_samples_apart_is_one(spark):
    d = spark.createDataFrame([("A", 0), ("A", 100), ("A", 200)], "symbol string, t_index long")
    assert [r["weight"] for r in labels.uniqueness(d, 50).collect()] == [1.0] * 3
    assert {r["weight"] for r in labels.uniqueness(spark.createDataFrame([("A", 0), ("A", 0)], "symbol string, t_index long"), 10).collect()} == {0.5}


def test_stop_and_target(spark):
    rows = [("A", i, p) for i, p in enumerate([100.0, 100.5, 102.0, 99.0, 100.0])]
    d = spark.createDataFrame(rows, "symbol string, bucket_ms long, close double")
    out = labels.stop_target_exit(d, F.lit(1), F.lit(1.0), F.lit(1.5), 3, indicators.order()).orderBy("bucket_ms").collect()
    assert [r["pnl"] for r in out] == [1.5, 1.5, -1.0, 1.0]


def test_cooldown_and_gross_cap(spark):
    d = spark.createDataFrame([("A", p) for p in (0, 1, 3, 4, 9)], "symbol string, pos long")
    assert [r["pos"] for r in simulate.with_cooldown(d, "pos", 3).orderBy("pos").collect()] == [0, 3, 9]
    rows = [("p", "a", 0, 10, 60.0, 1), ("p", "b", 5, 15, 60.0, 2), ("p", "c", 10, 20, 60.0, 1)]
    t_ = spark.createDataFrame(rows, "portfolio string, trade string, start long, stop long, amount double, rank int")
    got = {r["trade"]: r["filled"] for r in simulate.gross_cap(t_, 100.0, "portfolio", "start", "stop", "amount", "rank", "trade").collect()}
    assert got == {"a": 60.0, "b": 40.0, "c": 60.0}


def opportunities(spark, n=60, **over):
    rng = np.random.default_rng(3)
    up = rng.uniform(0.2, 0.8, n)
    df = pd.DataFrame({"block": 0, "t_index": np.arange(n), "time_ms": 1_704_067_200_000 + np.arange(n) * 3_600_000, "p_up": up, "p_neutral": 0.1, "p_down": 0.9 - up, "ret": rng.normal(0, 1, n), "cost": 0.01, "spread": 0.02, "rv": 5e-4, "tick_rate": 1.0, "momentum": rng.normal(0, 1, n)})
    return spark.createDataFrame(df.assign(**over)), df.assign(**over)


def test_strategy_with_neutral_knobs_takes_all_confident_trades(spark):
    d, df = opportunities(spark)
    got = simulate.simulate(d, simulate.Strategy()).orderBy("t_index").toPandas()
    best = df[["p_up", "p_neutral", "p_down"]].max(axis=1)
    taken = df[best >= 0.5]
    side = np.where(taken.p_up > taken.p_down, 1, -1)
    assert got.t_index.tolist() == taken.t_index.tolist()
    assert np.allclose(got.net, side * taken.ret - 0.01)


def test_strategy_halts_and_limits(spark):
    d, _ = opportunities(spark, ret=-1.0, p_up=0.8, p_down=0.1)
    assert simulate.simulate(d, simulate.Strategy(loss_streak_halt=3)).count() == 3
    assert simulate.simulate(d, simulate.Strategy(cooldown_after_loss=2)).count() == 20
    assert simulate.simulate(d, simulate.Strategy(daily_trade_cap=1)).count() == 3
    assert simulate.simulate(d, simulate.Strategy(short_only=True)).count() == 0
    assert simulate.simulate(d, simulate.Strategy(session_mask=1 << 5)).count() == 3
    assert simulate.simulate(d, simulate.Strategy(min_trade_spacing=10)).count() == 6


def test_levels_merge_and_leave():
    m = simulate.LevelMemory(0.5, fade=1.0, most=2)
    m.react(10.0, 1.0, 0)
    m.react(10.4, 1.0, 1)
    assert len(m.levels) == 1 and m.levels[0].price == pytest.approx(10.2)
    m.react(20.0, 5.0, 2)
    m.react(30.0, 0.5, 3)
    assert sorted(x.price for x in m.levels) == [pytest.approx(10.2), 20.0]
    assert m.nearest(15.0) == (pytest.approx(10.2), 20.0)


def test_daily_sharpe_closed_form(spark):
    rows = [(d, 1.1 if d % 2 == 0 else -0.9) for d in range(252)]
    d = spark.createDataFrame(rows, "day long, net double")
    assert stats.daily_sharpe(d, [], F.col("day")).first()["daily_sharpe"] == pytest.approx(0.1 * math.sqrt(252), rel=1e-9)
    assert stats.daily_sharpe(d.withColumn("net", F.lit(1.0)), [], F.col("day")).first()["daily_sharpe"] == 0.0


def test_normal_functions(spark):
    from statistics import NormalDist

    points = [0.001, 0.02, 0.3, 0.5, 0.7, 0.99]
    d = spark.createDataFrame([(p,) for p in points], "p double")
    for r in d.select("p", c.normal_ppf(F.col("p")).alias("z"), c.normal_cdf(c.normal_ppf(F.col("p"))).alias("b")).collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-6)
        assert r["b"] == pytest.approx(r["p"], abs=1e-6)


def test_multiple_testing_closed_form(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "id long, p double")
    got = {r["id"]: (round(r["q_bh"], 9), round(r["q_holm"], 9)) for r in stats.benjamini_hochberg(d).collect()}
    assert got == {1: (0.03, 0.03), 2: (0.04, 0.06), 3: (0.04, 0.06)}


def test_block_bootstrap_draws_circular_blocks(spark):
    d = resample.numbered(spark.createDataFrame([("A", i, float(2**i)) for i in range(6)], "k string, at long, pnl double"), ["k"], ["at"])
    got = resample.block_bootstrap_sums(d, ["k"], "pnl", 3, 50, 1).collect()
    v = [2.0**i for i in range(6)]
    blocks = {sum(v[(s + j) % 6] for j in range(3)) for s in range(6)}
    assert len(got) == 50 and all(r["total"] in {a + b for a in blocks for b in blocks} for r in got)


def test_poisson_bootstrap_is_centred_and_seeded(spark):
    d = resample.numbered(spark.createDataFrame([("A", i, 1.0) for i in range(200)], "k string, at long, pnl double"), ["k"], ["at"])
    a = resample.bootstrap_sums(d, ["k"], "pnl", 100, 5).orderBy("trial").toPandas()
    b = resample.bootstrap_sums(d.repartition(3), ["k"], "pnl", 100, 5).orderBy("trial").toPandas()
    assert abs(a.total.mean() - 200) < 8 and a.equals(b)


def test_null_walks_have_no_drift(spark):
    d = synthetic.random_walk(spark, 400, 3, series=8)
    last = d.filter("seq = 399").toPandas()
    sd = 1.2e-5 * math.sqrt(400)
    assert len(last) == 8 and (np.abs(np.log(last.mid / 2000)) < 5 * sd).all()


def test_constant_feature_normalises_to_zero(spark):
    d = spark.createDataFrame([("A", i, 42.0, 1.0) for i in range(32)] + [("A", 32, 42.0, 1.001)], "symbol string, seq long, x double, y double")
    z = normalize.frozen_after(d, ["x", "y"], "symbol", ["seq"], 32).filter("seq = 32").first()
    assert z["x_z"] == 0 and z["y_z"] == pytest.approx(0.001)


def test_softmax_of_large_logits(spark):
    r = spark.createDataFrame([([1000.0, 1001.0, 1002.0],)], "z array<double>").select(c.softmax(F.col("z")).alias("p")).first()["p"]
    assert sum(r) == pytest.approx(1) and r[2] == pytest.approx(0.665240955)


def test_logistic_fit_finds_the_side(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.5, 400) > 0).astype(int)
    d = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    w, bias = scoring.logistic_fit(d, ["a", "b"], "y")
    assert w[0] > 0 > w[1] and abs(bias) < 1 and scoring.formula(w, ["a", "b"], 1).endswith("*b")


def test_families_are_twenty_and_mirror(spark):
    assert len(indicators.FAMILIES) == 20
    names = ["ma48_144", "ma48_slope", "ma_dev12", "liquid", "r12", "ma12_48"]
    long = {"x_" + n + "_z": v for n, v in zip(names, (1.0, 1.0, -1.0, 1.0, 1.0, 1.0), strict=True)}
    short = {k: (v if "liquid" in k else -v) for k, v in long.items()}
    closed = long | {"x_liquid_z": -1.0}
    d = spark.createDataFrame(pd.DataFrame([long, short, closed]))
    assert [r[0] for r in d.select(indicators.family_direction("pullback", 0.3, 0.3)).collect()] == [1, -1, 0]


def test_archives_and_reports_and_settings(spark, tmp_path):
    import lzma

    raw = files.pack_record(5, 2_000_500, 2_000_000, 1.5, 2.5) + files.pack_record(9, 2_000_600, 2_000_100, 1.0, 1.0)
    d = spark.createDataFrame([(3_600_000, bytearray(lzma.compress(raw))), (7_200_000, bytearray())], "hour_ms long, content binary")
    got = files.read_archives(d).orderBy("seq").collect()
    assert [(r["time_ms"], r["ask"], r["bid_vol"]) for r in got] == [(3_600_005, 2000.5, 2.5), (3_600_009, 2000.6, 1.0)]
    folder = tmp_path / "2024" / "00" / "05"
    folder.mkdir(parents=True)
    (folder / "13h_ticks.bi5").write_bytes(lzma.compress(raw))
    assert files.archive_files(spark, str(tmp_path)).first()["hour_ms"] == 1_704_459_600_000
    numbers = " ".join(str(k + 0.5) for k in range(11))
    lines = [("r", 0, f"fold1: nan {numbers}"), ("r", 1, f"fold1: 3 {numbers}"), ("r", 2, "EDGE: yes (3)"), ("r", 3, "")]
    d = spark.createDataFrame(lines, "source string, line_no long, value string")
    row = files.parse_reports(d).first()
    assert row["trades"] == 3 and row["ci_hi"] == 10.5 and files.parse_verdicts(d).first()["verdict"] == "yes"
    path = tmp_path / "s.toml"
    path.write_text("[strategy]\nconf_gate = 0.7\n[data]\nwindow = 512\n")
    assert simulate.Strategy.of(files.settings(str(path), {"strategy.long_only": True})).conf_gate == 0.7
    assert files.parameter_key(a=1, b=2) == files.parameter_key(b=2, a=1)


def test_sinks_and_cache(spark, tmp_path):
    d = spark.createDataFrame([(2, float("nan")), (1, 1.5)], "k int, x double")
    files.write_parquet(d, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    files.write_jsonl(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).filter("x is null").count() == 1
    files.append_manifest(d, str(tmp_path / "m"))
    files.append_manifest(d, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 4
    made = []

    def make():
        made.append(1)
        return d

    for _ in range(2):
        assert files.kept(spark, str(tmp_path / "c"), make, window=5).count() == 2
    assert made == [1]
    files.write_csv(spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("2024-01-01 00:00:00", 2.0)], "time string, close double").coalesce(1), str(tmp_path / "b"))
    assert files.read_bars_csv(spark, str(tmp_path / "b"), "time timestamp, close double").collect()[0]["close"] == 1.0


def test_merge_with_defaults_and_as_of_tolerance(spark):
    a, b = spark.createDataFrame([(1, 10)], "k int, v int"), spark.createDataFrame([(1, 11, True), (2, 12, True)], "k int, v int, filled boolean")
    got = {r["k"]: (r["v"], r["filled"]) for r in joins.merged_by_priority([(a, {"filled": False}), (b, {})], ["k"]).collect()}
    assert got == {1: (10, False), 2: (12, True)}
    l, r = spark.createDataFrame([("A", 100), ("A", 500)], "symbol string, time_ms long"), spark.createDataFrame([("A", 90, 1.0)], "symbol string, time_ms long, x double")  # noqa: E741
    assert [x["x"] for x in joins.as_of(l, r, "x", tolerance_ms=50).orderBy("time_ms").collect()] == [1.0, None]


def test_grid_parameters_are_data(spark):
    assert search.parameter_table(spark, w=[1, 2], q=[0.1, 0.2, 0.3]).count() == 6


def test_breaks_with_volume_against_brute_force(spark):
    """sr_break_volume bar by bar, by the rule of run_indicator_strategy_search.py."""
    frames, want = [], {}
    for symbol, seed in (("A", 1), ("B", 2)):
        rng = np.random.default_rng(seed)
        n = 1200
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        open_ = np.r_[100, close[:-1]]
        high, low = np.maximum(open_, close) + rng.exponential(0.2, n), np.minimum(open_, close) - rng.exponential(0.2, n)
        ticks = rng.integers(20, 60, n) * np.where(rng.random(n) < 0.3, 6, 1)
        frames.append(pd.DataFrame({"symbol": symbol, "bucket_ms": 1_704_067_200_000 + 3_600_000 * np.arange(n), "open": open_, "high": high, "low": low, "close": close, "spread": 0.1, "ticks": ticks}))
        means = {5: float(ticks[0]), 10: float(ticks[0])}
        res, sup = [math.nan] * n, [math.nan] * n
        for i in range(n):
            if i:
                for k in means:
                    means[k] += 2 / (k + 1) * (ticks[i] - means[k])
                res[i], sup[i] = res[i - 1], sup[i - 1]
            j = i - 15
            if j >= 15:
                res[i] = high[j] if high[j] >= high[j - 15 : i + 1].max() else res[i]
                sup[i] = low[j] if low[j] <= low[j - 15 : i + 1].min() else sup[i]
            loud = 100 * (means[5] - means[10]) / means[10] > 20
            up = i and close[i] > res[i] and close[i - 1] <= res[i - 1] and not open_[i] - low[i] > close[i] - open_[i]
            down = i and close[i] < sup[i] and close[i - 1] >= sup[i - 1] and not open_[i] - close[i] < high[i] - open_[i]
            want[symbol, i] = 0 if not loud else 1 if up else -1 if down else 0
    d = spark.createDataFrame(pd.concat(frames)).repartition(3)
    got = indicators.chart_signals(d, F.timestamp_seconds(F.col("bucket_ms") / 1000)).select("symbol", "bucket_ms", "sr_break_volume").collect()
    assert {(r["symbol"], (r["bucket_ms"] - 1_704_067_200_000) // 3_600_000): r["sr_break_volume"] for r in got} == want
    assert {1, -1} <= set(want.values())
