"""DuckDB SQL for the tick features, each written out over its own direct frame."""

from __future__ import annotations

from collections.abc import Sequence

#: A series near 2,000 with spreads as wide as its moves and volumes that vary; what market.quotes_of gives.
QUOTES = """quotes AS (
  SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS time_ms, 2000 + value / 100 + (k + 1) / 100.0 AS ask, 2000 + value / 100 - (k + 1) / 100.0 AS bid,
    2000 + value / 100 AS mid, CAST(1 + k AS DOUBLE) AS ask_vol, CAST(1 + (event_id * 37 + k) % 97 AS DOUBLE) AS bid_vol
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY time_ms, seq), w64 AS (PARTITION BY symbol ORDER BY time_ms, seq ROWS 63 PRECEDING)"
_STEPS = f"""a AS (SELECT *, row_number() OVER w AS n, coalesce(lag(mid) OVER w, 0) AS pm, ask - bid AS spread, ask_vol + bid_vol AS vol, ask_vol - bid_vol AS svol,
  CASE WHEN lag(time_ms) OVER w IS NULL THEN 0.1 ELSE greatest(0.001, (time_ms - lag(time_ms) OVER w) / 1000.0) END AS dt FROM quotes {_W}),
b AS (SELECT *, spread / (mid + 1e-5) AS ns, svol / (vol + 1e-8) AS ofi, mid - pm AS move, (mid - pm) / dt AS vel, least(greatest(1 / dt, 0), 1000) AS rate, abs(mid - pm) / (vol + 1e-8) AS ami,
  CASE WHEN pm > 0 THEN ln((mid + 1e-8) / (pm + 1e-8)) ELSE 0.0 END AS ret, (ask * bid_vol + bid * ask_vol) / (vol + 1e-8) - mid AS mdv, nullif(sign(mid - pm), 0) AS moved FROM a),
c AS (SELECT *, ofi - coalesce(lag(ofi) OVER w, 0) AS d_ofi, vel - coalesce(lag(vel) OVER w, 0) AS accel, CAST(vel * coalesce(lag(vel) OVER w, 0) < 0 AND abs(move) < spread AS INTEGER) AS bnc,
  coalesce(last_value(moved IGNORE NULLS) OVER w, 0) AS dir, lag(ret) OVER w AS ret_1, lag(ret, 2) OVER w AS ret_2, lag(ret, 5) OVER w AS ret_5, move * lag(move) OVER w AS moves,
  CASE WHEN count(*) OVER w64 >= 16 AND var_pop(svol) OVER w64 * count(*) OVER w64 > 1e-10 THEN regr_slope(move, svol) OVER w64 ELSE 0.0 END AS kyle FROM b {_W}),
d AS (SELECT *, accel - coalesce(lag(accel) OVER w, 0) AS jerk, CASE WHEN dir > 0 THEN ask_vol ELSE 0 END AS buy, CASE WHEN dir < 0 THEN bid_vol ELSE 0 END AS sell, CAST(dir > 0 AS INTEGER) AS up,
  CAST(dir <> coalesce(lag(dir) OVER w, 0) AS INTEGER) AS turned FROM c {_W}),
e AS (SELECT *, sum(turned) OVER w AS island, (time_ms % 86400000) / 3.6e6 AS hour, (time_ms % 3600000) / 6e4 AS minute FROM d {_W}),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY time_ms, seq) AS run FROM e)"""
_SIZES = (8, 16, 32, 59, 62, 63, 64, 127, 128, 256, 512, 1024)


def _clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


def _z(x: str, m: int, least: str) -> str:
    return f"CASE WHEN stddev_pop({x}) OVER w{m} > {least} THEN {_clip(f'({x} - avg({x}) OVER w{m}) / stddev_pop({x}) OVER w{m}', -6, 6)} ELSE 0 END"


def _moment(m: int, power: int, less: int, low: int, high: int) -> str:
    """Standardised moment from the list of returns, deviations taken one by one."""
    held = f"list(ret) OVER w{m}"
    of = lambda p: f"list_avg(list_transform({held}, lambda x: power(x - list_avg({held}), {p})))"
    return f"CASE WHEN var_pop(ret) OVER w{m} > 1e-18 THEN {_clip(f'{of(power)} / power({of(2)}, {power / 2}) - {less}', low, high)} ELSE 0 END"


def _imbalance(m: int) -> str:
    return f"CASE WHEN sum(buy + sell) OVER w{m} > 1e-12 THEN sum(buy - sell) OVER w{m} / sum(buy + sell) OVER w{m} ELSE 0 END"


def _lag_corr(k: int) -> str:
    return f"CASE WHEN sum(ret * ret) OVER w64 > 1e-12 THEN {_clip(f'coalesce(sum(ret * ret_{k}) OVER w{64 - k}, 0) / sum(ret * ret) OVER w64', -1, 1)} ELSE 0 END"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) OVER w64 * sqrt(var_pop({x}) OVER w64 * var_pop({y}) OVER w64) * count(*) OVER w64 > 1e-12 THEN {_clip(f'covar_pop({x}, {y}) OVER w64 / (stddev_pop({x}) OVER w64 * stddev_pop({y}) OVER w64)', -1, 1)} ELSE 0 END"


_DEV = "sqrt(var_pop({}) OVER w32 + 1e-10)"
_UP = "(avg(up) OVER w64)"
_FALLS = "list_max(list_transform(list(mid) OVER w128, lambda x, i: (list_max((list(mid) OVER w128)[1:i]) - x) / (list_max((list(mid) OVER w128)[1:i]) + 1e-9)))"
TWINS: dict[str, str] = {
    **{x: x for x in ("ask", "bid", "mid", "ask_vol", "bid_vol", "spread")},
    "norm_spread": "ns", "ofi": "ofi", "d_ofi": "d_ofi", "mid_velocity": "vel", "mid_accel": "accel", "micro_dev": "mdv", "tick_rate": "rate", "log_tick_rate": "ln(1 + rate)",
    **{f"rv_{m}": f"CASE WHEN n >= {m} THEN sqrt(sum(ret * ret) OVER w{m}) ELSE 0 END" for m in (16, 64, 256)},
    "roll_spread": "2 * sqrt(greatest(0, -coalesce(avg(moves) OVER w127, 0)))", "lee_ready_32": "sum(dir) OVER w32", "amihud": "ami", "bounce": "bnc", "kyle_hasbrouck": "kyle",
    "trade_imbalance": "sum(buy - sell) OVER w32 / (sum(buy + sell) OVER w32 + 1e-8)",
    "vol_regime": "CASE WHEN n >= 256 AND sqrt(sum(ret * ret) OVER w256) > 1e-10 THEN least(10, sqrt(sum(ret * ret) OVER w16 / sum(ret * ret) OVER w256)) ELSE 1 END",
    "spread_compression": _clip("(ns - avg(ns) OVER w64) / sqrt(var_pop(ns) OVER w64 + 1e-10)", -5, 5),
    "autocorr_lag1": f"CASE WHEN n >= 32 THEN {_clip(f'covar_pop(ret, ret_1) OVER w32 / ({_DEV.format("ret_1")} * {_DEV.format("CASE WHEN n > 1 THEN ret END")} + 1e-10)', -1, 1)} ELSE 0 END",
    **{f"mom_{m}": f"sum(ret) OVER w{m}" for m in (8, 16, 32, 64, 128, 256, 512, 1024)},
    **{f"rv_{m}": f"sqrt(sum(ret * ret) OVER w{m})" for m in (8, 32, 128, 512, 1024)},
    **{f"absret_{m}": f"avg(abs(ret)) OVER w{m}" for m in (8, 16, 32, 64, 128)},
    "rstd_64": "stddev_pop(ret) OVER w64", "rstd_256": "stddev_pop(ret) OVER w256",
    "skew_64": _moment(64, 3, 0, -10, 10), "skew_256": _moment(256, 3, 0, -10, 10), "kurt_64": _moment(64, 4, 3, -10, 50), "kurt_256": _moment(256, 4, 3, -10, 50),
    **{f"sharpe_{m}": f"avg(ret) OVER w{m} / (stddev_pop(ret) OVER w{m} + 1e-9)" for m in (16, 64, 256)},
    **{f"donch_{m}": f"CASE WHEN max(mid) OVER w{m} - min(mid) OVER w{m} > 1e-12 THEN (mid - min(mid) OVER w{m}) / (max(mid) OVER w{m} - min(mid) OVER w{m}) ELSE 0.5 END" for m in (32, 128, 512)},
    **{f"midz_{m}": _z("mid", m, "1e-9") for m in (64, 256, 1024)},
    **{f"ofim_{m}": f"avg(ofi) OVER w{m}" for m in (8, 32, 128)}, **{f"ofisd_{m}": f"stddev_pop(ofi) OVER w{m}" for m in (32, 128)},
    **{f"svolsum_{m}": f"sum(svol) OVER w{m}" for m in (32, 128)}, **{f"volm_{m}": f"avg(vol) OVER w{m}" for m in (32, 128)}, **{f"volsd_{m}": f"stddev_pop(vol) OVER w{m}" for m in (32, 128)},
    "sprm_64": "avg(spread) OVER w64", "sprsd_64": "stddev_pop(spread) OVER w64", "sprz_64": _z("spread", 64, "1e-12"),
    **{f"velm_{m}": f"avg(vel) OVER w{m}" for m in (32, 128)}, **{f"velsd_{m}": f"stddev_pop(vel) OVER w{m}" for m in (32, 128)}, "accm_32": "avg(accel) OVER w32",
    "dir_run": "dir * run", "fracup_64": _UP, "ac2_64": _lag_corr(2), "ac5_64": _lag_corr(5),
    "var_ratio": f"CASE WHEN avg(ret * ret) OVER w64 > 1e-18 THEN {_clip('avg(ret * ret) OVER w8 / avg(ret * ret) OVER w64', 0, 10)} ELSE 1 END",
    "amihudm_64": "avg(ami) OVER w64", "kylem_64": "avg(kyle) OVER w64", "mdevm_32": "avg(mdv) OVER w32", "mdevsd_32": "stddev_pop(mdv) OVER w32",
    "jump_64": f"CASE WHEN sum(ret * ret) OVER w64 > 1e-18 THEN {_clip('1 - pi() / 2 * coalesce(sum(abs(ret * ret_1)) OVER w63, 0) / sum(ret * ret) OVER w64', 0, 1)} ELSE 0 END",
    "semiup_64": "sqrt(sum(power(greatest(ret, 0), 2)) OVER w64)", "semidn_64": "sqrt(sum(power(least(ret, 0), 2)) OVER w64)",
    "tod_sin_h": "sin(pi() * hour / 12)", "tod_cos_h": "cos(pi() * hour / 12)", "tod_sin_m": "sin(pi() * minute / 30)", "tod_cos_m": "cos(pi() * minute / 30)",
    "sess_asia": "CAST(hour NOT BETWEEN 7 AND 22.99999999 AS INTEGER)", "sess_london": "CAST(floor(hour) BETWEEN 7 AND 15 AS INTEGER)", "sess_ny": "CAST(floor(hour) BETWEEN 13 AND 21 AS INTEGER)",
    "dspr_8": "spread - avg(spread) OVER w8", "dspr_32": "spread - avg(spread) OVER w32",
    "sign_entropy_64": f"CASE WHEN {_UP} > 1e-9 AND {_UP} < 1 - 1e-9 THEN -{_UP} * log2({_UP}) - (1 - {_UP}) * log2(1 - {_UP}) ELSE 0 END",
    "mdd_128": _FALLS, **{f"vwapd_{m}": f"(mid - sum(vol * mid) OVER w{m} / sum(vol) OVER w{m}) / (mid + 1e-9)" for m in (64, 256)},
    "corr_ro_64": _corr("ret", "ofi"), "corr_rv_64": _corr("ret", "vol"), "acc_sign": "sign(accel)", "jerk": "jerk",
    "rvr_8_64": "sqrt(sum(ret * ret) OVER w8) / (sqrt(sum(ret * ret) OVER w64) + 1e-12)", "rvr_64_512": "sqrt(sum(ret * ret) OVER w64) / (sqrt(sum(ret * ret) OVER w512) + 1e-12)",
    **{f"lr_{m}": f"sum(dir) OVER w{m}" for m in (64, 128)}, **{f"tir_{m}": _imbalance(m) for m in (64, 128)},
    "trm_64": "avg(rate) OVER w64", "bouncef_64": "avg(bnc) OVER w64", "nrange_64": "(max(mid) OVER w64 - min(mid) OVER w64) / (mid + 1e-9)",
}


def features_sql(names: Sequence[str]) -> str:
    windows = ", ".join(f"w{m} AS (PARTITION BY symbol ORDER BY time_ms, seq ROWS {m - 1} PRECEDING)" for m in _SIZES)
    columns = ", ".join(f"{TWINS[w]} AS f_{w}" for w in names)
    return f"WITH {QUOTES},\n{_STEPS}\nSELECT symbol, seq, time_ms, {columns} FROM f WINDOW {windows}"
