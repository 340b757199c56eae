"""The causal tick features without memory beyond frames, by numpy over chunks of ticks.

Some 250 frame statistics stand behind the features.  As window expressions each
costs a lag for every row and level, about 100 microseconds a tick in all; as arrays
they cost a few.  A series goes in chunks (sources.ticks.in_chunks), each with the
ticks before it that its frames reach, so a chunk is a bounded group and one long
symbol uses all cores.

Every frame statistic is doubled: what holds for the last 2n ticks comes from what
holds for the last n and for the n before them.  So a frame costs the logarithm of
its length, and nothing is ever taken off a sum: sums are pairwise, and squared
deviations are merged from those of the halves, so a price near 2,000 that moves by
cents loses no digits on a series of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.shipping import ship
from tickloom.sources.ticks import in_chunks

FRAMES = (8, 16, 32, 64, 128, 256, 512, 1024)
#: Ticks before a chunk that its frames and lags reach.
REACH = 1024 + 64


def lagged(x: np.ndarray, k: int, fill: float = 0.0) -> np.ndarray:
    out = np.full(len(x), fill, x.dtype)
    if k < len(x):
        out[k:] = x[: len(x) - k]
    return out


def ratio(a: np.ndarray, b: np.ndarray, good: np.ndarray, other: float | np.ndarray = 0.0) -> np.ndarray:
    """a / b where it is good, else the other."""
    return np.where(good, a / np.where(good, b, 1.0), other)


class Frames:
    """Columns of a run of ticks, made once each, and their statistics over the last m ticks.

    n is each tick's place in its symbol, from 1; the first tick moves from 0 in 0.1 seconds.
    """

    def __init__(self, ask, bid, mid, ask_vol, bid_vol, time_ms, rows_before: int):
        self.time = time_ms
        self.n = rows_before + np.arange(1, len(mid) + 1)
        self._kept: dict[tuple, np.ndarray] = {}
        first = self.n == 1
        spread, vol, svol = ask - bid, ask_vol + bid_vol, ask_vol - bid_vol
        before = lagged(mid, 1)
        move = mid - before
        dt = np.where(first, 0.1, np.maximum(1e-3, np.diff(time_ms, prepend=time_ms[:1]) / 1e3))
        velocity = move / dt
        ret = np.where(before > 0, np.log((mid + 1e-8) / (before + 1e-8)), 0.0)
        accel = velocity - lagged(velocity, 1)
        at = np.arange(len(mid))
        last = np.maximum.accumulate(np.where(move != 0, at, -1))
        way = np.where(last >= 0, np.sign(move)[np.maximum(last, 0)], 0.0)
        turn = np.maximum.accumulate(np.where(way != lagged(way, 1), at, 0))
        ofi = svol / (vol + 1e-8)
        self._columns: dict[str, np.ndarray] = {
            "ask": ask, "bid": bid, "mid": mid, "ask_vol": ask_vol, "bid_vol": bid_vol, "spread": spread, "ns": spread / (mid + 1e-5), "vol": vol, "svol": svol, "ofi": ofi, "d_ofi": ofi - lagged(ofi, 1),
            "mdv": (ask * bid_vol + bid * ask_vol) / (vol + 1e-8) - mid, "move": move, "vel": velocity, "accel": accel, "jerk": accel - lagged(accel, 1), "rate": np.clip(1 / dt, 0, 1e3), "ret": ret,
            "ami": np.abs(move) / (vol + 1e-8), "bnc": ((velocity * lagged(velocity, 1) < 0) & (np.abs(move) < spread)).astype(float), "dir": way, "run": way * (at - turn + 1),
            "ret2": ret**2, "ret3": ret**3, "ret4": ret**4, "abs": np.abs(ret), "pos2": np.where(ret > 0, ret**2, 0.0), "neg2": np.where(ret <= 0, ret**2, 0.0), "up": (way > 0).astype(float),
            "buy": np.where(way > 0, ask_vol, 0.0), "sell": np.where(way < 0, bid_vol, 0.0), "vm": vol * mid, "moves": move * lagged(move, 1), "jumps": np.abs(ret * lagged(ret, 1)),
            **{f"ret_ret{k}": ret * lagged(ret, k) for k in (1, 2, 5)},
        }

    def __getitem__(self, name: str) -> np.ndarray:
        if name == "kyle" and name not in self._columns:
            q = self.squares("svol", 64)
            self._columns[name] = ratio(self.products("move", "svol", 64), q, (self.n >= 16) & (q > 1e-10))
        return self._columns[name]

    def _doubled(self, key: tuple, m: int, start: Callable[[], np.ndarray], step: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
        if (*key, m) not in self._kept:
            self._kept[*key, m] = start() if m == 1 else step(self._doubled(key, m // 2, start, step), m // 2)
        return self._kept[*key, m]

    def total(self, name: str, m: int) -> np.ndarray:
        """Sum over the last m ticks; an m that is no power of 2 is put together from powers."""
        out, done = None, 0
        for bit in (1 << k for k in range(m.bit_length() - 1, -1, -1)):
            if m & bit:
                part = lagged(self._doubled(("sum", name), bit, lambda: self[name], lambda x, h: x + lagged(x, h)), done)
                out, done = part if out is None else out + part, done + bit
        return out

    def products(self, a: str, b: str, m: int) -> np.ndarray:
        """Sum over the last m ticks of the deviations of a times those of b, each from its mean there."""

        def step(x: np.ndarray, h: int) -> np.ndarray:
            old = np.clip(self.n - h, 0, h)  # ticks in the older half
            some = np.maximum(old, 1)
            apart = lambda c: self.total(c, h) / h - lagged(self.total(c, h), h) / some
            one = apart(a)
            return x + np.where(old > 0, lagged(x, h) + one * (one if a == b else apart(b)) * (h * old / (h + old)), 0.0)

        return self._doubled(("products", a, b), m, lambda: np.zeros(len(self.n)), step)

    def squares(self, name: str, m: int) -> np.ndarray:
        return self.products(name, name, m)

    def highest(self, m: int) -> np.ndarray:
        return self._doubled(("high",), m, lambda: self["mid"], lambda x, h: np.maximum(x, lagged(x, h, -np.inf)))

    def lowest(self, m: int) -> np.ndarray:
        return self._doubled(("low",), m, lambda: self["mid"], lambda x, h: np.minimum(x, lagged(x, h, np.inf)))

    def fall(self, m: int) -> np.ndarray:
        """Largest fall of the mid from a peak before it, over the peak."""

        def step(x: np.ndarray, h: int) -> np.ndarray:
            peak = lagged(self.highest(h), h, 0.0)
            return np.maximum(np.maximum(x, lagged(x, h)), np.where(self.n > h, (peak - self.lowest(h)) / (peak + 1e-9), 0.0))

        return self._doubled(("fall",), m, lambda: np.zeros(len(self.n)), step)

    def held(self, m: int) -> np.ndarray:
        return np.minimum(self.n, m)

    def mean(self, name: str, m: int) -> np.ndarray:
        return self.total(name, m) / self.held(m)

    def sd(self, name: str, m: int) -> np.ndarray:
        return np.sqrt(self.squares(name, m) / self.held(m))


Feature = Callable[[Frames], np.ndarray]


def _column(name: str) -> Feature:
    return lambda f: f[name]


def _total(name: str, m: int) -> Feature:
    return lambda f: f.total(name, m)


def _mean(name: str, m: int) -> Feature:
    return lambda f: f.mean(name, m)


def _sd(name: str, m: int) -> Feature:
    return lambda f: f.sd(name, m)


def _root(name: str, m: int, full: bool = False) -> Feature:
    """Root of a sum; with full, 0 until the frame is."""
    return lambda f: np.where((f.n >= m) | (not full), np.sqrt(f.total(name, m)), 0.0)


def _z(name: str, m: int, least: float, width: float = 6.0) -> Feature:
    return lambda f: np.clip(ratio(f[name] - f.mean(name, m), f.sd(name, m), f.sd(name, m) > least), -width, width)


def _skew(m: int) -> Feature:
    def skew(f: Frames) -> np.ndarray:
        m1, m2, m3, var = f.mean("ret", m), f.mean("ret2", m), f.mean("ret3", m), f.sd("ret", m) ** 2
        return np.clip(ratio(m3 - 3 * m1 * m2 + 2 * m1**3, var**1.5, var > 1e-18), -10, 10)

    return skew


def _kurt(m: int) -> Feature:
    def kurt(f: Frames) -> np.ndarray:
        m1, m2, m3, m4, var = f.mean("ret", m), f.mean("ret2", m), f.mean("ret3", m), f.mean("ret4", m), f.sd("ret", m) ** 2
        return np.where(var > 1e-18, np.clip(ratio(m4 - 4 * m1 * m3 + 6 * m1**2 * m2 - 3 * m1**4, var * var, var > 1e-18) - 3, -10, 50), 0.0)

    return kurt


def _sharpe(m: int) -> Feature:
    return lambda f: f.mean("ret", m) / (f.sd("ret", m) + 1e-9)


def _place(m: int) -> Feature:
    def place(f: Frames) -> np.ndarray:
        wide = f.highest(m) - f.lowest(m)
        return ratio(f["mid"] - f.lowest(m), wide, wide > 1e-12, 0.5)

    return place


def _corr(a: str, b: str, m: int) -> Feature:
    def corr(f: Frames) -> np.ndarray:
        both = np.sqrt(f.squares(a, m) * f.squares(b, m))
        return np.clip(ratio(f.products(a, b, m), both, f.held(m) * both > 1e-12), -1, 1)

    return corr


def _lag_corr(lag: int, m: int = 64) -> Feature:
    """Products of a return and the one `lag` before, both inside the last m, over the squares."""
    return lambda f: np.clip(ratio(f.total(f"ret_ret{lag}", m - lag), f.total("ret2", m), f.total("ret2", m) > 1e-12), -1, 1)


def _next_corr(f: Frames, m: int = 32) -> np.ndarray:
    """Correlation of a return with the next over at most m pairs, once there are m returns."""
    k = np.maximum(np.minimum(f.n - 1, m), 1)
    y, yy = f.total("ret", m), f.total("ret2", m)
    x, xx = lagged(y, 1), lagged(yy, 1)
    dev = lambda q, t: np.sqrt(np.maximum(0, (q - t * t / k) / k) + 1e-10)
    cov = (f.total("ret_ret1", m) - x * y / k) / k
    return np.where(f.n >= m, np.clip(cov / (dev(xx, x) * dev(yy, y) + 1e-10), -1, 1), 0.0)


def _roll(f: Frames) -> np.ndarray:
    return 2 * np.sqrt(np.maximum(0, -ratio(f.total("moves", 127), np.minimum(f.n - 1, 127), f.n > 1)))


def _regime(f: Frames) -> np.ndarray:
    short, long = np.sqrt(f.total("ret2", 16)), np.sqrt(f.total("ret2", 256))
    good = (f.n >= 256) & (long > 1e-10)
    return np.where(good, np.minimum(ratio(short, long, good), 10), 1.0)


def _jump(f: Frames) -> np.ndarray:
    whole = f.total("ret2", 64)
    return np.clip(ratio(whole - np.pi / 2 * f.total("jumps", 63), whole, whole > 1e-18), 0, 1)


def _vwap_gap(m: int) -> Feature:
    return lambda f: (f["mid"] - ratio(f.total("vm", m), f.total("vol", m), f.total("vol", m) > 1e-12, f["mid"])) / (f["mid"] + 1e-9)


def _imbalance(m: int) -> Feature:
    def imbalance(f: Frames) -> np.ndarray:
        buy, sell = f.total("buy", m), f.total("sell", m)
        return ratio(buy - sell, buy + sell, buy + sell > 1e-12)

    return imbalance


def _entropy(f: Frames) -> np.ndarray:
    up = f.mean("up", 64)
    good = (up > 1e-9) & (up < 1 - 1e-9)
    p = np.where(good, up, 0.5)
    return np.where(good, -(p * np.log2(p) + (1 - p) * np.log2(1 - p)), 0.0)


def _turn(unit: float, width: float, wave: Callable) -> Feature:
    """Sine or cosine of the part of `width` units (of milliseconds) that has passed."""
    return lambda f: wave(2 * np.pi * ((f.time % round(unit * width)) / unit) / width)


def _session(a: int, b: int) -> Feature:
    def session(f: Frames) -> np.ndarray:
        hour = (f.time % 86_400_000) / 3.6e6
        return ((hour >= a) & (hour < b) if a < b else (hour >= a) | (hour < b)).astype(float)

    return session


#: Features by name, in order; the recursive ones are in operators.recursive.
FEATURES: dict[str, Feature] = {
    **{x: _column(x) for x in ("ask", "bid", "mid", "ask_vol", "bid_vol", "spread")},
    "norm_spread": _column("ns"), "ofi": _column("ofi"), "d_ofi": _column("d_ofi"), "mid_velocity": _column("vel"), "mid_accel": _column("accel"),
    "micro_dev": _column("mdv"), "tick_rate": _column("rate"), "log_tick_rate": lambda f: np.log1p(f["rate"]),
    **{f"rv_{m}": _root("ret2", m, full=True) for m in (16, 64, 256)},
    "roll_spread": _roll, "lee_ready_32": _total("dir", 32), "amihud": _column("ami"), "bounce": _column("bnc"), "kyle_hasbrouck": _column("kyle"),
    "trade_imbalance": lambda f: (f.total("buy", 32) - f.total("sell", 32)) / (f.total("buy", 32) + f.total("sell", 32) + 1e-8),
    "vol_regime": _regime, "spread_compression": lambda f: np.clip((f["ns"] - f.mean("ns", 64)) / np.sqrt(f.sd("ns", 64) ** 2 + 1e-10), -5, 5), "autocorr_lag1": _next_corr,
    **{f"mom_{m}": _total("ret", m) for m in FRAMES},
    **{f"rv_{m}": _root("ret2", m) for m in (8, 32, 128, 512, 1024)},
    **{f"absret_{m}": _mean("abs", m) for m in (8, 16, 32, 64, 128)},
    "rstd_64": _sd("ret", 64), "rstd_256": _sd("ret", 256),
    "skew_64": _skew(64), "skew_256": _skew(256), "kurt_64": _kurt(64), "kurt_256": _kurt(256),
    **{f"sharpe_{m}": _sharpe(m) for m in (16, 64, 256)},
    **{f"donch_{m}": _place(m) for m in (32, 128, 512)},
    **{f"midz_{m}": _z("mid", m, 1e-9) for m in (64, 256, 1024)},
    "ofim_8": _mean("ofi", 8), "ofim_32": _mean("ofi", 32), "ofim_128": _mean("ofi", 128), "ofisd_32": _sd("ofi", 32), "ofisd_128": _sd("ofi", 128),
    "svolsum_32": _total("svol", 32), "svolsum_128": _total("svol", 128),
    "volm_32": _mean("vol", 32), "volm_128": _mean("vol", 128), "volsd_32": _sd("vol", 32), "volsd_128": _sd("vol", 128),
    "sprm_64": _mean("spread", 64), "sprsd_64": _sd("spread", 64), "sprz_64": _z("spread", 64, 1e-12),
    "velm_32": _mean("vel", 32), "velm_128": _mean("vel", 128), "velsd_32": _sd("vel", 32), "velsd_128": _sd("vel", 128), "accm_32": _mean("accel", 32),
    "dir_run": _column("run"), "fracup_64": _mean("up", 64), "ac2_64": _lag_corr(2), "ac5_64": _lag_corr(5),
    "var_ratio": lambda f: np.clip(ratio(f.mean("ret2", 8), f.mean("ret2", 64), f.mean("ret2", 64) > 1e-18, 1.0), 0, 10),
    "amihudm_64": _mean("ami", 64), "kylem_64": _mean("kyle", 64), "mdevm_32": _mean("mdv", 32), "mdevsd_32": _sd("mdv", 32),
    "jump_64": _jump, "semiup_64": _root("pos2", 64), "semidn_64": _root("neg2", 64),
    "tod_sin_h": _turn(3.6e6, 24, np.sin), "tod_cos_h": _turn(3.6e6, 24, np.cos), "tod_sin_m": _turn(6e4, 60, np.sin), "tod_cos_m": _turn(6e4, 60, np.cos),
    "sess_asia": _session(23, 7), "sess_london": _session(7, 16), "sess_ny": _session(13, 22),
    "dspr_8": lambda f: f["spread"] - f.mean("spread", 8), "dspr_32": lambda f: f["spread"] - f.mean("spread", 32),
    "sign_entropy_64": _entropy, "mdd_128": lambda f: f.fall(128), "vwapd_64": _vwap_gap(64), "vwapd_256": _vwap_gap(256),
    "corr_ro_64": _corr("ret", "ofi", 64), "corr_rv_64": _corr("ret", "vol", 64),
    "acc_sign": lambda f: np.sign(f["accel"]), "jerk": _column("jerk"),
    "rvr_8_64": lambda f: np.sqrt(f.total("ret2", 8)) / (np.sqrt(f.total("ret2", 64)) + 1e-12), "rvr_64_512": lambda f: np.sqrt(f.total("ret2", 64)) / (np.sqrt(f.total("ret2", 512)) + 1e-12),
    "lr_64": _total("dir", 64), "lr_128": _total("dir", 128), "tir_64": _imbalance(64), "tir_128": _imbalance(128),
    "trm_64": _mean("rate", 64), "bouncef_64": _mean("bnc", 64), "nrange_64": lambda f: (f.highest(64) - f.lowest(64)) / (f["mid"] + 1e-9),
}

_PRICES = ("ask", "bid", "mid", "ask_vol", "bid_vol")


def tick_features(ticks: DataFrame, names: Sequence[str] | None = None, chunk_rows: int = 1 << 15) -> DataFrame:
    """symbol, seq, time_ms and the named features (all by default) of every tick, as doubles.

    ticks needs symbol, seq, time_ms, ask, bid, mid, ask_vol and bid_vol, repaired.
    The first tick of a symbol moves from 0 in 0.1 seconds, as if nothing stood
    before it; realised volatilities over 16, 64 and 256 ticks are 0 until the frame
    is full, all other frames may be partial.  A chunk has about chunk_rows ticks.
    """
    ship(ticks.sparkSession)
    wanted = list(names or FEATURES)
    schema = "symbol string, seq long, time_ms long" + "".join(f", f_{w} double" for w in wanted)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("time_ms", "ascending"), ("seq", "ascending")])
        frames = Frames(*(table.column(x).to_numpy().astype(float) for x in _PRICES), table.column("time_ms").to_numpy(), table.column("rows_before")[0].as_py())
        inside = table.column("inside").to_numpy()
        keep = table.select(["symbol", "seq", "time_ms"]).filter(pa.array(inside))
        # lent rows stand first; the results of the others go out
        skip = len(inside) - keep.num_rows
        made = {f"f_{w}": pa.array(np.ascontiguousarray(FEATURES[w](frames)[skip:], dtype=float)) for w in wanted}
        return pa.table({x: keep.column(x) for x in keep.column_names} | made)

    chunks = in_chunks(ticks.select("symbol", "seq", "time_ms", *_PRICES), REACH, chunk_rows, turns=True)
    return chunks.groupBy("symbol", "chunk").applyInArrow(run, schema)
