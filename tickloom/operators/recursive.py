"""Features with unlimited memory: exponential means, Wilder's RSI, the volume clock, filters.

Each is an affine recursion y = a x + (1 - a) y before it, which Catalyst has no
expression for.  Series of ticks go in chunks that run side by side (by_chunks);
series of bars, which are short, are one group for each symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tickloom.shipping import ship
from tickloom.sources.ticks import in_chunks

SPANS, PERIODS, CLOCK = (16, 64, 256, 1024), (14, 32, 64), 0.001


def smoothed(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """y[i] = y[i-1] + alpha (x[i] - y[i-1]) with start before the first."""
    return pd.Series(np.r_[start, x]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


class Recursion(NamedTuple):
    """States y = y + alpha (x - y) over the rows of a chunk: x and alpha, rows by states, and y before the first row of all."""

    x: np.ndarray
    alpha: np.ndarray
    start: np.ndarray

    def run(self, before: np.ndarray) -> np.ndarray:
        """The states after every row."""
        out = np.empty_like(self.x)
        for k in range(self.x.shape[1]):
            alpha = self.alpha[:, k]
            if len(alpha) and (alpha == alpha[0]).all():
                out[:, k] = smoothed(self.x[:, k], alpha[0], before[k])
            else:
                y = before[k]
                for i, (v, w) in enumerate(zip(self.x[:, k].tolist(), alpha.tolist(), strict=True)):
                    y += w * (v - y)
                    out[i, k] = y
        return out


def by_chunks(ticks: DataFrame, columns: Sequence[str], made: Callable[[pd.DataFrame], Recursion], finish: Callable[[pd.DataFrame, np.ndarray], dict], chunk_rows: int, width_ms: int) -> DataFrame:
    """ticks with the columns that finish() makes from the states; chunks of a symbol run side by side.

    made() gets a chunk's rows in order (n: the place in the symbol, from 1; and the
    rows lent from before, at least one) and gives its recursion, whose rows count only
    where inside holds.  The state after a chunk is an affine function of that before
    it, so a first pass gives each chunk's factor and offset, a fold over the few chunks
    of a symbol the states they start from, and a second pass the states themselves.
    """
    ship(ticks.sparkSession)
    chunks = in_chunks(ticks, 1, chunk_rows, width_ms)

    def ordered(df: pd.DataFrame) -> tuple[pd.DataFrame, Recursion]:
        df = df.sort_values(["time_ms", "seq"], ignore_index=True)
        df["n"] = df.rows_before.iloc[0] + np.arange(1, len(df) + 1)
        all_rows, keep = made(df), df.inside.to_numpy()
        return df[keep], Recursion(all_rows.x[keep], all_rows.alpha[keep], all_rows.start)

    def map_of(df: pd.DataFrame) -> pd.DataFrame:
        rows, r = ordered(df)
        after = r.run(np.zeros(r.x.shape[1]))[-1]
        return pd.DataFrame({"symbol": [rows.symbol.iloc[0]], "chunk": [rows.chunk.iloc[0]], "factor": [np.prod(1 - r.alpha, axis=0)], "offset": [after], "start": [r.start]})

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("chunk")
        y, before = df.start.iloc[0], []
        for factor, offset in zip(df.factor, df.offset, strict=True):
            before.append(y)
            y = y * factor + offset
        return pd.DataFrame({"symbol": df.symbol, "chunk": df.chunk, "before": before})

    def run(df: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        rows, r = ordered(df)
        return rows[names].assign(**finish(rows, r.run(states.before.iloc[0])))

    names = ticks.columns
    maps = chunks.groupBy("symbol", "chunk").applyInPandas(map_of, "symbol string, chunk long, factor array<double>, offset array<double>, start array<double>")
    states = maps.groupBy("symbol").applyInPandas(fold, "symbol string, chunk long, before array<double>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ticks.schema) + "".join(f", {x} double" for x in columns)
    return chunks.groupBy("symbol", "chunk").cogroup(states.groupBy("symbol", "chunk")).applyInPandas(run, schema)


CHUNK, HOUR_MS = 1 << 16, 3_600_000
RECURSIVE = (*(f"emadev_{n}" for n in SPANS), *(f"emax_{a}_{b}" for a, b in zip(SPANS, SPANS[1:], strict=False)), *(f"rsi_{n}" for n in PERIODS), "vol_clock_dev")


def recursive_features(ticks: DataFrame, chunk_rows: int = CHUNK, width_ms: int = HOUR_MS) -> DataFrame:
    """Deviation from exponential means, their crosses, RSI and the volume-clock deviation of every tick."""

    def made(df: pd.DataFrame) -> Recursion:
        mid, first = df.mid.to_numpy(float), df.n.to_numpy() == 1
        step = np.diff(mid, prepend=0.0)
        gain, loss = np.maximum(step, 0), np.maximum(-step, 0)
        gap = np.where(first, 0.1, np.maximum(0.001, np.diff(df.time_ms.to_numpy(), prepend=df.time_ms.iloc[0]) / 1000))
        rate = np.clip(1 / gap, 0, 1000)
        x = np.stack([mid] * len(SPANS) + [gain, loss] * len(PERIODS) + [rate, rate * rate], axis=1)
        alpha = np.array([2 / (n + 1) for n in SPANS] + [1 / n for n in PERIODS for _ in (0, 1)] + [CLOCK] * 2)
        return Recursion(x, np.broadcast_to(alpha, x.shape), np.r_[x[0, :-2], 0.0, 0.0])

    def finish(rows: pd.DataFrame, y: np.ndarray) -> dict:
        mid = rows.mid.to_numpy(float)
        ema, (gain, loss) = y[:, : len(SPANS)], (y[:, len(SPANS) + k : -2 : 2] for k in (0, 1))
        out = [(mid - ema[:, k]) / (mid + 1e-9) for k in range(len(SPANS))]
        out += [(ema[:, k] - ema[:, k + 1]) / (mid + 1e-9) for k in range(len(SPANS) - 1)]
        out += [1 - 1 / (1 + gain[:, k] / (loss[:, k] + 1e-12)) for k in range(len(PERIODS))]
        rate, mean, square = rows.rate.to_numpy(), y[:, -2], y[:, -1]
        out.append(np.clip((rate - mean) / np.sqrt(np.maximum(square - mean * mean, 0) + 1e-10), -5, 5))
        return dict(zip(RECURSIVE, out, strict=True))

    def with_rate(df: pd.DataFrame) -> Recursion:
        r = made(df)
        df["rate"] = r.x[:, -2]
        return r

    return by_chunks(ticks.select("symbol", "seq", "time_ms", "mid"), RECURSIVE, with_rate, finish, chunk_rows, width_ms).drop("mid")


def exponential_mean(series: DataFrame, alpha: float, value: str = "mid", chunk_rows: int = CHUNK, width_ms: int = HOUR_MS) -> DataFrame:
    """series (symbol, seq, time_ms, value, ...) with ema, the exponential mean of value; it starts at the first value."""

    def made(df: pd.DataFrame) -> Recursion:
        x = df[[value]].to_numpy(float)
        return Recursion(x, np.full(x.shape, alpha), x[0])

    return by_chunks(series, ["ema"], made, lambda _, y: {"ema": y[:, 0]}, chunk_rows, width_ms)


def bar_means(bars: DataFrame, value: str, spans: Sequence[int]) -> DataFrame:
    """Exponential means of a column of bars: adds {value}_ema{n} for each span.

    Null counts as 0; a mean is null until it rests on n / 2 bars, 2 at least.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("bucket_ms")
        x = df[value].astype(float).fillna(0.0)
        return df.assign(**{f"{value}_ema{n}": x.ewm(span=n, adjust=False, min_periods=max(2, n // 2)).mean() for n in spans})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + "".join(f", `{value}_ema{n}` double" for n in spans)
    return bars.groupBy("symbol").applyInPandas(run, schema)


def regime_filter(bars: DataFrame, observe: list[str], transition: np.ndarray, centres: np.ndarray, spread: float = 1.0) -> DataFrame:
    """Forward probabilities of a hidden Markov model over bars: adds regime (the likeliest) and regime_p.

    Emissions are Gaussian around centres (states x observed columns).
    """
    n = len(centres)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("bucket_ms")
        belief, regime, sure = np.full(n, 1 / n), [], []
        for x in df[observe].to_numpy(float):
            belief = belief @ transition * (np.exp(-((x - centres) ** 2).sum(axis=1) / (2 * spread * spread)) + 1e-300)
            belief /= belief.sum()
            regime.append(int(belief.argmax()))
            sure.append(float(belief.max()))
        return df.assign(regime=regime, regime_p=sure)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema) + ", regime int, regime_p double"
    return bars.groupBy("symbol").applyInPandas(run, schema)


def kalman_gains(n: np.ndarray, q: float, r: float) -> np.ndarray:
    """The gain of a scalar Kalman filter at each place n (rising by 1, from 1); it depends on nothing else.

    The variance tends to a fixed point, which it has reached once a step leaves it as it is.
    """
    variance, gains, k = 1.0, [], 0
    last = int(n[-1])
    while k < last:
        prior = variance + q
        gain = prior / (prior + r)
        settled = prior * (1 - gain) == variance
        variance, k = prior * (1 - gain), k + 1
        gains.append(gain)
        if settled:
            break
    return np.array(gains)[np.minimum(n, len(gains)) - 1]


def kalman_level(series: DataFrame, value: str, q: float = 1e-5, r: float = 1e-2, chunk_rows: int = CHUNK, width_ms: int = HOUR_MS) -> DataFrame:
    """Scalar Kalman filter of a level (symbol, seq, time_ms, value, ...): adds level and gain."""

    def made(df: pd.DataFrame) -> Recursion:
        x = df[[value]].to_numpy(float)
        df["gain"] = kalman_gains(df.n.to_numpy(), q, r)
        return Recursion(x, df[["gain"]].to_numpy(), x[0])

    return by_chunks(series, ["level", "gain"], made, lambda rows, y: {"level": y[:, 0], "gain": rows.gain.to_numpy()}, chunk_rows, width_ms)
