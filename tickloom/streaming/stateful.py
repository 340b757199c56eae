"""Operators that carry state from batch to batch, one state for each symbol."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.recursive import SPANS
from tickloom.operators.simulate import Level, LevelMemory
from tickloom.shipping import ship


#: Rows that a group hands on at once.
_AT_ONCE = 1 << 16


def streaming_ema(ticks: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """Exponential means of the mid over a stream; each symbol's last values are its state.

    A batch is put in order; batches are taken in the order in which they come.
    """
    ship(ticks.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(batches)).sort_values(["time_ms", "seq"])
        mid = df.mid.tolist()
        last = json.loads(state.get[0]) if state.exists else [mid[0]] * len(spans)
        means = {}
        for n, before in zip(spans, last, strict=True):
            alpha = 2 / (n + 1)
            means[f"ema_{n}"] = list(accumulate(mid, lambda y, x, alpha=alpha: y + alpha * (x - y), initial=before))[1:]
        state.update((json.dumps([x[-1] for x in means.values()]),))
        out = pd.DataFrame({"symbol": key[0], "seq": df.seq.to_numpy(), "time_ms": df.time_ms.to_numpy(), **means})
        for at in range(0, len(out), _AT_ONCE):
            yield out.iloc[at : at + _AT_ONCE]

    schema = "symbol string, seq long, time_ms long, " + ", ".join(f"ema_{n} double" for n in spans)
    return ticks.select("symbol", "seq", "time_ms", "mid").groupBy("symbol").applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def streaming_count_windows(ticks: DataFrame, rows: int) -> DataFrame:
    """A bar for every `rows` ticks of a symbol; ticks of an unfinished bar are the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(batches)).sort_values(["time_ms", "seq"])
        held = json.loads(state.get[0]) if state.exists else []
        held += list(zip(df.time_ms.tolist(), df.mid.tolist(), strict=True))
        out = []
        while len(held) >= rows:
            part, held = held[:rows], held[rows:]
            mids = [m for _, m in part]
            out.append((key[0], part[0][0], mids[0], max(mids), min(mids), mids[-1]))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["symbol", "start_ms", "open", "high", "low", "close"])

    return ticks.select("symbol", "seq", "time_ms", "mid").groupBy("symbol").applyInPandasWithState(run, "symbol string, start_ms long, open double, high double, low double, close double", "held string", "append", GroupStateTimeout.NoTimeout)


def streaming_levels(bars: DataFrame, tolerance: float, most: int = 128) -> DataFrame:
    """Support and resistance known before each bar of a stream; the levels are the state."""
    ship(bars.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(batches)).sort_values("bucket_ms")
        memory = LevelMemory(tolerance, most=most)
        if state.exists:
            memory.levels = [Level(*x) for x in json.loads(state.get[0])]
        rows = []
        for b in df.itertuples(index=False):
            rows.append((key[0], b.bucket_ms, b.close, *memory.nearest(b.close)))
            if b.high > b.close:
                memory.react(b.high, b.high - b.close, b.bucket_ms)
            if b.low < b.close:
                memory.react(b.low, b.close - b.low, b.bucket_ms)
        state.update((json.dumps([(x.price, x.strength, x.touched) for x in memory.levels]),))
        yield pd.DataFrame(rows, columns=["symbol", "bucket_ms", "close", "support", "resistance"]).astype({"support": float, "resistance": float})

    return bars.select("symbol", "bucket_ms", "high", "low", "close").groupBy("symbol").applyInPandasWithState(run, "symbol string, bucket_ms long, close double, support double, resistance double", "levels string", "append", GroupStateTimeout.NoTimeout)
