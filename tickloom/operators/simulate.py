"""Trade ledgers from signals: overlapping, with cooldown, netted, capped, and by a stateful strategy."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.shipping import ship


def overlapping(rows: DataFrame, signal: str, horizon: int, cost_mult: float, price: str = "close", latency: int = 0, key: str = "symbol", order: str = "bucket_ms") -> DataFrame:
    """Every signal is a trade held for horizon bars; the entry may come `latency` bars late."""
    w = Window.partitionBy(key).orderBy(order)
    entry, exit_ = F.lead(price, latency).over(w), F.lead(price, latency + horizon).over(w)
    median = F.coalesce("spread", F.lit(0.0))
    out = rows.withColumns({"entry": entry, "exit": exit_, "exit_time": F.lead(order, latency + horizon).over(w), "_cost": F.greatest(median, F.lit(0.0)) * cost_mult})
    out = out.filter((F.col(signal) != 0) & F.col("exit").isNotNull() & F.col("entry").isNotNull())
    out = out.withColumns({"direction": F.col(signal), "gross": F.col(signal) * (F.col("exit") - F.col("entry")), "cost": F.col("_cost")})
    return out.select(key, order, "exit_time", "direction", "entry", "exit", "gross", "cost", (F.col("gross") - F.col("cost")).alias("pnl"))


def with_cooldown(trades: DataFrame, position: str, hold: int, key: str = "symbol") -> DataFrame:
    """Greedy choice without overlap: after a trade the next may start `hold` positions later.

    Which trade is taken depends on the one before, so a key's positions, numbers
    only, go through one fold; keys side by side.
    """

    def choose(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(position)
        free, taken = None, []
        for p in df[position]:
            taken.append(free is None or p >= free)
            if taken[-1]:
                free = p + hold
        return df[taken]

    schema = f"{key} {dict(trades.dtypes)[key]}, {position} {dict(trades.dtypes)[position]}"
    chosen = trades.select(key, position).groupBy(key).applyInPandas(choose, schema)
    return trades.join(chosen, [key, position])


def netted(rows: DataFrame, signal: str, horizon: int, cost_mult: float, price: str = "close", key: str = "symbol", order: str = "bucket_ms") -> DataFrame:
    """Position: the sum of the last horizon signals, clipped to one; pnl on the next bar's move, cost on turnover."""
    w = Window.partitionBy(key).orderBy(order)
    position = F.greatest(F.lit(-1), F.least(F.lit(1), F.sum(signal).over(w.rowsBetween(-(horizon - 1), 0))))
    out = rows.withColumn("position", position)
    out = out.withColumns({"turnover": F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))), "move": F.lead(price).over(w) - F.col(price)})
    out = out.filter(F.col("move").isNotNull() & ((F.col("position") != 0) | (F.col("turnover") != 0)))
    return out.select(key, order, "position", "turnover", (F.col("position") * F.col("move") - F.col("turnover") * F.greatest(F.coalesce("spread", F.lit(0.0)), F.lit(0.0)) * cost_mult / 2).alias("pnl"))


def ensemble(ledgers: Sequence[DataFrame]) -> DataFrame:
    """Several ledgers with equal weights."""
    out = None
    for k, df in enumerate(ledgers):
        df = df.withColumns({"rule": F.lit(k), "pnl": F.col("pnl") / len(ledgers)})
        out = df if out is None else out.unionByName(df)
    return out


def exposure(trades: DataFrame, key: Sequence[str], start: str, end: str, amount: str) -> DataFrame:
    """Peak amount open at once, exits before entries at equal times."""
    opens = trades.select(*key, F.col(start).alias("_t"), F.col(amount).alias("_d"), F.lit(1).alias("_s"))
    closes = trades.select(*key, F.col(end).alias("_t"), (-F.col(amount)).alias("_d"), F.lit(0).alias("_s"))
    events = opens.union(closes).groupBy(*key, "_t", "_s").agg(F.sum("_d").alias("_d"))
    run = events.withColumn("_open", F.sum("_d").over(Window.partitionBy(*key).orderBy("_t", "_s")))
    return run.groupBy(*key).agg(F.greatest(F.max("_open"), F.lit(0.0)).alias("peak"), F.count("*").alias("events"))


def gross_cap(trades: DataFrame, capital: float, portfolio: str, start: str, end: str, amount: str, rank: str, trade: str) -> DataFrame:
    """filled of each trade: what is free of the capital at its entry, exits first, then by rank.

    What is free depends on all fills before, so a portfolio is one fold over its
    events; portfolios side by side.
    """

    def allocate(df: pd.DataFrame) -> pd.DataFrame:
        entries = [(s, 1, r, t, a) for s, r, t, a in zip(df[start], df[rank], df[trade], df[amount], strict=True)]
        exits = [(e, 0, 0, t, 0.0) for e, t in zip(df[end], df[trade], strict=True)]
        free, filled, early = capital, {}, set()
        for _, is_entry, _, t, want in sorted(entries + exits):
            if is_entry:
                filled[t] = min(want, max(free, 0.0))
                # a trade that ends where it starts has had its exit already
                free -= 0.0 if t in early else filled[t]
            elif t in filled:
                free += filled[t]
            else:
                early.add(t)
        return df.assign(filled=df[trade].map(filled))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trades.schema) + ", filled double"
    return trades.groupBy(portfolio).applyInPandas(allocate, schema)


def allocation_rank(trades: DataFrame, policy: str, model: str, pnl: str) -> DataFrame:
    """rank of each trade's model: by mean result, by falling volatility, or by name."""
    per = trades.groupBy(model).agg(F.avg(pnl).alias("_edge"), F.stddev_samp(pnl).alias("_vol"))
    by = {"edge_rank": F.col("_edge").desc(), "inverse_vol": F.col("_vol").asc_nulls_last(), "name_order": F.col(model).asc(), "reverse": F.col("_edge").asc()}[policy]
    ranked = per.withColumn("rank", F.dense_rank().over(Window.partitionBy().orderBy(by))).select(model, "rank")  # one row for each model
    return trades.join(F.broadcast(ranked), model)


def after_cost(rows: DataFrame, probability: Sequence[str], ret: str, cost: str, gate: float, slip: float = 0.0, commission: float = 0.0) -> DataFrame:
    """Trades of predictions [up, neutral, down] at or above the gate, net of slipped cost and commission."""
    up, flat, down = (F.col(p) for p in probability)
    top = F.greatest(up, flat, down)
    side = F.when((flat >= up) & (flat >= down), 0).when(up >= down, 1).otherwise(-1)
    out = rows.withColumns({"direction": side, "confidence": top}).filter((F.col("direction") != 0) & (F.col("confidence") >= gate))
    return out.withColumn("net", F.col("direction") * F.col(ret) - (F.col(cost) * (1 + slip) + commission))


#: Scenarios of execution cost: spread multiple, commission and slippage, each per unit traded.
COST_SCENARIOS = {"low": (0.5, 0.0, 0.0), "base": (1.0, 0.02, 0.01), "stress": (2.0, 0.05, 0.05)}


def cost_scenarios(trades: DataFrame, spread: str, size: Column, gross: str) -> DataFrame:
    """Each trade once for every scenario, with its cost and net."""
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("m"), F.lit(b).alias("c"), F.lit(s).alias("s")) for n, (a, b, s) in COST_SCENARIOS.items()]))
    out = trades.withColumn("_x", table)
    out = out.withColumns({"scenario": F.col("_x.scenario"), "cost": (F.col(spread) * F.col("_x.m") + F.col("_x.c") + F.col("_x.s")) * size})
    return out.withColumn("net", F.col(gross) * size - F.col("cost")).drop("_x")


def kelly_size(rows: DataFrame, calibration: Column, net: str, confidence: str, gate: float, cap: float) -> DataFrame:
    """size: Kelly fraction of the calibration slice, at most cap, scaled by how far confidence is above the gate."""
    x = F.when(calibration, F.col(net))
    win, gain, loss = F.avg((x > 0).cast("double")), F.avg(F.when(x > 0, x)), -F.avg(F.when(x <= 0, x))
    kelly = rows.agg(F.greatest(F.lit(0.0), F.least(F.lit(cap), F.coalesce(win - (1 - win) / (gain / loss + 1e-12), F.lit(0.0)))).alias("kelly"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(confidence) - gate) / (1 - gate)))
    return rows.join(F.broadcast(kelly), how="cross").withColumn("size", F.col("kelly") * scaled)


@dataclass(frozen=True)
class Strategy:
    """Fifty knobs; the defaults leave each without effect.  Fixed values: names and defaults."""

    conf_gate: float = 0.5
    margin_gate: float = 0.0
    neutral_mass_max: float = 1.0
    prob_floor: float = 0.0
    long_only: bool = False
    short_only: bool = False
    invert_signal: bool = False
    signal_ema_confirm: bool = False
    signal_ema_alpha: float = 0.2
    agreement_run: int = 0
    flip_block: int = 0
    size_mode: str = "fixed"
    base_size: float = 1.0
    kelly_frac: float = 0.5
    kelly_window: int = 200
    vol_target: float = 0.0
    size_cap: float = 1e9
    size_floor: float = 0.0
    equity_compound: bool = False
    base_equity: float = 1.0
    dd_derisk: float = 0.0
    anti_martingale: float = 1.0
    martingale: float = 1.0
    recovery_size: float = 1.0
    max_spread: float = 1e9
    min_tick_rate: float = -1e9
    vol_min: float = -1e9
    vol_max: float = 1e9
    trend_filter: int = 0
    trend_block: float = 0.0
    min_expected_edge: float = -1e9
    cost_skip_mult: float = 0.0
    session_mask: int = 0xFFFFFFFF
    env_mask: int = 0xFFFFFFFF
    edge_k: float = 1.0
    barrier_tp_mult: float = 1.0
    barrier_sl_mult: float = 1.0
    barrier_cost_mult: float = 1.5
    tp_clamp: float = 1e9
    sl_clamp: float = 1e9
    net_loss_cap: float = 1e9
    net_win_cap: float = 1e9
    extra_cost: float = 0.0
    max_dd_halt: float = 1e9
    cooldown_after_loss: int = 0
    cooldown_after_win: int = 0
    loss_streak_halt: int = 0
    win_streak_cap: int = 0
    daily_loss_limit: float = 1e9
    daily_trade_cap: int = 1 << 30
    min_trade_spacing: int = 0
    equity_floor_halt: float = -1e9
    equity_target_halt: float = 1e9

    @classmethod
    def of(cls, settings: dict) -> Strategy:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in settings.items() if k in kinds})


DAY_MS = 86_400_000


def regime_of(time_ms: int, rv: float) -> int:
    hour = time_ms % DAY_MS // 3_600_000 if time_ms > 0 else -1
    for regime, inside in ((0, 7 <= hour < 12), (1, 13 <= hour < 17), (2, hour >= 23 or 0 <= hour < 4), (3, rv > 1e-3), (4, rv < 1e-4)):
        if inside:
            return regime
    return 5


class Portfolio:
    """What a strategy remembers along one block of opportunities."""

    def __init__(self, knobs: Strategy):
        self.k = knobs
        self.equity = self.peak = self.worst = self.day_pnl = self.signal = 0.0
        self.wins = self.losses = self.cooldown = self.flips = self.day_trades = self.agreeing = 0
        self.last_at = self.day = -1
        self.last_side = self.agreed = 0
        self.day_closed = self.halted = False
        self.results: deque[float] = deque(maxlen=2 * knobs.kelly_window if knobs.kelly_window > 0 else None)

    def kelly(self) -> float:
        recent = list(self.results)[-self.k.kelly_window :] if self.k.kelly_window > 0 else list(self.results)
        won, lost = [x for x in recent if x > 0], [-x for x in recent if x <= 0]
        if not lost or sum(lost) / len(lost) <= 1e-12:
            return 0.0
        rate, ratio = len(won) / len(recent), (sum(won) / len(won) if won else 0.0) / (sum(lost) / len(lost))
        return max(0.0, rate - (1 - rate) / (ratio + 1e-12))

    def side(self, o) -> int:
        """Follow the signal: its mean, its run, the counters, the day; gives the model's side."""
        k = self.k
        self.signal += k.signal_ema_alpha * (o.p_up - o.p_down - self.signal)
        best = max(o.p_up, o.p_neutral, o.p_down)
        side = 0 if o.p_neutral == best else 1 if o.p_up == best else -1
        self.agreeing = self.agreeing + 1 if side and side == self.agreed else int(side != 0)
        self.agreed = side
        if o.time_ms > 0 and o.time_ms // DAY_MS != self.day:
            self.day, self.day_pnl, self.day_trades, self.day_closed = o.time_ms // DAY_MS, 0.0, 0, False
        return side

    def refuses(self, o, side: int, flipping: bool) -> bool:
        """Whether a knob speaks against trading this side."""
        k = self.k
        probabilities = sorted((o.p_up, o.p_neutral, o.p_down))
        sign = o.p_up - o.p_down
        move = k.edge_k * o.rv
        return any(
            (
                k.long_only and side != 1,
                k.short_only and side != -1,
                probabilities[2] < k.conf_gate,
                probabilities[2] - probabilities[1] < k.margin_gate,
                o.p_neutral > k.neutral_mass_max,
                (o.p_up if side == 1 else o.p_down) < k.prob_floor,
                k.signal_ema_confirm and self.signal * side <= 0,
                k.agreement_run > 0 and self.agreeing < k.agreement_run,
                flipping and self.last_side not in (0, side),
                o.spread > k.max_spread,
                o.tick_rate < k.min_tick_rate,
                not k.vol_min <= o.rv <= k.vol_max,
                k.trend_filter != 0 and o.momentum * side * k.trend_filter <= 0,
                k.trend_block > 0 and abs(o.momentum) > k.trend_block and o.momentum * side < 0,
                sign * side * move - o.cost < k.min_expected_edge,
                k.cost_skip_mult > 0 and o.cost > k.cost_skip_mult * move,
                o.time_ms > 0 and not k.session_mask >> (o.time_ms % DAY_MS // 3_600_000) & 1,
                k.env_mask != 0xFFFFFFFF and not k.env_mask >> regime_of(o.time_ms, o.rv) & 1,
                k.min_trade_spacing > 0 and self.last_at >= 0 and o.t_index - self.last_at < k.min_trade_spacing,
                self.worst > k.max_dd_halt,
            )
        )

    def size(self, o) -> float:
        k = self.k
        top = max(o.p_up, o.p_neutral, o.p_down)
        size = k.base_size
        if k.size_mode == "confidence":
            size *= min(1.0, max(0.0, (top - k.conf_gate) / max(1e-6, 1 - k.conf_gate)))
        elif k.size_mode == "kelly":
            size *= k.kelly_frac * self.kelly()
        elif k.size_mode == "vol_target":
            size *= k.vol_target / o.rv if o.rv > 1e-9 and k.vol_target > 0 else 1.0
        elif k.size_mode == "inv_spread":
            size /= 1 + max(0.0, o.spread)
        if k.equity_compound and k.base_equity > 1e-9:
            size *= max(0.0, self.equity / k.base_equity + 1)
        if k.dd_derisk > 0:
            size *= min(1.0, max(0.0, 1 - self.worst / k.dd_derisk))
        size *= k.anti_martingale**self.wins * k.martingale**self.losses
        if self.equity < self.peak:
            size *= k.recovery_size
        size = min(size, k.size_cap)
        return 0.0 if size < k.size_floor else max(size, 0.0)

    def close(self, net: float, side: int) -> None:
        k = self.k
        self.equity += net
        self.peak = max(self.peak, self.equity)
        self.worst = max(self.worst, self.peak - self.equity)
        won = net > 0
        self.wins, self.losses = (self.wins + 1, 0) if won else (0, self.losses + 1)
        self.cooldown = max(self.cooldown, k.cooldown_after_win if won else k.cooldown_after_loss, int(0 < k.win_streak_cap <= self.wins))
        self.day_pnl += net
        self.day_trades += 1
        self.day_closed |= self.day_pnl <= -k.daily_loss_limit or self.day_trades >= k.daily_trade_cap
        self.halted |= 0 < k.loss_streak_halt <= self.losses or self.equity < k.equity_floor_halt or self.equity >= k.equity_target_halt
        self.results.append(net)
        self.last_side = side
        self.flips = k.flip_block or self.flips

    def offer(self, o) -> tuple[int, float, float]:
        """Side, size and net of an opportunity; 0, 0, 0 if it isn't taken."""
        k = self.k
        model = self.side(o)
        cooling, flipping = self.cooldown > 0, self.flips > 0
        self.cooldown, self.flips = max(0, self.cooldown - 1), max(0, self.flips - 1)
        side = -model if k.invert_signal else model
        if self.halted or self.day_closed or cooling or not model or self.refuses(o, side, flipping):
            return 0, 0.0, 0.0
        size = self.size(o)
        if size <= 0:
            return 0, 0.0, 0.0
        gross = max(min(side * o.ret, k.tp_clamp), -k.sl_clamp)
        net = min(max(size * (gross - o.cost - k.extra_cost), -k.net_loss_cap), k.net_win_cap)
        self.last_at = o.t_index
        self.close(net, side)
        return side, size, net


def simulate(opportunities: DataFrame, knobs: Strategy, block: str = "block") -> DataFrame:
    """Trades that a strategy takes, block by block, each from a fresh state and in order of t_index.

    opportunities: block, t_index, time_ms, p_up, p_neutral, p_down, ret, cost, spread, rv, tick_rate, momentum.
    A block is a fold: its trades depend on one another, blocks don't.
    """

    ship(opportunities.sparkSession)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("t_index")
        state, rows = Portfolio(knobs), []
        for o in df.itertuples(index=False):
            side, size, net = state.offer(o)
            if side:
                rows.append((getattr(o, block), o.t_index, o.time_ms, side, size, net, state.equity))
        return pd.DataFrame(rows, columns=[block, "t_index", "time_ms", "direction", "size", "net", "equity"])

    kind = dict(opportunities.dtypes)[block]
    return opportunities.groupBy(block).applyInPandas(run, f"{block} {kind}, t_index long, time_ms long, direction int, size double, net double, equity double")


@dataclass
class Level:
    price: float
    strength: float
    touched: int


class LevelMemory:
    """Support and resistance prices: near ones merge, all fade, the weakest leave when there are too many."""

    def __init__(self, tolerance: float, fade: float = 0.999, most: int = 128):
        self.tolerance, self.fade, self.most, self.levels = tolerance, fade, most, []

    def react(self, price: float, size: float, at: int) -> None:
        for x in self.levels:
            x.strength *= self.fade
        near = min((x for x in self.levels if abs(x.price - price) <= self.tolerance), key=lambda x: abs(x.price - price), default=None)
        if near:
            near.price = (near.price * near.strength + price * size) / (near.strength + size)
            near.strength += size
            near.touched = at
        else:
            self.levels.append(Level(price, size, at))
            if len(self.levels) > self.most:
                self.levels.remove(min(self.levels, key=lambda x: x.strength))

    def nearest(self, price: float) -> tuple[float | None, float | None]:
        """The nearest level below and above a price."""
        below, above = [x.price for x in self.levels if x.price <= price], [x.price for x in self.levels if x.price > price]
        return (max(below) if below else None), (min(above) if above else None)


def level_context(bars: DataFrame, tolerance: float, most: int = 128) -> DataFrame:
    """support and resistance known before each bar, from reactions at earlier highs and lows of a symbol."""

    ship(bars.sparkSession)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("bucket_ms")
        memory, support, resistance = LevelMemory(tolerance, most=most), [], []
        for b in df.itertuples(index=False):
            s, r = memory.nearest(b.close)
            support.append(s)
            resistance.append(r)
            memory.react(b.high, b.high - b.close, b.bucket_ms) if b.high > b.close else None
            memory.react(b.low, b.close - b.low, b.bucket_ms) if b.low < b.close else None
        return df.assign(support=pd.Series(support, index=df.index, dtype=float), resistance=pd.Series(resistance, index=df.index, dtype=float))[["symbol", "bucket_ms", "close", "support", "resistance"]]

    return bars.select("symbol", "bucket_ms", "high", "low", "close").groupBy("symbol").applyInPandas(run, "symbol string, bucket_ms long, close double, support double, resistance double")
