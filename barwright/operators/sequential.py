"""State machines over one ticker's bars, which windows cannot express: grouped Arrow tables, one ticker a group.

A group is one ticker's history, whose size is the number of its bars. All its columns travel through the function, so
nothing is joined back. The machines look at the bars where signals are on and jump between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import windows as win
from ..functions.indicators import Kernels

Columns = dict[str, np.ndarray | pa.Array]


def per_ticker(bars: DataFrame, reads: list[str], machine: Callable[[Columns], dict[str, pa.Array]], adds: str) -> DataFrame:
    """bars with the columns `adds` (a DDL schema) that `machine` makes of `reads` in each ticker's rows in time order.

    A machine gets the columns as numpy arrays, and the times as they are under `ts`.
    """
    schema = StructType([*bars.schema.fields, *StructType.fromDDL(adds).fields])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ts").combine_chunks()
        made = machine({c: rows.column(c).to_numpy() for c in reads} | {"ts": rows.column("ts").chunk(0)})
        for name, values in made.items():
            rows = rows.append_column(name, values)
        return rows

    return bars.groupBy("ticker").applyInArrow(run, schema)


def _floats(col: Columns, *names: str) -> list[np.ndarray]:
    return [np.asarray(col[n], float) for n in names]


def _on(x: np.ndarray) -> np.ndarray:
    """Where a boolean column is true, ascending."""
    return np.flatnonzero(x.astype(bool))


def _next(places: np.ndarray, at: int, none: int) -> int:
    """The first of the ascending places from `at` on."""
    i = int(np.searchsorted(places, at))
    return int(places[i]) if i < len(places) else none


def reversals(pivots: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], fires: np.ndarray, k: int, window: int) -> np.ndarray:
    """Events of a two-pivot reversal: a pivot is known k bars later; a pair of neighbours that fits arms for `window` bars.

    The first bar from the arming on where `fires` holds is the event; armings that meet at one bar give one event.
    fits(first, second) tells which pairs of places fit.
    """
    out, at, hits = np.zeros(len(fires), bool), _on(pivots), _on(fires)
    first, second = at[:-1], at[1:]
    pairs = (second - first <= window) & fits(first, second) if len(at) > 1 else np.zeros(0, bool)
    armed = second[pairs] + k
    nth = np.searchsorted(hits, armed)
    armed, nth = armed[nth < len(hits)], nth[nth < len(hits)]
    event = hits[nth]
    out[event[event <= armed + window]] = True
    return out


def _crosses(close: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.zeros(len(close), bool), np.zeros(len(close), bool)
    with np.errstate(invalid="ignore"):
        up[1:] = (close[1:] > mid[1:]) & (close[:-1] <= mid[:-1])
        down[1:] = (close[1:] < mid[1:]) & (close[:-1] >= mid[:-1])
    return up, down


def double_pattern(k: Kernels, band_period: int = 20, band_std: float = 2.0, pivot_lookback: int = 5, pattern_window: int = 40, volume_mult: float = 1.5) -> dict[str, str]:
    """Two lows, the first below the lower band and the second inside, then a close over the middle on high volume; and mirrored."""
    name = f"double_{band_period}_{band_std}_{pivot_lookback}_{pattern_window}_{volume_mult}".replace(".", "_")
    out = {"bullish": f"{name}_bull", "bearish": f"{name}_bear"}
    if out["bullish"] in k.made:
        return out
    mid, upper, lower = k.bands("close", band_period, band_std)
    volume = k.sma("volume", band_period)
    lows, highs = k.pivot("low", pivot_lookback, True), k.pivot("high", pivot_lookback, False)

    def machine(col: Columns) -> dict[str, pa.Array]:
        high, low, close, vol, mean, m, u, lo = _floats(col, "high", "low", "close", "volume", volume, mid, upper, lower)
        up, down = _crosses(close, m)
        with np.errstate(invalid="ignore"):
            loud = vol >= volume_mult * mean
            bull = reversals(col[lows], lambda a, b: (low[a] < lo[a]) & (low[b] >= lo[b]), up & loud, pivot_lookback, pattern_window)
            bear = reversals(col[highs], lambda a, b: (high[a] > u[a]) & (high[b] <= u[b]), down & loud, pivot_lookback, pattern_window)
        return {out["bullish"]: pa.array(bull), out["bearish"]: pa.array(bear)}

    k.replace(per_ticker(k.df, ["high", "low", "close", "volume", mid, upper, lower, volume, lows, highs], machine, ", ".join(f"{c} boolean" for c in out.values())))
    return out


def rsi_divergence(k: Kernels, rsi_period: int = 14, band_period: int = 20, pivot_lookback: int = 5, pattern_window: int = 40) -> dict[str, str]:
    """A lower low of the price with a higher one of the RSI, then a close over the middle; and mirrored."""
    name = f"divergence_{rsi_period}_{band_period}_{pivot_lookback}_{pattern_window}"
    out = {"bullish": f"{name}_bull", "bearish": f"{name}_bear"}
    if out["bullish"] in k.made:
        return out
    rsi, mid = k.rsi("close", rsi_period), k.sma("close", band_period)
    lows, highs = k.pivot("low", pivot_lookback, True), k.pivot("high", pivot_lookback, False)

    def machine(col: Columns) -> dict[str, pa.Array]:
        high, low, close, r, m = _floats(col, "high", "low", "close", rsi, mid)
        up, down = _crosses(close, m)
        with np.errstate(invalid="ignore"):
            bull = reversals(col[lows], lambda a, b: (low[b] < low[a]) & (r[b] > r[a]), up, pivot_lookback, pattern_window)
            bear = reversals(col[highs], lambda a, b: (high[b] > high[a]) & (r[b] < r[a]), down, pivot_lookback, pattern_window)
        return {out["bullish"]: pa.array(bull), out["bearish"]: pa.array(bear)}

    k.replace(per_ticker(k.df, ["high", "low", "close", rsi, mid, lows, highs], machine, ", ".join(f"{c} boolean" for c in out.values())))
    return out


def adx(k: Kernels, n: int = 14) -> str:
    """Average directional index: Wilder's averages, each begun by a plain mean of n values; zero until it is defined.

    All of it is windows: an average that begins with a mean is the exponential one of a column that holds the mean at
    its first place.
    """
    name = f"adx_{n}"
    if name in k.made:
        return name
    high, low, before = F.col("high"), F.col("low"), win.lag(F.col("close"))
    at = k.put("bar_number", lambda: F.row_number().over(win.by_time()) - 1)
    rise = k.put("move_up", lambda: high - win.lag(high))
    fall = k.put("move_down", lambda: win.lag(low) - low)
    true = k.put("true_range", lambda: F.when(F.col(at) > 0, F.greatest(high, before) - F.least(low, before)))
    up, down = F.col(rise), F.col(fall)
    plus = k.put("move_plus", lambda: F.when(F.col(at) > 0, F.when((up > down) & (up > 0), up).otherwise(0.0)))
    minus = k.put("move_minus", lambda: F.when(F.col(at) > 0, F.when((down > up) & (down > 0), down).otherwise(0.0)))

    def wilder(x: str, first: int) -> str:
        begun = k.put(f"begun_{x}_{n}_{first}", lambda: F.when(F.col(at) == first, win.rolling(F.avg, F.col(x), n)).when(F.col(at) > first, F.col(x)))
        return k.smoothed(begun, 1 / n, 1)

    t, p, m = (F.col(wilder(x, n)) for x in (true, plus, minus))
    a, b = (F.coalesce(F.try_divide(x, F.nullif(t, F.lit(0.0))), F.lit(0.0)) for x in (p, m))
    dx = k.put(f"dx_{n}", lambda: F.when(F.col(at) >= n, F.coalesce(F.try_divide(100 * F.abs(a - b), F.nullif(a + b, F.lit(0.0))), F.lit(0.0))))
    smooth = wilder(dx, 2 * n - 1)
    bars = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return k.put(name, lambda: F.when((F.col(at) >= 2 * n - 1) & (bars > 2 * n), F.coalesce(smooth, F.lit(0.0))).otherwise(0.0))


EVENT = "array<struct<ts:{ts},kind:string,stage:int,weight:double,price:double,reason:string>>"


def _first(x: np.ndarray, at: int, test: Callable[[np.ndarray], np.ndarray]) -> int:
    """The first place from `at` on where test holds, looked for in spans that double; len(x) if none."""
    span = 64
    while at < len(x):
        hit = np.flatnonzero(test(x[at : at + span]))
        if len(hit):
            return at + int(hit[0])
        at, span = at + span, 2 * span
    return len(x)


class _Stages:
    """One ticker's signals as places where they are on, and the cycles of positions that follow from them."""

    def __init__(self, close: np.ndarray, entries: list[np.ndarray], exits: list[np.ndarray], emergency: np.ndarray | None, level: np.ndarray | None, multiple: float | None):
        self.close, self.level, self.multiple, self.n = close, level, multiple, len(close)
        self.entries, self.exits = [_on(e) for e in entries], [_on(e) for e in exits]
        self.emergency = None if emergency is None else _on(emergency)

    def end(self, start: int) -> tuple[int, str, float]:
        """(place, kind, price level) of what ends a cycle as a whole; of several at one bar the first in this order."""
        found = [(_next(self.emergency, start, self.n), "emergency_exit", 0.0)] if self.emergency is not None else []
        stop = float(self.level[start]) if self.level is not None else float("nan")
        if stop == stop:
            if self.multiple is not None:
                target = float(self.close[start] + self.multiple * (self.close[start] - stop))
                found.append((_first(self.close, start, lambda x: x >= target), "take_profit", target))
            found.append((_first(self.close, start, lambda x: x < stop), "stop_loss", stop))
        if self.exits:
            found.append((_next(self.exits[-1], start, self.n), "exit", 0.0))
        return min(found, key=lambda f: f[0], default=(self.n, "", 0.0))

    def openings(self, start: int) -> dict[int, int]:
        """stage: place where it opens if the cycle goes on: each after the one before, the last whenever it wants to.

        Once the last one is open none follows, save those of the same bar.
        """
        last, out, at = _next(self.entries[-1], start, self.n), {}, start
        for stage, places in enumerate(self.entries[:-1], 1):
            at = _next(places, at, self.n)
            if at == self.n or at > last:
                break
            out[stage] = at
        return out | ({len(self.entries): last} if last < self.n else {})

    def cycles(self) -> Iterator[tuple[dict[int, int], dict[int, int], int, str, float]]:
        """(openings, closings by their own exits, end, its kind and price level) of each cycle."""
        at = 0
        while at < self.n and self.entries:
            start = min(_next(self.entries[0], at, self.n), _next(self.entries[-1], at, self.n))
            if start == self.n:
                return
            end, kind, price = self.end(start)
            opened = {s: t for s, t in self.openings(start).items() if t <= end}
            own = {s: _next(self.exits[s - 1], t, self.n) for s, t in opened.items() if s < len(self.exits)}
            own = {s: t for s, t in own.items() if t < end}
            for t in sorted(set(own.values())):  # the first bar at which all that is open has left ends the cycle
                if all(own.get(s, self.n) <= t for s, o in opened.items() if o <= t):
                    opened, own, end, kind = {s: o for s, o in opened.items() if o <= t}, {s: c for s, c in own.items() if c <= t}, t, ""
                    break
            yield opened, own, end, kind, price
            at = end + 1


def staged(k: Kernels, entries: list[tuple[str, float, str]], exits: list[tuple[str, str]], emergency: tuple[str, str] | None, stop: str | None, multiple: float | None, name: str = "staged") -> tuple[str, str]:
    """Staged positions: columns of the weight held and of each bar's events.

    entries: (signal, weight, reason) by stage; exits: (signal, reason); signals and reasons are columns. Stages before
    the last open in turn, the last may open at once. While a cycle is open the first of these that holds ends it:
    the emergency signal, the target (entry price plus `multiple` times its distance from the stop), the stop taken
    from column `stop` on the first bar, the last exit; earlier exits close their own stage.
    """
    weight, events = f"{name}_weight", f"{name}_events"
    event = EVENT.format(ts=dict(k.df.dtypes)["ts"])
    reads = ["close", *dict.fromkeys([c for s, _, r in entries for c in (s, r)] + [c for e in exits for c in e] + list(emergency or ()) + ([stop] if stop else []))]

    def machine(col: Columns) -> dict[str, pa.Array]:
        (close,) = _floats(col, "close")
        found = _Stages(close, [col[s] for s, *_ in entries], [col[s] for s, _ in exits], col[emergency[0]] if emergency else None, _floats(col, stop)[0] if stop else None, multiple)
        held, log = np.zeros(len(close)), []  # log: (place, order in the bar, kind, stage, reason)
        for opened, own, end, kind, price in found.cycles():
            for stage, at in opened.items():
                held[at : own.get(stage, end)] += entries[stage - 1][1]
                log.append((at, 0, "entry", stage, col[entries[stage - 1][2]][at]))
            log += [(at, 1, "exit", stage, col[exits[stage - 1][1]][at]) for stage, at in own.items()]
            if kind and end < len(close):
                why = {"emergency_exit": lambda: col[emergency[1]][end], "take_profit": lambda: f"target {price:.2f} reached", "stop_loss": lambda: f"stop {price:.2f} broken", "exit": lambda: col[exits[-1][1]][end]}[kind]()
                log += [(end, 1, kind, stage, why) for stage in opened.keys() - own.keys()]
        log.sort(key=lambda e: (e[0], e[1], e[3]))
        at = np.array([e[0] for e in log], np.int64)
        parts = {
            "ts": col["ts"].take(pa.array(at)), "kind": pa.array([e[2] for e in log], pa.string()), "stage": pa.array([e[3] for e in log], pa.int32()), "weight": pa.array([entries[e[3] - 1][1] for e in log], pa.float64()),
            "price": pa.array(close[at], pa.float64()), "reason": pa.array([e[4] for e in log], pa.string()),
        }
        bars = pa.array(np.searchsorted(at, np.arange(len(close) + 1)), pa.int32())
        return {weight: pa.array(held), events: pa.ListArray.from_arrays(bars, pa.StructArray.from_arrays(list(parts.values()), list(parts)))}

    k.replace(per_ticker(k.df, reads, machine, f"{weight} double, {events} {event}"))
    return weight, events


def staged_trades(curve: DataFrame, events: str) -> DataFrame:
    """(ticker, entry_date, exit_date, entry_price, exit_price, return_pct): cycles of staged events.

    Events fill at the next bar's close (the last bar's own). A cycle ends where the weights opened and closed so far
    even out; one still open at the end is valued at the last close.
    """
    w = Window.partitionBy("ticker").orderBy("ts")
    last = Window.partitionBy("ticker")
    bars = curve.select("ticker", "ts", events, F.coalesce(F.lead("close").over(w), F.col("close")).alias("fill"), F.max("ts").over(last).alias("last_ts"), F.last("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_close"))
    each = bars.select("ticker", "ts", "fill", "last_ts", "last_close", F.posexplode(events).alias("nth", "e"))
    signed = F.when(F.col("e.kind") == "entry", F.col("e.weight")).otherwise(-F.col("e.weight"))
    by = Window.partitionBy("ticker").orderBy("ts", "nth")
    each = each.withColumn("open_after", F.round(F.sum(signed).over(by.rowsBetween(Window.unboundedPreceding, 0)), 9))
    each = each.withColumn("cycle", F.coalesce(F.sum(F.when((F.col("e.kind") != "entry") & (F.col("open_after") <= 1e-9), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    entry, weight = F.col("e.kind") == "entry", F.col("e.weight")
    mean = lambda c: F.try_divide(F.sum(F.when(c, weight * F.col("fill"))), F.sum(F.when(c, weight)))
    closed = F.max_by("open_after", F.struct("ts", "nth")) <= 1e-9
    out = each.groupBy("ticker", "cycle").agg(
        F.min(F.when(entry, F.col("ts"))).alias("entry_date"), F.when(closed, F.max("ts")).otherwise(F.max("last_ts")).alias("exit_date"), F.coalesce(mean(entry), F.lit(0.0)).alias("entry_price"), F.when(closed, mean(~entry)).otherwise(F.max("last_close")).alias("exit_price")
    )
    gain = F.when(F.col("entry_price") > 0, (F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1) * 100)
    return out.withColumn("return_pct", gain).drop("cycle")
