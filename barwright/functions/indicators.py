"""Technical indicators as window columns that are made once and shared.

`Kernels` wraps a bar table. Each indicator adds its columns under a name made of its parameters and returns the
names; asking again returns the same names. Inputs are column names, so indicators nest, one projection a level.
Everything is partitioned by ticker and ordered by time: Spark shuffles and sorts once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as win


class Kernels:
    """A bar table with indicator columns; `df` has all that were made so far.

    `longest` bounds the bars of a ticker where that is known (daily bars of ten years: 2,600). Exponential averages
    then need a single running sum where the powers of their decay stay in a double's range; else they are summed in
    blocks of bars that do, with what the block before leaves carried on.
    """

    def __init__(self, bars: DataFrame, longest: int | None = None):
        self.df, self.longest, self.made = bars, longest, set(bars.columns)

    def put(self, name: str, make: Callable[[], Column]) -> str:
        """The column `name`, made on first use."""
        name = name.replace(".", "_").replace("-", "m")
        if name not in self.made:
            made = make()
            self.df = self.df.withColumn(name, made)
            self.made.add(name)
        return name

    def replace(self, df: DataFrame) -> None:
        """Goes on with a table that has more columns."""
        self.df, self.made = df, set(df.columns)

    # ------------------------------------------------------------ averages and spreads
    def sma(self, x: str, n: int) -> str:
        return self.put(f"sma_{x}_{n}", lambda: win.rolling(F.avg, F.col(x), n))

    def std(self, x: str, n: int, ddof: int = 0) -> str:
        return self.put(f"std{ddof}_{x}_{n}", lambda: win.rolling(F.stddev_samp if ddof else F.stddev_pop, F.col(x), n))

    def highest(self, x: str, n: int) -> str:
        return self.put(f"highest_{x}_{n}", lambda: win.rolling(F.max, F.col(x), n))

    def lowest(self, x: str, n: int) -> str:
        return self.put(f"lowest_{x}_{n}", lambda: win.rolling(F.min, F.col(x), n))

    def smoothed(self, x: str, alpha: float, least: int) -> str:
        """y0 = x0, y = (1 - alpha) y + alpha x from x's first value on; null until `least` values."""
        name = f"ewm_{x}_{alpha:.8f}_{least}"
        if name.replace(".", "_") in self.made:
            return name.replace(".", "_")
        q = 1 - alpha
        block = max(1, int(600 / -math.log(q))) if q > 0 else 1
        t = self.put(f"t_{x}", lambda: win.position_in(F.col(x)))
        one_block = self.longest is not None and self.longest <= block
        step = F.col(t) % block
        weight = F.when(F.col(t) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        term = F.when(F.col(x).isNotNull(), weight * F.col(x) * F.pow(F.lit(q), -step))
        by = win.by_time() if one_block else Window.partitionBy("ticker", F.floor(F.col(t) / block)).orderBy("ts")
        part = self.put(f"{name}_part", lambda: F.pow(F.lit(q), step) * F.sum(term).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        if one_block:
            value = F.col(part)
        else:
            ends = F.when((step == block - 1) & F.col(x).isNotNull(), F.col(part))
            carried = self.put(f"{name}_carried", lambda: F.last(ends, ignorenulls=True).over(win.by_time().rowsBetween(Window.unboundedPreceding, -1)))
            value = F.col(part) + F.when(F.col(t) >= block, F.pow(F.lit(q), step + 1) * F.col(carried)).otherwise(0.0)
        return self.put(name, lambda: F.when((F.col(t) >= least - 1) & F.col(x).isNotNull(), value))

    def ema(self, x: str, n: int) -> str:
        return self.smoothed(x, 2 / (n + 1), n)

    def average(self, x: str, n: int, kind: str = "sma") -> str:
        return self.ema(x, n) if kind == "ema" else self.sma(x, n)

    # ------------------------------------------------------------ momentum
    def roc(self, x: str, n: int) -> str:
        return self.put(f"roc_{x}_{n}", lambda: (F.try_divide(F.col(x), win.lag(F.col(x), n)) - 1) * 100)

    def rsi(self, x: str, n: int = 14) -> str:
        diff = self.put(f"diff_{x}", lambda: F.col(x) - win.lag(F.col(x)))
        up = self.put(f"up_{x}", lambda: F.when(F.col(x).isNotNull(), F.coalesce(F.greatest(F.col(diff), F.lit(0.0)), F.lit(0.0))))
        down = self.put(f"down_{x}", lambda: F.when(F.col(x).isNotNull(), F.coalesce(F.greatest(-F.col(diff), F.lit(0.0)), F.lit(0.0))))
        u, d = F.col(self.smoothed(up, 1 / n, n)), F.col(self.smoothed(down, 1 / n, n))
        return self.put(f"rsi_{x}_{n}", lambda: F.when(d == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(u, d))))

    def macd(self, x: str, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[str, str, str]:
        a, b = self.ema(x, fast), self.ema(x, slow)
        line = self.put(f"macd_{x}_{fast}_{slow}", lambda: F.col(a) - F.col(b))
        trigger = self.ema(line, signal)
        return line, trigger, self.put(f"macdh_{x}_{fast}_{slow}_{signal}", lambda: F.col(line) - F.col(trigger))

    def mfi(self, high: str = "high", low: str = "low", close: str = "close", volume: str = "volume", n: int = 14) -> str:
        key = f"{high}_{low}_{close}"
        tp = self.put(f"tp_{key}", lambda: (F.col(high) + F.col(low) + F.col(close)) / 3)
        before = self.put(f"tpb_{key}", lambda: win.lag(F.col(tp)))
        flow = F.col(tp) * F.col(volume)
        gain = self.put(f"mfu_{key}_{volume}", lambda: F.when(F.col(tp) > F.col(before), flow).when(flow.isNotNull(), F.lit(0.0)))
        loss = self.put(f"mfd_{key}_{volume}", lambda: F.when(F.col(tp) < F.col(before), flow).when(flow.isNotNull(), F.lit(0.0)))
        p, q = (self.put(f"sum_{c}_{n}", lambda c=c: win.rolling(F.sum, F.col(c), n)) for c in (gain, loss))
        return self.put(f"mfi_{key}_{volume}_{n}", lambda: F.when((F.col(q) == 0) & (F.col(p) > 0), F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(F.col(p), F.col(q)))))

    # ------------------------------------------------------------ bands
    def bands(self, x: str, n: int = 20, k: float = 2.0) -> tuple[str, str, str]:
        """(mid, upper, lower)."""
        mid, std = self.sma(x, n), self.std(x, n)
        upper = self.put(f"bbu_{x}_{n}_{k}", lambda: F.col(mid) + k * F.col(std))
        return mid, upper, self.put(f"bbl_{x}_{n}_{k}", lambda: F.col(mid) - k * F.col(std))

    def band_width(self, x: str, n: int = 20, k: float = 2.0) -> str:
        mid, upper, lower = self.bands(x, n, k)
        return self.put(f"bbw_{x}_{n}_{k}", lambda: F.try_divide(F.col(upper) - F.col(lower), F.col(mid)))

    def percent_b(self, x: str, n: int = 20, k: float = 2.0) -> str:
        _, upper, lower = self.bands(x, n, k)
        return self.put(f"pctb_{x}_{n}_{k}", lambda: F.try_divide(F.col(x) - F.col(lower), F.col(upper) - F.col(lower)))

    def squeeze_release(self, n: int = 20, k: float = 2.0, threshold: float = 0.1, lookback: int = 20, hold: int = 3) -> str:
        width = F.col(self.band_width("close", n, k))
        key = f"{n}_{k}_{threshold}_{lookback}"
        tight = self.put(f"tight_{key}", lambda: win.is_true(width < threshold).cast("int"))
        was = self.put(f"was_tight_{key}", lambda: F.max(tight).over(win.over(win.by_time(), -lookback, -1)))
        event = self.put(f"release_{key}", lambda: win.is_true((width >= threshold) & (win.lag(width) < threshold) & (F.col(was) == 1)).cast("int"))
        return self.put(f"squeeze_release_{key}_{hold}", lambda: F.max(event).over(win.over(win.by_time(), -(hold - 1), 0)) == 1)

    def ichimoku(self, tenkan: int = 9, kijun: int = 26, span_b: int = 52, shift: int = 26) -> dict[str, str]:
        def middle(n: int) -> str:
            high, low = self.highest("high", n), self.lowest("low", n)
            return self.put(f"mid_{n}", lambda: (F.col(high) + F.col(low)) / 2)

        t, k, b = middle(tenkan), middle(kijun), middle(span_b)
        key = f"{tenkan}_{kijun}_{span_b}_{shift}"
        lead_a = self.put(f"span_a_{key}", lambda: win.lag((F.col(t) + F.col(k)) / 2, shift))
        lead_b = self.put(f"span_b_{key}", lambda: win.lag(F.col(b), shift))
        return {
            "tenkan": t, "kijun": k, "span_a": lead_a, "span_b": lead_b,
            "cloud_top": self.put(f"cloud_top_{key}", lambda: F.greatest(lead_a, lead_b)),
            "cloud_bottom": self.put(f"cloud_bottom_{key}", lambda: F.least(lead_a, lead_b)),
            "chikou_ref": self.put(f"chikou_{shift}", lambda: win.lag(F.col("close"), shift)),
        }

    # ------------------------------------------------------------ volume and pivots
    def volume_ratio(self, n: int = 20) -> str:
        return self.put(f"volume_ratio_{n}", lambda: F.try_divide(F.col("volume"), win.rolling(F.avg, F.col("volume"), n, high=-1)))

    def volume_dryup(self, n: int = 10) -> str:
        return self.put(f"volume_dryup_{n}", lambda: F.try_divide(F.col("volume"), win.rolling(F.max, F.col("volume"), n, high=-1)))

    def pivot(self, x: str, k: int, low: bool) -> str:
        """True where x is the least (or greatest) of the k values on either side."""
        frame = win.over(win.by_time(), -k, k)
        agg = F.min if low else F.max
        return self.put(f"pivot_{'low' if low else 'high'}_{x}_{k}", lambda: win.is_true((F.count(x).over(frame) == 2 * k + 1) & (F.col(x) == agg(x).over(frame))))
