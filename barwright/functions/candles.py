"""Candlestick patterns as boolean columns over a bar and the ones before it.

Every function takes `Kernels` and returns a dict from the pattern's direction (or kind) to a Column that is never null.
A bar whose high equals its low has no range, so ratios to it are null and patterns that need them don't hold.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import windows as win
from .indicators import Kernels



def _shape(k: Kernels) -> dict[str, str]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body = k.put("candle_body", lambda: F.abs(c - o))
    rng = k.put("candle_range", lambda: F.when(h != lo, h - lo))
    upper = k.put("candle_upper", lambda: h - F.greatest(o, c))
    lower = k.put("candle_lower", lambda: F.least(o, c) - lo)
    ratio = k.put("candle_ratio", lambda: F.try_divide(F.col(body), F.col(rng)))
    return {"body": body, "range": rng, "upper": upper, "lower": lower, "ratio": ratio}


def _all(*conditions: Column) -> Column:
    return win.is_true(reduce(and_, conditions))


def _ago(x: str, n: int) -> Column:
    return win.lag(F.col(x), n)


def engulfing(k: Kernels) -> dict[str, Column]:
    """A body that wraps the opposite body before it."""
    o, c, po, pc = F.col("open"), F.col("close"), _ago("open", 1), _ago("close", 1)
    return {"bullish": _all(pc < po, c > o, o <= pc, c >= po), "bearish": _all(pc > po, c < o, o >= pc, c <= po)}


def marubozu(k: Kernels, threshold: float = 0.9) -> dict[str, Column]:
    """A body that is most of the bar."""
    strong = F.col(_shape(k)["ratio"]) >= threshold
    return {"bullish": _all(strong, F.col("close") > F.col("open")), "bearish": _all(strong, F.col("close") < F.col("open"))}


def pin_bar(k: Kernels, body_max: float = 0.3, wick_times: float = 2.0) -> dict[str, Column]:
    """A short body with one long wick."""
    s = {n: F.col(c) for n, c in _shape(k).items()}
    small = s["ratio"] <= body_max
    one = lambda long, short: _all(small, s[long] >= wick_times * s["body"], s[short] <= s["body"])
    return {"bullish": one("lower", "upper"), "bearish": one("upper", "lower")}


def doji(k: Kernels, body_max: float = 0.1, long_wick: float = 0.3, extreme_wick: float = 0.6, short_wick: float = 0.1) -> dict[str, Column]:
    """Open and close nearly equal; the first kind that fits of dragonfly, gravestone, long-legged, standard."""
    s = {n: F.col(c) for n, c in _shape(k).items()}
    up, down = F.try_divide(s["upper"], s["range"]), F.try_divide(s["lower"], s["range"])
    kind = k.put(
        f"doji_{body_max}_{long_wick}_{extreme_wick}_{short_wick}",
        lambda: F.when(_all(s["ratio"] <= body_max), F.when((down >= extreme_wick) & (up <= short_wick), "dragonfly").when((up >= extreme_wick) & (down <= short_wick), "gravestone").when((up >= long_wick) & (down >= long_wick), "long_legged").otherwise("standard")),
    )
    return {name: win.is_true(F.col(kind) == name) for name in ("standard", "long_legged", "dragonfly", "gravestone")}


def inside_bar(k: Kernels) -> dict[str, Column]:
    """A bar within the range of the one before."""
    return {"any": _all(F.col("high") <= _ago("high", 1), F.col("low") >= _ago("low", 1))}


def inside_bar_breakout(k: Kernels, lookback: int = 5) -> dict[str, Column]:
    """The first close beyond the mother bar's range within `lookback` bars of an inside bar; a new inside bar starts anew."""
    name = f"inside_breakout_{lookback}"
    inside = k.put("inside_bar", lambda: inside_bar(k)["any"])
    group = k.put("inside_group", lambda: F.sum(F.col(inside).cast("int")).over(win.to_now()))
    own = Window.partitionBy("ticker", group).orderBy("ts")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    before_high, before_low = k.put("mother_high_1", lambda: _ago("high", 1)), k.put("mother_low_1", lambda: _ago("low", 1))
    high = k.put("mother_high", lambda: F.first(before_high).over(upto))
    low = k.put("mother_low", lambda: F.first(before_low).over(upto))
    age = k.put("inside_age", lambda: F.row_number().over(own) - 1)
    side = k.put(f"{name}_side", lambda: F.when((F.col(group) > 0) & (F.col(age) <= lookback), F.when(F.col("close") > F.col(high), 1).when(F.col("close") < F.col(low), -1)))
    nth = k.put(f"{name}_nth", lambda: F.count(side).over(upto))
    hit = k.put(name, lambda: F.when(F.col(nth) == 1, F.col(side)))
    return {"bullish": win.is_true(F.col(hit) == 1), "bearish": win.is_true(F.col(hit) == -1)}


def piercing_dark_cloud(k: Kernels, n: int = 20, times: float = 2.0) -> dict[str, Column]:
    """A close past the middle of the opposite body before it, back inside a band that the bar had left."""
    _, upper, lower = (F.col(c) for c in k.bands("close", n, times))
    o, h, lo, c, po, pc = F.col("open"), F.col("high"), F.col("low"), F.col("close"), _ago("open", 1), _ago("close", 1)
    mid = (po + pc) / 2
    return {
        "bullish": _all(pc < po, c > o, o < pc, c > mid, c < po, lo < lower, c > lower),
        "bearish": _all(pc > po, c < o, o > pc, c < mid, c > po, h > upper, c < upper),
    }


def star(k: Kernels, star_max: float = 0.3, big_min: float = 0.5) -> dict[str, Column]:
    """Morning and evening star: a big body, a small one beyond its close, a big one back past its middle."""
    ratio = _shape(k)["ratio"]
    o, c = F.col("open"), F.col("close")
    o1, c1, o2, c2 = _ago("open", 2), _ago("close", 2), _ago("open", 1), _ago("close", 1)
    sizes = [_ago(ratio, 2) >= big_min, _ago(ratio, 1) <= star_max, F.col(ratio) >= big_min]
    mid = (o1 + c1) / 2
    return {
        "bullish": _all(*sizes, c1 < o1, F.greatest(o2, c2) < c1, c > o, c > mid),
        "bearish": _all(*sizes, c1 > o1, F.least(o2, c2) > c1, c < o, c < mid),
    }


def three_soldiers_crows(k: Kernels, body_min: float = 0.6) -> dict[str, Column]:
    """Three strong bodies in a row, each opening inside the one before and closing beyond it."""
    ratio = _shape(k)["ratio"]
    o = [_ago("open", 2), _ago("open", 1), F.col("open")]
    c = [_ago("close", 2), _ago("close", 1), F.col("close")]
    strong = [_ago(ratio, 2) >= body_min, _ago(ratio, 1) >= body_min, F.col(ratio) >= body_min]
    rise = [x > y for x, y in zip(c, o, strict=True)] + [c[i] > c[i - 1] for i in (1, 2)] + [(o[i] > o[i - 1]) & (o[i] < c[i - 1]) for i in (1, 2)]
    fall = [x < y for x, y in zip(c, o, strict=True)] + [c[i] < c[i - 1] for i in (1, 2)] + [(o[i] < o[i - 1]) & (o[i] > c[i - 1]) for i in (1, 2)]
    return {"bullish": _all(*strong, *rise), "bearish": _all(*strong, *fall)}


def three_methods(k: Kernels, pause: int = 3, big_min: float = 0.5) -> dict[str, Column]:
    """A big body, `pause` bars inside its range, a big body in the same direction beyond its close."""
    ratio = _shape(k)["ratio"]
    n = pause + 1
    h0, l0, o0, c0 = _ago("high", n), _ago("low", n), _ago("open", n), _ago("close", n)
    held = [(_ago("high", i) <= h0) & (_ago("low", i) >= l0) for i in range(1, n)]
    big = [_ago(ratio, n) >= big_min, F.col(ratio) >= big_min, *held]
    o, c = F.col("open"), F.col("close")
    return {"bullish": _all(*big, c0 > o0, c > o, c > c0), "bearish": _all(*big, c0 < o0, c < o, c < c0)}


PATTERNS = {
    "engulfing": engulfing, "marubozu": marubozu, "pin_bar": pin_bar, "doji": doji, "inside_bar": inside_bar, "inside_bar_breakout": inside_bar_breakout,
    "piercing_dark_cloud": piercing_dark_cloud, "star_pattern": star, "three_soldiers_crows": three_soldiers_crows, "three_methods": three_methods,
}
