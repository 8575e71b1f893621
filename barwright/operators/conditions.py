"""Strategy conditions: dicts with an `indicator` become boolean columns over bars, never null.

Comparisons with missing values are false before AND, OR and NOT apply; states called dead are the negation of golden,
so they hold while averages warm up.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import candles
from ..functions import windows as win
from ..functions.indicators import Kernels
from . import sequential

Condition = dict
OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(x: Column, op: str, value: float) -> Column:
    if op not in OPERATIONS:
        raise ValueError(f"unknown comparison {op!r}")
    return win.is_true(OPERATIONS[op](x, F.lit(float(value))))


def _number(name: str, default: float) -> Callable[[Condition], float]:
    return lambda c: float(c.get(name, default))


def _crossing(a: Column, b: Column, up: bool) -> Column:
    return win.crossed_over(a, b) if up else win.crossed_under(a, b)


def _ma_cross(k: Kernels, c: Condition) -> Column:
    kind = c.get("ma_type", "sma")
    short, long = (F.col(k.average("close", int(c.get(p, d)), kind)) for p, d in (("short", 20), ("long", 60)))
    golden = win.is_true(short > long)
    return golden if c.get("type", "golden") == "golden" else ~golden


def _rsi(k: Kernels, c: Condition) -> Column:
    return compare(F.col(k.rsi("close", int(c.get("period", 14)))), c.get("op", "<"), c.get("value", 30))


def _rsi_cross(k: Kernels, c: Condition) -> Column:
    return _crossing(F.col(k.rsi("close", int(c.get("period", 14)))), F.lit(float(c.get("level", 30))), c.get("direction", "up") == "up")


def _bollinger(k: Kernels, c: Condition) -> Column:
    mid, upper, lower = (F.col(x) for x in k.bands("close", int(c.get("period", 20)), float(c.get("std_dev", 2.0))))
    close, over = F.col("close"), c.get("op") == "break_above"
    band = c.get("band", "lower")
    if band == "mid":
        return win.is_true(close > mid if over else close < mid)
    return win.is_true(close > upper if band == "upper" or over else close < lower)


def _macd(k: Kernels, c: Condition) -> tuple[str, str, str]:
    return k.macd("close", *(int(c.get(p, d)) for p, d in (("fast", 12), ("slow", 26), ("signal", 9))))


def _macd_cross(k: Kernels, c: Condition) -> Column:
    line, signal, _ = (F.col(x) for x in _macd(k, c))
    hit, zone = _crossing(line, signal, c.get("direction", "golden") == "golden"), c.get("zone", "any")
    if zone == "below_zero":
        return hit & win.is_true(line < 0)
    return hit & win.is_true(line > 0) if zone == "above_zero" else hit


def _macd_level(k: Kernels, c: Condition) -> Column:
    line, _, hist = _macd(k, c)
    return compare(F.col(hist if c.get("source", "macd") == "hist" else line), c.get("op", "<"), c.get("value", 0))


def _ichimoku(k: Kernels, c: Condition) -> dict[str, Column]:
    made = k.ichimoku(*(int(c.get(p, d)) for p, d in (("tenkan_len", 9), ("kijun_len", 26), ("span_b_len", 52), ("displacement", 26))))
    return {n: F.col(x) for n, x in made.items()}


def _tk_state(k: Kernels, c: Condition) -> Column:
    i = _ichimoku(k, c)
    golden = win.is_true(i["tenkan"] > i["kijun"])
    return golden if c.get("direction", "golden") == "golden" else ~golden


def _tk_cross(k: Kernels, c: Condition) -> Column:
    i = _ichimoku(k, c)
    return _crossing(i["tenkan"], i["kijun"], c.get("direction", "golden") == "golden")


def _cloud_break(k: Kernels, c: Condition) -> Column:
    i, up = _ichimoku(k, c), c.get("direction", "up") == "up"
    return _crossing(F.col("close"), i["cloud_top" if up else "cloud_bottom"], up)


def _cloud_state(k: Kernels, c: Condition) -> Column:
    i = _ichimoku(k, c)
    return win.is_true(F.col("close") > i["cloud_top"] if c.get("direction", "above") == "above" else F.col("close") < i["cloud_bottom"])


def _chikou_state(k: Kernels, c: Condition) -> Column:
    ref = F.col(k.put(f"chikou_{int(c.get('displacement', 26))}", lambda: win.lag(F.col("close"), int(c.get("displacement", 26)))))
    return win.is_true(F.col("close") > ref if c.get("direction", "up") == "up" else F.col("close") < ref)


def _squeeze(k: Kernels, c: Condition) -> Column:
    made = k.squeeze_release(int(c.get("period", 20)), float(c.get("std_dev", 2.0)), float(c.get("threshold", 0.1)), int(c.get("lookback", 20)), int(c.get("hold_bars", 3)))
    return win.is_true(F.col(made))


def _percent_b(k: Kernels, c: Condition) -> Column:
    return compare(F.col(k.percent_b("close", int(c.get("period", 20)), float(c.get("std_dev", 2.0)))), c.get("op", ">="), c.get("value", 0.8))


def _mfi(k: Kernels, c: Condition) -> Column:
    return compare(F.col(k.mfi(n=int(c.get("period", 14)))), c.get("op", ">="), c.get("value", 80))


def _machine(make, **defaults):
    def condition(k: Kernels, c: Condition) -> Column:
        made = make(k, **{p: type(d)(c.get(p, d)) for p, d in defaults.items()})
        return win.is_true(F.col(made["bullish" if c.get("direction", "bullish") == "bullish" else "bearish"]))

    return condition


def _candle(make, **params):
    """params: the pattern's argument -> (the condition's key, default)."""

    def condition(k: Kernels, c: Condition) -> Column:
        made = make(k, **{p: type(d)(c.get(key, d)) for p, (key, d) in params.items()})
        return made["bullish" if c.get("direction", "bullish") == "bullish" else "bearish"]

    return condition


def _doji(k: Kernels, c: Condition) -> Column:
    made = candles.doji(k, float(c.get("body_ratio_max", 0.1)))
    kind = c.get("doji_type", "standard")
    if kind not in made:
        raise ValueError(f"unknown doji {kind!r}")
    return made[kind]


def _level_break(k: Kernels, c: Condition) -> Column:
    n, high = int(c.get("period", 20)), c.get("source", "highest_high") == "highest_high"
    name = k.highest("high", n) if high else k.lowest("low", n)
    level = F.col(k.put(f"{name}_before", lambda: win.lag(F.col(name))))
    return win.is_true(F.col("close") > level if c.get("op", "break_above") == "break_above" else F.col("close") < level)


def _ma_touch(k: Kernels, c: Condition) -> Column:
    return _crossing(F.col("close"), F.col(k.average("close", int(c.get("period", 20)), c.get("ma_type", "ema"))), c.get("op", "break_below") == "break_above")


REGISTRY: dict[str, Callable[[Kernels, Condition], Column]] = {
    "ma_cross": _ma_cross,
    "rsi": _rsi,
    "bollinger": _bollinger,
    "rsi_cross": _rsi_cross,
    "macd_cross": _macd_cross,
    "macd_level": _macd_level,
    "ichimoku_tk_state": _tk_state,
    "ichimoku_tk_cross": _tk_cross,
    "ichimoku_cloud_break": _cloud_break,
    "ichimoku_cloud_state": _cloud_state,
    "ichimoku_chikou_state": _chikou_state,
    "bbw_squeeze_release": _squeeze,
    "percent_b": _percent_b,
    "mfi": _mfi,
    "double_pattern": _machine(sequential.double_pattern, band_period=20, band_std=2.0, pivot_lookback=5, pattern_window=40, volume_mult=1.5),
    "rsi_divergence": _machine(sequential.rsi_divergence, rsi_period=14, band_period=20, pivot_lookback=5, pattern_window=40),
    "engulfing": _candle(candles.engulfing),
    "marubozu": _candle(candles.marubozu, threshold=("body_ratio_threshold", 0.9)),
    "pin_bar": _candle(candles.pin_bar, body_max=("body_ratio_max", 0.3), wick_times=("wick_body_mult", 2.0)),
    "doji": _doji,
    "inside_bar": lambda k, c: candles.inside_bar(k)["any"],
    "inside_bar_breakout": _candle(candles.inside_bar_breakout, lookback=("lookback", 5)),
    "piercing_dark_cloud": _candle(candles.piercing_dark_cloud, n=("band_period", 20), times=("band_std", 2.0)),
    "star_pattern": _candle(candles.star, star_max=("star_body_ratio_max", 0.3), big_min=("big_body_ratio_min", 0.5)),
    "three_soldiers_crows": _candle(candles.three_soldiers_crows, body_min=("body_ratio_min", 0.6)),
    "three_methods": _candle(candles.three_methods, pause=("n_pause", 3), big_min=("big_body_ratio_min", 0.5)),
    "level_break": _level_break,
    "ma_touch": _ma_touch,
    "volume_spike": lambda k, c: compare(F.col(k.volume_ratio(int(c.get("period", 20)))), ">=", c.get("mult", 2.0)),
    "volume_dryup": lambda k, c: compare(F.col(k.volume_dryup(int(c.get("lookback", 10)))), "<=", c.get("ratio", 0.4)),
}


_SIDE = {"bullish": "bullish", "bearish": "bearish"}
_MOVE = {"break_above": "breaks above", "break_below": "falls below"}
#: How each indicator's condition is said: a sentence, what its keys are unless set, and the words for values of some keys.
WORDING: dict[str, tuple[str, dict, dict[str, dict]]] = {
    "ma_cross": ("the {short}-bar {ma_type} is {type} the {long}-bar one", {"short": 20, "long": 60, "ma_type": "sma", "type": "golden"}, {"type": {"golden": "above", "dead": "not above"}}),
    "rsi": ("RSI({period}) {op} {value}", {"period": 14, "op": "<", "value": 30}, {}),
    "rsi_cross": ("RSI({period}) crosses {level} {direction}", {"period": 14, "level": 30, "direction": "up"}, {"direction": {"up": "upwards", "down": "downwards"}}),
    "bollinger": ("the close {op} the {band} Bollinger band ({period} bars)", {"period": 20, "band": "lower", "op": "break_below"}, {"op": _MOVE, "band": {"mid": "middle"}}),
    "bbw_squeeze_release": ("a squeeze of the band width below {threshold} is released", {"threshold": 0.1}, {}),
    "percent_b": ("%B {op} {value}", {"op": ">=", "value": 0.8}, {}),
    "mfi": ("MFI({period}) {op} {value}", {"period": 14, "op": ">=", "value": 80}, {}),
    "double_pattern": ("a double {direction} is confirmed", {"direction": "bullish"}, {"direction": {"bullish": "bottom", "bearish": "top"}}),
    "rsi_divergence": ("price and RSI show a {direction} divergence", {"direction": "bullish"}, {"direction": _SIDE}),
    "macd_cross": ("MACD crosses its signal {direction}{zone}", {"direction": "golden", "zone": "any"}, {"direction": {"golden": "upwards", "dead": "downwards"}, "zone": {"any": "", "below_zero": " below zero", "above_zero": " above zero"}}),
    "macd_level": ("the MACD {source} {op} {value}", {"source": "macd", "op": "<", "value": 0}, {"source": {"macd": "line", "hist": "histogram"}}),
    "ichimoku_tk_state": ("the conversion line is {direction} the base line", {"direction": "golden"}, {"direction": {"golden": "above", "dead": "not above"}}),
    "ichimoku_tk_cross": ("the conversion line crosses the base line {direction}", {"direction": "golden"}, {"direction": {"golden": "upwards", "dead": "downwards"}}),
    "ichimoku_cloud_break": ("the close {direction} the cloud", {"direction": "up"}, {"direction": {"up": "breaks above", "down": "falls below"}}),
    "ichimoku_cloud_state": ("the close is {direction} the cloud", {"direction": "above"}, {}),
    "ichimoku_chikou_state": ("the close is {direction} that of {displacement} bars before", {"direction": "up", "displacement": 26}, {"direction": {"up": "above", "down": "below"}}),
    "engulfing": ("a {direction} engulfing bar", {"direction": "bullish"}, {"direction": _SIDE}),
    "marubozu": ("a {direction} bar without shadows", {"direction": "bullish"}, {"direction": _SIDE}),
    "pin_bar": ("a {direction} pin bar", {"direction": "bullish"}, {"direction": _SIDE}),
    "doji": ("a {doji_type} doji", {"doji_type": "standard"}, {"doji_type": {"long_legged": "long-legged"}}),
    "inside_bar": ("a bar inside the one before", {}, {}),
    "inside_bar_breakout": ("an inside bar's mother bar is left {direction}", {"direction": "bullish"}, {"direction": {"bullish": "upwards", "bearish": "downwards"}}),
    "piercing_dark_cloud": ("a {direction}", {"direction": "bullish"}, {"direction": {"bullish": "piercing line", "bearish": "dark cloud"}}),
    "star_pattern": ("{direction} star", {"direction": "bullish"}, {"direction": {"bullish": "a morning", "bearish": "an evening"}}),
    "three_soldiers_crows": ("three {direction}", {"direction": "bullish"}, {"direction": {"bullish": "white soldiers", "bearish": "black crows"}}),
    "three_methods": ("{direction} three methods", {"direction": "bullish"}, {"direction": {"bullish": "rising", "bearish": "falling"}}),
    "level_break": ("the close {op} the {source} of {period} bars", {"op": "break_above", "source": "highest_high", "period": 20}, {"op": _MOVE, "source": {"highest_high": "high", "lowest_low": "low"}}),
    "ma_touch": ("the close {op} the {period}-bar {ma_type}", {"op": "break_below", "period": 20, "ma_type": "ema"}, {"op": _MOVE}),
    "volume_spike": ("volume is at least {mult} times its {period}-bar mean", {"mult": 2.0, "period": 20}, {}),
    "volume_dryup": ("volume is at most {ratio} of its {lookback}-bar high", {"ratio": 0.4, "lookback": 10}, {}),
}


def describe(c: Condition) -> str:
    """The condition in words; one of an unknown indicator is its name."""
    name = str(c.get("indicator") or "condition")
    if name not in WORDING:
        return name
    text, usual, words = WORDING[name]
    said = {k: words.get(k, {}).get(v, f"{v:g}" if isinstance(v, float) else v) for k, v in (usual | {k: c[k] for k in usual if c.get(k) is not None}).items()}
    return text.format(**said)


def evaluate(k: Kernels, c: Condition) -> str:
    """The name of the condition's column, made once."""
    if c.get("indicator") not in REGISTRY:
        raise ValueError(f"unknown indicator {c.get('indicator')!r}")
    key = f"is_{c['indicator']}_{zlib.crc32(repr(sorted((x, str(y)) for x, y in c.items())).encode()):08x}"
    return k.put(key, lambda made=REGISTRY[c["indicator"]](k, c): made)


def combined(k: Kernels, config: dict) -> Column:
    """The conditions of a config joined by its logic: AND, else OR; no condition never holds."""
    found = [F.col(evaluate(k, c)) for c in config.get("conditions", [])]
    if not found:
        return F.lit(False)
    return reduce(and_ if str(config.get("logic", "AND")).upper() == "AND" else or_, found)


def reason(k: Kernels, config: dict, active: bool = True) -> Column:
    """Why a config's signal went on (or off) at a bar, in words."""
    pairs = [(describe(c), F.col(evaluate(k, c))) for c in config.get("conditions", [])]
    both = str(config.get("logic", "AND")).upper() == "AND"
    if not pairs:
        return F.lit("conditions met" if active else "conditions gone")
    if active == both:
        return F.lit(" & ".join(t for t, _ in pairs))
    picked = F.concat_ws(" & ", *[F.when(c if active else ~c, F.lit(t)) for t, c in pairs])
    return F.when(picked == "", F.lit("conditions met" if active else "conditions gone")).otherwise(picked)
