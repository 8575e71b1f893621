"""Market regimes: daily labels, scores of the latest bar, segments, and breadth.

Labels are English: bull, bear, sideways for daily labels; neutral for the snapshot's middle. Scores are per ticker, so a
benchmark is a bar table with one ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import Kernels
from ..functions.windows import by_time, is_true, lag
from . import sequential

#: Bands of (upper bound, score, level), the first whose bound is above the value: volatility index, credit spread in bp.
VIX_BANDS = ((15, 10, "calm"), (20, 0, "normal"), (25, -10, "uneasy"), (30, -18, "fear"), (float("inf"), -25, "panic"))
SPREAD_BANDS = ((300, 10, "calm"), (500, 0, "normal"), (800, -10, "uneasy"), (1000, -18, "stress"), (float("inf"), -25, "crisis"))
#: Bars of the short-term regimes, the return in % that makes one, and bars that a segment has at least.
SHORT_TERM, SHORT_TERM_PCT, LEAST_BARS = {"1m": 21, "3m": 63}, 5.0, 10


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def _last(df: DataFrame, *columns: Column, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The columns' values at each ticker's last bar; columns that aren't there yet are null."""
    return df.groupBy(*keys).agg(F.max_by(F.struct("ts", *columns), "ts").alias("_l")).select(*keys, "_l.*")


def daily(bars: DataFrame, n_adx: int = 14, longest: int | None = None) -> DataFrame:
    """bars with drawdown (from the 252-bar high, %), adx and regime.

    sideways without a 200-bar average or where the trend is weak (ADX below 20), bear from a drawdown of 20 %, else by the
    close's side of the average.
    """
    k = Kernels(bars, longest)
    adx, mean = F.col(sequential.adx(k, n_adx)), F.col(k.sma("close", 200))
    top = F.max("close").over(by_time().rowsBetween(-251, 0))
    df = k.df.withColumn("drawdown", (F.try_divide(F.col("close"), top) - 1) * 100).withColumn("adx", adx)
    label = F.when(mean.isNull(), "sideways").when(F.col("drawdown") <= -20, "bear").when(~is_true(adx >= 20), "sideways").when(F.col("close") > mean, "bull").otherwise("bear")
    return df.withColumn("regime", label).select(*bars.columns, "drawdown", "adx", "regime")


def segments(labelled: DataFrame, label: str = "regime", least: int = LEAST_BARS) -> DataFrame:
    """(ticker, label, start, end, bars): maximal runs of one label that have at least `least` bars."""
    both = by_time()
    own = Window.partitionBy("ticker", label).orderBy("ts")
    rows = labelled.filter(F.col(label).isNotNull()).withColumn("_run", F.row_number().over(both) - F.row_number().over(own))
    return rows.groupBy("ticker", label, "_run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars")).filter(F.col("bars") >= least).drop("_run")


def scores(bars: DataFrame) -> DataFrame:
    """Per ticker at its last bar: trend_position, ma_cross and drawdown scores, and the short-term regimes.

    The first two are 25 above and -25 below, null with fewer than 200 bars; the drawdown's is from -25 to 0, its flag
    set from -20 %.
    """
    k = Kernels(bars)
    long, mid = F.col(k.sma("close", 200)), F.col(k.sma("close", 50))
    fall = (F.try_divide(F.col("close"), F.max("close").over(by_time().rowsBetween(-251, 0))) - 1) * 100
    side = lambda a, b: F.when(b.isNotNull(), F.when(a > b, 25.0).otherwise(-25.0))
    moves = {n: (F.try_divide(F.col("close"), lag(F.col("close"), b)) - 1) * 100 for n, b in SHORT_TERM.items()}
    df = k.df.select("ticker", "ts", side(F.col("close"), long).alias("trend_position"), side(mid, long).alias("ma_cross"), fall.alias("drawdown_pct"), *[m.alias(f"return_{n}") for n, m in moves.items()])
    out = _last(df, "trend_position", "ma_cross", "drawdown_pct", *[f"return_{n}" for n in moves])
    word = lambda x: F.when(x >= SHORT_TERM_PCT, "bull").when(x <= -SHORT_TERM_PCT, "bear").when(x.isNotNull(), "neutral")
    out = out.withColumn("drawdown", clip(F.col("drawdown_pct") / 20 * 25, -25, 0)).withColumn("bear_market", F.col("drawdown_pct") <= -20)
    return out.withColumns({f"regime_{n}": word(F.col(f"return_{n}")) for n in moves})


def breadth(bars: DataFrame, n: int = 200) -> DataFrame:
    """One row: tickers, those with n bars, those whose last close is above their n-bar average, the share in % and its score."""
    k = Kernels(bars)
    mean = k.sma("close", n)
    last = _last(k.df, "close", mean)
    above = F.col("close") > F.col(mean)
    out = last.agg(F.count("*").alias("n_total"), F.count(mean).alias("n_data_ok"), F.coalesce(F.sum(above.cast("int")), F.lit(0)).alias("n_above"), (F.avg(above.cast("double")) * 100).alias("pct_above"))
    return out.withColumn("score", clip((F.col("pct_above") - 50) * 1.25, -25, 25)).withColumn("overheated", F.col("pct_above") >= 85)


def band_score(x: Column, bands: tuple) -> Column:
    """struct(score, level) of the first band whose bound is above x; null for null."""
    out = F.lit(None)
    for bound, score, level in reversed(bands):
        out = F.when(x < bound, F.struct(F.lit(float(score)).alias("score"), F.lit(level).alias("level"))).otherwise(out)
    return F.when(x.isNotNull(), out)


def volatility_signal(x: Column) -> Column:
    return band_score(x, VIX_BANDS)


def credit_signal(spread_pct: Column) -> Column:
    return band_score(spread_pct * 100, SPREAD_BANDS)


def curve_signal(spread_pct: Column) -> Column:
    """The score of ten-year less three-month yields: -20 inverted, -5 flat, else 5."""
    return F.when(spread_pct < 0, -20.0).when(spread_pct < 0.5, -5.0).when(spread_pct.isNotNull(), 5.0)


def classify(total: Column) -> Column:
    return F.when(total >= 35, "bull").when(total <= -35, "bear").otherwise("neutral")


def snapshot(universe: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a benchmark ticker: its scores, the universe's breadth, the total of those known, and the regime."""
    parts = ("trend_position", "ma_cross", "drawdown", "breadth")
    out = scores(benchmark).crossJoin(F.broadcast(breadth(universe).select(F.col("score").alias("breadth"), "pct_above", "n_total", "n_data_ok", "n_above", "overheated")))
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    return out.withColumn("total_score", total).withColumn("regime", classify(F.col("total_score")))


def for_trading(snapshots: DataFrame) -> DataFrame:
    """snapshots with trade_regime: the regime, or for a neutral one the side of its total, flagged ambiguous."""
    neutral = F.col("regime") == "neutral"
    side = F.when(F.col("total_score") >= 0, "bull").otherwise("bear")
    return snapshots.withColumn("trade_regime", F.when(neutral, side).otherwise(F.col("regime"))).withColumn("ambiguous", neutral)


def stale(computed_at: Column, now: Column, zone: str = "Asia/Seoul") -> Column:
    """Whether a UTC time lies on an earlier day than `now` in the zone."""
    day = lambda x: F.from_utc_timestamp(x, zone).cast("date")
    return day(computed_at) < day(now)
