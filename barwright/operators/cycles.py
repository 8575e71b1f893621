"""Cycle classifiers: the price and volume egg (phases A1 to B3), and macro quadrants of growth.

Phases A1, A2, A3 lead up from a low, B1, B2, B3 down from a high. Macro phases are recovery, expansion, slowdown and
contraction. Series tables have series, ts and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import lag, rolling
from .regime import _last

PHASES = ("A1", "A2", "A3", "B1", "B2", "B3")
#: Sectors that do well in each macro phase.
FAVOURED = {
    "recovery": ["Financials", "Industrials", "Consumer Discretionary", "Real Estate"],
    "expansion": ["Information Technology", "Consumer Discretionary", "Industrials", "Materials"],
    "slowdown": ["Energy", "Materials", "Consumer Staples"],
    "contraction": ["Utilities", "Health Care", "Consumer Staples"],
}


def egg_phase(bars: DataFrame, lookback: int = 252, short: int = 20, long: int = 60) -> DataFrame:
    """Per ticker at its last bar: position_pct, volume_ratio, roc_20, the zone and the phase.

    position_pct is the close's place in the range of its last `lookback` closes (50 for a flat one), the volume ratio
    the mean of the last `short` volumes over that of the last `long`, null with fewer bars or without volume.
    """
    w = Window.partitionBy("ticker").orderBy("ts")
    span = w.rowsBetween(-(lookback - 1), 0)
    low, high = F.min("close").over(span), F.max("close").over(span)
    place = F.when(high == low, 50.0).otherwise(F.try_divide(F.col("close") - low, high - low) * 100)
    ratio = F.try_divide(rolling(F.avg, F.col("volume"), short), F.nullif(rolling(F.avg, F.col("volume"), long), F.lit(0.0)))
    rows = bars.select("ticker", "ts", place.alias("position_pct"), ratio.alias("volume_ratio"), ((F.try_divide(F.col("close"), lag(F.col("close"), 20)) - 1) * 100).alias("roc_20"))
    out = _last(rows, "position_pct", "volume_ratio", "roc_20")
    zone = F.when(F.col("position_pct") <= 30, "low").when(F.col("position_pct") >= 70, "high").otherwise("mid")
    rising, loud, steep = F.col("roc_20") > 0, F.coalesce(F.col("volume_ratio") >= 1.2, F.lit(False)), F.abs("roc_20") >= 15
    pick = lambda test, yes, no: F.when(test, yes).otherwise(no)
    phase = F.when(F.col("roc_20").isNotNull(), pick(
        zone == "low", pick(rising, pick(loud, "A2", "A1"), pick(loud & steep, "B3", "A1")),
        pick(zone == "high", pick(rising, pick(loud, "A3", "A2"), pick(loud, "B2", "B1")), pick(rising, "A2", "B2")),
    ))
    return out.withColumn("zone", zone).withColumn("phase", phase)


def theme_bars(bars: DataFrame, themes: DataFrame) -> DataFrame:
    """Bars of themes: the mean of their tickers' closes indexed to 100 at each one's start, and the sum of volumes.

    themes: (theme, ticker). A day counts the tickers that have it; the theme takes the ticker column's place.
    """
    w = Window.partitionBy("ticker").orderBy("ts")
    indexed = bars.filter("close is not null").withColumn("_i", F.try_divide(F.col("close"), F.first("close").over(w)) * 100)
    return indexed.join(themes, "ticker").groupBy(F.col("theme").alias("ticker"), "ts").agg(F.avg("_i").alias("close"), F.sum("volume").alias("volume"))


def theme_phases(bars: DataFrame, themes: DataFrame) -> DataFrame:
    """egg_phase of every theme, in the phases' order."""
    order = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    return egg_phase(theme_bars(bars, themes)).withColumnRenamed("ticker", "theme").orderBy(order.asc_nulls_last(), "theme")


def _by() -> object:
    return Window.partitionBy("series").orderBy("ts")


def growth(series: DataFrame, periods: int = 4) -> DataFrame:
    """series with value as its change in % over `periods` observations; nulls are dropped first."""
    rows = series.filter("value is not null")
    return rows.withColumn("value", (F.try_divide(F.col("value"), lag(F.col("value"), periods, _by())) - 1) * 100).filter("value is not null")


def direction(value: Column, window: int = 3) -> Column:
    """up, down or flat: the sign of the mean change in the last `window` observations; null without one more than them."""
    change = F.when(lag(value, window, _by()).isNotNull(), value - lag(value, window - 1, _by()))
    return F.when(change > 0, "up").when(change < 0, "down").when(change.isNotNull(), "flat")


def quadrants(gdp_growth: DataFrame, last: int = 12, mean_over: int = 8) -> DataFrame:
    """series, ts, value, quadrant of the last observations, each judged by what was known then.

    The level is compared with the mean of the last eight values, the momentum is the last change: low and rising is
    recovery, high and rising expansion, high and falling slowdown, low and falling contraction.
    """
    w = _by()
    nth, total = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy("series"))
    high = F.col("value") > F.avg("value").over(w.rowsBetween(-(mean_over - 1), 0))
    up = F.col("value") > lag(F.col("value"), 1, w)
    label = F.when(high & up, "expansion").when(high, "slowdown").when(up, "recovery").otherwise("contraction")
    rows = gdp_growth.filter("value is not null").select("series", "ts", "value", label.alias("quadrant"), nth.alias("_i"), total.alias("_n"))
    return rows.filter(F.col("_i") >= F.greatest(F.lit(mean_over), F.col("_n") - last)).drop("_i", "_n")


def sahm(unemployment: DataFrame) -> DataFrame:
    """series, ts, value, mean3, low12, gap, triggered: the three-month mean against its lowest in twelve months."""
    w = _by()
    rows = unemployment.filter("value is not null").withColumn("mean3", rolling(F.avg, F.col("value"), 3, w))
    rows = rows.withColumn("low12", rolling(F.min, F.col("mean3"), 12, w)).withColumn("gap", F.col("mean3") - F.col("low12"))
    return rows.withColumn("triggered", F.coalesce(F.col("gap") >= 0.5, F.lit(False)))


def macro_phase(gdp_growth: DataFrame, unemployment: DataFrame) -> DataFrame:
    """One row: the latest quadrant, the Sahm rule, and the phase, which the rule turns into contraction."""
    q = quadrants(gdp_growth).agg(F.max_by("quadrant", "ts").alias("quadrant"))
    s = sahm(unemployment).agg(F.max_by("triggered", "ts").alias("sahm"), F.max_by("gap", "ts").alias("gap"))
    return q.crossJoin(s).withColumn("phase", F.when(F.col("sahm"), "contraction").otherwise(F.col("quadrant")))


def cfnai_state(mean3: Column) -> Column:
    """The activity index's three-month mean in words."""
    return F.when(mean3 < -0.7, "recession").when(mean3 > 0.7, "overheating").when(mean3 > 0.2, "expansion").when(mean3.isNotNull(), "neutral")


def curve_state(spread: Column) -> Column:
    return F.when(spread < 0, "inverted").when(spread.isNotNull(), "normal")


def indicator_cards(series: DataFrame) -> DataFrame:
    """The latest non-null value and its day of each series."""
    return series.filter("value is not null").groupBy("series").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def fx_volatility(series: DataFrame, window: int = 20) -> DataFrame:
    """series with the annualised deviation of daily changes, in %."""
    w = _by()
    rows = series.filter("value is not null").withColumn("_r", F.try_divide(F.col("value"), lag(F.col("value"), 1, w)) - 1)
    return rows.withColumn("volatility", rolling(F.stddev_samp, F.col("_r"), window, w) * F.sqrt(F.lit(252.0)) * 100).drop("_r")
