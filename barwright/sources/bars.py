"""Price bars: derived from event tables, merged, sliced and resampled.

A bar table has ticker, ts, open, high, low, close and volume, one row a ticker and time; every history of every
ticker is in one DataFrame, keyed by ticker. Missing values are nulls, never NaN.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
#: How far back each interval reaches, in days; intervals of a day and more have no limit.
LOOKBACK_DAYS = {"1m": 6, "2m": 60, "5m": 60, "15m": 60, "30m": 60, "90m": 60, "60m": 730, "1h": 730}


def _ohlcv(rows: DataFrame, keys: list[str], value: str, order: Column, volume: Column) -> DataFrame:
    """Bars from ticks in one aggregation: first and last value by `order`, extremes, and the volume."""
    return rows.groupBy(*keys).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), volume.cast("double").alias("volume")
    )


def daily_bars(spark: SparkSession, sf_dir: str, ticker: str = "p_brand") -> DataFrame:
    """Daily bars of line items by a column of part: prices in order of line key, quantity as volume.

    Line keys may repeat, then the price decides. Key and price make one number (an order has fewer than a thousand lines,
    and a price of more than ten digits before the point is an error), since an aggregation that holds only numbers is
    hashed, while one that holds structs is sorted.
    """
    line_key = (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).cast("decimal(20,0)")
    order = line_key * F.lit(10**14).cast("decimal(15,0)") + F.round(F.col("price") * 10_000).cast("decimal(14,0)")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(ticker).alias("ticker"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ts"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"))
    ticks = line.join(part, line["l_partkey"] == part["p_partkey"])
    return _ohlcv(ticks, ["ticker", "ts"], "price", order, F.sum("quantity"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by event type, the number of events as volume."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", F.col("value").cast("double").alias("value"))
    return _ohlcv(events, ["ticker", "hour"], "value", F.struct("ts", "event_id"), F.count("*")).withColumnRenamed("hour", "ts")


def clamp_start(interval: str, start: dt.date, end: dt.date) -> tuple[dt.date, bool]:
    """start moved to the farthest day that the interval reaches back from `end`, and whether it was moved."""
    days = LOOKBACK_DAYS.get(interval)
    if days is None or start >= end - dt.timedelta(days=days):
        return start, False
    return end - dt.timedelta(days=days), True


def merge_bars(*frames: DataFrame) -> DataFrame:
    """The union of bar tables; of rows with equal ticker and time, the last table's stays."""
    ranked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    last = Window.partitionBy("ticker", "ts").orderBy(F.desc("_rank"), *[F.desc(c) for c in (*PRICES, "volume")])
    return reduce(DataFrame.unionByName, ranked).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_rank")


def history(bars: DataFrame, start=None, end=None, tickers: list[str] | None = None) -> DataFrame:
    """Bars from `start` to before `end`, of the given tickers; tickers without rows simply have none."""
    if tickers is not None:
        bars = bars.filter(F.col("ticker").isin(tickers))
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start))
    return bars.filter(F.col("ts") < F.lit(end)) if end is not None else bars


def bucket(rule: str, ts: str = "ts") -> Column:
    """The end of the calendar bucket that a day is in: weeks to Friday (W-FRI), months (ME), quarters (QE)."""
    day = F.col(ts).cast("date")
    if rule == "W-FRI":
        return F.next_day(F.date_sub(day, 1), "FRI")
    if rule == "ME":
        return F.last_day(day)
    if rule == "QE":
        return F.last_day(F.add_months(F.date_trunc("quarter", day).cast("date"), 2))
    raise ValueError(f"unknown rule {rule}")


def resample(bars: DataFrame, rule: str) -> DataFrame:
    """Bars of longer buckets, dated by the last bar in each; buckets without any open, high, low or close go."""
    ordered = lambda pick, c: pick(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    out = bars.groupBy("ticker", bucket(rule).alias("bucket")).agg(
        F.max("ts").alias("ts"), ordered(F.min_by, "open"), F.max("high").alias("high"), F.min("low").alias("low"), ordered(F.max_by, "close"), F.sum("volume").alias("volume")
    )
    return out.dropna(subset=list(PRICES)).drop("bucket")


def latest_price(bars: DataFrame) -> DataFrame:
    """(ticker, ts, close): each ticker's last bar that has a close."""
    has = bars.filter("close is not null")
    return has.groupBy("ticker").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


def save_bars(bars: DataFrame, path: str, interval: str = "1d") -> None:
    """Replaces what the store has of these tickers at this interval; other tickers' partitions stay."""
    out = bars.withColumn("interval", F.lit(interval)).repartition("ticker").sortWithinPartitions("ticker", "ts")
    out.write.option("partitionOverwriteMode", "dynamic").partitionBy("interval", "ticker").mode("overwrite").parquet(path)


def load_bars(spark: SparkSession, path: str, interval: str = "1d") -> DataFrame:
    """The stored bars of an interval; filters on ticker prune partitions."""
    return spark.read.parquet(path).filter(F.col("interval") == interval).drop("interval")


def append_bars(spark: SparkSession, path: str, fresh: DataFrame, interval: str = "1d") -> DataFrame:
    """Merges fresh bars into the store, only rewriting their tickers; returns what is now stored of those."""
    tickers = fresh.select("ticker").distinct()
    try:
        known = load_bars(spark, path, interval).join(F.broadcast(tickers) if tickers.count() < 100_000 else tickers, "ticker", "left_semi")
    except Exception as error:  # an empty store
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        merged = fresh
    else:
        merged = merge_bars(known.select(fresh.columns), fresh).checkpoint()
    save_bars(merged, path, interval)
    return merged


def clear_bars(spark: SparkSession, path: str, ticker: str, interval: str = "1d") -> int:
    """Takes a ticker's bars out of the store; returns the number of files that went."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/interval={interval}/ticker={ticker}")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return 0
    n = sum(1 for s in store.listStatus(place) if s.getPath().getName().endswith(".parquet"))
    store.delete(place, True)
    return n
