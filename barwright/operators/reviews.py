"""Prices as of a day for many rows at once, reviews of what became of them, and how fresh stored results are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, bars: DataFrame, day: str = "day", out: str = "price") -> DataFrame:
    """`rows` (ticker, day, ...) with the close of the ticker's last bar at or before the day, null where there is none.

    Rows and bars are put in one order by ticker and year, each year starting from the close that the years before it
    left; so a ticker with very many rows is dealt over its years. Rows stay as they are, repeated ones and ones without
    ticker or day too, whose price is null. Bars without a close are passed over.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    null = F.lit(None)
    prices = bars.filter("close is not null").select("ticker", F.col("ts").cast("date").alias("day"), F.col("close").cast("double").alias("close"))
    asked = rows.select(F.col("ticker"), F.col(f"`{day}`").cast("date").alias("day"), null.cast("double").alias("close"), row.alias("row"), F.lit(1).alias("kind"))
    both = asked.unionByName(prices.withColumn("row", null.cast(asked.schema["row"].dataType)).withColumn("kind", F.lit(0))).withColumn("year", F.year("day"))
    own = Window.partitionBy("ticker", "year").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("price", F.last("close", ignorenulls=True).over(own)).filter("kind = 1")
    ends = prices.groupBy("ticker", F.year("day").alias("year")).agg(F.max_by("close", "day").alias("close"))
    until = F.lead("year").over(Window.partitionBy("ticker").orderBy("year"))
    # a year's last close holds in the years after it that have bars of their own and in those between
    spans = ends.withColumn("to", F.coalesce(until, F.lit(9999))).select("ticker", F.col("year").alias("from"), "to", F.col("close").alias("carried"))
    years = found.select("ticker", "year").distinct().join(spans, "ticker").filter("year > from and year <= to").select("ticker", "year", "carried")
    joined = found.join(years, ["ticker", "year"], "left")
    kept = [c for c in rows.columns if c != out]
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], F.when(F.col("ticker").isNotNull(), F.coalesce("price", "carried")).alias(out))


def price_reviews(rows: DataFrame, bars: DataFrame, now: Column, day: str = "day", paid: str | None = None) -> DataFrame:
    """`rows` with price_then, price_now, elapsed_days, change_pct and review, what became of each since its day.

    price_then is the column `paid`, else the close as of the day; price_now is the close as of `now`, a date. Where a
    price is missing, or price_then is 0, there is no change and the review says so.
    """
    then = as_of(rows, bars, day, "price_then") if paid is None else rows.withColumn("price_then", F.col(paid).cast("double"))
    found = as_of(then.withColumn("_now", now.cast("date")), bars, "_now", "price_now")
    change = (F.try_divide(F.col("price_now"), F.col("price_then")) - 1) * 100
    found = found.withColumn("elapsed_days", F.datediff("_now", F.col(f"`{day}`"))).withColumn("change_pct", change).drop("_now")
    text = F.format_string("%,.2f then, %,.2f now: %+.1f %% in %d days.", "price_then", "price_now", "change_pct", "elapsed_days")
    return found.withColumn("review", F.when(F.col("change_pct").isNull() | F.col("elapsed_days").isNull(), "No comparison: a price or the day is missing.").otherwise(text))


def freshness(files: DataFrame, now: Column, content: str = "content", stamp: str = "run_created_at") -> DataFrame:
    """`files` with exists, latest_run_at, count and hours_since of the JSON list of results that each one holds.

    A file that is null or holds no list doesn't exist. Times that can't be read are passed over; without any, the latest is
    null. `now` is a UTC timestamp, like the stored ones.
    """
    text = F.col(content).cast("string")
    records = F.from_json(text, f"array<struct<`{stamp}`: string>>", {"mode": "PERMISSIVE"})
    is_list = F.coalesce(text.rlike(r"^\s*\["), F.lit(False)) & F.try_parse_json(text).isNotNull()
    times = F.transform(records, lambda r: F.coalesce(r[stamp].try_cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")))
    rows = files.withColumn("exists", is_list).withColumn("_times", F.when(is_list, times))
    rows = rows.withColumn("latest_run_at", F.array_max("_times")).withColumn("count", F.when(F.col("exists"), F.size("_times")).otherwise(0))
    hours = F.timestamp_diff("SECOND", F.col("latest_run_at").cast("timestamp_ntz"), now.cast("timestamp_ntz")) / 3600
    return rows.withColumn("hours_since", hours).drop("_times")


def stored_freshness(spark: SparkSession, paths: list[str], now: Column) -> DataFrame:
    """(path, modified_at, exists, latest_run_at, count, hours_since) of the named files, whether they are there or not."""
    jvm, asked, there = spark.sparkContext._jvm, [], []
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        full = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place)
        asked.append((p, full.toString()))
        if full.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(full):
            there.append(p)
    names = spark.createDataFrame(asked, "path string, _full string")
    if there:
        found = spark.read.format("binaryFile").load(there).select(F.col("path").alias("_full"), F.col("modificationTime").alias("modified_at"), "content")
    else:
        found = spark.createDataFrame([], "_full string, modified_at timestamp, content binary")
    return freshness(names.join(found, "_full", "left"), now).drop("_full", "content")
