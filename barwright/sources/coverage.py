"""Which days of each ticker a store has, and which it lacks: intervals of days, whole days at both ends.

A coverage table has ticker, low and high. A ticker in the table of full histories has everything there is before its
first covered day, so that nothing older is fetched for it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(*coverages: DataFrame) -> DataFrame:
    """(ticker, low, high): the union of coverage tables, with intervals that overlap or touch made one."""
    rows = coverages[0].select("ticker", "low", "high")
    for more in coverages[1:]:
        rows = rows.unionByName(more.select("ticker", "low", "high"))
    rows = rows.filter("low <= high")
    before = F.max("high").over(Window.partitionBy("ticker").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("_new", (before.isNull() | (F.col("low") > F.date_add(before, 1))).cast("int"))
    runs = starts.withColumn("_run", F.sum("_new").over(Window.partitionBy("ticker").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("ticker", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def of_bars(bars: DataFrame, most_days: int = 5) -> DataFrame:
    """The coverage that bars themselves show: runs of days without more than `most_days` between neighbours."""
    days = bars.select("ticker", F.col("ts").cast("date").alias("day")).distinct()
    by = Window.partitionBy("ticker").orderBy("day")
    new = F.coalesce((F.datediff("day", F.lag("day").over(by)) > most_days).cast("int"), F.lit(1))
    runs = days.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("ticker", "_run").agg(F.min("day").alias("low"), F.max("day").alias("high")).drop("_run")


def missing(asked: DataFrame, covered: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """(ticker, low, high): the maximal ranges of days in `asked` (ticker, start, end) that `covered` lacks.

    `end` is excluded. A null start asks for all there is: the range before the first covered day then has a null low,
    unless `full` (ticker) says that nothing is older. A ticker that has nothing yet lacks its whole range, and one with
    a full history is not asked for older days whatever its start. Rows of one ticker are answered together.
    """
    first = covered.groupBy("ticker").agg(F.min("low").alias("_first"))
    rows = asked.select("ticker", "start", F.date_sub("end", 1).alias("_to")).join(first, "ticker", "left")
    if full is not None:
        rows = rows.join(full.select("ticker").distinct().withColumn("_full", F.lit(True)), "ticker", "left")
        rows = rows.withColumn("start", F.when(F.col("_full") & F.col("_first").isNotNull(), F.greatest("start", "_first")).otherwise(F.col("start")))
    rows = rows.withColumn("_open", F.col("start").isNull()).withColumn("_from", F.coalesce("start", F.date_sub("_first", 1), "_to"))
    wanted = rows.filter("_from <= _to").select("ticker", F.col("_from").alias("low"), F.col("_to").alias("high"), "_open")
    # an asked range is cut at covered ones: what lies behind the farthest covered day so far and before the next one
    ranges = merged(wanted).join(wanted.filter("_open").select("ticker").distinct().withColumn("_open", F.lit(True)), "ticker", "left")
    inside = merged(covered).withColumnsRenamed({"ticker": "_ticker", "low": "_low", "high": "_high"})
    cut = ranges.join(inside, (F.col("ticker") == F.col("_ticker")) & (F.col("_low") <= F.col("high")) & (F.col("_high") >= F.col("low")), "left").drop("_ticker")
    by = Window.partitionBy("ticker", "low", "high").orderBy("_low")
    begin = F.greatest(F.col("low"), F.coalesce(F.date_add(F.lag("_high").over(by), 1), F.col("low")))
    gaps = cut.select("ticker", "high", "_open", F.col("low").alias("_range"), begin.alias("_a"), F.coalesce(F.date_sub("_low", 1), F.col("high")).alias("_b"))
    tails = cut.groupBy("ticker", "low", "high", "_open").agg(F.max("_high").alias("_last")).filter("_last < high").select("ticker", "high", "_open", F.col("low").alias("_range"), F.date_add("_last", 1).alias("_a"), F.col("high").alias("_b"))
    found = gaps.unionByName(tails).filter("_a <= _b")
    oldest = F.min("_range").over(Window.partitionBy("ticker"))
    endless = F.coalesce("_open", F.lit(False)) & (F.col("_a") == oldest)
    return found.withColumn("_endless", endless).select("ticker", F.when(~F.col("_endless"), F.col("_a")).alias("low"), F.col("_b").alias("high"))


def fetched(source: DataFrame, ranges: DataFrame) -> DataFrame:
    """The bars of `source` that lie in missing ranges (see `missing`; a null low has no beginning); nothing else is kept."""
    day, wanted = F.col("ts").cast("date"), ranges.select("ticker", F.col("low").alias("_low"), F.col("high").alias("_high"))
    return source.join(wanted, "ticker").filter((day <= F.col("_high")) & (F.col("_low").isNull() | (day >= F.col("_low")))).select(source.columns)
