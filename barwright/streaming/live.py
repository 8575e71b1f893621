"""Structured Streaming forms of bar building and alerts.

State is kept by Spark: late ticks up to a watermark, each tick once, and one alert each time a condition turns true.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours", value: str = "value") -> DataFrame:
    """Bars of a stream of ticks (event_id, ticker, ts, value): each tick once, final once the watermark has passed.

    ticker, ts (the bar's start), open, high, low, close and volume (ticks). Times without a zone are taken in the session's.
    """
    once = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    key = F.struct("ts", "event_id")
    bars = once.groupBy("ticker", F.window("ts", width)).agg(F.min_by(value, key).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, key).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("ticker", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def edge_alerts(bars: DataFrame, column: str) -> DataFrame:
    """(ticker, ts): bars at which a boolean column turns true, across batches; the last value a ticker had is its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, seen = state.get if state.exists else (False, pd.Timestamp.min.value // 1000)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, now in zip(rows["ts"], rows[column], strict=True):
            at = pd.Timestamp(ts).value // 1000
            if at <= seen:
                continue
            if now and not was:
                out.append((key[0], ts))
            was, seen = bool(now), at
        state.update((was, seen))
        yield pd.DataFrame(out, columns=["ticker", "ts"])

    return bars.select("ticker", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(column, F.lit(False)).alias(column)).groupBy("ticker").applyInPandasWithState(
        step, "ticker string, ts timestamp", "was boolean, seen long", "append", GroupStateTimeout.NoTimeout
    )


def append_batches(stream: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that hands each micro-batch to `merge` (as an append to a bar store); what is there is run once."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
