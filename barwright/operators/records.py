"""Entity tables (strategies, watchlist, alerts, results) as DataFrames: upserts, deletes and their rules.

Each operation returns the table as it then is; the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tickers that a watchlist may hold.
WATCHED = 50


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows added, replacing those of equal keys."""
    return table.join(rows.select(keys), keys, "left_anti").unionByName(rows.select(table.columns))


def update(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the non-null values of `changes` (key and some columns) put in place."""
    cols = [c for c in changes.columns if c != key]
    both = table.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols]), key, "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in table.columns])


def remove(table: DataFrame, ids: list, key: str = "id") -> DataFrame:
    return table.filter(~F.col(key).isin(ids) | F.col(key).isNull())


def watch(watchlist: DataFrame, ticker: str, strategy_id: int | None = None, memo: str | None = None) -> DataFrame:
    """watchlist with the ticker added or changed; a new one beyond WATCHED tickers raises ValueError."""
    name = ticker.strip().upper()
    if not name:
        raise ValueError("a ticker is needed")
    known = {r.ticker for r in watchlist.select("ticker").distinct().limit(WATCHED + 1).collect()}
    if name not in known and len(known) >= WATCHED:
        raise ValueError(f"a watchlist holds {WATCHED} tickers")
    spark = watchlist.sparkSession
    old = watchlist.filter(F.col("ticker") == name)
    if name in known:
        change = old.withColumn("strategy_id", F.coalesce(F.lit(strategy_id).cast("long"), "strategy_id")).withColumn("memo", F.coalesce(F.lit(memo).cast("string"), "memo"))
        return remove(watchlist, [name], "ticker").unionByName(change)
    next_id = (watchlist.agg(F.max("id")).first()[0] or 0) + 1
    row = spark.createDataFrame([(next_id, name, strategy_id, memo)], "id long, ticker string, strategy_id long, memo string").withColumn("added_at", F.current_timestamp())
    return watchlist.unionByName(row.select(watchlist.columns))


def watched(watchlist: DataFrame, strategies: DataFrame) -> DataFrame:
    """The watchlist with strategy names, newest first."""
    names = strategies.select(F.col("id").alias("strategy_id"), F.col("name").alias("strategy_name"))
    return watchlist.join(names, "strategy_id", "left").orderBy(F.desc("added_at"), F.desc("id"))


def delete_strategy(strategy_id: int, strategies: DataFrame, results: DataFrame, watchlist: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All four tables without a strategy: its results go, watchlist and alerts lose their reference."""
    cut = lambda t: t.withColumn("strategy_id", F.when(F.col("strategy_id") == strategy_id, None).otherwise(F.col("strategy_id")))
    return remove(strategies, [strategy_id]), remove(results, [strategy_id], "strategy_id"), cut(watchlist), cut(alerts)


def strategies_listed(strategies: DataFrame, results: DataFrame, watchlist: DataFrame, archived: bool = False) -> DataFrame:
    """Strategies newest first with the numbers of their results and watchlist items."""
    count = lambda t, name: t.filter("strategy_id is not null").groupBy(F.col("strategy_id").alias("id")).agg(F.count("*").alias(name))
    rows = strategies if archived else strategies.filter(~F.coalesce("is_archived", F.lit(False)))
    rows = rows.join(count(results, "n_results"), "id", "left").join(count(watchlist, "n_watched"), "id", "left")
    return rows.fillna(0, ["n_results", "n_watched"]).orderBy(F.desc("created_at"), F.desc("id"))


def alerts_of(triggered: DataFrame, watchlist: DataFrame) -> DataFrame:
    """New alert rows: watchlist items with a strategy whose ticker triggered (ticker, strategy_id, as_of)."""
    hit = triggered.filter("triggered").select("ticker", "strategy_id", F.col("as_of").alias("detected_at"))
    message = F.concat(F.lit("entry signal on "), F.col("ticker"))
    return watchlist.filter("strategy_id is not null").select("ticker", "strategy_id").join(hit, ["ticker", "strategy_id"]).withColumn("message", message).withColumn("is_read", F.lit(False))


def recent_alerts(alerts: DataFrame, limit: int = 100, unread_only: bool = False) -> DataFrame:
    return (alerts.filter("not is_read") if unread_only else alerts).orderBy(F.desc("detected_at"), "ticker").limit(limit)


def unread_count(alerts: DataFrame) -> DataFrame:
    """One row, n: alerts that aren't read."""
    return alerts.filter("not is_read").agg(F.count("*").alias("n"))


def all_read(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("is_read", F.lit(True))


def watched_count(watchlist: DataFrame) -> DataFrame:
    """One row, n: items on the watchlist."""
    return watchlist.agg(F.count("*").alias("n"))


def sectors(stocks: DataFrame) -> DataFrame:
    """The sectors there are, in order."""
    return stocks.select("sector").filter("sector is not null").distinct().orderBy("sector")


def newest(*snapshots: DataFrame) -> DataFrame:
    """The row with the latest computed_at of all snapshot tables."""
    rows = snapshots[0]
    for s in snapshots[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    return rows.orderBy(F.desc_nulls_last("computed_at")).limit(1)


def last_rows(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by `order`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in table.columns if c not in (*keys, order)])
    return table.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
