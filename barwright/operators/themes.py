"""Themes: which stocks may belong to one, and the macroeconomic surroundings of its sector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(themes: DataFrame, universe: DataFrame) -> DataFrame:
    """(theme, ticker): the universe's stocks of a theme's sectors, or the tickers that it names itself.

    `themes` (theme, sector, ticker) has a row for each sector or ticker of a theme, many to many: a row with a sector
    stands for all of the sector's stocks in `universe` (ticker, sector), one without for its ticker alone, whether the
    universe has it or not. Each stock counts once a theme; a theme with neither has no rows.
    """
    stocks = universe.filter("ticker is not null and sector is not null").select("sector", "ticker").distinct()
    by_sector = themes.filter("sector is not null").select("theme", "sector").distinct().join(stocks, "sector").select("theme", "ticker")
    named = themes.filter("sector is null and ticker is not null").select("theme", "ticker")
    return by_sector.unionByName(named).distinct()


def context(themes: DataFrame, phase: DataFrame, favoured: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(theme, cycle_sector, market_regime, phase, is_favoured) of each of `themes` (theme, cycle_sector).

    `phase` has one row (phase) at most, `snapshot` one (regime) at most, and `favoured` (phase, sector) says which sectors
    do better in which phase. Without a phase, or for a theme without a sector, whether it is favoured is null.
    """
    now = phase.agg(F.first("phase", ignorenulls=True).alias("phase")).crossJoin(snapshot.agg(F.first("regime", ignorenulls=True).alias("market_regime")))
    rows = themes.select("theme", "cycle_sector").crossJoin(F.broadcast(now))  # one row
    better = favoured.select("phase", F.col("sector").alias("cycle_sector")).distinct().withColumn("_hit", F.lit(True))
    found = rows.join(better, ["phase", "cycle_sector"], "left")
    known = F.col("phase").isNotNull() & F.col("cycle_sector").isNotNull()
    return found.select("theme", "cycle_sector", "market_regime", "phase", F.when(known, F.coalesce("_hit", F.lit(False))).alias("is_favoured"))
