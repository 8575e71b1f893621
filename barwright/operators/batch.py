"""Configs by row: which strategy a ticker's bars follow is a table, and many groups are searched in one plan.

All configs that may be followed are compiled to columns of one table of bars; a bar's choice is then an element of an
array, so that any number of tickers with strategies of their own takes one pass.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import Kernels
from ..plans import strategy
from ..sources.bars import history
from . import backtest, ranking, regime, tuning

#: Regimes that are trained for, and the days that tell a ticker's present trend.
REGIMES, TREND_DAYS = ("bear", "bull"), 182


def dispatched(bars: DataFrame, configs: list[dict], choice: DataFrame) -> DataFrame:
    """The bars (ticker, ts, close) of each row of `choice` (ticker, candidate, ...), with the candidate's position.

    The candidate is an index of `configs`; a null one, or one out of range, is never in the market. A ticker with several
    rows has its bars several times, one without any has none. Other columns of `choice` stay beside the bars.
    """
    k = Kernels(bars)
    names = strategy.weight_columns(k, configs)
    every = F.array(*[F.col(n) for n in names]) if names else F.array().cast("array<double>")
    rows = k.df.select("ticker", "ts", "close", every.alias("_weights")).join(choice, "ticker")
    return rows.withColumn("position", F.coalesce(F.get("_weights", F.col("candidate")), F.lit(0.0))).drop("_weights")


def measured(rows: DataFrame, keys: list[str], max_holding_days: int | None = None) -> DataFrame:
    """Metrics of rows (keys, ts, close, position), each combination of the keys being a curve of its own."""
    rows = rows.select(F.struct(*keys).alias("ticker"), "ts", "close", "position")
    if max_holding_days is not None:
        helper, capped = backtest.capped(F.col("position"), max_holding_days)
        rows = rows.withColumn("_run", helper).withColumn("position", capped).drop("_run")
    out = backtest.summarized(backtest.equity(rows))
    return out.select("ticker.*", *[c for c in out.columns if c != "ticker"])


# ------------------------------------------------------------ regimes as windows
def regime_spans(labelled: DataFrame, windows: dict[str, tuple[dt.date, dt.date]]) -> DataFrame:
    """(part, regime, start, end, bars): the segments of labels (ts, regime) that lie in each named window, clipped to it.

    Windows include both of their ends. A segment that a window's edge cuts counts with the bars inside, if they are
    enough for a segment.
    """
    spark = labelled.sparkSession
    parts = spark.createDataFrame([(n, *w) for n, w in windows.items()], "part string, low date, high date")
    day = F.col("ts").cast("date")
    rows = labelled.select(day.alias("ts"), "regime").join(F.broadcast(parts), (F.col("ts") >= F.col("low")) & (F.col("ts") <= F.col("high")))
    found = regime.segments(rows.select(F.col("part").alias("ticker"), "ts", "regime"))
    return found.select(F.col("ticker").alias("part"), "regime", "start", "end", "bars")


def longest_span(spans: DataFrame) -> DataFrame:
    """(part, regime, start, end): of each part and regime the longest single segment by days, the first on ties."""
    best = F.max_by(F.struct("start", "end"), F.struct(F.datediff("end", "start"), -F.unix_date("start")))
    return spans.groupBy("part", "regime").agg(best.alias("s")).select("part", "regime", "s.start", "s.end")


def regime_matched_test(bars: DataFrame, config: dict, labelled: DataFrame, benchmark: DataFrame, start: dt.date, end: dt.date, regimes: tuple[str, ...] = REGIMES, max_holding_days: int | None = None) -> DataFrame:
    """(ticker, regime, start, end, cagr, benchmark_cagr, excess_return): the config on the longest segment of each regime.

    Only segments between start and end count, and they are not stitched. A ticker has a row for each regime; without a
    segment, or without bars in it, the figures are null. The benchmark is held, and has one ticker.
    """
    spark = bars.sparkSession
    spans = longest_span(regime_spans(labelled, {"test": (start, end)})).drop("part")
    asked = bars.select("ticker").distinct().crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in regimes], "regime string"))).join(F.broadcast(spans), "regime", "left")
    own = _on_spans(dispatched(_from(bars, start, end), [config], asked.select("ticker", "regime", "start", "end", F.lit(0).alias("candidate"))), ["ticker", "regime"], max_holding_days)
    held = _held(benchmark, spans)
    out = asked.join(own.select("ticker", "regime", "cagr"), ["ticker", "regime"], "left").join(F.broadcast(held), "regime", "left")
    return out.select("ticker", "regime", "start", "end", "cagr", "benchmark_cagr", F.round(F.col("cagr") - F.col("benchmark_cagr"), 2).alias("excess_return"))


def _from(bars: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return history(bars, start - dt.timedelta(days=backtest.WARM_UP_DAYS), end + dt.timedelta(days=1))


def _on_spans(rows: DataFrame, keys: list[str], max_holding_days: int | None = None) -> DataFrame:
    """Metrics of the rows that lie in their own span, whose end is excluded."""
    day = F.col("ts").cast("date")
    return measured(rows.filter((day >= F.col("start")) & (day < F.col("end"))), keys, max_holding_days)


def _held(benchmark: DataFrame, spans: DataFrame) -> DataFrame:
    """(regime, benchmark_cagr) of holding the benchmark over each regime's span."""
    rows = benchmark.select("ts", "close").join(F.broadcast(spans), (F.col("ts").cast("date") >= F.col("start")) & (F.col("ts").cast("date") < F.col("end")))
    found = measured(rows.withColumn("position", F.lit(1.0)), ["regime"])
    return found.select("regime", F.col("cagr").alias("benchmark_cagr"))


# ------------------------------------------------------------ many groups
def tuned_groups(
    bars: DataFrame, groups: DataFrame, config: dict, labelled: DataFrame, benchmark: DataFrame, start: dt.date, end: dt.date,
    regimes: tuple[str, ...] = REGIMES, ratio: float = 0.75, intensity: str = "fast", max_holding_days: int | None = None,
) -> DataFrame:
    """One search for each style and regime, all in one plan: a row for each ticker of `groups` (ticker, style) and regime.

    Each style has a grid of its own. A regime's segments in the training window are its folds; a candidate's score in a
    group is the mean less half the deviation, over folds, of the mean Sharpe ratio of tickers with enough trades, where
    half of the group's tickers in a fold and half of the folds have one. The best (of scores that agree in three decimals
    the first in the grid) is tried on
    the regime's longest segment in the test window; a group without any keeps the original, `insufficient` where its
    regime has no fold. Columns: ticker, style, regime, candidate (in the style's grid), config (JSON), score, insufficient,
    test_start, test_end, cagr, benchmark_cagr, excess_return and reason, which says why there is no excess. Styles come
    from a short list; their grids are bounded by the intensity.
    """
    spark = bars.sparkSession
    train, test = tuning.split(start, end, ratio)
    styles = sorted(r.style for r in groups.select("style").filter("style is not null").distinct().collect())
    grids = {s: tuning.grid(config, s, intensity) for s in styles}
    configs = [c for s in styles for c in grids[s]]
    first = {s: sum(len(grids[x]) for x in styles[:i]) for i, s in enumerate(styles)}
    table = spark.createDataFrame([(s, i, first[s] + i, json.dumps(c), c == config) for s in styles for i, c in enumerate(grids[s])], "style string, nth int, candidate int, config string, original boolean")

    spans = regime_spans(labelled, {"train": train, "test": test}).filter(F.col("regime").isin(*regimes))
    folds = spans.filter("part = 'train'").select("regime", "start", "end", F.struct("regime", "start").alias("fold"))
    tests = longest_span(spans.filter("part = 'test'")).select("regime", "start", "end")

    named = groups.select("ticker", "style").distinct()
    each = named.join(F.broadcast(table.select("style", "candidate")), "style").select("ticker", "style", "candidate")
    scores = _fold_scores(bars, configs, each, folds, train, max_holding_days)
    size = named.groupBy("style").agg(F.count("*").alias("members"))
    n_folds = folds.groupBy("regime").agg(F.count("*").alias("n_folds"))
    half = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / 2))
    fold = scores.filter(F.col("trade_count") >= tuning.LEAST_TRADES).groupBy("style", "regime", "fold", "candidate").agg(F.avg("sharpe").alias("s"), F.count("*").alias("n"))
    fold = fold.join(F.broadcast(size), "style").filter(F.col("n") >= half("members"))
    ranked = fold.groupBy("style", "regime", "candidate").agg((F.avg("s") - tuning.PENALTY * F.stddev_pop("s")).alias("score"), F.count("*").alias("n"))
    ranked = ranked.join(F.broadcast(n_folds), "regime").filter(F.col("n") >= half("n_folds"))
    best = ranked.groupBy("style", "regime").agg(F.max_by(F.struct("candidate", "score"), F.struct(F.round("score", 3), -F.col("candidate"))).alias("b")).select("style", "regime", "b.*")

    wanted = spark.createDataFrame([(r,) for r in regimes], "regime string").join(F.broadcast(n_folds), "regime", "left")
    plain = table.filter("original").select("style", F.col("candidate").alias("original"))
    asked = size.select("style").crossJoin(F.broadcast(wanted)).join(F.broadcast(plain), "style", "left").join(best, ["style", "regime"], "left")
    asked = asked.select("style", "regime", F.coalesce("candidate", "original").alias("candidate"), "score", F.col("n_folds").isNull().alias("insufficient"))
    asked = asked.join(F.broadcast(tests), "regime", "left")
    whole = named.join(asked, "style", "left")
    own = _on_spans(dispatched(_from(bars, *test), configs, whole.filter("start is not null").select("ticker", "style", "regime", "start", "end", "candidate")), ["ticker", "style", "regime"], max_holding_days)
    out = whole.join(own.select("ticker", "style", "regime", "cagr"), ["ticker", "style", "regime"], "left").join(F.broadcast(_held(benchmark, tests)), "regime", "left")
    out = out.join(F.broadcast(table.select("candidate", "nth", "config")), "candidate", "left")
    reason = F.when(F.col("style").isNull(), "no style").when(F.col("start").isNull(), "the test window has no such regime").when(F.col("cagr").isNull(), "no bars in the test segment").when(F.col("benchmark_cagr").isNull(), "no benchmark")
    return out.select(
        "ticker", "style", "regime", F.col("nth").alias("candidate"), "config", "score", "insufficient", F.col("start").alias("test_start"), F.col("end").alias("test_end"), "cagr", "benchmark_cagr",
        F.round(F.col("cagr") - F.col("benchmark_cagr"), 2).alias("excess_return"), reason.alias("reason"),
    )


def _fold_scores(bars: DataFrame, configs: list[dict], each: DataFrame, folds: DataFrame, train: tuple[dt.date, dt.date], max_holding_days: int | None) -> DataFrame:
    """Metrics of the training folds for every ticker, style and candidate: folds are narrowed to before candidates multiply the bars."""
    k = Kernels(_from(bars, *train))
    every = F.array(*[F.col(n) for n in strategy.weight_columns(k, configs)]) if configs else F.array().cast("array<double>")
    day = F.col("ts").cast("date")
    rows = k.df.select("ticker", "ts", "close", every.alias("_weights")).join(F.broadcast(folds), (day >= F.col("start")) & (day < F.col("end")))
    own = each.groupBy("ticker", "style").agg(F.collect_set("candidate").alias("_own"))  # at most a grid a row
    rows = rows.join(own, "ticker").withColumn("candidate", F.explode("_own")).withColumn("position", F.coalesce(F.get("_weights", F.col("candidate")), F.lit(0.0)))
    return measured(rows, ["ticker", "style", "regime", "fold", "candidate"], max_holding_days)


# ------------------------------------------------------------ choices from a library
def named_strategies(rows: DataFrame, key: str, chosen: dict[str, int], strategies: DataFrame | None = None) -> DataFrame:
    """rows with strategy_id, and with `strategies` (id, name, config) strategy_name and config, by the key column's value.

    A value without a choice, and a choice that the library doesn't have, leave all three null.
    """
    pairs = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair]) if chosen else F.create_map().cast("map<string,int>")
    rows = rows.withColumn("strategy_id", F.try_element_at(pairs, key))
    if strategies is None:
        return rows
    library = strategies.select(F.col("id").cast("int").alias("_id"), F.col("name").alias("strategy_name"), "config")
    return rows.join(library, F.col("strategy_id") == F.col("_id"), "left").withColumn("strategy_id", F.col("_id")).drop("_id")


def live_choice(daily: DataFrame, chosen: dict[str, int], strategies: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(ticker, ts, regime, strategy_id, strategy_name, config, reason) for each of `benchmarks` (ticker).

    The regime is that of the last bar in `daily` (see regime.daily); a benchmark without bars has nulls and a reason, one
    whose strategy is gone keeps its regime alone.
    """
    last = daily.groupBy("ticker").agg(F.max("ts").alias("ts"), F.max_by("regime", "ts").alias("regime"))
    rows = named_strategies(benchmarks.select("ticker").distinct().join(last, "ticker", "left"), "regime", chosen, strategies)
    return rows.withColumn("reason", F.when(F.col("ts").isNull(), "no bars"))


def trend_choice(bars: DataFrame, chosen: dict[str, int], strategies: DataFrame, as_of: dt.date, tickers: DataFrame | None = None, days: int = TREND_DAYS) -> DataFrame:
    """(ticker, cagr, trend, strategy_id, strategy_name, config): each ticker's strategy by its own recent trend.

    Only the `days` before `as_of` count, on purpose fewer than those that strategies were trained on. A ticker without
    two days there has a null trend and no strategy, like one whose strategy is gone.
    """
    recent = ranking.trend_by_growth(history(bars, as_of - dt.timedelta(days=days), as_of))
    recent = recent.withColumn("trend", F.when(F.col("cagr").isNotNull(), F.col("trend")))
    asked = (bars if tickers is None else tickers).select("ticker").distinct().join(recent, "ticker", "left")
    return named_strategies(asked, "trend", chosen, strategies)


def own_strategies(bars: DataFrame, choice: DataFrame, library: dict[int, dict], start: dt.date, end: dt.date) -> DataFrame:
    """Metrics by ticker between start and before end, each ticker following the config of its strategy_id in `choice`.

    A null id, or one that `library` doesn't have, is never in the market.
    """
    ids = sorted(library)
    place = F.create_map(*[F.lit(x) for i, n in enumerate(ids) for x in (n, i)]) if ids else F.create_map().cast("map<int,int>")
    picked = choice.select("ticker", F.try_element_at(place, "strategy_id").alias("candidate"), F.lit(start).alias("start"), F.lit(end).alias("end"))
    return _on_spans(dispatched(_from(bars, start, end), [library[n] for n in ids], picked), ["ticker"])
