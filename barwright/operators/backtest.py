"""Backtests over every ticker at once: positions, trades, equity and metrics.

Signals of a bar are executed at the next one, and the lag starts anew at the window's first bar, which is always flat.
A backtest reads 400 days before its window, so that indicators are warm; the window's end is exclusive.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.indicators import Kernels
from ..functions.windows import by_time, to_now
from ..plans import strategy
from ..sources.bars import history
from .sequential import staged_trades

WARM_UP_DAYS, YEAR_DAYS, TRADING_DAYS = 400, 365.25, 252


@dataclass
class Backtest:
    """curve: bars of the window with position, equity; trades; staged events (in the curve) if there are stages."""

    curve: DataFrame
    trades: DataFrame

    @property
    def metrics(self) -> DataFrame:
        return metrics(self.curve, self.trades) if "events" in self.curve.columns else summarized(self.curve)


def capped(position: Column, most: int) -> tuple[Column, Column]:
    """(helper, expression): the helper numbers runs in the market; the expression ends a run's holdings after `most` bars.

    The bar after is out and starts the count anew, so within a run every (most + 1)th bar is flat.
    """
    run = F.sum(F.when(position > 0, 0).otherwise(1)).over(to_now())
    nth = F.row_number().over(Window.partitionBy("ticker", "_run").orderBy("ts")) - F.when(F.col("_run") > 0, 1).otherwise(0)
    return run, F.when((position > 0) & (nth % (most + 1) == 0), F.lit(0.0)).otherwise(position)


def equity(df: DataFrame, position: str = "position", start: float = 100.0) -> DataFrame:
    """df with executed (the position one bar later, flat at first), ret (the close's change) and equity.

    A long curve may leave a double's range, so that figures are made from log_equity (the logarithm of the equity's
    growth, as a sum) and sign (0 from a total loss on, -1 while more than all is lost).
    """
    df = df.withColumn("executed", F.coalesce(F.lag(position).over(by_time()), F.lit(0.0)))
    df = df.withColumn("ret", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(by_time())) - 1, F.lit(0.0)))
    growth = 1 + F.col("ret") * F.col("executed")
    logs = F.sum(F.coalesce(F.log(F.abs(growth)), F.lit(0.0))).over(to_now())
    return df.withColumns({"equity": start * F.product(growth).over(to_now()), "log_equity": logs, "sign": F.product(F.signum(growth)).over(to_now())})


def _change(w: WindowSpec) -> Column:
    """The equity's change at each bar, null at the first one and after a total loss."""
    before = F.lag("sign").over(w)
    return F.when(before != 0, F.col("sign") * before * F.exp(F.col("log_equity") - F.lag("log_equity").over(w)) - 1)


def _top(w: WindowSpec) -> Column:
    """The logarithm of the highest equity so far."""
    return F.max(F.when(F.col("sign") > 0, F.col("log_equity"))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def trades_of(curve: DataFrame) -> DataFrame:
    """Trades of a curve whose position is in or out: runs of executed bars, filled at the closes where they start and end.

    A run still open at the last bar is closed there. Reasons are those of the bar before, whose signal it was.
    """
    held = F.col("executed") > 0
    before = F.coalesce(F.lag(held).over(by_time()), F.lit(False))
    rows = curve.withColumn("_in", held & ~before).withColumn("_out", ~held & before)
    rows = rows.withColumn("_trade", F.sum(F.col("_in").cast("int")).over(to_now())).withColumn("_last", F.max("ts").over(Window.partitionBy("ticker")))
    for c in ("active", "inactive"):
        rows = rows.withColumn(f"_{c}", F.lag(c).over(by_time())) if c in curve.columns else rows.withColumn(f"_{c}", F.lit(None).cast("string"))
    rows = rows.filter((held | F.col("_out")) & (F.col("_trade") > 0))
    out = rows.groupBy("ticker", "_trade").agg(
        F.min("ts").alias("entry_date"),
        F.max("ts").alias("exit_date"),
        F.min_by("close", "ts").alias("entry_price"),
        F.max_by("close", "ts").alias("exit_price"),
        F.min_by("_active", "ts").alias("entry_reason"),
        F.when(F.max(F.col("_out").cast("int")) == 1, F.max_by("_inactive", "ts")).otherwise(F.lit("closed at the end")).alias("exit_reason"),
    )
    return out.withColumn("return_pct", (F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1) * 100).drop("_trade")


def _figures(top: Column, day: Column) -> list[Column]:
    """The figures of a curve, from the logarithm of its highest equity so far and its change at each bar."""
    span = F.greatest(F.datediff(F.max("ts"), F.min("ts")) / F.lit(YEAR_DAYS), F.lit(1e-9))
    grown = F.max_by("log_equity", "ts") - F.min_by("log_equity", "ts")
    sign = F.max_by("sign", "ts") * F.min_by("sign", "ts")
    spread, enough = F.stddev_pop(day), F.count("*") >= 2
    return [
        F.when(enough, (sign * F.exp(grown) - 1) * 100).otherwise(0.0).alias("cumulative_return"),
        F.when(enough & (sign > 0), (F.exp(grown / span) - 1) * 100).otherwise(0.0).alias("cagr"),
        F.when(enough, F.min((F.col("sign") * F.exp(F.col("log_equity") - top) - 1) * 100)).otherwise(0.0).alias("mdd"),
        F.when(enough & (spread > 0), F.avg(day) / spread * F.sqrt(F.lit(float(TRADING_DAYS)))).otherwise(0.0).alias("sharpe"),
    ]


def metrics(curve: DataFrame, trades: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Per ticker: cumulative return and CAGR in %, deepest drawdown in %, Sharpe ratio, trades and how they went.

    Days run from a curve's first bar to its last. Curves of fewer than two bars have zeros; a Sharpe ratio without
    spread is zero. Values are not rounded.
    """
    by = Window.partitionBy(*keys).orderBy("ts")
    rows = curve.withColumn("_top", _top(by)).withColumn("_day", _change(by))
    found = rows.groupBy(*keys).agg(*_figures(F.col("_top"), F.col("_day")))
    done = trades.filter("return_pct is not null").groupBy(*keys).agg(
        (F.avg((F.col("return_pct") > 0).cast("double")) * 100).alias("win_rate"), F.avg(F.datediff("exit_date", "entry_date")).alias("avg_holding_days"), F.count("*").alias("trade_count")
    )
    return found.join(done, list(keys), "left").fillna(0, ["win_rate", "avg_holding_days", "trade_count"])


def summarized(curve: DataFrame, *more: Column) -> DataFrame:
    """The metrics of a curve whose position is in or out, and aggregates `more` of it, in one pass over its bars.

    A trade's return is known at the bar where it ends, which carries the close and day of its entry, so the curve need
    not be aggregated by trade and joined back; values are those of `metrics` with `trades_of`.
    """
    by, held = by_time(), F.col("executed") > 0
    before = F.coalesce(F.lag(held).over(by), F.lit(False))
    rows = curve.withColumns({"_top": _top(by), "_day": _change(by), "_in": held & ~before, "_out": ~held & before, "_last": F.lead("ts").over(by).isNull()})
    rows = rows.withColumn("_entry", F.last(F.when(F.col("_in"), F.struct("close", "ts")), ignorenulls=True).over(to_now()))
    ended = F.col("_out") | (held & F.col("_last"))
    rows = rows.withColumn("_return", F.when(ended, F.try_divide(F.col("close"), F.col("_entry.close")) - 1))
    done = F.col("_return").isNotNull()
    return rows.groupBy("ticker").agg(
        *_figures(F.col("_top"), F.col("_day")),
        F.coalesce(F.avg(F.when(done, (F.col("_return") > 0).cast("double"))) * 100, F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(done, F.datediff("ts", "_entry.ts"))), F.lit(0.0)).alias("avg_holding_days"),
        F.count(F.when(done, 1)).alias("trade_count"),
        *more,
    )


def run(bars: DataFrame, config: str | dict, start=None, end=None, max_holding_days: int | None = None, longest: int | None = None) -> Backtest:
    """The strategy over all tickers of `bars` between start and before end; tickers without bars there have no rows.

    `longest` bounds the bars of a ticker with their warm-up where the caller knows that no ticker has more.
    """
    warm = start - dt.timedelta(days=WARM_UP_DAYS) if start is not None else None
    k = Kernels(history(bars, warm, end), longest)
    signal = strategy.compile_signal(k, config)
    keep = ["ticker", "ts", "open", "high", "low", "close", "volume", F.col(signal.weight).alias("position"), signal.active.alias("active"), signal.inactive.alias("inactive")]
    df = k.df.select(*keep, *([F.col(signal.events).alias("events")] if signal.events else []))
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start))
    if max_holding_days is not None:
        helper, position = capped(F.col("position"), max_holding_days)
        df = df.withColumn("_run", helper).withColumn("position", position).drop("_run")
    curve = equity(df)
    return Backtest(curve, staged_trades(curve, "events") if signal.events else trades_of(curve))


def buy_and_hold(bars: DataFrame, start=None, end=None) -> Backtest:
    """In the market throughout, as one trade a ticker."""
    df = history(bars, start, end).withColumn("position", F.lit(1.0)).withColumn("active", F.lit("held")).withColumn("inactive", F.lit("held"))
    curve = equity(df)
    return Backtest(curve, trades_of(curve))


def compared(bars: DataFrame, config: str | dict, benchmark: DataFrame, start=None, end=None, max_holding_days: int | None = None) -> DataFrame:
    """Metrics of the strategy, of holding each ticker, and of holding the benchmark, in one table by `leg`.

    A strategy that is in or out is measured with its tickers in one pass, each bar standing in both legs.
    """
    held = buy_and_hold(benchmark, start, end).metrics.withColumn("leg", F.lit("benchmark"))
    if strategy.kind_of(config) == "staged" or max_holding_days is not None:
        own, ticker = run(bars, config, start, end, max_holding_days), buy_and_hold(bars, start, end)
        return own.metrics.withColumn("leg", F.lit("strategy")).unionByName(ticker.metrics.withColumn("leg", F.lit("ticker"))).unionByName(held)
    k = Kernels(history(bars, start - dt.timedelta(days=WARM_UP_DAYS) if start is not None else None, end))
    legs = F.array(*[F.struct(F.lit(n).alias("leg"), w.alias("position")) for n, w in (("strategy", F.col(strategy.compile_signal(k, config).weight)), ("ticker", F.lit(1.0)))])
    rows = history(k.df, start).select("ticker", "ts", "close", F.explode(legs).alias("l"))
    both = summarized(equity(rows.select(F.struct("ticker", "l.leg").alias("ticker"), "ts", "close", "l.position")))
    return both.select("ticker.*", *[c for c in both.columns if c != "ticker"]).unionByName(held)


def by_regime(curve: DataFrame, regimes: DataFrame) -> DataFrame:
    """Per ticker and regime: days, and the return compounded over them (in %, and as a logarithm). regimes: (ts, regime) of a benchmark.

    A bar takes the regime of its own day, else that of the closest earlier bar that had one.
    """
    rows = curve.join(regimes.select("ts", "regime"), "ts", "left")
    rows = rows.withColumn("regime", F.last("regime", ignorenulls=True).over(to_now())).withColumn("_day", F.coalesce(_change(by_time()), F.lit(0.0)))
    return rows.filter("regime is not null").groupBy("ticker", "regime").agg(F.count("*").alias("days"), ((F.product(1 + F.col("_day")) - 1) * 100).alias("cumulative_return"), F.sum(F.log1p("_day")).alias("log_return"))


def health(trades: DataFrame) -> DataFrame:
    """Per ticker the share of trades that end on the day they start, and whether that is a defect (all) or a doubt (half)."""
    share = F.avg((F.col("entry_date") == F.col("exit_date")).cast("double"))
    out = trades.groupBy("ticker").agg(share.alias("same_day_share"), F.count("*").alias("trades"))
    return out.withColumn("warning", F.when(F.col("same_day_share") == 1, "defect").when(F.col("same_day_share") >= 0.5, "doubt"))


def latest(bars: DataFrame, config: str | dict, longest: int | None = None) -> DataFrame:
    """(ticker, as_of, triggered, in_position): whether the last bar newly entered, or raised a staged weight."""
    k = Kernels(bars, longest)
    weight = strategy.compile_signal(k, config).weight
    rows = k.df.select("ticker", "ts", F.col(weight).alias("now"), F.coalesce(F.lag(weight).over(by_time()), F.lit(0.0)).alias("before"))
    last = rows.groupBy("ticker").agg(F.max("ts").alias("as_of"), F.max_by(F.struct("now", "before"), "ts").alias("w"))
    return last.select("ticker", "as_of", (F.col("w.now") > F.col("w.before") + 1e-9).alias("triggered"), (F.col("w.now") > 0).alias("in_position"))
