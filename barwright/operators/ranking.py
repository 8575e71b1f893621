"""Cross-sections: theme strength, leaders and followers, discovery, screening, styles, sampling.

Ranks are average ranks as shares; each caller says where missing values stand. Ticker breaks all ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import Kernels
from ..functions.windows import average_rank_pct, by_time, is_true, lag
from .cycles import FAVOURED, theme_bars
from .regime import _last

#: Bars back and weights of the strength factor; weights of the discovery score.
STRENGTH = ((63, 0.4), (126, 0.2), (189, 0.2), (252, 0.2))
DISCOVERY = {"momentum": 0.3, "quality": 0.3, "value": 0.25, "growth": 0.15}
STYLES = ("leader", "growth", "value", "cyclical", "defensive", "quality")
#: Sectors that follow the cycle, and those that don't.
CYCLICAL = tuple(sorted({s for phase in ("recovery", "expansion", "slowdown") for s in FAVOURED[phase]}))
DEFENSIVE = tuple(FAVOURED["contraction"])


def rank_score(x: str | Column, missing: str = "keep", if_none: float | None = None, partition: Sequence[str] = ()) -> Column:
    """100 times the average rank's share. missing: lowest, highest (in rank), or keep (null). if_none: where all miss.

    Without a partition all rows meet in one task, so it is for cross-sections: a row for each ticker of a universe.
    """
    x = F.col(x) if isinstance(x, str) else x
    base = Window.partitionBy(*(partition or [F.lit(1)]))
    known = F.count(x).over(base)
    if missing == "keep":
        score = F.when(x.isNotNull(), average_rank_pct(x, base.orderBy(x.asc_nulls_last()), known) * 100)
    else:
        order = x.asc_nulls_first() if missing == "lowest" else x.asc_nulls_last()
        score = average_rank_pct(x, base.orderBy(order), F.count(F.lit(1)).over(base)) * 100
    return F.when(known == 0, F.lit(if_none)).otherwise(score)


def weighted(parts: Sequence[tuple[Column, float]], renormalise: bool = True) -> Column:
    """The weighted sum of the known parts, over their weights if asked; null if none is known."""
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight if renormalise else total)


def strength_factor(close: Column) -> Column:
    """Returns over a quarter to a year in %, weighted, over the windows that history allows."""
    return weighted([((F.try_divide(close, lag(close, n)) - 1) * 100, w) for n, w in STRENGTH])


def theme_strength(bars: DataFrame, themes: DataFrame) -> DataFrame:
    """Per theme at its last bar: strength_factor, its change in 20 bars and trend, returns, rs_score, strongest first."""
    rows = theme_bars(bars, themes).withColumn("factor", strength_factor(F.col("close")))
    moves = {f"return_{n}": (F.try_divide(F.col("close"), lag(F.col("close"), b)) - 1) * 100 for n, b in (("3m", 63), ("6m", 126), ("12m", 252))}
    last = _last(rows.select("ticker", "ts", "factor", lag(F.col("factor"), 20).alias("before"), *[m.alias(n) for n, m in moves.items()]), "factor", "before", *moves)
    change = F.col("factor") - F.col("before")
    trend = F.when(change > 1e-9, "up").when(change < -1e-9, "down").when(change.isNotNull(), "flat")
    out = last.select(F.col("ticker").alias("theme"), "ts", F.col("factor").alias("strength_factor"), change.alias("trend_change"), trend.alias("trend"), *moves)
    return out.withColumn("rs_score", rank_score("strength_factor")).orderBy(F.desc_nulls_last("rs_score"), "theme")


def trend_label(bars: DataFrame) -> DataFrame:
    """(ticker, abs_trend): up above the 200-bar average with 50 over 200, down with neither, else mixed; null when short."""
    k = Kernels(bars)
    long, mid = k.sma("close", 200), k.sma("close", 50)
    last = _last(k.df, "close", long, mid)
    above, golden = F.col("close") > F.col(long), F.col(mid) > F.col(long)
    return last.select("ticker", F.when(F.col(long).isNull(), None).when(above & golden, "up").when(~above & ~golden, "down").otherwise("mixed").alias("abs_trend"))


def leaders_and_growth(stocks: DataFrame, top_n: int = 3, by: str = "theme") -> DataFrame:
    """Per theme its leader (largest market cap) and the growth stocks with the best score, in `role` and `place`.

    stocks: theme, ticker, market_cap, earnings_growth, per. Growth stocks come from below the caps' upper quartile, or
    from all but the leader where none is; they are ranked by growth, else by the price-earnings ratio, missing ones high.
    """
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("market_cap"), "ticker")
    rows = stocks.withColumn("_n", F.row_number().over(w)).withColumn("_q", F.expr("percentile(market_cap, 0.75)").over(Window.partitionBy(by)))
    rest = rows.filter("_n > 1").withColumn("_small", is_true(F.col("market_cap") < F.col("_q")))
    pool = rest.withColumn("_any", F.max(F.col("_small")).over(Window.partitionBy(by))).filter(F.col("_small") | ~F.col("_any"))
    pool = pool.withColumn("score", rank_score(F.coalesce("earnings_growth", "per"), "highest", 50.0, (by,)))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "ticker"))
    growth = pool.withColumn("place", place).filter(F.col("place") <= top_n).withColumn("role", F.lit("growth"))
    leader = rows.filter("_n = 1").withColumn("score", F.lit(None).cast("double")).withColumn("place", F.lit(1)).withColumn("role", F.lit("leader"))
    return leader.select(by, "ticker", "role", "place", "score").unionByName(growth.select(by, "ticker", "role", "place", "score"))


def relationship(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per ticker against one benchmark series (ts, close): beta, corr, rs_change_3m (62 bars), rs_trend (19 bars, 1 %).

    Days both have; null with fewer than 15 of them or 10 returns.
    """
    both = bars.select("ticker", "ts", "close").join(benchmark.select("ts", F.col("close").alias("bench")), "ts").filter("close is not null and bench is not null")
    change = lambda c: F.try_divide(F.col(c), lag(F.col(c))) - 1
    ratio = F.try_divide(F.col("close"), F.col("bench"))
    rows = both.select("ticker", "ts", change("close").alias("x"), change("bench").alias("y"), ratio.alias("rs"), lag(ratio, 62).alias("rs62"), lag(ratio, 19).alias("rs19"))
    out = rows.groupBy("ticker").agg(
        F.count("*").alias("days"), F.count("x").alias("returns"), F.try_divide(F.covar_samp("x", "y"), F.var_samp(F.when(F.col("x").isNotNull(), F.col("y")))).alias("beta"), F.corr("x", "y").alias("corr"), F.max_by(F.struct("rs", "rs62", "rs19"), "ts").alias("l")
    )
    moved = F.try_divide(F.col("l.rs"), F.col("l.rs19")) - 1
    enough = (F.col("days") >= 15) & (F.col("returns") >= 10)
    return out.select(
        "ticker", "days", F.when(enough, F.col("beta")).alias("beta"), F.when(enough, F.col("corr")).alias("corr"), F.when(enough, (F.try_divide(F.col("l.rs"), F.col("l.rs62")) - 1) * 100).alias("rs_change_3m"), F.when(enough, F.when(moved > 0.01, "up").when(moved < -0.01, "down").when(moved.isNotNull(), "flat")).alias("rs_trend")
    )


def lag_candidates(metrics: DataFrame, leader_trend: Column) -> Column:
    """Whether a stock trails a rising leader that it usually follows."""
    return is_true((leader_trend == "up") & (metrics["beta"] >= 0.5) & (metrics["corr"] >= 0.5) & (metrics["rs_trend"] != "up"))


def common_start(bars: DataFrame, indexed: bool = True) -> DataFrame:
    """bars from the first day that all tickers have, with closes indexed to 100 there if asked."""
    first = bars.filter("close is not null").groupBy("ticker").agg(F.min("ts").alias("t")).agg(F.max("t").alias("_start"))
    rows = bars.filter("close is not null").crossJoin(F.broadcast(first)).filter(F.col("ts") >= F.col("_start")).drop("_start")
    return rows.withColumn("indexed", F.try_divide(F.col("close"), F.first("close").over(by_time())) * 100) if indexed else rows


def momentum(close: Column) -> Column:
    """The strength factor's weights over returns that exist, missing ones counting as none."""
    return weighted([((F.try_divide(close, F.nullif(lag(close, n), F.lit(0.0))) - 1) * 100, w) for n, w in STRENGTH], renormalise=False)


def quality_raw() -> Column:
    """The mean of free cash flow over market cap in % and of cash over debt (10 at most, and without debt)."""
    flow = F.when(F.col("market_cap") > 0, F.try_divide(F.col("fcf"), F.col("market_cap")) * 100)
    cover = F.when(F.col("total_debt") > 0, F.least(F.try_divide(F.col("total_cash"), F.col("total_debt")), F.lit(10.0))).when((F.col("total_debt") == 0) & F.col("total_cash").isNotNull(), 10.0)
    return weighted([(flow, 1.0), (cover, 1.0)])


def value_raw() -> Column:
    """The mean of negated price multiples that mean something; null without positive earnings."""
    pbr = F.when(F.col("pbr") > 0, -F.col("pbr"))
    peg = F.when(F.col("earnings_growth") > 0, -F.try_divide(F.col("per"), F.col("earnings_growth") * 100))
    return F.when(F.col("per") > 0, weighted([(-F.col("per"), 1.0), (pbr, 1.0), (peg, 1.0)]))


def discover(stocks: DataFrame, bars: DataFrame, top_n: int = 30, weights: dict[str, float] = DISCOVERY, sectors: list[str] | None = None, members: DataFrame | None = None) -> DataFrame:
    """Stocks with the best composite of ranked momentum, quality, value and growth; missing factors rank lowest.

    sectors filters, `members` (ticker) keeps those of an index at the time.
    """
    if sectors:
        stocks = stocks.filter(F.col("sector").isin(sectors))
    if members is not None:
        stocks = stocks.join(members.select("ticker"), "ticker", "left_semi")
    moves = _last(bars.select("ticker", "ts", momentum(F.col("close")).alias("momentum_raw")), "momentum_raw").drop("ts")
    rows = stocks.join(moves, "ticker", "left").withColumn("quality_raw", quality_raw()).withColumn("value_raw", value_raw()).withColumn("growth_raw", F.col("earnings_growth"))
    for f in weights:
        rows = rows.withColumn(f, rank_score(f"{f}_raw", "lowest", 0.0))
    total = sum((F.col(f) * w for f, w in weights.items()), F.lit(0.0))
    return rows.withColumn("score", total).orderBy(F.desc("score"), "ticker").limit(top_n)


#: Screener columns with bounds, and those that need prices.
BOUNDED, TECHNICAL = ("per", "pbr", "market_cap", "rsi", "pct_from_sma"), ("rsi", "pct_from_sma")


def screen(stocks: DataFrame, filters: dict, bars: DataFrame | None = None) -> DataFrame:
    """Stocks within `filters`: min_ and max_ of BOUNDED columns, sector. Missing values fail a bound that is set.

    Prices are only read if a technical bound is set. Largest first, unknown caps last.
    """
    wanted = [c for c in TECHNICAL if f"min_{c}" in filters or f"max_{c}" in filters]
    if wanted:
        k = Kernels(bars)
        rsi, mean = k.rsi("close", 14), k.sma("close", 20)
        last = _last(k.df, F.col(rsi).alias("rsi"), ((F.try_divide(F.col("close"), F.col(mean)) - 1) * 100).alias("pct_from_sma"))
        stocks = stocks.join(last.drop("ts"), "ticker", "left")
    for c in BOUNDED:
        for side, test in (("min", lambda x, v: x >= v), ("max", lambda x, v: x <= v)):
            if filters.get(f"{side}_{c}") is not None:
                stocks = stocks.filter(is_true(test(F.col(c), filters[f"{side}_{c}"])))
    if filters.get("sector"):
        stocks = stocks.filter(F.col("sector") == filters["sector"])
    return stocks.orderBy(F.desc_nulls_last("market_cap"), "ticker")


def sample_universe(stocks: DataFrame, n: int = 100, seed: int | None = None) -> DataFrame:
    """About n stocks, an equal quota a sector (one at least), the rest going to the sectors of largest caps.

    By market cap, or by a seeded hash where a seed is given.
    """
    caps = stocks.groupBy("sector").agg(F.coalesce(F.sum("market_cap"), F.lit(0)).alias("cap"))
    kinds = F.count("*").over(Window.partitionBy(F.lit(1)))
    quota = caps.withColumn("k", kinds).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("cap"), "sector")))
    quota = quota.withColumn("quota", F.greatest(F.floor(F.lit(n) / F.col("k")), F.lit(1)) + (F.col("place") <= F.greatest(F.lit(n) - F.greatest(F.floor(F.lit(n) / F.col("k")), F.lit(1)) * F.col("k"), F.lit(0))).cast("int"))
    order = [F.desc_nulls_last("market_cap")] if seed is None else [F.xxhash64(F.lit(seed), "ticker")]
    rows = stocks.withColumn("_n", F.row_number().over(Window.partitionBy("sector").orderBy(*order, "ticker")))
    return rows.join(F.broadcast(quota.select("sector", "quota")), "sector").filter("_n <= quota").drop("_n", "quota")


def style_scores(stocks: DataFrame, bars: DataFrame) -> DataFrame:
    """(ticker, style, style_scores): six scores by rank within the universe, and the best one's name (first on ties).

    Momentum is the return of the last 126 bars; stability the deepest drawdown and the share of bars above the
    200-bar average (null below 210 bars). Missing inputs rank highest, a column without any is 50.
    """
    k = Kernels(bars)
    mean = k.sma("close", 200)
    w = by_time()
    rows = k.df.withColumn("_dd", F.try_divide(F.col("close"), F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1).withColumn("_back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts"))))
    recent = F.when(F.col("_back") <= 126, F.col("close"))
    sums = rows.groupBy("ticker").agg(
        ((F.try_divide(F.max_by("close", "ts"), F.min_by(recent, F.when(recent.isNotNull(), F.col("ts")))) - 1) * 100).alias("momentum"),
        F.when(F.count("*") >= 210, F.min("_dd") * 100).alias("mdd"),
        F.when(F.count("*") >= 210, F.avg((F.col("close") > F.col(mean)).cast("double")) * 100).alias("above"),
    )
    all_ = stocks.join(sums, "ticker", "left")
    rank = lambda x: rank_score(x, "highest", 50.0)
    of = lambda names: F.when(F.col("sector").isin(*names), 100.0).otherwise(0.0)
    for name, column in (
        ("leader", rank(F.col("momentum"))),
        ("growth", rank(F.coalesce("earnings_growth", "per"))),
        ("value", rank(-weighted([(F.col("per"), 1.0), (F.col("pbr"), 1.0)]))),
        ("cyclical", of(CYCLICAL)),
        ("defensive", of(DEFENSIVE)),
        ("quality", rank(-F.abs("mdd")) * 0.5 + F.coalesce("above", F.lit(0.0)) * 0.5),
    ):
        all_ = all_.withColumn(f"_{name}", column)
    found = {n: F.round(f"_{n}", 1) for n in STYLES}
    scores = F.create_map(*[x for n in STYLES for x in (F.lit(n), found[n])])
    best = F.array_max(F.array(*[F.struct(found[n].alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(STYLES)]))
    return all_.select("ticker", best["n"].alias("style"), scores.alias("style_scores"))


def ticker_cagr(bars: DataFrame) -> DataFrame:
    """(ticker, cagr): the calendar growth rate in % from first to last close; null without two days."""
    years = F.datediff(F.max("ts"), F.min("ts")) / 365.25
    ratio = F.try_divide(F.max_by("close", "ts"), F.min_by("close", "ts"))
    return bars.filter("close is not null").groupBy("ticker").agg(F.when((years > 0) & (ratio > 0), (F.pow(ratio, F.lit(1.0) / years) - 1) * 100).alias("cagr"))


def trend_by_growth(bars: DataFrame) -> DataFrame:
    """(ticker, cagr, trend): up from 10 %, down to -10 %, else sideways."""
    return ticker_cagr(bars).withColumn("trend", F.when(F.col("cagr") >= 10, "up").when(F.col("cagr") <= -10, "down").otherwise("sideways"))


def trend_terciles(bars: DataFrame) -> DataFrame:
    """(ticker, cagr, trend) by thirds of the growth rates' ranks; fewer than three tickers are all sideways."""
    rows = ticker_cagr(bars).filter("cagr is not null")
    everything = Window.partitionBy(F.lit(1))
    share = average_rank_pct(F.col("cagr"), everything.orderBy("cagr"), F.count("*").over(everything))
    label = F.when(F.count("*").over(everything) < 3, "sideways").when(share > 2 / 3, "up").when(share <= 1 / 3, "down").otherwise("sideways")
    return rows.withColumn("trend", label)
