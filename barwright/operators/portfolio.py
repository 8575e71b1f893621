"""Valuation and portfolio arithmetic as columns and small aggregations.

Closed forms take Columns and give null where their inputs make no sense; zero counts as missing where a price multiple
or a share count is concerned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import lag


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(None if x is None else float(x))


# ------------------------------------------------------------ valuation
def dcf(fcf, shares, growth=0.08, discount=0.10, terminal=0.025, years: int = 5) -> Column:
    """Value a share of free cash flows growing for `years`, then for ever; null unless discount exceeds terminal growth."""
    f, n, g, r, t = map(_c, (fcf, shares, growth, discount, terminal))
    q = (1 + g) / (1 + r)
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda a, i: a + F.pow(q, i))
    last = F.pow(q, F.lit(years)) * F.try_divide(1 + t, r - t)
    return F.when((n > 0) & (r > t) & (f > 0), F.try_divide(f * (flows + last), n))


def ddm(dividend, required=0.09, growth=0.03) -> Column:
    d, r, g = map(_c, (dividend, required, growth))
    return F.when((r > g) & (d > 0), F.try_divide(d * (1 + g), r - g))


def per_value(eps, peer_per) -> Column:
    e, p = map(_c, (eps, peer_per))
    return F.when((e != 0) & (p != 0), e * p)


def pbr_value(bvps, peer_pbr) -> Column:
    return per_value(bvps, peer_pbr)


def ev_ebitda_value(ebitda, multiple, net_debt, shares) -> Column:
    e, m, d, n = map(_c, (ebitda, multiple, net_debt, shares))
    return F.when((n > 0) & (e != 0) & (m != 0), F.try_divide(e * m - F.coalesce(d, F.lit(0.0)), n))


def peg(per, growth_pct) -> Column:
    p, g = map(_c, (per, growth_pct))
    return F.when(g > 0, F.try_divide(p, g))


def graham(eps, bvps) -> Column:
    e, b = map(_c, (eps, bvps))
    return F.when((e > 0) & (b > 0), F.sqrt(22.5 * e * b))


def valuations(inputs: DataFrame) -> DataFrame:
    """inputs with every method's value a share and the PEG ratio.

    Reads fcf, shares, dividend, eps, bvps, ebitda, net_debt, per, earnings_growth, peer_per, peer_pbr, peer_ev_ebitda.
    """
    c = F.col
    return inputs.withColumns(
        {
            "dcf_value": dcf(c("fcf"), c("shares")),
            "ddm_value": ddm(c("dividend")),
            "per_value": per_value(c("eps"), c("peer_per")),
            "pbr_value": pbr_value(c("bvps"), c("peer_pbr")),
            "ev_ebitda_value": ev_ebitda_value(c("ebitda"), c("peer_ev_ebitda"), c("net_debt"), c("shares")),
            "graham_value": graham(c("eps"), c("bvps")),
            "peg": peg(c("per"), c("earnings_growth") * 100),
        }
    )


def valuation_band(bars: DataFrame, inputs: DataFrame) -> DataFrame:
    """(ticker, ts, per, pbr): closes over today's earnings and book value a share."""
    rows = bars.join(inputs.select("ticker", "eps", "bvps"), "ticker")
    ratio = lambda x: F.when(F.col(x) > 0, F.try_divide(F.col("close"), F.col(x)))
    return rows.select("ticker", "ts", ratio("eps").alias("per"), ratio("bvps").alias("pbr"))


def peers(stocks: DataFrame, n: int = 2, pool: int = 20) -> DataFrame:
    """(ticker, peer, distance): of the first `pool` stocks of the same sector by ticker, the n closest in market cap.

    The pool is bounded, so a sector of any size gives `pool` rows a stock at most.
    """
    first = Window.partitionBy("sector").orderBy("ticker")
    picked = stocks.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= pool + 1).select("sector", F.col("ticker").alias("peer"), F.col("market_cap").alias("peer_cap"), "_n")
    pairs = stocks.select("ticker", "sector", "market_cap").join(F.broadcast(picked), "sector").filter("ticker <> peer")
    in_pool = F.row_number().over(Window.partitionBy("ticker").orderBy("_n")) <= pool
    pairs = pairs.withColumn("_in", in_pool).filter("_in and market_cap is not null and peer_cap is not null").withColumn("distance", F.abs(F.col("market_cap") - F.col("peer_cap")))
    best = Window.partitionBy("ticker").orderBy("distance", "peer")
    return pairs.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= n).select("ticker", "peer", "distance")


# ------------------------------------------------------------ portfolio
def pnl(holdings: DataFrame, prices: DataFrame, key: str = "portfolio") -> DataFrame:
    """holdings (key, ticker, quantity, purchase_price) with cost, value, pnl, pnl_pct, and weight in the known total.

    prices: (ticker, close). Holdings without a price have null values.
    """
    rows = holdings.join(prices.select("ticker", F.col("close").alias("price")), "ticker", "left")
    rows = rows.withColumn("cost", F.col("quantity") * F.col("purchase_price")).withColumn("value", F.col("quantity") * F.col("price"))
    rows = rows.withColumn("pnl", F.col("value") - F.col("cost")).withColumn("pnl_pct", F.try_divide(F.col("pnl"), F.col("cost")) * 100)
    total = F.sum("value").over(Window.partitionBy(key))
    return rows.withColumn("weight", F.try_divide(F.col("value"), F.nullif(total, F.lit(0.0))) * 100)


def daily_returns(bars: DataFrame) -> DataFrame:
    """(ticker, ts, ret) on the days that every ticker has a return for."""
    w = Window.partitionBy("ticker").orderBy("ts")
    rows = bars.select("ticker", "ts", (F.try_divide(F.col("close"), lag(F.col("close"), 1, w)) - 1).alias("ret"))
    n = bars.select("ticker").distinct().count()
    days = rows.filter("ret is not null").groupBy("ts").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("ts")
    return rows.join(days, "ts", "left_semi")


def volatility(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: the annualised deviation of the weighted daily return, in %. weights: (ticker, weight)."""
    day = returns.join(F.broadcast(weights), "ticker").groupBy("ts").agg(F.sum(F.col("ret") * F.col("weight")).alias("r"))
    return day.agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0)) * 100).alias("volatility"))


def correlations(returns: DataFrame) -> DataFrame:
    """(a, b, corr) for every two tickers, each pair once and with itself: returns meet on their day."""
    a = returns.select("ts", F.col("ticker").alias("a"), F.col("ret").alias("x"))
    b = returns.select("ts", F.col("ticker").alias("b"), F.col("ret").alias("y"))
    return a.join(b, "ts").filter("a <= b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


def correlation_matrix(bars: DataFrame) -> DataFrame:
    """(a, b, corr) for every two tickers, each pair once and with itself, on the days that every ticker has a return for.

    A day's returns are put into one row, a vector by ticker, so that they are shuffled once; its pairs then are made
    in that row and summed up before they are shuffled, at most a row for each pair and task.
    """
    w = Window.partitionBy("ticker").orderBy("ts")
    rows = bars.select("ticker", "ts", (F.try_divide(F.col("close"), lag(F.col("close"), 1, w)) - 1).alias("ret")).filter("ret is not null")
    n = bars.agg(F.count_distinct("ticker").alias("n"))
    day = rows.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("ticker", "ret"))).alias("v"))
    day = day.crossJoin(F.broadcast(n)).filter(F.size("v") == F.col("n")).select("v", F.posexplode("v").alias("i", "x"))  # one row of n
    pairs = day.select("x", F.explode(F.slice("v", F.col("i") + 1, F.size("v"))).alias("y"))
    return pairs.groupBy(F.col("x.ticker").alias("a"), F.col("y.ticker").alias("b")).agg(F.corr("x.ret", "y.ret").alias("corr"))


def concentration(valued: DataFrame, sectors: DataFrame, key: str = "portfolio") -> DataFrame:
    """(key, sector, value, share): value by sector in % of the total, unknown sectors as other; none for a zero total."""
    rows = valued.join(sectors.select("ticker", "sector"), "ticker", "left").filter("value is not null")
    sums = rows.groupBy(key, F.coalesce("sector", F.lit("other")).alias("sector")).agg(F.sum("value").alias("value"))
    total = F.sum("value").over(Window.partitionBy(key))
    return sums.withColumn("share", F.try_divide(F.col("value"), F.nullif(total, F.lit(0.0))) * 100).filter("share is not null")


def comment(total_pct: Column, top_sector: Column, top_share: Column, vol: Column) -> Column:
    """A portfolio in a sentence: gain or loss, concentration from 40 % of one sector, volatility if known."""
    gain = F.concat(F.lit("Total return "), F.format_number(total_pct, 1), F.lit(" %."))
    heavy = F.when(top_share >= 40, F.concat(F.lit(" Concentrated in "), top_sector, F.lit(" ("), F.format_number(top_share, 0), F.lit(" %).")))
    return F.concat(gain, F.coalesce(heavy, F.lit("")), F.coalesce(F.concat(F.lit(" Volatility "), F.format_number(vol, 1), F.lit(" %.")), F.lit("")))
