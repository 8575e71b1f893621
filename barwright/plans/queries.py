"""The registered queries of the engine's operators, and their equivalents in DuckDB's SQL.

Each query is `name(spark, sf_dir)`; SQL[name] is its oracle where SQL can express it. Bars are line items by brand and
day; sectors are part types, holders customers, prices retail prices, posts conversation turns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candles
from ..functions import windows as win
from ..functions.indicators import Kernels
from ..operators import backtest, conditions, cycles, expression, holdings, portfolio, ranking, records, regime, sequential, tuning
from ..sources import bars as B
from . import intake, strategy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LONGEST = 3000  # daily bars of a ticker in the tables' seven years, at most


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.daily_bars(spark, sf)


def _r(x, n: int = 6):
    return F.round(x, n)


# ------------------------------------------------------------ SQL pieces
BARS = """bars AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS ts, arg_min(l_extendedprice, (l_orderkey*1000+l_linenumber, l_extendedprice)) AS o,
 max(l_extendedprice) AS h, min(l_extendedprice) AS l, arg_max(l_extendedprice, (l_orderkey*1000+l_linenumber, l_extendedprice)) AS c, CAST(sum(l_quantity) AS DOUBLE) AS v
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
W = "PARTITION BY ticker ORDER BY ts"


def over(low: int, high: int = 0) -> str:
    edge = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"OVER ({W} ROWS BETWEEN {edge(low)} AND {edge(high)})"


def roll(agg: str, x: str, n: int, high: int = 0) -> str:
    frame = over(high - n + 1, high)
    return f"(CASE WHEN count({x}) {frame} >= {n} THEN {agg}({x}) {frame} END)"


def lagged(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def true(x: str) -> str:
    return f"coalesce({x}, false)"


def ewm(source: str, x: str, alpha: float, least: int, out: str) -> str:
    """A CTE body: source's rows with `out`, the exponential average of x, by running sums over powers of its decay."""
    q = 1 - alpha
    t = f"count({x}) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1"
    return f"""SELECT * EXCLUDE (_t, _p), CASE WHEN _t >= {least - 1} AND {x} IS NOT NULL THEN pow({q!r}, _t) * _p END AS {out} FROM
 (SELECT *, sum(CASE WHEN {x} IS NOT NULL THEN (CASE WHEN _t = 0 THEN 1.0 ELSE {alpha!r} END) * {x} * pow({q!r}, -_t) END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS _p FROM
 (SELECT *, {t} AS _t FROM {source}))"""


CHANGES = "ch AS (SELECT *, coalesce(greatest(d, 0.0), 0.0) AS up, coalesce(greatest(-d, 0.0), 0.0) AS dn FROM (SELECT *, c - lag(c) OVER (PARTITION BY ticker ORDER BY ts) AS d FROM bars))"


def rsi_ctes(n: int = 14) -> str:
    return f"{CHANGES}, ru AS ({ewm('ch', 'up', 1 / n, n, 'au')}), rs AS (SELECT *, CASE WHEN ad = 0 THEN 100.0 ELSE 100 - 100 / (1 + au / ad) END AS rsi FROM ({ewm('ru', 'dn', 1 / n, n, 'ad')}))"


def counts(names: dict[str, str], source: str, ctes: str) -> str:
    """Per ticker, how many bars each boolean expression holds at, and the sum of their squared day numbers, which tells which."""
    day = "(ts - DATE '1970-01-01')"
    cols = ", ".join(f"CAST(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS BIGINT) AS {n}, CAST(sum(CASE WHEN {x} THEN {day} * {day} ELSE 0 END) AS BIGINT) AS {n}_days" for n, x in names.items())
    return f"WITH {BARS}, {ctes} SELECT ticker, {cols} FROM {source} GROUP BY ticker"


def _count(df: DataFrame, **names) -> DataFrame:
    day = F.unix_date("ts").cast("long")
    return df.groupBy("ticker").agg(*[a for n, c in names.items() for a in (F.sum(F.col(c).cast("long")).alias(n), F.sum(F.when(F.col(c), day * day).otherwise(0)).alias(f"{n}_days"))])


def _conditions(spark: SparkSession, sf: str, named: dict[str, dict]) -> DataFrame:
    k = Kernels(_bars(spark, sf), LONGEST)
    made = {n: conditions.evaluate(k, c) for n, c in named.items()}
    return _count(k.df, **made)


# ------------------------------------------------------------ bars
@query(f"WITH {BARS} SELECT ticker, ts, o AS open, h AS high, l AS low, c AS close, v AS volume FROM bars")
def bars_daily(spark, sf):
    return _bars(spark, sf)


@query("""SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
 CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""")
def bars_hourly(spark, sf):
    return B.hourly_bars(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _resample_sql(bucket: str) -> str:
    return f"""WITH {BARS} SELECT ticker, max(ts) AS ts, arg_min(o, ts) AS open, max(h) AS high, min(l) AS low, arg_max(c, ts) AS close, sum(v) AS volume FROM bars GROUP BY ticker, {bucket}"""


@query(_resample_sql("date_trunc('week', ts + INTERVAL 2 DAY)"))
def resample_week(spark, sf):
    return B.resample(_bars(spark, sf), "W-FRI")


@query(_resample_sql("date_trunc('month', ts)"))
def resample_month(spark, sf):
    return B.resample(_bars(spark, sf), "ME")


@query(_resample_sql("date_trunc('quarter', ts)"))
def resample_quarter(spark, sf):
    return B.resample(_bars(spark, sf), "QE")


@query(f"WITH {BARS} SELECT ticker, max(ts) AS ts, arg_max(c, ts) AS close FROM bars GROUP BY ticker")
def latest_price(spark, sf):
    return B.latest_price(_bars(spark, sf))


@query(f"""WITH {BARS} SELECT ticker, ts, CASE WHEN ts >= DATE '1997-01-01' THEN c * 2 ELSE c END AS close, v AS volume FROM bars WHERE ts >= DATE '1996-01-01' AND ts < DATE '1998-01-01' AND ticker IN ('Brand#1', 'Brand#11', 'Brand#5')""")
def merged_history(spark, sf):
    """Union of two stores, the later winning, sliced to a half-open range and a ticker list."""
    old = _bars(spark, sf)
    new = old.filter(F.col("ts") >= F.lit(dt.date(1997, 1, 1))).withColumn("close", F.col("close") * 2)
    out = B.history(B.merge_bars(old, new), dt.date(1996, 1, 1), dt.date(1998, 1, 1), ["Brand#1", "Brand#11", "Brand#5"])
    return out.select("ticker", "ts", "close", "volume")


# ------------------------------------------------------------ indicators
@query(f"WITH {BARS}, e AS ({ewm('bars', 'c', 2 / 21, 20, 'ema20')}) SELECT ticker, ts, round({roll('avg', 'c', 20)}, 6) AS sma20, round(ema20, 5) AS ema20, round((c / {lagged('c', 10)} - 1) * 100, 6) AS roc10 FROM e")
def indicator_averages(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    a, b, c = k.sma("close", 20), k.ema("close", 20), k.roc("close", 10)
    return k.df.select("ticker", "ts", _r(a).alias("sma20"), _r(b, 5).alias("ema20"), _r(c).alias("roc10"))


@query(f"""WITH {BARS}, b AS (SELECT ticker, ts, c, {roll('avg', 'c', 20)} AS m, {roll('stddev_pop', 'c', 20)} AS s FROM bars)
 SELECT ticker, ts, round((m + 2 * s) / m, 5) AS upper_ratio, round(4 * s / m, 5) AS bbw, round(CASE WHEN s > 0 THEN (c - m + 2 * s) / (4 * s) END, 5) AS percent_b FROM b""")
def indicator_bands(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    m, u, _ = k.bands("close")
    w, p = k.band_width("close"), k.percent_b("close")
    return k.df.select("ticker", "ts", _r(F.col(u) / F.col(m), 5).alias("upper_ratio"), _r(w, 5).alias("bbw"), _r(p, 5).alias("percent_b"))


MFI = f"mf AS (SELECT *, CASE WHEN tp > tb THEN tp * v ELSE 0 END AS pf, CASE WHEN tp < tb THEN tp * v ELSE 0 END AS nf FROM (SELECT *, lag(tp) OVER ({W}) AS tb FROM (SELECT *, (h + l + c) / 3 AS tp FROM rs))), mm AS (SELECT *, {roll('sum', 'pf', 14)} AS sp, {roll('sum', 'nf', 14)} AS sn FROM mf), mo AS (SELECT *, CASE WHEN sn = 0 AND sp > 0 THEN 100.0 WHEN sn = 0 THEN NULL ELSE 100 - 100 / (1 + sp / sn) END AS mfi FROM mm)"


@query(f"WITH {BARS}, {rsi_ctes()}, {MFI} SELECT ticker, ts, round(rsi, 5) AS rsi14, round(mfi, 5) AS mfi14 FROM mo")
def indicator_momentum(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    a, b = k.rsi("close"), k.mfi()
    return k.df.select("ticker", "ts", _r(a, 5).alias("rsi14"), _r(b, 5).alias("mfi14"))


MACD = f"m1 AS ({ewm('bars', 'c', 2 / 13, 12, 'ef')}), m2 AS ({ewm('m1', 'c', 2 / 27, 26, 'es')}), m3 AS (SELECT *, ef - es AS macd FROM m2), md AS ({ewm('m3', 'macd', 2 / 10, 9, 'sig')})"


@query(f"WITH {BARS}, {MACD} SELECT ticker, ts, round(macd, 3) AS macd, round(sig, 3) AS signal, round(macd - sig, 3) AS hist FROM md")
def indicator_macd(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    a, b, c = k.macd("close")
    return k.df.select("ticker", "ts", _r(a, 3).alias("macd"), _r(b, 3).alias("signal"), _r(c, 3).alias("hist"))


def _mid(n: int) -> str:
    return f"({roll('max', 'h', n)} + {roll('min', 'l', n)}) / 2"


ICHI = f"""i1 AS (SELECT *, {_mid(9)} AS tk, {_mid(26)} AS kj, {_mid(52)} AS sb FROM bars), i2 AS (SELECT *, {lagged('(tk + kj) / 2', 26)} AS sa26, {lagged('sb', 26)} AS sb26, {lagged('c', 26)} AS chi FROM i1),
 ic AS (SELECT *, greatest(sa26, sb26) AS ct, least(sa26, sb26) AS cb FROM i2)"""


@query(f"WITH {BARS}, {ICHI} SELECT ticker, ts, round(tk, 6) AS tenkan, round(kj, 6) AS kijun, round(ct, 6) AS cloud_top, round(cb, 6) AS cloud_bottom, chi AS chikou_ref FROM ic")
def indicator_ichimoku(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    i = k.ichimoku()
    return k.df.select("ticker", "ts", *[_r(i[n]).alias(n) for n in ("tenkan", "kijun", "cloud_top", "cloud_bottom")], F.col(i["chikou_ref"]).alias("chikou_ref"))


@query(f"""WITH {BARS} SELECT ticker, ts, round(v / {roll('avg', 'v', 20, -1)}, 6) AS volume_ratio, round(v / {roll('max', 'v', 10, -1)}, 6) AS dryup, {roll('max', 'h', 20)} AS highest, {roll('min', 'l', 20)} AS lowest,
 (count(l) {over(-5, 5)} = 11 AND l = min(l) {over(-5, 5)}) AS pivot_low, (count(h) {over(-5, 5)} = 11 AND h = max(h) {over(-5, 5)}) AS pivot_high FROM bars""")
def indicator_levels(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    cols = {"highest": k.highest("high", 20), "lowest": k.lowest("low", 20), "pivot_low": k.pivot("low", 5, True), "pivot_high": k.pivot("high", 5, False)}
    a, b = k.volume_ratio(), k.volume_dryup()
    return k.df.select("ticker", "ts", _r(a).alias("volume_ratio"), _r(b).alias("dryup"), *[F.col(c).alias(n) for n, c in cols.items()])


def _begun(x: str, first: int) -> str:
    """x from bar `first` on, there the mean of 14 values."""
    return f"CASE WHEN i = {first} THEN avg({x}) {over(-13)} WHEN i > {first} THEN {x} END"


_SHARE = lambda x: f"coalesce({x} / nullif(st, 0), 0)"
ADX = f"""a0 AS (SELECT *, row_number() OVER ({W}) - 1 AS i, h - {lagged('h')} AS up_, {lagged('l')} - l AS dn_, {lagged('c')} AS pc, count(*) OVER (PARTITION BY ticker) AS n_ FROM bars),
 a1 AS (SELECT *, CASE WHEN i > 0 THEN greatest(h, pc) - least(l, pc) END AS tr, CASE WHEN i > 0 THEN CASE WHEN up_ > dn_ AND up_ > 0 THEN up_ ELSE 0 END END AS pl, CASE WHEN i > 0 THEN CASE WHEN dn_ > up_ AND dn_ > 0 THEN dn_ ELSE 0 END END AS mi FROM a0),
 a2 AS (SELECT *, {_begun('tr', 14)} AS bt, {_begun('pl', 14)} AS bp, {_begun('mi', 14)} AS bm_ FROM a1), a3 AS ({ewm('a2', 'bt', 1 / 14, 1, 'st')}), a4 AS ({ewm('a3', 'bp', 1 / 14, 1, 'sp')}), a5 AS ({ewm('a4', 'bm_', 1 / 14, 1, 'sm')}),
 a6 AS (SELECT *, CASE WHEN i >= 14 THEN coalesce(100 * abs({_SHARE('sp')} - {_SHARE('sm')}) / nullif({_SHARE('sp')} + {_SHARE('sm')}, 0), 0) END AS dx FROM a5), a7 AS (SELECT *, {_begun('dx', 27)} AS bd FROM a6), a8 AS ({ewm('a7', 'bd', 1 / 14, 1, 'sd')}),
 ax AS (SELECT *, CASE WHEN i >= 27 AND n_ > 28 THEN coalesce(sd, 0) ELSE 0 END AS adx FROM a8)"""


@query(f"WITH {BARS}, {ADX} SELECT ticker, ts, round(adx, 6) AS adx14 FROM ax")
def indicator_adx(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    name = sequential.adx(k)
    return k.df.select("ticker", "ts", _r(name).alias("adx14"))


# ------------------------------------------------------------ candles
_lag = lagged
SHAPE = f"""s0 AS (SELECT *, abs(c - o) AS body, CASE WHEN h <> l THEN h - l END AS rng, h - greatest(o, c) AS uw, least(o, c) - l AS lw FROM bars),
 s1 AS (SELECT *, body / rng AS br, uw / rng AS ur, lw / rng AS lr, {_lag('o')} AS o1, {_lag('c')} AS c1, {_lag('h')} AS h1, {_lag('l')} AS l1, {_lag('o', 2)} AS o2, {_lag('c', 2)} AS c2, {_lag('body / rng')} AS br1, {_lag('body / rng', 2)} AS br2,
 {_lag('h', 2)} AS h2, {_lag('l', 2)} AS l2, {_lag('h', 3)} AS h3, {_lag('l', 3)} AS l3, {_lag('o', 4)} AS o4, {_lag('c', 4)} AS c4, {_lag('h', 4)} AS h4, {_lag('l', 4)} AS l4, {_lag('body / rng', 4)} AS br4, {roll('avg', 'c', 20)} AS bm, {roll('stddev_pop', 'c', 20)} AS bs FROM s0)"""
_HELD = " AND ".join(f"h{i} <= h4 AND l{i} >= l4" for i in (1, 2, 3))
CANDLES = {
    "engulfing_bull": "c1 < o1 AND c > o AND o <= c1 AND c >= o1", "engulfing_bear": "c1 > o1 AND c < o AND o >= c1 AND c <= o1",
    "marubozu_bull": "br >= 0.9 AND c > o", "marubozu_bear": "br >= 0.9 AND c < o",
    "pin_bull": "br <= 0.3 AND lw >= 2 * body AND uw <= body", "pin_bear": "br <= 0.3 AND uw >= 2 * body AND lw <= body",
    "doji_dragonfly": "br <= 0.1 AND lr >= 0.6 AND ur <= 0.1", "doji_gravestone": "br <= 0.1 AND NOT (lr >= 0.6 AND ur <= 0.1) AND ur >= 0.6 AND lr <= 0.1",
    "doji_long": "br <= 0.1 AND NOT (lr >= 0.6 AND ur <= 0.1) AND NOT (ur >= 0.6 AND lr <= 0.1) AND ur >= 0.3 AND lr >= 0.3",
    "doji_standard": "br <= 0.1 AND NOT (lr >= 0.6 AND ur <= 0.1) AND NOT (ur >= 0.6 AND lr <= 0.1) AND NOT (ur >= 0.3 AND lr >= 0.3)",
    "inside": "h <= h1 AND l >= l1",
    "piercing": "c1 < o1 AND c > o AND o < c1 AND c > (o1 + c1) / 2 AND c < o1 AND l < bm - 2 * bs AND c > bm - 2 * bs",
    "dark_cloud": "c1 > o1 AND c < o AND o > c1 AND c < (o1 + c1) / 2 AND c > o1 AND h > bm + 2 * bs AND c < bm + 2 * bs",
    "morning_star": "c2 < o2 AND br2 >= 0.5 AND br1 <= 0.3 AND greatest(o1, c1) < c2 AND c > o AND br >= 0.5 AND c > (o2 + c2) / 2",
    "evening_star": "c2 > o2 AND br2 >= 0.5 AND br1 <= 0.3 AND least(o1, c1) > c2 AND c < o AND br >= 0.5 AND c < (o2 + c2) / 2",
    "soldiers": "br2 >= 0.6 AND br1 >= 0.6 AND br >= 0.6 AND c2 > o2 AND c1 > o1 AND c > o AND c1 > c2 AND c > c1 AND o1 > o2 AND o1 < c2 AND o > o1 AND o < c1",
    "crows": "br2 >= 0.6 AND br1 >= 0.6 AND br >= 0.6 AND c2 < o2 AND c1 < o1 AND c < o AND c1 < c2 AND c < c1 AND o1 < o2 AND o1 > c2 AND o < o1 AND o > c1",
    "rising_three": f"br4 >= 0.5 AND c4 > o4 AND {_HELD} AND br >= 0.5 AND c > o AND c > c4", "falling_three": f"br4 >= 0.5 AND c4 < o4 AND {_HELD} AND br >= 0.5 AND c < o AND c < c4",
}


@query(counts(CANDLES, "s1", SHAPE))
def candle_patterns(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    found = {
        "engulfing": candles.engulfing(k), "marubozu": candles.marubozu(k), "pin": candles.pin_bar(k), "doji": candles.doji(k), "inside": candles.inside_bar(k), "cloud": candles.piercing_dark_cloud(k), "star": candles.star(k), "three": candles.three_soldiers_crows(k), "methods": candles.three_methods(k)
    }
    pick = {f"{p}_{s}": found[p][d] for p in ("engulfing", "marubozu", "pin") for s, d in (("bull", "bullish"), ("bear", "bearish"))}
    pick |= {f"doji_{s}": found["doji"][d] for s, d in (("dragonfly", "dragonfly"), ("gravestone", "gravestone"), ("long", "long_legged"), ("standard", "standard"))}
    pick |= {"inside": found["inside"]["any"]}
    pick |= {n: found[p][d] for p, names in (("cloud", ("piercing", "dark_cloud")), ("star", ("morning_star", "evening_star")), ("three", ("soldiers", "crows")), ("methods", ("rising_three", "falling_three"))) for n, d in zip(names, ("bullish", "bearish"), strict=True)}
    df = k.df.withColumns({f"_{n}": c for n, c in pick.items()})
    return _count(df, **{n: f"_{n}" for n in pick})


BREAK = f"""b1 AS (SELECT *, {true('h <= ' + _lag('h') + ' AND l >= ' + _lag('l'))} AS ins, {_lag('h')} AS mh, {_lag('l')} AS ml FROM bars), b2 AS (SELECT *, sum(CASE WHEN ins THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM b1),
 b3 AS (SELECT *, first_value(mh) OVER (PARTITION BY ticker, g ORDER BY ts) AS gh, first_value(ml) OVER (PARTITION BY ticker, g ORDER BY ts) AS gl, row_number() OVER (PARTITION BY ticker, g ORDER BY ts) - 1 AS age FROM b2),
 b4 AS (SELECT *, CASE WHEN g > 0 AND age <= 5 THEN CASE WHEN c > gh THEN 1 WHEN c < gl THEN -1 END END AS side FROM b3), b5 AS (SELECT *, count(side) OVER (PARTITION BY ticker, g ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM b4)"""


@query(counts({"up": "nth = 1 AND side = 1", "down": "nth = 1 AND side = -1"}, "b5", BREAK))
def inside_bar_breakouts(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    made = candles.inside_bar_breakout(k)
    return _count(k.df.withColumn("_u", made["bullish"]).withColumn("_d", made["bearish"]), up="_u", down="_d")


# ------------------------------------------------------------ conditions
def crossed(a: str, b: str, op: str = ">") -> str:
    """SQL over columns that a CTE named; the comparison now and not before."""
    return f"({true(f'{a} {op} {b}')} AND NOT coalesce(lag({true(f'{a} {op} {b}')}) OVER ({W}), false))"


PRICE = f"""p1 AS (SELECT *, {roll('avg', 'c', 20)} AS m20, {roll('avg', 'c', 60)} AS m60, {roll('stddev_pop', 'c', 20)} AS s20, {roll('max', 'h', 20)} AS hh, {roll('min', 'l', 20)} AS ll, {roll('avg', 'v', 20, -1)} AS av, {roll('max', 'v', 10, -1)} AS pv FROM bars),
 p2 AS (SELECT *, {lagged('hh')} AS hh1, {lagged('ll')} AS ll1, {crossed('c', 'm20', '<')} AS touch_down, {crossed('c', 'm20')} AS touch_up FROM p1)"""


@query(
    counts(
        {"golden": "m20 > m60", "dead": f"NOT {true('m20 > m60')}", "band_lower": "c < m20 - 2 * s20", "band_upper": "c > m20 + 2 * s20", "band_mid": "c > m20", "level_up": "c > hh1", "level_down": "c < ll1", "touch_down": "touch_down", "touch_up": "touch_up", "spike": "v / av >= 2", "dryup": "v / pv <= 0.4", "percent_b": "s20 > 0 AND (c - m20 + 2 * s20) / (4 * s20) >= 0.8"},
        "p2",
        PRICE,
    )
)
def conditions_price(spark, sf):
    c = lambda name, **p: {"indicator": name} | p
    return _conditions(
        spark, sf,
        {
            "golden": c("ma_cross"), "dead": c("ma_cross", type="dead"), "band_lower": c("bollinger"), "band_upper": c("bollinger", band="upper"), "band_mid": c("bollinger", band="mid", op="break_above"), "level_up": c("level_break"),
            "level_down": c("level_break", source="lowest_low", op="break_below"), "touch_down": c("ma_touch", ma_type="sma"), "touch_up": c("ma_touch", ma_type="sma", op="break_above"), "spike": c("volume_spike"), "dryup": c("volume_dryup"), "percent_b": c("percent_b"),
        },
    )


@query(
    counts(
        {"rsi_low": "rsi < 45", "rsi_high": "rsi >= 55", "rsi_up": "xu", "rsi_down": "xd", "mfi_high": "mfi >= 80", "mfi_low": "mfi < 30"},
        f"(SELECT *, {crossed('rsi', '50')} AS xu, {crossed('rsi', '50', '<')} AS xd FROM mo)",
        f"{rsi_ctes()}, {MFI}",
    )
)
def conditions_momentum(spark, sf):
    c = lambda name, **p: {"indicator": name} | p
    return _conditions(spark, sf, {"rsi_low": c("rsi", value=45), "rsi_high": c("rsi", op=">=", value=55), "rsi_up": c("rsi_cross", level=50), "rsi_down": c("rsi_cross", level=50, direction="down"), "mfi_high": c("mfi"), "mfi_low": c("mfi", op="<", value=30)})


@query(
    counts(
        {"cross_up": "gu", "cross_down": "gd", "up_below_zero": "gu AND macd < 0", "down_above_zero": "gd AND macd > 0", "below": "macd < 0", "hist_above": "macd - sig > 0"},
        f"(SELECT *, {crossed('macd', 'sig')} AS gu, {crossed('macd', 'sig', '<')} AS gd FROM md)",
        MACD,
    )
)
def conditions_macd(spark, sf):
    c = lambda name, **p: {"indicator": name} | p
    return _conditions(spark, sf, {"cross_up": c("macd_cross"), "cross_down": c("macd_cross", direction="dead"), "up_below_zero": c("macd_cross", zone="below_zero"), "down_above_zero": c("macd_cross", direction="dead", zone="above_zero"), "below": c("macd_level"), "hist_above": c("macd_level", source="hist", op=">")})


@query(
    counts(
        {"tk_golden": "tk > kj", "tk_dead": f"NOT {true('tk > kj')}", "tk_up": "tu", "cloud_up": "cu", "cloud_down": "cd", "above": "c > ct", "below": "c < cb", "chikou_up": "c > chi"},
        f"(SELECT *, {crossed('tk', 'kj')} AS tu, {crossed('c', 'ct')} AS cu, {crossed('c', 'cb', '<')} AS cd FROM ic)",
        ICHI,
    )
)
def conditions_ichimoku(spark, sf):
    c = lambda name, **p: {"indicator": f"ichimoku_{name}"} | p
    return _conditions(
        spark, sf,
        {"tk_golden": c("tk_state"), "tk_dead": c("tk_state", direction="dead"), "tk_up": c("tk_cross"), "cloud_up": c("cloud_break"), "cloud_down": c("cloud_break", direction="down"), "above": c("cloud_state"), "below": c("cloud_state", direction="below"), "chikou_up": c("chikou_state")},
    )


ICHI2 = f"""i1 AS (SELECT *, {_mid(5)} AS tk, {_mid(13)} AS kj, {_mid(20)} AS sb FROM bars), i2 AS (SELECT *, {lagged('(tk + kj) / 2', 10)} AS sa26, {lagged('sb', 10)} AS sb26, {lagged('c', 10)} AS chi FROM i1),
 ic AS (SELECT *, greatest(sa26, sb26) AS ct, least(sa26, sb26) AS cb FROM i2)"""


@query(f"WITH {BARS}, {ICHI2} SELECT ticker, ts, {true('tk > kj')} AS golden, {crossed('c', 'ct')} AS broke_up, {true('c < cb')} AS below, {true('c > chi')} AS over_past FROM ic")
def conditions_ichimoku_set(spark, sf):
    """Ichimoku conditions by bar, with lengths of their own."""
    k, own = Kernels(_bars(spark, sf), LONGEST), {"tenkan_len": 5, "kijun_len": 13, "span_b_len": 20, "displacement": 10}
    names = {"golden": {"indicator": "ichimoku_tk_state"}, "broke_up": {"indicator": "ichimoku_cloud_break"}, "below": {"indicator": "ichimoku_cloud_state", "direction": "below"}, "over_past": {"indicator": "ichimoku_chikou_state"}}
    made = {n: conditions.evaluate(k, c | own) for n, c in names.items()}
    return k.df.select("ticker", "ts", *[F.col(c).alias(n) for n, c in made.items()])


SQUEEZE = f"""q1 AS (SELECT *, 4 * {roll('stddev_pop', 'c', 20)} / {roll('avg', 'c', 20)} AS w FROM bars), q2 AS (SELECT *, {true('w < 1.8')} AS tight, lag(w) OVER ({W}) AS w1 FROM q1),
 q3 AS (SELECT *, max(CASE WHEN tight THEN 1 ELSE 0 END) {over(-20, -1)} AS was FROM q2), q4 AS (SELECT *, CASE WHEN {true('w >= 1.8 AND w1 < 1.8 AND was = 1')} THEN 1 ELSE 0 END AS ev FROM q3), q5 AS (SELECT *, max(ev) {over(-2)} AS held FROM q4)"""


@query(counts({"released": "held = 1"}, "q5", SQUEEZE))
def condition_squeeze(spark, sf):
    return _conditions(spark, sf, {"released": {"indicator": "bbw_squeeze_release", "threshold": 1.8}})


@query()
def conditions_sequential(spark, sf):
    both = {f"{n}_{d}": {"indicator": i, "direction": d} for n, i in (("double", "double_pattern"), ("divergence", "rsi_divergence")) for d in ("bullish", "bearish")}
    return _conditions(spark, sf, both)


EXPR = f"""x1 AS (SELECT *, {roll('avg', 'c', 20)} AS m20, {roll('avg', 'v', 20)} AS v20, {roll('max', 'h', 10)} AS hh, {roll('avg', 'c', 5)} AS m5 FROM rs), x2 AS (SELECT *, {roll('avg', 'm5', 3)} AS m53, {roll('stddev_samp', 'c', 10)} AS sd FROM x1), x3 AS (SELECT *, {crossed('m5', 'm20')} AS xo FROM x2)"""


@query(
    counts(
        {"a": "coalesce(c > m20, false) AND coalesce(rsi < 55, false)", "b": "xo AND coalesce(v > v20 * 1.1, false)", "d": f"NOT {true('c < m53')} AND coalesce(c <> hh, true)", "e": "coalesce(abs(c - o) / c > 0.3, false) OR coalesce(sd / c > 1.5, false)"},
        "x3",
        f"{rsi_ctes()}, {EXPR}",
    )
)
def expressions(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    texts = {"a": "close > sma(close, 20) and rsi(close, 14) < 55", "b": "crossover(sma(close, 5), sma(close, 20)) and volume > sma(volume, 20) * 1.1", "d": "not close < sma(sma(close, 5), 3) and close != highest(high, 10)", "e": "abs(close - open) / close > 0.3 or stdev(close, period=10) / close > 1.5"}
    made = {n: expression.evaluate(k, t) for n, t in texts.items()}
    return _count(k.df, **made)


# ------------------------------------------------------------ backtests
CROSS = {"logic": "AND", "conditions": [{"indicator": "ma_cross", "short": 20, "long": 60, "type": "golden"}]}
CURVE = f"""g1 AS (SELECT ticker, ts, c, CASE WHEN {true(f"{roll('avg', 'c', 20)} > {roll('avg', 'c', 60)}")} THEN 1 ELSE 0 END AS pos FROM bars),
 g2 AS (SELECT *, coalesce(lag(pos) OVER ({W}), 0) AS ex, coalesce(c / lag(c) OVER ({W}) - 1, 0) AS ret FROM g1),
 g3 AS (SELECT *, sum(ln(1 + ret * ex)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS le, coalesce(lag(ex) OVER ({W}), 0) AS ex1 FROM g2),
 g4 AS (SELECT *, max(le) OVER ({W} ROWS UNBOUNDED PRECEDING) AS top, exp(le - lag(le) OVER ({W})) - 1 AS day FROM g3)"""
TRADES = f"""t1 AS (SELECT *, sum(CASE WHEN ex = 1 AND ex1 = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS tr FROM g3),
 t2 AS (SELECT ticker, tr, min(ts) AS entry_date, max(ts) AS exit_date, arg_min(c, ts) AS entry_price, arg_max(c, ts) AS exit_price FROM t1 WHERE tr > 0 AND (ex = 1 OR ex1 = 1) GROUP BY 1, 2)"""


@query(
    f"""WITH {BARS}, {CURVE}, {TRADES}, m AS (SELECT ticker, round(arg_max(le, ts), 5) AS log_growth, round(min(exp(le - top) - 1) * 100, 4) AS mdd, round(CASE WHEN stddev_pop(day) > 0 THEN avg(day) / stddev_pop(day) * sqrt(252) ELSE 0 END, 5) AS sharpe FROM g4 GROUP BY ticker),
 n AS (SELECT ticker, round(avg(CASE WHEN exit_price > entry_price THEN 1.0 ELSE 0.0 END) * 100, 6) AS win_rate, round(avg(exit_date - entry_date), 6) AS avg_holding_days, count(*) AS trade_count FROM t2 GROUP BY ticker)
 SELECT m.ticker, log_growth, mdd, sharpe, coalesce(win_rate, 0) AS win_rate, coalesce(avg_holding_days, 0) AS avg_holding_days, coalesce(trade_count, 0) AS trade_count FROM m LEFT JOIN n USING (ticker)"""
)
def golden_cross(spark, sf):
    """The flagship: a golden-cross strategy on every ticker, with its metrics."""
    found = backtest.summarized(backtest.run(_bars(spark, sf), CROSS).curve, _r(F.max_by(F.when(F.col("sign") > 0, F.col("log_equity")), "ts"), 5).alias("log_growth"))
    return found.select("ticker", "log_growth", _r("mdd", 4).alias("mdd"), _r("sharpe", 5).alias("sharpe"), _r("win_rate").alias("win_rate"), _r("avg_holding_days").alias("avg_holding_days"), "trade_count")


@query(f"WITH {BARS}, {CURVE}, {TRADES} SELECT ticker, entry_date, exit_date, entry_price, exit_price, round((exit_price / entry_price - 1) * 100, 6) AS return_pct FROM t2")
def golden_cross_trades(spark, sf):
    b = backtest.run(_bars(spark, sf), CROSS)
    return b.trades.select("ticker", "entry_date", "exit_date", "entry_price", "exit_price", _r("return_pct").alias("return_pct"))


@query(
    f"""WITH {BARS}, s AS (SELECT ticker, ts, c, {true('c > ' + roll('avg', 'c', 5))} AS sig FROM bars), r AS (SELECT *, sum(CASE WHEN sig THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM s),
 p AS (SELECT *, CASE WHEN sig AND (row_number() OVER (PARTITION BY ticker, run ORDER BY ts) - CASE WHEN run > 0 THEN 1 ELSE 0 END) % 4 = 0 THEN 0 WHEN sig THEN 1 ELSE 0 END AS pos FROM r)
 SELECT ticker, CAST(sum(pos) AS BIGINT) AS bars_in, CAST(sum(CASE WHEN sig THEN 1 ELSE 0 END) AS BIGINT) AS bars_signalled FROM p GROUP BY ticker"""
)
def holding_cap(spark, sf):
    b = backtest.run(_bars(spark, sf), {"expression": "close > sma(close, 5)"}, max_holding_days=3)
    k = Kernels(_bars(spark, sf), LONGEST)
    name = expression.evaluate(k, "close > sma(close, 5)")
    sig = _count(k.df, bars_signalled=name)
    return b.curve.groupBy("ticker").agg(F.sum(F.col("position").cast("long")).alias("bars_in")).join(sig, "ticker").select("ticker", "bars_in", "bars_signalled")


@query(f"""WITH {BARS}, w AS (SELECT * FROM bars WHERE ts >= DATE '1996-01-01' AND ts < DATE '1998-01-01') SELECT ticker, min(ts) AS entry_date, max(ts) AS exit_date, arg_min(c, ts) AS entry_price, arg_max(c, ts) AS exit_price, round(ln(arg_max(c, ts) / arg_min(c, ts)), 6) AS log_growth FROM w GROUP BY ticker""")
def buy_and_hold(spark, sf):
    """Held from the second bar of the window, whose return is the first that counts."""
    b = backtest.buy_and_hold(_bars(spark, sf), dt.date(1996, 1, 1), dt.date(1998, 1, 1))
    ends = b.curve.groupBy("ticker").agg(F.min("ts").alias("entry_date"), F.max("ts").alias("exit_date"), F.min_by("close", "ts").alias("entry_price"), F.max_by("close", "ts").alias("exit_price"), _r(F.log(F.max_by("equity", "ts") / 100)).alias("log_growth"))
    return ends


STAGED = {
    "entry_stages": [{"weight": 0.3, "logic": "AND", "conditions": [{"indicator": "rsi", "op": "<", "value": 48}]}, {"weight": 0.7, "logic": "AND", "conditions": [{"indicator": "rsi", "op": "<", "value": 44}]}],
    "exit_stages": [{"logic": "AND", "conditions": [{"indicator": "rsi", "op": ">", "value": 52}]}, {"logic": "AND", "conditions": [{"indicator": "rsi", "op": ">", "value": 55}]}],
    "emergency_exit": {"logic": "AND", "conditions": [{"indicator": "level_break", "source": "lowest_low", "op": "break_below"}]},
    "stop_loss": {"source": "lowest_low", "period": 20},
    "take_profit": {"multiple": 2.0},
}


@query()
def staged_strategy(spark, sf):
    return backtest.run(_bars(spark, sf), STAGED).trades.select("ticker", "entry_date", "exit_date", _r("entry_price", 4).alias("entry_price"), _r("exit_price", 4).alias("exit_price"), _r("return_pct", 4).alias("return_pct"))


@query()
def combined_strategy(spark, sf):
    both = {"combine": "OR", "strategies": [CROSS, STAGED, {"expression": "crossover(close, sma(close, 20))"}]}
    found = backtest.run(_bars(spark, sf), both).metrics
    return found.select("ticker", _r(F.log10(F.col("cagr") + 101), 5).alias("size"), _r("mdd", 4).alias("mdd"), _r("sharpe", 5).alias("sharpe"), _r("win_rate").alias("win_rate"), _r("avg_holding_days").alias("avg_holding_days"), F.col("trade_count").cast("long").alias("trade_count"))


@query()
def benchmark_comparison(spark, sf):
    d = _bars(spark, sf)
    found = backtest.compared(d, CROSS, d.filter("ticker = 'Brand#1'"))
    return found.select("ticker", "leg", _r(F.log10(F.col("cagr") + 101), 5).alias("size"), _r("mdd", 4).alias("mdd"), _r("sharpe", 5).alias("sharpe"), _r("win_rate").alias("win_rate"), _r("avg_holding_days").alias("avg_holding_days"), F.col("trade_count").cast("long").alias("trade_count"))


@query(f"""WITH {BARS}, {CURVE}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS b FROM (SELECT *, lag(pos) OVER ({W}) AS before FROM g1)) SELECT ticker, ts AS as_of, (pos > coalesce(before, 0)) AS triggered, pos > 0 AS in_position FROM r WHERE b = 1""")
def latest_signal(spark, sf):
    return backtest.latest(_bars(spark, sf), CROSS)


@query(f"WITH {BARS}, {CURVE}, {TRADES} SELECT ticker, round(avg(CASE WHEN entry_date = exit_date THEN 1.0 ELSE 0.0 END), 6) AS same_day_share, count(*) AS trades FROM t2 GROUP BY ticker")
def strategy_health(spark, sf):
    return backtest.health(backtest.run(_bars(spark, sf), CROSS).trades).select("ticker", _r("same_day_share").alias("same_day_share"), "trades")


# ------------------------------------------------------------ regimes and cycles
DAILY = f"""dr AS (SELECT *, (c / max(c) {over(-251)} - 1) * 100 AS dd, {roll('avg', 'c', 200)} AS m200 FROM ax), dl AS (SELECT *, CASE WHEN m200 IS NULL THEN 'sideways' WHEN dd <= -20 THEN 'bear' WHEN adx < 20 THEN 'sideways' WHEN c > m200 THEN 'bull' ELSE 'bear' END AS regime FROM dr)"""


@query(
    f"""WITH {BARS}, {CURVE}, {ADX}, {DAILY}, lb AS (SELECT ts, regime FROM dl WHERE ticker = 'Brand#1'), j AS (SELECT g4.ticker, g4.ts, coalesce(day, 0) AS day, lb.regime AS own FROM g4 LEFT JOIN lb ON g4.ts = lb.ts), k AS (SELECT *, last_value(own IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS regime FROM j)
 SELECT ticker, regime, count(*) AS days, round(sum(ln(1 + day)), 4) AS log_growth FROM k WHERE regime IS NOT NULL GROUP BY 1, 2"""
)
def regime_breakdown(spark, sf):
    """The strategy of every ticker in each regime of a benchmark."""
    d = _bars(spark, sf)
    labels = regime.daily(d.filter("ticker = 'Brand#1'"))
    found = backtest.by_regime(backtest.run(d, CROSS).curve, labels)
    return found.select("ticker", "regime", "days", _r("log_return", 4).alias("log_growth"))


@query(f"WITH {BARS}, {ADX}, {DAILY} SELECT ticker, ts, round(dd, 6) AS drawdown, round(adx, 6) AS adx, regime FROM dl")
def daily_regime(spark, sf):
    return regime.daily(_bars(spark, sf)).select("ticker", "ts", _r("drawdown").alias("drawdown"), _r("adx").alias("adx"), "regime")


@query(
    f"""WITH {BARS}, s AS (SELECT ticker, ts, CASE WHEN {roll('avg', 'c', 60)} IS NULL THEN NULL WHEN c > {roll('avg', 'c', 60)} THEN 'above' ELSE 'below' END AS side FROM bars), r AS (SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY ticker, side ORDER BY ts) AS g FROM s WHERE side IS NOT NULL)
 SELECT ticker, side, min(ts) AS "start", max(ts) AS "end", count(*) AS bars FROM r GROUP BY ticker, side, g HAVING count(*) >= 4"""
)
def label_segments(spark, sf):
    k = Kernels(_bars(spark, sf), LONGEST)
    m = F.col(k.sma("close", 60))
    rows = k.df.withColumn("side", F.when(m.isNull(), None).when(F.col("close") > m, "above").otherwise("below"))
    return regime.segments(rows, "side", 4)


LASTROW = f"lr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM (SELECT *, {roll('avg', 'c', 200)} AS m200, {roll('avg', 'c', 50)} AS m50, (c / max(c) {over(-251)} - 1) * 100 AS dd, (c / {lagged('c', 21)} - 1) * 100 AS r1, (c / {lagged('c', 63)} - 1) * 100 AS r3 FROM bars))"
_WORD = "CASE WHEN {0} >= 5 THEN 'bull' WHEN {0} <= -5 THEN 'bear' WHEN {0} IS NOT NULL THEN 'neutral' END"


@query(f"""WITH {BARS}, {LASTROW} SELECT ticker, ts, CAST(CASE WHEN m200 IS NOT NULL THEN CASE WHEN c > m200 THEN 25 ELSE -25 END END AS DOUBLE) AS trend_position, CAST(CASE WHEN m200 IS NOT NULL THEN CASE WHEN m50 > m200 THEN 25 ELSE -25 END END AS DOUBLE) AS ma_cross,
 round(greatest(-25, least(0, dd / 20 * 25)), 6) AS drawdown, dd <= -20 AS bear_market, {_WORD.format('r1')} AS regime_1m, {_WORD.format('r3')} AS regime_3m FROM lr WHERE back = 1""")
def regime_scores(spark, sf):
    return regime.scores(_bars(spark, sf)).select("ticker", "ts", "trend_position", "ma_cross", _r("drawdown").alias("drawdown"), "bear_market", "regime_1m", "regime_3m")


@query(f"WITH {BARS}, {LASTROW}, b AS (SELECT count(*) AS n_total, count(m200) AS n_data_ok, CAST(coalesce(sum(CASE WHEN c > m200 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_above, 100.0 * avg(CASE WHEN m200 IS NULL THEN NULL WHEN c > m200 THEN 1 ELSE 0 END) AS pct FROM lr WHERE back = 1) SELECT n_total, n_data_ok, n_above, round(pct, 6) AS pct_above, round(greatest(-25, least(25, (pct - 50) * 1.25)), 6) AS score, pct >= 85 AS overheated FROM b")
def market_breadth(spark, sf):
    return regime.breadth(_bars(spark, sf)).select("n_total", "n_data_ok", "n_above", _r("pct_above").alias("pct_above"), _r("score").alias("score"), "overheated")


@query(
    f"""WITH {BARS}, {LASTROW}, b AS (SELECT greatest(-25, least(25, (100.0 * avg(CASE WHEN m200 IS NULL THEN NULL WHEN c > m200 THEN 1 ELSE 0 END) - 50) * 1.25)) AS breadth FROM lr WHERE back = 1),
 s AS (SELECT ticker, ts, CASE WHEN m200 IS NOT NULL THEN CASE WHEN c > m200 THEN 25 ELSE -25 END END AS tp, CASE WHEN m200 IS NOT NULL THEN CASE WHEN m50 > m200 THEN 25 ELSE -25 END END AS mc, greatest(-25, least(0, dd / 20 * 25)) AS d, breadth FROM lr, b WHERE back = 1 AND ticker = 'Brand#1'),
 t AS (SELECT *, coalesce(tp, 0) + coalesce(mc, 0) + coalesce(d, 0) + coalesce(breadth, 0) AS total FROM s), r AS (SELECT *, CASE WHEN total >= 35 THEN 'bull' WHEN total <= -35 THEN 'bear' ELSE 'neutral' END AS regime FROM t)
 SELECT ticker, ts, round(breadth, 6) AS breadth, round(total, 6) AS total_score, regime, CASE WHEN regime <> 'neutral' THEN regime WHEN total >= 0 THEN 'bull' ELSE 'bear' END AS trade_regime, regime = 'neutral' AS ambiguous FROM r"""
)
def regime_snapshot(spark, sf):
    d = _bars(spark, sf)
    found = regime.for_trading(regime.snapshot(d, d.filter("ticker = 'Brand#1'")))
    return found.select("ticker", "ts", _r("breadth").alias("breadth"), _r("total_score").alias("total_score"), "regime", "trade_regime", "ambiguous")


@query(
    """SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value < 15 THEN 10 WHEN value < 20 THEN 0 WHEN value < 25 THEN -10 WHEN value < 30 THEN -18 ELSE -25 END::DOUBLE AS vix_score,
 CASE WHEN value IS NULL THEN NULL WHEN value / 10 * 100 < 300 THEN 'calm' WHEN value / 10 * 100 < 500 THEN 'normal' WHEN value / 10 * 100 < 800 THEN 'uneasy' WHEN value / 10 * 100 < 1000 THEN 'stress' ELSE 'crisis' END AS credit_level,
 CASE WHEN value IS NULL THEN NULL WHEN value / 50 - 1 < 0 THEN -20 WHEN value / 50 - 1 < 0.5 THEN -5 ELSE 5 END::DOUBLE AS curve_score FROM events"""
)
def risk_signals(spark, sf):
    v = F.col("value")
    return _t(spark, sf, "events").select("event_id", regime.volatility_signal(v)["score"].alias("vix_score"), regime.credit_signal(v / 10)["level"].alias("credit_level"), regime.curve_signal(v / 50 - 1).alias("curve_score"))


EGG = f"""e1 AS (SELECT *, min(c) {over(-251)} AS lo, max(c) {over(-251)} AS hi, {roll('avg', 'v', 20)} / {roll('avg', 'v', 60)} AS vr, (c / {lagged('c', 20)} - 1) * 100 AS roc, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM bars), e2 AS (SELECT *, CASE WHEN hi = lo THEN 50 ELSE (c - lo) / (hi - lo) * 100 END AS pos FROM e1 WHERE back = 1)"""


@query(
    f"""WITH {BARS}, {EGG} SELECT ticker, ts, round(pos, 6) AS position_pct, round(vr, 6) AS volume_ratio, CASE WHEN roc IS NULL THEN NULL WHEN pos <= 30 THEN CASE WHEN roc > 0 THEN CASE WHEN coalesce(vr >= 1.2, false) THEN 'A2' ELSE 'A1' END ELSE CASE WHEN coalesce(vr >= 1.2, false) AND abs(roc) >= 15 THEN 'B3' ELSE 'A1' END END
 WHEN pos >= 70 THEN CASE WHEN roc > 0 THEN CASE WHEN coalesce(vr >= 1.2, false) THEN 'A3' ELSE 'A2' END ELSE CASE WHEN coalesce(vr >= 1.2, false) THEN 'B2' ELSE 'B1' END END ELSE CASE WHEN roc > 0 THEN 'A2' ELSE 'B2' END END AS phase FROM e2"""
)
def egg_cycle(spark, sf):
    return cycles.egg_phase(_bars(spark, sf)).select("ticker", "ts", _r("position_pct").alias("position_pct"), _r("volume_ratio").alias("volume_ratio"), "phase")


def _monthly(spark, sf):
    o = _t(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.last_day(F.col("o_orderdate")).alias("ts")).agg(F.avg("o_totalprice").alias("value"))


MONTHLY = "mo AS (SELECT o_orderpriority AS series, last_day(CAST(o_orderdate AS DATE)) AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
S = "PARTITION BY series ORDER BY ts"


@query(
    f"""WITH {MONTHLY}, g AS (SELECT series, ts, (value / lag(value, 4) OVER ({S}) - 1) * 100 AS value FROM mo), k AS (SELECT * FROM g WHERE value IS NOT NULL),
 q AS (SELECT *, avg(value) OVER ({S} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m, lag(value) OVER ({S}) AS b, row_number() OVER ({S}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM k)
 SELECT series, ts, round(value, 6) AS value, CASE WHEN value > m AND value > b THEN 'expansion' WHEN value > m THEN 'slowdown' WHEN value > b THEN 'recovery' ELSE 'contraction' END AS quadrant FROM q WHERE i >= greatest(8, n - 12)"""
)
def macro_quadrants(spark, sf):
    return cycles.quadrants(cycles.growth(_monthly(spark, sf))).withColumn("value", _r("value"))


@query(
    f"""WITH {MONTHLY}, a AS (SELECT series, ts, value / 10000 AS value FROM mo), b AS (SELECT *, CASE WHEN count(value) OVER ({S} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN avg(value) OVER ({S} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS m3 FROM a),
 c AS (SELECT *, CASE WHEN count(m3) OVER ({S} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) >= 12 THEN min(m3) OVER ({S} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END AS l12 FROM b)
 SELECT series, ts, round(m3 - l12, 6) AS gap, coalesce(m3 - l12 >= 0.5, false) AS triggered FROM c"""
)
def sahm_rule(spark, sf):
    return cycles.sahm(_monthly(spark, sf).withColumn("value", F.col("value") / 10000)).select("series", "ts", _r("gap").alias("gap"), "triggered")


@query(f"WITH {MONTHLY} SELECT series, round(arg_max(value, ts), 6) AS value, max(ts) AS ts FROM mo GROUP BY series")
def macro_cards(spark, sf):
    return cycles.indicator_cards(_monthly(spark, sf)).select("series", _r("value").alias("value"), "ts")


@query(f"""WITH {MONTHLY}, r AS (SELECT *, value / lag(value) OVER ({S}) - 1 AS x FROM mo) SELECT series, ts, round(CASE WHEN count(x) OVER ({S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_samp(x) OVER ({S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END * sqrt(252) * 100, 6) AS volatility FROM r""")
def fx_volatility(spark, sf):
    return cycles.fx_volatility(_monthly(spark, sf)).select("series", "ts", _r("volatility").alias("volatility"))


# ------------------------------------------------------------ cross-sections
def _stocks(spark, sf):
    """Fundamentals made of the brands' parts, with gaps."""
    p = _t(spark, sf, "part")
    rows = p.groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_type").alias("sector"), F.sum("p_retailprice").alias("market_cap"), F.avg("p_size").alias("per"), (F.avg("p_size") / 10).alias("pbr"), (F.stddev_pop("p_size") / 100).alias("g"), F.count("*").alias("n"))
    gap = F.pmod(F.col("n"), F.lit(5)) == 0
    return rows.withColumn("earnings_growth", F.when(~gap, F.col("g"))).withColumn("fcf", F.col("market_cap") / 20).withColumn("total_cash", F.col("per") * 10).withColumn("total_debt", F.when(~gap, F.col("pbr") * 50).otherwise(0.0)).withColumn("theme", F.col("sector")).drop("g")


STOCKS = """st AS (SELECT *, CASE WHEN n % 5 <> 0 THEN g END AS earnings_growth, market_cap / 20 AS fcf, per * 10 AS total_cash, CASE WHEN n % 5 <> 0 THEN pbr * 50 ELSE 0 END AS total_debt, sector AS theme FROM
 (SELECT p_brand AS ticker, min(p_type) AS sector, sum(p_retailprice) AS market_cap, avg(p_size) AS per, avg(p_size) / 10 AS pbr, stddev_pop(p_size) / 100 AS g, count(*) AS n FROM part GROUP BY 1))"""


def rank_sql(x: str, missing: str) -> str:
    """100 times the average rank's share over all rows."""
    order = f"{x} ASC NULLS {'FIRST' if missing == 'lowest' else 'LAST'}"
    return f"100.0 * (rank() OVER (ORDER BY {order}) + count(*) OVER (ORDER BY {order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2 / count(*) OVER ()"


@query(f"WITH {STOCKS} SELECT ticker, round({rank_sql('earnings_growth', 'lowest')}, 6) AS low, round({rank_sql('earnings_growth', 'highest')}, 6) AS high, round({rank_sql('sector', 'lowest')}, 6) AS tied FROM st")
def rank_scores(spark, sf):
    rows = _stocks(spark, sf)
    return rows.select("ticker", _r(ranking.rank_score("earnings_growth", "lowest")).alias("low"), _r(ranking.rank_score("earnings_growth", "highest")).alias("high"), _r(ranking.rank_score("sector", "lowest")).alias("tied"))


@query(
    f"""WITH {STOCKS}, q AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY market_cap DESC NULLS LAST, ticker) AS n_, quantile_cont(market_cap, 0.75) OVER (PARTITION BY theme) AS q75 FROM st), r AS (SELECT *, coalesce(market_cap < q75, false) AS small FROM q WHERE n_ > 1), p AS (SELECT *, bool_or(small) OVER (PARTITION BY theme) AS any_ FROM r),
 z AS (SELECT *, coalesce(earnings_growth, per) AS x FROM p WHERE small OR NOT any_), s AS (SELECT *, CASE WHEN count(x) OVER (PARTITION BY theme) = 0 THEN 50 ELSE 100.0 * (rank() OVER (PARTITION BY theme ORDER BY x ASC NULLS LAST) + count(*) OVER (PARTITION BY theme ORDER BY x ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2 / count(*) OVER (PARTITION BY theme) END AS score FROM z),
 t AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY score DESC, ticker) AS place FROM s)
 SELECT theme, ticker, 'leader' AS role, 1 AS place, CAST(NULL AS DOUBLE) AS score FROM q WHERE n_ = 1 UNION ALL SELECT theme, ticker, 'growth', CAST(place AS INTEGER), round(score, 6) FROM t WHERE place <= 3"""
)
def leaders_and_growth(spark, sf):
    return ranking.leaders_and_growth(_stocks(spark, sf)).withColumn("score", _r("score"))


def _themes(spark, sf):
    return _stocks(spark, sf).select("theme", "ticker")


STRENGTH = " + ".join(f"coalesce((c / {lagged('c', n)} - 1) * 100 * {w}, 0)" for n, w in ranking.STRENGTH)
STRENGTH_W = " + ".join(f"CASE WHEN {lagged('c', n)} IS NOT NULL THEN {w} ELSE 0 END" for n, w in ranking.STRENGTH)


@query(
    f"""WITH {BARS}, {STOCKS}, i AS (SELECT ticker AS tk, ts, c / first_value(c) OVER ({W}) * 100 AS c FROM bars), tb AS (SELECT theme AS ticker, i.ts, avg(c) AS c FROM i JOIN st ON i.tk = st.ticker GROUP BY 1, 2),
 f AS (SELECT *, CASE WHEN {STRENGTH_W} > 0 THEN ({STRENGTH}) / ({STRENGTH_W}) END AS factor, (c / {lagged('c', 63)} - 1) * 100 AS return_3m FROM tb), g AS (SELECT *, lag(factor, 20) OVER ({W}) AS before, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM f)
 SELECT ticker AS theme, ts, round(factor, 5) AS strength_factor, CASE WHEN factor - before > 1e-9 THEN 'up' WHEN factor - before < -1e-9 THEN 'down' WHEN factor - before IS NOT NULL THEN 'flat' END AS trend, round(return_3m, 5) AS return_3m, round({rank_sql('factor', 'lowest')}, 6) AS rs_score FROM g WHERE back = 1"""
)
def theme_strength(spark, sf):
    return ranking.theme_strength(_bars(spark, sf), _themes(spark, sf)).select("theme", "ts", _r("strength_factor", 5).alias("strength_factor"), "trend", _r("return_3m", 5).alias("return_3m"), _r("rs_score").alias("rs_score"))


@query()
def theme_phases(spark, sf):
    found = cycles.theme_phases(_bars(spark, sf), _themes(spark, sf))
    return found.select("theme", "ts", _r("position_pct", 4).alias("position_pct"), _r("volume_ratio").alias("volume_ratio"), _r("roc_20", 4).alias("roc_20"), "zone", "phase")


@query(
    f"""WITH {BARS}, b AS (SELECT x.ticker, x.ts, x.c, y.c AS bench FROM bars x JOIN bars y ON x.ts = y.ts AND y.ticker = 'Brand#1'), r AS (SELECT *, c / lag(c) OVER ({W}) - 1 AS x, bench / lag(bench) OVER ({W}) - 1 AS y, c / bench AS rs, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM b),
 l AS (SELECT *, lag(rs, 62) OVER ({W}) AS r62, lag(rs, 19) OVER ({W}) AS r19 FROM r),
 m AS (SELECT ticker, count(*) AS days, count(x) AS n, round(covar_samp(x, y) / var_samp(y), 6) AS beta, round(corr(x, y), 6) AS corr, round((max(CASE WHEN back = 1 THEN rs END) / max(CASE WHEN back = 1 THEN r62 END) - 1) * 100, 5) AS rs_change_3m FROM l GROUP BY ticker)
 SELECT ticker, days, CASE WHEN days >= 15 AND n >= 10 THEN beta END AS beta, CASE WHEN days >= 15 AND n >= 10 THEN corr END AS corr, CASE WHEN days >= 15 AND n >= 10 THEN rs_change_3m END AS rs_change_3m FROM m"""
)
def relationships(spark, sf):
    d = _bars(spark, sf)
    return ranking.relationship(d, d.filter("ticker = 'Brand#1'")).select("ticker", "days", _r("beta").alias("beta"), _r("corr").alias("corr"), _r("rs_change_3m", 5).alias("rs_change_3m"))


@query(
    f"""WITH {BARS}, {STOCKS}, mm AS (SELECT ticker, ts, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back, CASE WHEN {STRENGTH_W} > 0 THEN {STRENGTH} END AS mr FROM bars), j AS (SELECT st.*, mr, CASE WHEN market_cap > 0 THEN fcf / market_cap * 100 END AS flow, CASE WHEN total_debt > 0 THEN least(total_cash / total_debt, 10) WHEN total_debt = 0 THEN 10 END AS cov FROM st LEFT JOIN mm ON st.ticker = mm.ticker AND back = 1),
 k AS (SELECT *, (coalesce(flow, 0) + coalesce(cov, 0)) / ((flow IS NOT NULL)::INT + (cov IS NOT NULL)::INT) AS qr, CASE WHEN earnings_growth > 0 THEN (-per - pbr - per / (earnings_growth * 100)) / 3 ELSE (-per - pbr) / 2 END AS vr FROM j),
 s AS (SELECT ticker, 0.3 * {rank_sql('mr', 'lowest')} + 0.3 * {rank_sql('qr', 'lowest')} + 0.25 * {rank_sql('vr', 'lowest')} + 0.15 * {rank_sql('earnings_growth', 'lowest')} AS score FROM k) SELECT ticker, round(score, 6) AS score FROM s ORDER BY score DESC, ticker LIMIT 10"""
)
def discovery(spark, sf):
    return ranking.discover(_stocks(spark, sf), _bars(spark, sf), 10).select("ticker", _r("score").alias("score"))


@query(f"WITH {STOCKS} SELECT ticker, sector, round(per, 6) AS per FROM st WHERE per >= 24 AND per <= 26 AND market_cap >= 1000")
def screener(spark, sf):
    return ranking.screen(_stocks(spark, sf), {"min_per": 24, "max_per": 26, "min_market_cap": 1000}).select("ticker", "sector", _r("per").alias("per"))


@query(
    f"""WITH {BARS}, {STOCKS}, {rsi_ctes()}, la AS (SELECT ticker, rsi, (c / {roll('avg', 'c', 20)} - 1) * 100 AS pct, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM rs)
 SELECT st.ticker, round(rsi, 6) AS rsi, round(pct, 6) AS pct_from_sma FROM st JOIN la ON st.ticker = la.ticker AND back = 1 WHERE rsi >= 40 AND rsi <= 60"""
)
def screener_technical(spark, sf):
    return ranking.screen(_stocks(spark, sf), {"min_rsi": 40, "max_rsi": 60}, _bars(spark, sf)).select("ticker", _r("rsi").alias("rsi"), _r("pct_from_sma").alias("pct_from_sma"))


@query(
    f"""WITH {STOCKS}, cp AS (SELECT sector, sum(market_cap) AS cap FROM st GROUP BY 1), q AS (SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY cap DESC, sector) AS place FROM cp), z AS (SELECT sector, greatest(10 // k, 1) + CASE WHEN place <= greatest(10 - greatest(10 // k, 1) * k, 0) THEN 1 ELSE 0 END AS quota FROM q),
 r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY market_cap DESC NULLS LAST, ticker) AS n_ FROM st) SELECT ticker, r.sector FROM r JOIN z ON r.sector = z.sector WHERE n_ <= quota"""
)
def universe_sample(spark, sf):
    return ranking.sample_universe(_stocks(spark, sf), 10).select("ticker", "sector")


@query(f"""WITH {BARS}, {STOCKS}, b1 AS (SELECT *, c / max(c) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS dd, {roll('avg', 'c', 200)} AS m200, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY ticker) AS n FROM bars),
 bs AS (SELECT ticker, (arg_max(c, ts) / arg_min(c, ts) FILTER (back <= 126) - 1) * 100 AS momentum, CASE WHEN max(n) >= 210 THEN -abs(min(dd) * 100) END AS mdd, CASE WHEN max(n) >= 210 THEN avg(CASE WHEN m200 IS NULL THEN NULL WHEN c > m200 THEN 1.0 ELSE 0.0 END) * 100 END AS above FROM b1 GROUP BY ticker),
 j AS (SELECT st.*, momentum, mdd, above, coalesce(earnings_growth, per) AS gr, -(coalesce(per, 0) + coalesce(pbr, 0)) / nullif((per IS NOT NULL)::INT + (pbr IS NOT NULL)::INT, 0) AS va FROM st LEFT JOIN bs ON bs.ticker = st.ticker),
 s AS (SELECT ticker, round({rank_sql('momentum', 'highest')}, 1) AS leader, round({rank_sql('gr', 'highest')}, 1) AS growth, round({rank_sql('va', 'highest')}, 1) AS value, 0.0 AS cyclical, 0.0 AS defensive, round({rank_sql('mdd', 'highest')} * 0.5 + coalesce(above, 0) * 0.5, 1) AS quality FROM j)
 SELECT ticker, CASE greatest(leader, growth, value, cyclical, defensive, quality) WHEN leader THEN 'leader' WHEN growth THEN 'growth' WHEN value THEN 'value' WHEN cyclical THEN 'cyclical' WHEN defensive THEN 'defensive' ELSE 'quality' END AS style, leader, growth, value, CAST(cyclical AS DOUBLE) AS cyclical, CAST(defensive AS DOUBLE) AS defensive, quality FROM s""")
def style_scores(spark, sf):
    return ranking.style_scores(_stocks(spark, sf), _bars(spark, sf)).select("ticker", "style", *[F.col("style_scores")[s].alias(s) for s in ranking.STYLES])


GROWTH = "gr AS (SELECT ticker, (pow(arg_max(c, ts) / arg_min(c, ts), 365.25 / (max(ts) - min(ts))) - 1) * 100 AS cagr FROM bars GROUP BY ticker HAVING max(ts) > min(ts))"


@query(f"WITH {BARS}, {GROWTH}, r AS (SELECT *, ({rank_sql('cagr', 'lowest')}) / 100 AS s, count(*) OVER () AS n FROM gr) SELECT ticker, round(cagr, 6) AS cagr, CASE WHEN n < 3 THEN 'sideways' WHEN s > 2.0 / 3 THEN 'up' WHEN s <= 1.0 / 3 THEN 'down' ELSE 'sideways' END AS trend FROM r")
def trend_terciles(spark, sf):
    return ranking.trend_terciles(_bars(spark, sf)).select("ticker", _r("cagr").alias("cagr"), "trend")


@query(f"WITH {BARS}, {GROWTH} SELECT ticker, round(cagr, 6) AS cagr, CASE WHEN cagr >= 10 THEN 'up' WHEN cagr <= -10 THEN 'down' ELSE 'sideways' END AS trend FROM gr")
def trend_by_growth(spark, sf):
    return ranking.trend_by_growth(_bars(spark, sf)).select("ticker", _r("cagr").alias("cagr"), "trend")


# ------------------------------------------------------------ valuation and portfolio
@query(
    """WITH v AS (SELECT p_partkey, p_retailprice AS x, p_size AS s, p_retailprice / 15 AS eps, p_retailprice / 3 AS bvps FROM part)
 SELECT p_partkey, round(x * (SELECT sum(pow(1.08 / 1.1, i)) FROM range(1, 6) t(i)) + x * pow(1.08 / 1.1, 5) * 1.025 / 0.075, 4) AS dcf, round(s * 1.03 / 0.06, 6) AS ddm, round(eps * 12, 6) AS per_value, round(sqrt(22.5 * eps * bvps), 6) AS graham, round(CASE WHEN s - 25 > 0 THEN 15.0 / (s - 25) END, 6) AS peg, round((x * 8 - s) / 10, 6) AS ev FROM v"""
)
def valuation_methods(spark, sf):
    p = _t(spark, sf, "part").withColumn("eps", F.col("p_retailprice") / 15).withColumn("bvps", F.col("p_retailprice") / 3).withColumn("s", F.col("p_size").cast("double"))
    x, s = F.col("p_retailprice"), F.col("s")
    return p.select(
        "p_partkey", _r(portfolio.dcf(x, F.lit(1.0)), 4).alias("dcf"), _r(portfolio.ddm(s)).alias("ddm"), _r(portfolio.per_value(F.col("eps"), 12.0)).alias("per_value"), _r(portfolio.graham(F.col("eps"), F.col("bvps"))).alias("graham"), _r(portfolio.peg(15.0, s - 25)).alias("peg"), _r(portfolio.ev_ebitda_value(x, 8.0, s, 10.0)).alias("ev")
    )


def _holdings(spark, sf):
    line = _t(spark, sf, "lineitem")
    part = _t(spark, sf, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_suppkey").alias("portfolio"), F.col("p_brand").alias("ticker")).agg(F.sum("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("purchase_price"))


HOLD = "ho AS (SELECT l_suppkey AS portfolio, p_brand AS ticker, sum(l_quantity) AS quantity, avg(l_extendedprice) AS purchase_price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), lp AS (SELECT ticker, arg_max(c, ts) AS price FROM bars GROUP BY 1), va AS (SELECT *, quantity * price AS value, quantity * purchase_price AS cost FROM ho LEFT JOIN lp USING (ticker))"


@query(f"WITH {BARS}, {HOLD} SELECT portfolio, ticker, round(value, 4) AS value, round((value - cost) / cost * 100, 6) AS pnl_pct, round(value / sum(value) OVER (PARTITION BY portfolio) * 100, 6) AS weight FROM va")
def portfolio_pnl(spark, sf):
    out = portfolio.pnl(_holdings(spark, sf), B.latest_price(_bars(spark, sf)))
    return out.select("portfolio", "ticker", _r("value", 4).alias("value"), _r("pnl_pct").alias("pnl_pct"), _r("weight").alias("weight"))


@query(f"WITH {BARS}, {HOLD}, {STOCKS}, s AS (SELECT portfolio, coalesce(sector, 'other') AS sector, sum(value) AS value FROM va LEFT JOIN st USING (ticker) GROUP BY 1, 2) SELECT portfolio, sector, round(value / sum(value) OVER (PARTITION BY portfolio) * 100, 6) AS share FROM s")
def sector_concentration(spark, sf):
    valued = portfolio.pnl(_holdings(spark, sf), B.latest_price(_bars(spark, sf)))
    return portfolio.concentration(valued, _stocks(spark, sf)).select("portfolio", "sector", _r("share").alias("share"))


RET = f"rt AS (SELECT ticker, ts, c / lag(c) OVER ({W}) - 1 AS r FROM bars), dy AS (SELECT ts FROM rt WHERE r IS NOT NULL GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT ticker) FROM bars)), rr AS (SELECT * FROM rt JOIN dy USING (ts))"
KINDS = BARS.replace("p_brand AS ticker", "p_type AS ticker")


def _kinds(spark, sf):
    """Bars by part type: few tickers, so that on most days all of them have a return."""
    return B.daily_bars(spark, sf, "p_type")


@query(f"WITH {KINDS}, {RET} SELECT x.ticker AS a, y.ticker AS b, round(corr(x.r, y.r), 6) AS corr FROM rr x JOIN rr y ON x.ts = y.ts AND x.ticker <= y.ticker GROUP BY 1, 2")
def correlation_matrix(spark, sf):
    return portfolio.correlation_matrix(_kinds(spark, sf)).withColumn("corr", _r("corr"))


@query(f"WITH {KINDS}, {RET}, d AS (SELECT ts, sum(r * 0.25) AS r FROM rr GROUP BY ts) SELECT round(stddev_samp(r) * sqrt(252) * 100, 5) AS volatility FROM d")
def portfolio_volatility(spark, sf):
    bars = _kinds(spark, sf)
    weights = bars.select("ticker", F.lit(0.25).alias("weight")).distinct()
    return portfolio.volatility(portfolio.daily_returns(bars), weights).withColumn("volatility", _r("volatility", 5))


@query(
    f"""WITH {STOCKS}, f AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY ticker) AS n_ FROM st), p AS (SELECT a.ticker, b.ticker AS peer, abs(a.market_cap - b.market_cap) AS distance, row_number() OVER (PARTITION BY a.ticker ORDER BY b.n_) AS i FROM st a JOIN f b ON a.sector = b.sector AND a.ticker <> b.ticker AND b.n_ <= 21),
 q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY distance, peer) AS r FROM p WHERE i <= 20) SELECT ticker, peer, round(distance, 4) AS distance FROM q WHERE r <= 2"""
)
def auto_peers(spark, sf):
    return portfolio.peers(_stocks(spark, sf)).withColumn("distance", _r("distance", 4))


# ------------------------------------------------------------ holdings, texts, records
@query(
    """WITH h AS (SELECT 'S' || (l_suppkey % 5) AS g, CASE WHEN p_size > 3 THEN p_brand || '/' || p_type END AS ticker, l_quantity AS w FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT ticker, g, sum(w) AS w FROM h WHERE g IN ('S1', 'S2', 'S3') AND ticker IS NOT NULL GROUP BY 1, 2)
 SELECT ticker, round(sum(w), 4) AS total_weight FROM r GROUP BY ticker HAVING count(*) = 3"""
)
def common_holdings(spark, sf):
    line, part = _t(spark, sf, "lineitem"), _t(spark, sf, "part")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.concat(F.lit("S"), F.col("l_suppkey") % 5).alias("guru_name"), F.when(F.col("p_size") > 3, F.concat_ws("/", "p_brand", "p_type")).alias("ticker"), F.col("l_quantity").alias("weight_pct"))
    return holdings.common(rows, ["S1", "S2", "S3", "S1"]).withColumn("total_weight", _r("total_weight", 4))


@query("""WITH e AS (SELECT p_brand AS filing, upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS issuer_name, p_size AS shares, CAST(floor(p_retailprice) AS BIGINT) AS v FROM part), g AS (SELECT filing, issuer_name, CAST(sum(shares) AS BIGINT) AS shares, CAST(sum(v) * 1000 AS BIGINT) AS value FROM e GROUP BY 1, 2)
 SELECT filing, issuer_name, shares, value, round(CAST(value AS DOUBLE) / sum(value) OVER (PARTITION BY filing) * 100, 4) AS weight_pct FROM g""")
def filing_holdings(spark, sf):
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("filing"), F.col("p_name").alias("issuer_name"), F.col("p_size").alias("shares"), F.floor("p_retailprice").alias("value_thousands"))
    return holdings.from_filing(rows)


#: Tickers and first characters of a text, as in holdings.summaries.
TICKERS = """list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F\\p{P}\\p{S}\\p{Z}]', 'a', 'g'), '\\$?\\b[A-Z]{1,5}\\b'), lambda t: replace(t, '$', '')), lambda t: NOT list_contains(['""" + "','".join(holdings.NOT_TICKERS) + "'], t))))"
LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SNIPPET = f"CASE WHEN length({LINE}) > 200 THEN substring({LINE}, 1, 200) || '...' ELSE {LINE} END"


@query(f"SELECT doc_id, coalesce({TICKERS}, []) AS tickers, coalesce({SNIPPET}, '') AS snippet FROM documents")
def tickers_in_text(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", "text")
    return holdings.summaries(rows).select("doc_id", "tickers", "snippet")


def _posts(spark, sf):
    rows = _t(spark, sf, "conversations")
    at = F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") * 60)
    return holdings.summaries(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", at.alias("created_at")))


@query(f"""WITH p AS (SELECT conv_id * 1000 + turn AS id, make_timestamp((conv_id * 3600 + turn * 60) * 1000000) AS t_, {TICKERS} AS tickers, {SNIPPET} AS snippet FROM conversations), e AS (SELECT max(t_) AS e FROM p),
 r AS (SELECT unnest(tickers) AS ticker, t_, id, snippet, e FROM p, e WHERE t_ > e - INTERVAL 7 DAY), n AS (SELECT *, (row_number() OVER (PARTITION BY ticker ORDER BY t_, id) - 1) // 100 AS part, min(t_) OVER (PARTITION BY ticker) AS a, count(*) OVER (PARTITION BY ticker) AS n FROM r)
 SELECT ticker, CAST(part AS INTEGER) AS part, min(a) AS period_start, max(e) AS period_end, max(n) AS post_count, string_agg('- ' || strftime(t_, '%Y-%m-%d') || ': ' || snippet, chr(10) ORDER BY t_, id) AS report_text FROM n GROUP BY ticker, part""")
def weekly_digest(spark, sf):
    return holdings.weekly_digest(_posts(spark, sf), most=100).withColumn("period_start", F.col("period_start").cast("timestamp_ntz")).withColumn("period_end", F.col("period_end").cast("timestamp_ntz"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), t AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS date, list_sort(list_distinct(list(o_orderpriority || (o_orderkey % 3)))) AS tickers FROM orders WHERE o_orderdate >= DATE '1994-01-01' GROUP BY 1)
 SELECT day, CAST(len(coalesce((SELECT arg_max(tickers, date) FROM t WHERE date <= day), (SELECT arg_min(tickers, date) FROM t))) AS BIGINT) AS members FROM d""")
def members_as_of(spark, sf):
    o = _t(spark, sf, "orders")
    lists = o.filter(F.col("o_orderdate") >= F.lit("1994-01-01")).groupBy(F.date_trunc("quarter", "o_orderdate").cast("date").alias("date")).agg(F.array_sort(F.collect_set(F.concat("o_orderpriority", F.col("o_orderkey") % 3))).alias("tickers"))
    days = o.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return holdings.members_as_of(lists, days).select("day", F.size("tickers").cast("long").alias("members"))


@query("""WITH s AS (SELECT c_custkey AS id, c_mktsegment AS name FROM customer), w AS (SELECT o_orderkey AS id, o_orderpriority AS ticker, o_custkey % 100 AS strategy_id FROM orders) SELECT ticker, name AS strategy_name, count(*) AS items FROM w LEFT JOIN s ON strategy_id = s.id GROUP BY 1, 2""")
def watchlist_strategies(spark, sf):
    strategies = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    items = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("ticker"), (F.col("o_custkey") % 100).alias("strategy_id"), F.col("o_orderdate").alias("added_at"))
    return records.watched(items, strategies).groupBy("ticker", "strategy_name").agg(F.count("*").alias("items"))


@query("""WITH k AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders), n AS (SELECT o_orderkey AS id, -o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') SELECT id, v FROM k WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, v FROM n""")
def records_upsert(spark, sf):
    o = _t(spark, sf, "orders")
    known = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    new = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), (-F.col("o_totalprice")).alias("v"))
    return records.upsert(known, new, ["id"])


# ------------------------------------------------------------ search
RSI_PAIR = {"logic": "OR", "conditions": [{"indicator": "rsi", "op": "<", "value": 45, "period": 14}, {"indicator": "ma_cross", "short": 10, "long": 30}]}


@query()
def walk_forward_search(spark, sf):
    _, found, _ = tuning.tune_group(_bars(spark, sf), RSI_PAIR, dt.date(1995, 1, 1), dt.date(2001, 12, 1), "growth", "fast", 3)
    return found.select("candidate", _r("mean_sharpe", 5).alias("mean_sharpe"), _r("std_sharpe", 5).alias("std_sharpe"), F.col("folds").cast("long").alias("folds"), _r("score", 5).alias("score"), "place")


@query()
def era_validation(spark, sf):
    eras = [(str(y), f"{y}-01-01", f"{y + 1}-01-01") for y in range(1995, 2002)]
    found = tuning.era_validation(_bars(spark, sf), CROSS, eras)
    return found.select("era", _r("mean_excess_return", 2).alias("mean_excess_return"), _r("win_ratio").alias("win_ratio"), "n_tickers", _r("robustness").alias("robustness"))


@query(f"WITH {BARS}, {ADX}, {DAILY}, l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM dl) SELECT ticker, ts, regime, CASE regime WHEN 'bull' THEN 1 WHEN 'bear' THEN 2 END AS strategy_id FROM l WHERE back = 1")
def live_strategy(spark, sf):
    """The strategy for each ticker's present regime; none for a sideways market."""
    return tuning.live_strategy(regime.daily(_bars(spark, sf)), {"bull": 1, "bear": 2})


SWITCH = {"expression": tuning.regime_switched("close < lowest(low, 5) * 1.5", 30, 10)}


@query(
    f"""WITH {BARS}, s AS (SELECT ticker, ts, {true('c > ' + roll('avg', 'c', 30))} AND {true('c >= ' + roll('max', 'c', 10))} OR {true('c <= ' + roll('avg', 'c', 30))} AND {true('c < ' + roll('min', 'l', 5) + ' * 1.5')} AS held FROM bars)
 SELECT ticker, CAST(sum(CASE WHEN held THEN 1 ELSE 0 END) AS BIGINT) AS bars_in, CAST(sum(CASE WHEN held THEN (ts - DATE '1970-01-01') * (ts - DATE '1970-01-01') ELSE 0 END) AS BIGINT) AS bars_in_days FROM s GROUP BY ticker"""
)
def regime_switch(spark, sf):
    """An expression that follows breakouts in uptrends and another rule else."""
    k = Kernels(_bars(spark, sf), LONGEST)
    held = expression.evaluate(k, SWITCH["expression"])
    return _count(k.df, bars_in=held).select("ticker", "bars_in", "bars_in_days")


def _results(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select(F.concat(F.lit("T"), F.col("o_custkey") % 40).alias("ticker"), F.col("o_orderstatus").alias("strategy"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("date").alias("run_created_at"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 1000).alias("excess_return"))


RESULTS = "re AS (SELECT 'T' || (o_custkey % 40) AS ticker, o_orderstatus AS strategy, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS run_created_at, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1000 END AS excess_return FROM orders)"


@query(f"WITH {RESULTS} SELECT ticker, run_id, excess_return FROM re WHERE excess_return IS NOT NULL ORDER BY excess_return DESC, run_id LIMIT 50")
def leaderboard(spark, sf):
    rows = _results(spark, sf)
    return tuning.leaderboard(rows.filter("strategy = 'F'"), rows.filter("strategy <> 'F' or excess_return > 100")).select("ticker", "run_id", "excess_return")


@query(f"""WITH {RESULTS}, o AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY excess_return DESC, ticker) AS own FROM re WHERE excess_return IS NOT NULL), p AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN own > 2 THEN 1 ELSE 0 END, excess_return DESC, strategy, ticker) AS n FROM o)
 SELECT strategy, ticker, excess_return, CAST(row_number() OVER (ORDER BY excess_return DESC, strategy, ticker) AS INTEGER) AS place FROM p WHERE n <= 10""")
def two_phase_selection(spark, sf):
    return tuning.two_phase_best(_results(spark, sf)).select("strategy", "ticker", "excess_return", "place")


# ------------------------------------------------------------ strategy texts
INTAKE_TEXT = """CASE p_type WHEN 'ECONOMY' THEN 'RSI 과매수 ' WHEN 'LARGE' THEN 'RSI, Macd and Ichimoku ' WHEN 'MEDIUM' THEN 'GOLDEN or Dead Cross ' WHEN 'PROMO' THEN '볼린저 Upper, 과매도 과매수 '
 ELSE p_name END || CASE p_size % 4 WHEN 0 THEN '골든크로스' WHEN 1 THEN 'Bollinger' WHEN 2 THEN '' END"""


INTAKE_SQL = f"""WITH t AS (SELECT p_partkey, lower(coalesce({INTAKE_TEXT}, '')) AS x FROM part), f AS (SELECT p_partkey,
 regexp_matches(x, '1:2:6|1대2대6|1대 2대 6|일목균형표|이치모쿠|단계별|분할매매|분할 매매|스퀴즈|밴드폭|밴드 너비|퍼센트비|%b|다이버전스|쌍바닥|쌍봉|마루보즈|핀바|도지|인사이드바|관통형|흑운형|모닝스타|이브닝스타|적삼병|흑삼병|삼법형') OR (x LIKE '%rsi%' AND x LIKE '%macd%' AND x LIKE '%ichimoku%') AS st,
 regexp_matches(x, '골든크로스|golden|이동평균|ma cross') AS g, regexp_matches(x, '데드크로스|dead cross') AS d, x LIKE '%과매수%' AND x NOT LIKE '%과매도%' AS ob, x LIKE '%과매도%' OR x LIKE '%rsi%' AND x NOT LIKE '%과매수%' AS os,
 regexp_matches(x, '볼린저|bollinger') AND regexp_matches(x, '상단|upper') AS up, regexp_matches(x, '볼린저|bollinger') AND NOT regexp_matches(x, '상단|upper') AS lo FROM t),
 n AS (SELECT *, concat_ws('+', CASE WHEN g THEN '골든크로스' END, CASE WHEN d THEN '데드크로스' END, CASE WHEN ob THEN 'RSI 과매수' END, CASE WHEN os THEN 'RSI 눌림목' END, CASE WHEN up THEN '볼린저 상단 돌파' END, CASE WHEN lo THEN '볼린저 하단 이탈' END) AS name,
 concat_ws(', ', CASE WHEN g THEN '{{"indicator": "ma_cross", "short": 20, "long": 60, "ma_type": "sma", "type": "golden"}}' END, CASE WHEN d THEN '{{"indicator": "ma_cross", "short": 20, "long": 60, "ma_type": "sma", "type": "dead"}}' END,
  CASE WHEN ob THEN '{{"indicator": "rsi", "period": 14, "op": ">", "value": 70}}' END, CASE WHEN os THEN '{{"indicator": "rsi", "period": 14, "op": "<", "value": 30}}' END,
  CASE WHEN up THEN '{{"indicator": "bollinger", "period": 20, "std_dev": 2.0, "band": "upper", "op": "break_above"}}' END, CASE WHEN lo THEN '{{"indicator": "bollinger", "period": 20, "std_dev": 2.0, "band": "lower", "op": "break_below"}}' END) AS body FROM f)
 SELECT p_partkey, CASE WHEN st THEN 'staged' ELSE 'regime' END AS kind, CASE WHEN st THEN '1:2:6 단계별 매매법(RSI+MACD+일목균형표)' WHEN name = '' THEN '후보' ELSE name END AS name,
 CASE WHEN st THEN '{{"entry_stages": [{{"weight": 0.1, "logic": "AND", "conditions": [{{"indicator": "rsi_cross", "period": 14, "level": 30, "direction": "up"}}]}}, {{"weight": 0.2, "logic": "AND", "conditions": [{{"indicator": "macd_cross", "direction": "golden", "zone": "below_zero"}}, {{"indicator": "rsi", "period": 14, "op": ">", "value": 30}}]}}, {{"weight": 0.6, "logic": "AND", "conditions": [{{"indicator": "ichimoku_tk_state", "direction": "golden"}}, {{"indicator": "ichimoku_cloud_break", "direction": "up"}}, {{"indicator": "ichimoku_chikou_state", "direction": "up"}}]}}], "exit_stages": [{{"weight": 0.1, "logic": "AND", "conditions": [{{"indicator": "macd_cross", "direction": "dead", "zone": "any"}}]}}, {{"weight": 0.2, "logic": "AND", "conditions": [{{"indicator": "rsi_cross", "period": 14, "level": 50, "direction": "down"}}]}}, {{"weight": 0.6, "logic": "AND", "conditions": [{{"indicator": "ichimoku_cloud_break", "direction": "down"}}]}}], "emergency_exit": {{"logic": "AND", "conditions": [{{"indicator": "macd_cross", "direction": "dead", "zone": "any"}}, {{"indicator": "rsi_cross", "period": 14, "level": 50, "direction": "down"}}]}}}}'
 ELSE '{{"logic": "AND", "conditions": [' || CASE WHEN body = '' THEN '{{"indicator": "ma_cross", "short": 20, "long": 60, "ma_type": "sma", "type": "golden"}}' ELSE body END || ']}}' END AS config FROM n"""


@query(INTAKE_SQL)
def strategy_intake(spark, sf):
    """Texts with words of strategies, some of them null, read as configs."""
    rows = _t(spark, sf, "part").select("p_partkey", F.expr(INTAKE_TEXT).alias("text"))
    return intake.interpreted(rows).drop("text")


TRIM = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+|[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+$', '', 'g')"


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex({TRIM.format("replace(text, '. ', chr(10) || ' ----' || chr(10))")}, '(?m)^[ \t]*-{{3,}}[ \t]*$'), lambda x: {TRIM.format("x")}), lambda x: x <> '') AS parts FROM documents)
 SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS place, unnest(parts) AS script FROM p""")
def strategy_scripts(spark, sf):
    """Whole texts whose sentences lie between lines of dashes, as scripts."""
    rows = _t(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\. ", "\n ----\n").alias("text"))
    return rows.select("doc_id", F.posexplode(intake.scripts("text")).alias("place", "script"))


@query("""WITH n AS (SELECT DISTINCT o_custkey AS n FROM orders), a AS (SELECT 1 AS n UNION SELECT n + 1 FROM n) SELECT '후보' || min(n) AS name FROM a WHERE n NOT IN (SELECT n FROM n)""")
def candidate_name(spark, sf):
    """The first candidate name that no customer with orders has taken."""
    return intake.free_name(_t(spark, sf, "orders").select(F.concat(F.lit(intake.CANDIDATE), F.col("o_custkey")).alias("name")))


@query(
    f"""WITH {BARS}, {CURVE}, {TRADES}, n AS (SELECT ticker, count(*) AS trades FROM t2 GROUP BY ticker),
 y AS (SELECT ticker, arg_max(le, ts) AS le, (max(ts) - min(ts)) / 365.25 AS years, arg_max(c, ts) / arg_min(c, ts) AS held FROM g3 GROUP BY ticker),
 x AS (SELECT ticker, (exp(le / years) - 1) * 100 - (SELECT (pow(held, 1 / years) - 1) * 100 FROM y WHERE ticker = 'Brand#1') AS excess FROM y)
 SELECT CAST(sum(trades) AS BIGINT) AS total_trades, round(log10(avg(round(excess, 2))), 5) AS log_excess, sum(trades) >= 3 AND avg(excess) IS NOT NULL AS passed FROM x LEFT JOIN n USING (ticker)"""
)
def strategy_sanity(spark, sf):
    """Whether the golden cross trades at all, and its mean excess over holding one brand, as a logarithm."""
    d = _bars(spark, sf)
    found = tuning.sanity(tuning.cross_validated(backtest.compared(d, CROSS, d.filter("ticker = 'Brand#1'"))))
    return found.select("total_trades", _r(F.log10("avg_excess_return"), 5).alias("log_excess"), "passed")
