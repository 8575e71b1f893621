"""Registered queries of searches over many groups and of strategies chosen by row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.indicators import Kernels
from ..functions.windows import is_true
from ..operators import batch, regime
from .queries import ADX, BARS, CHANGES, CROSS, DAILY, EGG, SQL, STOCKS, W, _bars, _r, _t, ewm, over, query, roll, rsi_ctes, true

START, END = dt.date(1995, 1, 1), dt.date(2001, 12, 1)  # around all line items
PAIR = {"logic": "AND", "conditions": [{"indicator": "ma_cross", "short": 10, "long": 30}]}


def _labelled(bars):
    """(ts, regime) of one brand: bull while its 20-bar average is above its 60-bar one."""
    k = Kernels(bars.filter("ticker = 'Brand#1'"))
    up = is_true(F.col(k.sma("close", 20)) > F.col(k.sma("close", 60)))
    return k.df.select("ts", F.when(up, "bull").otherwise("bear").alias("regime"))


def _size(x):
    """A growth rate in % on a scale on which engines agree however large it is."""
    return _r(F.log10(F.col(x) + 101), 5)


LABELS = f"lb AS (SELECT ts, CASE WHEN {true(roll('avg', 'c', 20) + ' > ' + roll('avg', 'c', 60))} THEN 'bull' ELSE 'bear' END AS regime FROM bars WHERE ticker = 'Brand#1')"


def spans_sql(source: str) -> str:
    """Segments of at least 10 bars of (part, ts, regime)."""
    return f"""(SELECT part, regime, min(ts) AS lo, max(ts) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ts) - row_number() OVER (PARTITION BY part, regime ORDER BY ts) AS g FROM {source}) GROUP BY part, regime, g HAVING count(*) >= 10)"""


def curves_sql(source: str, keys: str) -> str:
    """Per key: rows, growth as a logarithm, years, trades and Sharpe ratio of (keys, ts, c, pos)."""
    by = f"OVER (PARTITION BY {keys} ORDER BY ts)"
    upto = f"OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return f"""(SELECT {keys}, count(*) AS n, arg_max(le, ts) AS le, greatest((max(ts) - min(ts)) / 365.25, 1e-9) AS years, CAST(sum(CASE WHEN ex = 1 AND ex1 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS trades,
 CASE WHEN count(*) >= 2 AND stddev_pop(day) > 0 THEN avg(day) / stddev_pop(day) * sqrt(252) ELSE 0 END AS sharpe
 FROM (SELECT *, exp(le - lag(le) {by}) - 1 AS day, coalesce(lag(ex) {by}, 0) AS ex1 FROM (SELECT *, sum(ln(1 + ret * ex)) {upto} AS le FROM
 (SELECT *, coalesce(lag(pos) {by}, 0) AS ex, coalesce(c / lag(c) {by} - 1, 0) AS ret FROM {source}))) GROUP BY {keys})"""


RATE = "CASE WHEN n >= 2 THEN (exp({0} / years) - 1) * 100 WHEN n IS NOT NULL THEN 0 END"

# ------------------------------------------------------------ many groups at once
NUMBERS = (3, 8, 9, 10, 15, 20, 24, 25, 30, 45, 60, 75)
BATCH_SQL = f"""WITH {BARS}, {LABELS}, d AS (SELECT DATE '1995-01-01' AS a, DATE '1995-01-01' + 1894 AS cut, DATE '2001-12-01' AS z),
 lp AS (SELECT 'train' AS part, ts, regime FROM lb, d WHERE ts >= a AND ts <= cut UNION ALL SELECT 'test', ts, regime FROM lb, d WHERE ts > cut AND ts <= z), sp AS {spans_sql('lp')},
 fo AS (SELECT regime, lo, hi FROM sp WHERE part = 'train'), te AS (SELECT regime, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY hi - lo DESC, lo) AS r FROM sp WHERE part = 'test') WHERE r = 1),
 gr AS (SELECT DISTINCT p_brand AS ticker, CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 0 THEN 'leader' WHEN 1 THEN 'growth' ELSE 'value' END AS style FROM part UNION ALL SELECT n_name, 'quality' FROM nation),
 st(style, lo, hi) AS (VALUES ('leader', 0.3, 0.8), ('growth', 0.8, 2.0), ('value', 0.8, 1.5), ('quality', 1.0, 2.5)),
 va AS (SELECT DISTINCT style, v, unnest([greatest(2, round(v * lo)), v, greatest(greatest(2, round(v * lo)) + 1, round(v * hi))]) AS x FROM st, (VALUES (10), (30)) q(v)),
 ca AS (SELECT s.style, CAST(s.x AS INT) AS s, CAST(l.x AS INT) AS l, row_number() OVER (PARTITION BY s.style ORDER BY s.x, l.x) - 1 AS nth FROM va s JOIN va l ON s.style = l.style AND s.v = 10 AND l.v = 30),
 bt AS (SELECT 'a|' || ticker AS ticker, ts, c FROM bars, d WHERE ts < cut + 1 UNION ALL SELECT 'z|' || ticker, ts, c FROM bars, d WHERE ts >= cut + 1 - 400 AND ts < z + 1),
 ma AS (SELECT ticker, ts, c, {', '.join(f"{roll('avg', 'c', n)} AS m{n}" for n in NUMBERS)} FROM bt),
 lo AS (SELECT ticker, ts, n, m FROM ma UNPIVOT INCLUDE NULLS (m FOR n IN ({', '.join(f'm{n}' for n in NUMBERS)}))),
 ps AS (SELECT substr(b.ticker, 1, 1) AS part, g.ticker, g.style, k.nth, b.ts, b.c, CASE WHEN x.m > y.m THEN 1 ELSE 0 END AS pos FROM ma b JOIN gr g ON substr(b.ticker, 3) = g.ticker JOIN ca k ON g.style = k.style
  JOIN lo x ON x.ticker = b.ticker AND x.ts = b.ts AND x.n = 'm' || k.s JOIN lo y ON y.ticker = b.ticker AND y.ts = b.ts AND y.n = 'm' || k.l),
 tr AS (SELECT ticker, style, nth, regime, lo AS fold, ts, c, pos FROM ps JOIN fo ON ts >= lo AND ts < hi WHERE part = 'a'), sc AS {curves_sql('tr', 'ticker, style, nth, regime, fold')},
 gn AS (SELECT style, greatest(1, ceil(count(*) / 2.0)) AS need FROM gr GROUP BY style), fn AS (SELECT regime, greatest(1, ceil(count(*) / 2.0)) AS need FROM fo GROUP BY regime),
 f0 AS (SELECT style, nth, regime, fold, avg(sharpe) AS s, count(*) AS m FROM sc WHERE trades >= 5 GROUP BY style, nth, regime, fold), fs AS (SELECT f0.* FROM f0 JOIN gn ON gn.style = f0.style WHERE m >= need),
 r0 AS (SELECT style, nth, regime, avg(s) - 0.5 * stddev_pop(s) AS score, count(*) AS m FROM fs GROUP BY style, nth, regime), rk AS (SELECT r0.* FROM r0 JOIN fn ON fn.regime = r0.regime WHERE m >= need),
 be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY style, regime ORDER BY round(score, 3) DESC, nth) AS r FROM rk) WHERE r = 1),
 ch AS (SELECT o.style, w.regime, coalesce(b.nth, o.nth) AS nth, b.score, w.regime NOT IN (SELECT regime FROM fo) AS insufficient FROM (SELECT style, nth FROM ca WHERE s = 10 AND l = 30) o CROSS JOIN (VALUES ('bear'), ('bull')) w(regime) LEFT JOIN be b ON b.style = o.style AND b.regime = w.regime),
 tt AS (SELECT p.ticker, p.style, c.regime, p.ts, p.c, p.pos FROM ps p JOIN ch c ON p.style = c.style AND p.nth = c.nth JOIN te ON te.regime = c.regime AND p.ts >= te.lo AND p.ts < te.hi WHERE part = 'z'), ow AS {curves_sql('tt', 'ticker, style, regime')},
 bb AS (SELECT te.regime, b.ts, b.c, 1 AS pos FROM bars b JOIN te ON b.ts >= te.lo AND b.ts < te.hi WHERE b.ticker = 'Brand#1'), hb AS {curves_sql('bb', 'regime')}
 SELECT g.ticker, g.style, c.regime, CAST(c.nth AS INT) AS candidate, '{{"logic": "AND", "conditions": [{{"indicator": "ma_cross", "short": ' || k.s || ', "long": ' || k.l || '}}]}}' AS config, round(c.score, 4) AS score, c.insufficient, te.lo AS test_start, te.hi AS test_end,
 round(log10({RATE.format('ow.le').replace(' n ', ' ow.n ').replace('years', 'ow.years')} + 101), 5) AS own, round(log10({RATE.format('hb.le').replace(' n ', ' hb.n ').replace('years', 'hb.years')} + 101), 5) AS held,
 CASE WHEN te.lo IS NULL THEN 'the test window has no such regime' WHEN ow.n IS NULL THEN 'no bars in the test segment' END AS reason
 FROM gr g JOIN ch c ON g.style = c.style JOIN ca k ON k.style = c.style AND k.nth = c.nth LEFT JOIN te ON te.regime = c.regime LEFT JOIN ow ON ow.ticker = g.ticker AND ow.regime = c.regime LEFT JOIN hb ON hb.regime = c.regime"""


@query(BATCH_SQL)
def batch_tuning(spark, sf):
    """Every brand's style group and, as tickers without bars, nations: each group searched for each regime at once."""
    d = _bars(spark, sf)
    kind = F.substring("p_brand", 7, 9).cast("int") % 3
    brands = _t(spark, sf, "part").select(F.col("p_brand").alias("ticker"), F.when(kind == 0, "leader").when(kind == 1, "growth").otherwise("value").alias("style")).distinct()
    groups = brands.unionByName(_t(spark, sf, "nation").select(F.col("n_name").alias("ticker"), F.lit("quality").alias("style")))
    found = batch.tuned_groups(d, groups, PAIR, _labelled(d), d.filter("ticker = 'Brand#1'"), START, END)
    return found.select("ticker", "style", "regime", "candidate", "config", _r("score", 4).alias("score"), "insufficient", "test_start", "test_end", _size("cagr").alias("own"), _size("benchmark_cagr").alias("held"), "reason")


@query(f"""WITH {BARS}, {LABELS}, lp AS (SELECT 'test' AS part, ts, regime FROM lb), te AS (SELECT regime, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY hi - lo DESC, lo) AS r FROM {spans_sql('lp')}) WHERE r = 1),
 ps AS (SELECT ticker, ts, c, CASE WHEN {true(roll('avg', 'c', 10) + ' > ' + roll('avg', 'c', 30))} THEN 1 ELSE 0 END AS pos FROM bars), tt AS (SELECT ticker, regime, ts, c, pos FROM ps JOIN te ON ts >= lo AND ts < hi), ow AS {curves_sql('tt', 'ticker, regime')},
 bb AS (SELECT regime, ts, c, 1 AS pos FROM bars JOIN te ON ts >= lo AND ts < hi WHERE ticker = 'Brand#1'), hb AS {curves_sql('bb', 'regime')}
 SELECT a.ticker, w.regime, te.lo AS "start", te.hi AS "end", round(log10({RATE.format('ow.le').replace(' n ', ' ow.n ').replace('years', 'ow.years')} + 101), 5) AS own, round(log10({RATE.format('hb.le').replace(' n ', ' hb.n ').replace('years', 'hb.years')} + 101), 5) AS held
 FROM (SELECT DISTINCT ticker FROM bars) a CROSS JOIN (VALUES ('bear'), ('bull'), ('sideways')) w(regime) LEFT JOIN te ON te.regime = w.regime LEFT JOIN ow ON ow.ticker = a.ticker AND ow.regime = w.regime LEFT JOIN hb ON hb.regime = w.regime""")
def regime_matched_test(spark, sf):
    """A strategy on the longest segment of each regime; no bar is ever sideways here."""
    d = _bars(spark, sf)
    found = batch.regime_matched_test(d, PAIR, _labelled(d), d.filter("ticker = 'Brand#1'"), START, END, ("bear", "bull", "sideways"))
    return found.select("ticker", "regime", "start", "end", _size("cagr").alias("own"), _size("benchmark_cagr").alias("held"))


# ------------------------------------------------------------ strategies by row
def _library(spark, sf):
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit('{"expression": "close > '), "c_nationkey", F.lit('"}')).alias("config"))


LIBRARY = "li AS (SELECT c_custkey AS id, c_name AS name, '{\"expression\": \"close > ' || c_nationkey || '\"}' AS config FROM customer)"


@query(f"""WITH {BARS}, {LIBRARY}, e AS (SELECT max(ts) AS z FROM bars), r AS (SELECT ticker, (pow(arg_max(c, ts) / arg_min(c, ts), 365.25 / (max(ts) - min(ts))) - 1) * 100 AS cagr FROM bars, e WHERE ts >= z - 182 AND ts < z GROUP BY ticker HAVING max(ts) > min(ts)),
 t AS (SELECT a.ticker, cagr, CASE WHEN cagr >= 10 THEN 'up' WHEN cagr <= -10 THEN 'down' WHEN cagr IS NOT NULL THEN 'sideways' END AS trend FROM (SELECT DISTINCT ticker FROM bars UNION SELECT n_name FROM nation) a LEFT JOIN r USING (ticker))
 SELECT ticker, round(log10(cagr + 101), 5) AS size, trend, CAST(li.id AS INT) AS strategy_id, li.name AS strategy_name, li.config FROM t LEFT JOIN li ON li.id = CASE trend WHEN 'up' THEN 1 WHEN 'down' THEN 2 WHEN 'sideways' THEN -5 END""")
def trend_strategy(spark, sf):
    """Each ticker's strategy by its own half year before the last day; tickers without bars, and a trend whose strategy is gone, have none."""
    d = _bars(spark, sf)
    end = d.agg(F.max("ts")).first()[0] or END
    tickers = d.select("ticker").unionByName(_t(spark, sf, "nation").select(F.col("n_name").alias("ticker")))
    found = batch.trend_choice(d, {"up": 1, "down": 2, "sideways": -5}, _library(spark, sf), end, tickers)
    return found.select("ticker", _size("cagr").alias("size"), "trend", "strategy_id", "strategy_name", "config")


@query(f"""WITH {BARS}, {ADX}, {DAILY}, {LIBRARY}, l AS (SELECT ticker, ts, regime FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM dl) WHERE back = 1),
 a AS (SELECT DISTINCT ticker FROM bars UNION SELECT n_name FROM nation)
 SELECT ticker, ts, regime, CAST(li.id AS INT) AS strategy_id, li.name AS strategy_name, li.config, CASE WHEN ts IS NULL THEN 'no bars' END AS reason FROM a LEFT JOIN l USING (ticker) LEFT JOIN li ON li.id = CASE regime WHEN 'bull' THEN 1 WHEN 'bear' THEN 2 WHEN 'sideways' THEN -5 END""")
def live_choice(spark, sf):
    """The strategy, with its name and config, for the present regime of each benchmark."""
    d = _bars(spark, sf)
    benchmarks = d.select("ticker").unionByName(_t(spark, sf, "nation").select(F.col("n_name").alias("ticker")))
    return batch.live_choice(regime.daily(d), {"bull": 1, "bear": 2, "sideways": -5}, _library(spark, sf), benchmarks)


@query(f"""WITH {BARS}, ps AS (SELECT ticker, ts, c, CASE CAST(substr(ticker, 7) AS INT) % 4 WHEN 0 THEN CASE WHEN {true(roll('avg', 'c', 20) + ' > ' + roll('avg', 'c', 60))} THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN {true('c > ' + roll('avg', 'c', 20))} THEN 1 ELSE 0 END ELSE 0 END AS pos FROM bars),
 o AS {curves_sql('ps', 'ticker')} SELECT ticker, trades AS trade_count, round(log10({RATE.format('le')} + 101), 5) AS size, round(sharpe, 5) AS sharpe FROM o""")
def own_strategies(spark, sf):
    """A backtest in which each brand follows the strategy that a table names for it; half of the brands have none that exists."""
    d = _bars(spark, sf)
    kind = F.substring("ticker", 7, 9).cast("int") % 4
    choice = d.select("ticker").distinct().select("ticker", F.when(kind == 0, 11).when(kind == 1, 22).when(kind == 2, 33).alias("strategy_id"))
    found = batch.own_strategies(d, choice, {11: CROSS, 22: {"expression": "close > sma(close, 20)"}}, START, END)
    return found.select("ticker", F.col("trade_count").cast("long").alias("trade_count"), _size("cagr").alias("size"), _r("sharpe", 5).alias("sharpe"))


# ------------------------------------------------------------ SQL of searches and comparisons registered elsewhere
HELD_SQL = f"""lg AS (SELECT ticker, 'strategy' AS leg, ts, c, CASE WHEN {true(roll('avg', 'c', 20) + ' > ' + roll('avg', 'c', 60))} THEN 1 ELSE 0 END AS pos FROM bars UNION ALL SELECT ticker, 'ticker', ts, c, 1 FROM bars UNION ALL SELECT ticker, 'benchmark', ts, c, 1 FROM bars WHERE ticker = 'Brand#1')"""
BY_LEG = "PARTITION BY ticker, leg ORDER BY ts"
SQL["benchmark_comparison"] = f"""WITH {BARS}, {HELD_SQL}, a AS (SELECT *, coalesce(lag(pos) OVER ({BY_LEG}), 0) AS ex, coalesce(c / lag(c) OVER ({BY_LEG}) - 1, 0) AS ret FROM lg),
 b AS (SELECT *, sum(ln(1 + ret * ex)) OVER ({BY_LEG} ROWS UNBOUNDED PRECEDING) AS le, coalesce(lag(ex) OVER ({BY_LEG}), 0) AS ex1 FROM a),
 m AS (SELECT *, max(le) OVER ({BY_LEG} ROWS UNBOUNDED PRECEDING) AS top, sum(CASE WHEN ex = 1 AND ex1 = 0 THEN 1 ELSE 0 END) OVER ({BY_LEG} ROWS UNBOUNDED PRECEDING) AS tr FROM b),
 d AS (SELECT ticker, leg, min(exp(le - top) - 1) * 100 AS mdd FROM m GROUP BY ticker, leg), t AS (SELECT ticker, leg, tr, max(ts) - min(ts) AS days, arg_max(c, ts) > arg_min(c, ts) AS won FROM m WHERE tr > 0 AND (ex = 1 OR ex1 = 1) GROUP BY ticker, leg, tr),
 n AS (SELECT ticker, leg, avg(CASE WHEN won THEN 100.0 ELSE 0 END) AS win_rate, avg(days) AS days, count(*) AS trades FROM t GROUP BY ticker, leg), o AS {curves_sql('lg', 'ticker, leg')}
 SELECT o.ticker, o.leg, round(log10({RATE.format('le').replace(' n ', ' o.n ')} + 101), 5) AS size, round(d.mdd, 4) AS mdd, round(sharpe, 5) AS sharpe, round(coalesce(win_rate, 0), 6) AS win_rate, round(coalesce(days, 0), 6) AS avg_holding_days, CAST(coalesce(n.trades, 0) AS BIGINT) AS trade_count
 FROM o JOIN d ON o.ticker = d.ticker AND o.leg = d.leg LEFT JOIN n ON n.ticker = o.ticker AND n.leg = o.leg"""

#: The candidates that the search draws with its fixed seed: level and period of the RSI, short and long average.
DRAWN = """(0, 55, 11, 8, 60), (1, 45, 11, 8, 24), (2, 55, 11, 20, 60), (3, 55, 11, 20, 30), (4, 35, 11, 8, 24), (5, 35, 28, 20, 24), (6, 55, 28, 10, 24), (7, 45, 28, 10, 24), (8, 35, 28, 10, 30), (9, 45, 11, 8, 30), (10, 35, 11, 10, 24),
 (11, 45, 14, 20, 30), (12, 35, 28, 10, 60), (13, 35, 14, 8, 60), (14, 45, 28, 20, 30), (15, 55, 11, 20, 24), (16, 35, 28, 8, 30), (17, 35, 11, 8, 30), (18, 35, 14, 10, 24), (19, 55, 14, 20, 60), (20, 45, 14, 10, 30)"""
RSIS = CHANGES.replace("FROM bars", "FROM wb") + "".join(
    f", ru{n} AS ({ewm(source, 'up', 1 / n, n, f'au{n}')}), rd{n} AS ({ewm(f'ru{n}', 'dn', 1 / n, n, f'ad{n}')}), rs{n} AS (SELECT *, CASE WHEN ad{n} = 0 THEN 100.0 ELSE 100 - 100 / (1 + au{n} / ad{n}) END AS rsi{n} FROM rd{n})" for n, source in ((11, "ch"), (14, "rs11"), (28, "rs14"))
)
SQL["walk_forward_search"] = f"""WITH {BARS}, wb AS (SELECT * FROM bars WHERE ts < DATE '1995-01-01' + 1894), {RSIS}, ma AS (SELECT ticker, ts, c, rsi11, rsi14, rsi28, {', '.join(f"{roll('avg', 'c', n)} AS m{n}" for n in (8, 10, 20, 24, 30, 60))} FROM rs28),
 ca(candidate, level, period, s, l) AS (VALUES {DRAWN}), fo(fold, lo, hi) AS (SELECT i, DATE '1995-01-01' + i * 631, CASE WHEN i = 2 THEN DATE '1995-01-01' + 1894 ELSE DATE '1995-01-01' + ((i + 1) * 631 - 1) END FROM (VALUES (0), (1), (2)) q(i)),
 ps AS (SELECT ticker, candidate, fold, ts, c, CASE WHEN coalesce(CASE period WHEN 11 THEN rsi11 WHEN 14 THEN rsi14 ELSE rsi28 END < level, false)
   OR coalesce(CASE s WHEN 8 THEN m8 WHEN 10 THEN m10 ELSE m20 END > CASE l WHEN 24 THEN m24 WHEN 30 THEN m30 ELSE m60 END, false) THEN 1 ELSE 0 END AS pos FROM ma JOIN fo ON ts >= lo AND ts < hi CROSS JOIN ca),
 sc AS {curves_sql('ps', 'ticker, candidate, fold')}, f0 AS (SELECT candidate, fold, avg(sharpe) AS s, count(*) AS m FROM sc WHERE trades >= 5 GROUP BY candidate, fold), nt AS (SELECT greatest(1, ceil(count(DISTINCT ticker) / 2.0)) AS need FROM bars),
 fs AS (SELECT f0.* FROM f0, nt WHERE m >= need), rk AS (SELECT candidate, avg(s) AS mean_sharpe, stddev_pop(s) AS std_sharpe, count(*) AS folds FROM fs GROUP BY candidate HAVING count(*) >= 2)
 SELECT CAST(candidate AS INTEGER) AS candidate, round(mean_sharpe, 5) AS mean_sharpe, round(std_sharpe, 5) AS std_sharpe, folds, round(mean_sharpe - 0.5 * std_sharpe, 5) AS score, CAST(row_number() OVER (ORDER BY round(mean_sharpe - 0.5 * std_sharpe, 3) DESC, candidate) AS INTEGER) AS place FROM rk"""

SQL["era_validation"] = f"""WITH {BARS}, wb AS (SELECT *, CASE WHEN {true(roll('avg', 'c', 20) + ' > ' + roll('avg', 'c', 60))} THEN 1 ELSE 0 END AS p0 FROM bars),
 ps AS (SELECT ticker, CAST(year(ts) AS VARCHAR) AS era, which, ts, c, CASE WHEN which = 0 THEN p0 ELSE 1 END AS pos FROM wb, (VALUES (0), (1)) q(which)), o AS {curves_sql('ps', 'ticker, era, which')},
 x AS (SELECT a.era, {RATE.format('a.le').replace(' n ', ' a.n ').replace('years', 'a.years')} - {RATE.format('b.le').replace(' n ', ' b.n ').replace('years', 'b.years')} AS excess FROM o a JOIN o b ON a.ticker = b.ticker AND a.era = b.era WHERE a.which = 0 AND b.which = 1),
 g AS (SELECT era, avg(excess) AS e, avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0.0 END) AS w, count(*) AS n_tickers FROM x GROUP BY era)
 SELECT era, round(e, 2) AS mean_excess_return, round(w, 6) AS win_ratio, n_tickers, round((SELECT count(*) FROM g WHERE e > 0) / 7.0, 6) AS robustness FROM g"""

SQL["theme_phases"] = f"""WITH {BARS}, {STOCKS}, i AS (SELECT ticker AS tk, ts, v, c / first_value(c) OVER ({W}) * 100 AS c FROM bars), tb AS (SELECT theme AS ticker, i.ts, avg(c) AS c, sum(v) AS v FROM i JOIN st ON i.tk = st.ticker GROUP BY 1, 2), {EGG.replace('FROM bars', 'FROM tb')}
 SELECT ticker AS theme, ts, round(pos, 4) AS position_pct, round(vr, 6) AS volume_ratio, round(roc, 4) AS roc_20, CASE WHEN pos <= 30 THEN 'low' WHEN pos >= 70 THEN 'high' ELSE 'mid' END AS zone,
 CASE WHEN roc IS NULL THEN NULL WHEN pos <= 30 THEN CASE WHEN roc > 0 THEN CASE WHEN coalesce(vr >= 1.2, false) THEN 'A2' ELSE 'A1' END ELSE CASE WHEN coalesce(vr >= 1.2, false) AND abs(roc) >= 15 THEN 'B3' ELSE 'A1' END END
  WHEN pos >= 70 THEN CASE WHEN roc > 0 THEN CASE WHEN coalesce(vr >= 1.2, false) THEN 'A3' ELSE 'A2' END ELSE CASE WHEN coalesce(vr >= 1.2, false) THEN 'B2' ELSE 'B1' END END ELSE CASE WHEN roc > 0 THEN 'A2' ELSE 'B2' END END AS phase FROM e2"""


#: The staged strategy bar by bar (its second entry implies its first): n1 and n2 say which stages are open after a bar, o and
#: q what the bar opened and closed, cy the cycle; a cycle's stop and target are those of its first bar.
MACHINE = f"""{rsi_ctes()}, s0 AS (SELECT ticker, ts, c, rsi, {roll('min', 'l', 20)} AS lv, row_number() OVER ({W}) AS rn, lead(c) OVER ({W}) AS after FROM rs),
 sg AS (SELECT ticker, ts, c, rn, lv, coalesce(after, c) AS fill, coalesce(rsi < 48, false) AS e1, coalesce(rsi < 44, false) AS e2, coalesce(rsi > 52, false) AS x1, coalesce(rsi > 55, false) AS x2, coalesce(c < lag(lv) OVER ({W}), false) AS em FROM s0),
 mc AS (SELECT ticker, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS cy, false AS n1, false AS n2, CAST(NULL AS DOUBLE) AS stop, CAST(NULL AS DOUBLE) AS target, false AS o1, false AS o2, false AS q1, false AS q2 FROM sg WHERE rn = 1
  UNION ALL SELECT ticker, rn, cy, p1 AND NOT ends AND NOT own, p2 AND NOT ends, stop, target, o1, o2, p1 AND (own OR ends), p2 AND ends FROM (SELECT *, p1 AND x1 AND NOT ends AS own FROM (
   SELECT *, (p1 OR p2) AND (em OR x2 OR coalesce(c >= target, false) OR coalesce(c < stop, false)) AS ends FROM (
    SELECT s.ticker, s.rn, s.c, s.em, s.x1, s.x2, m.cy + CASE WHEN NOT (m.n1 OR m.n2) AND s.e1 THEN 1 ELSE 0 END AS cy, CASE WHEN m.n1 OR m.n2 THEN m.stop ELSE s.lv END AS stop, CASE WHEN m.n1 OR m.n2 THEN m.target ELSE s.c + 2 * (s.c - s.lv) END AS target,
     s.e1 AND NOT (m.n1 OR m.n2) AS o1, s.e2 AND NOT m.n2 AS o2, m.n1 OR (s.e1 AND NOT m.n2) AS p1, m.n2 OR s.e2 AS p2
    FROM mc m JOIN sg s ON s.ticker = m.ticker AND s.rn = m.rn + 1))))"""
SQL["staged_strategy"] = f"""WITH RECURSIVE {BARS}, {MACHINE}, ev AS (SELECT m.ticker, m.cy, s.ts, s.fill, CASE WHEN o1 THEN 0.3 ELSE 0 END + CASE WHEN o2 THEN 0.7 ELSE 0 END AS wo, CASE WHEN q1 THEN 0.3 ELSE 0 END + CASE WHEN q2 THEN 0.7 ELSE 0 END AS wc FROM mc m JOIN sg s ON s.ticker = m.ticker AND s.rn = m.rn WHERE o1 OR o2 OR q1 OR q2),
 z AS (SELECT ticker, max(ts) AS last_ts, arg_max(c, ts) AS last_c FROM sg GROUP BY ticker),
 t AS (SELECT ticker, cy, min(CASE WHEN wo > 0 THEN ts END) AS entry_date, max(ts) AS last_event, abs(sum(wo) - sum(wc)) < 1e-9 AS closed, sum(wo * fill) / sum(wo) AS entry_price, sum(wc * fill) / nullif(sum(wc), 0) AS out_price FROM ev GROUP BY ticker, cy)
 SELECT t.ticker, entry_date, CASE WHEN closed THEN last_event ELSE last_ts END AS exit_date, round(entry_price, 4) AS entry_price, round(CASE WHEN closed THEN out_price ELSE last_c END, 4) AS exit_price, round((CASE WHEN closed THEN out_price ELSE last_c END / entry_price - 1) * 100, 4) AS return_pct FROM t JOIN z ON z.ticker = t.ticker"""

SQL["combined_strategy"] = f"""WITH RECURSIVE {BARS}, {MACHINE}, cr AS (SELECT ticker, rn, c, ts, coalesce(c > m20, false) AS ov, coalesce(m20 > m60, false) AS gc FROM (SELECT ticker, ts, c, rn, {roll('avg', 'c', 20)} AS m20, {roll('avg', 'c', 60)} AS m60 FROM sg)),
 xo AS (SELECT *, ov AND NOT coalesce(lag(ov) OVER ({W}), false) AS xover FROM cr), lg AS (SELECT x.ticker, x.ts, x.c, CASE WHEN gc OR xover OR n1 OR n2 THEN 1 ELSE 0 END AS pos FROM xo x JOIN mc m ON m.ticker = x.ticker AND m.rn = x.rn),
 a AS (SELECT *, coalesce(lag(pos) OVER ({W}), 0) AS ex, coalesce(c / lag(c) OVER ({W}) - 1, 0) AS ret FROM lg), b AS (SELECT *, sum(ln(1 + ret * ex)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS le, coalesce(lag(ex) OVER ({W}), 0) AS ex1 FROM a),
 m AS (SELECT *, max(le) OVER ({W} ROWS UNBOUNDED PRECEDING) AS top, sum(CASE WHEN ex = 1 AND ex1 = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS tr FROM b), d AS (SELECT ticker, min(exp(le - top) - 1) * 100 AS mdd FROM m GROUP BY ticker),
 t AS (SELECT ticker, tr, max(ts) - min(ts) AS days, arg_max(c, ts) > arg_min(c, ts) AS won FROM m WHERE tr > 0 AND (ex = 1 OR ex1 = 1) GROUP BY ticker, tr), n AS (SELECT ticker, avg(CASE WHEN won THEN 100.0 ELSE 0 END) AS win_rate, avg(days) AS days, count(*) AS trades FROM t GROUP BY ticker), o AS {curves_sql('lg', 'ticker')}
 SELECT o.ticker, round(log10({RATE.format('le').replace(' n ', ' o.n ')} + 101), 5) AS size, round(d.mdd, 4) AS mdd, round(sharpe, 5) AS sharpe, round(coalesce(win_rate, 0), 6) AS win_rate, round(coalesce(days, 0), 6) AS avg_holding_days, CAST(coalesce(n.trades, 0) AS BIGINT) AS trade_count
 FROM o JOIN d ON o.ticker = d.ticker LEFT JOIN n ON n.ticker = o.ticker"""


def reversal_sql(name: str, pivot: str, fits: str, fires: str) -> str:
    """CTEs of a two-pivot reversal's events: a pair arms five bars after its second pivot, for 40 bars."""
    return f"""{name}p AS (SELECT *, lag(rn) OVER w AS rn0, lag(l) OVER w AS l0, lag(h) OVER w AS h0, lag(lo) OVER w AS lo0, lag(up) OVER w AS up0, lag(rsi) OVER w AS rsi0 FROM q2 WHERE {pivot} WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
 {name}e AS (SELECT p.ticker, p.rn, min(f.rn) AS hit FROM {name}p p JOIN q2 f ON f.ticker = p.ticker AND f.rn >= p.rn + 5 AND f.rn <= p.rn + 45 WHERE p.rn - p.rn0 <= 40 AND {fits} AND f.{fires} GROUP BY p.ticker, p.rn), {name} AS (SELECT DISTINCT ticker, hit FROM {name}e)"""


REVERSALS = {
    "double_bullish": reversal_sql("db", "pl", "p.l0 < p.lo0 AND p.l >= p.lo", "xu AND f.loud"), "double_bearish": reversal_sql("dr", "ph", "p.h0 > p.up0 AND p.h <= p.up", "xd AND f.loud"),
    "divergence_bullish": reversal_sql("vb", "pl", "p.l < p.l0 AND p.rsi > p.rsi0", "xu"), "divergence_bearish": reversal_sql("vr", "ph", "p.h > p.h0 AND p.rsi < p.rsi0", "xd"),
}
SQL["conditions_sequential"] = f"""WITH {BARS}, {rsi_ctes()}, q0 AS (SELECT ticker, ts, c, l, h, v, rsi, row_number() OVER ({W}) AS rn, {roll('avg', 'c', 20)} AS m, {roll('stddev_pop', 'c', 20)} AS sd, {roll('avg', 'v', 20)} AS mv,
  coalesce(count(l) {over(-5, 5)} = 11 AND l = min(l) {over(-5, 5)}, false) AS pl, coalesce(count(h) {over(-5, 5)} = 11 AND h = max(h) {over(-5, 5)}, false) AS ph FROM rs),
 q2 AS (SELECT *, m - 2 * sd AS lo, m + 2 * sd AS up, coalesce(v >= 1.5 * mv, false) AS loud, coalesce(c > m AND lag(c) OVER ({W}) <= lag(m) OVER ({W}), false) AS xu, coalesce(c < m AND lag(c) OVER ({W}) >= lag(m) OVER ({W}), false) AS xd FROM q0),
 {', '.join(REVERSALS.values())}, al AS ({' UNION ALL '.join(f"SELECT ticker, hit, '{n}' AS name FROM {sql.split()[0][:-1]}" for n, sql in REVERSALS.items())}),
 k AS (SELECT al.ticker, name, (q2.ts - DATE '1970-01-01') AS day FROM al JOIN q2 ON q2.ticker = al.ticker AND q2.rn = al.hit)
 SELECT a.ticker, {', '.join(f"CAST(count(CASE WHEN name = '{n}' THEN 1 END) AS BIGINT) AS {n}, CAST(coalesce(sum(CASE WHEN name = '{n}' THEN day * day END), 0) AS BIGINT) AS {n}_days" for n in REVERSALS)} FROM (SELECT DISTINCT ticker FROM bars) a LEFT JOIN k ON k.ticker = a.ticker GROUP BY a.ticker"""
