"""Searches over groups and strategies chosen by row, against one search or backtest at a time."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import backtest, batch, tuning

PAIR = {"conditions": [{"indicator": "ma_cross", "short": 3, "long": 8}]}
DAY = dt.timedelta(days=1)
FIRST = dt.date(2020, 1, 1)


def bar_rows(ticker, n, seed, first=FIRST):
    rng = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + rng.normal(0.0005, 0.02, n))
    return [(ticker, first + i * DAY, float(c), float(c) * 1.01, float(c) * 0.99, float(c), 1000.0) for i, c in enumerate(close)]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [r for i, t in enumerate("ABCDE") for r in bar_rows(t, 900, i)] + bar_rows("X", 900, 99)
    return spark.createDataFrame(rows, "ticker string, ts date, open double, high double, low double, close double, volume double").persist()


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(FIRST + i * DAY, "bull" if (i // 90) % 2 == 0 else "bear") for i in range(900)]
    return spark.createDataFrame(rows, "ts date, regime string")


def test_spans_are_clipped_and_the_longest_is_single(spark):
    labels = "u" * 5 + "d" * 30 + "u" * 12 + "d" * 40 + "u" * 9 + "d" * 40
    rows = [(FIRST + i * DAY, {"u": "bull", "d": "bear"}[c]) for i, c in enumerate(labels)]
    frame = spark.createDataFrame(rows, "ts date, regime string")
    found = batch.regime_spans(frame, {"a": (FIRST, FIRST + 40 * DAY), "b": (FIRST + 41 * DAY, FIRST + 200 * DAY)})
    at = lambda a, b: (FIRST + a * DAY, FIRST + b * DAY)
    assert {(r.part, r.regime, (r.start, r.end), r.bars) for r in found.collect()} == {("a", "bear", at(5, 34), 30), ("b", "bear", at(47, 86), 40), ("b", "bear", at(96, 135), 40)}
    assert {(r.part, r.regime, (r.start, r.end)) for r in batch.longest_span(found).collect()} == {("a", "bear", at(5, 34)), ("b", "bear", at(47, 86))}


def test_dispatch_is_one_backtest_a_ticker(spark, bars):
    staged = {"entry_stages": [{"weight": 1.0, "conditions": [{"indicator": "rsi", "op": "<", "value": 45}]}], "exit_stages": [{"conditions": [{"indicator": "rsi", "op": ">", "value": 55}]}]}
    library = {1: PAIR, 2: {"expression": "close > sma(close, 20)"}, 7: staged}
    choice = spark.createDataFrame([("A", 1), ("B", 2), ("C", 9), ("D", None), ("E", 7), ("nowhere", 1)], "ticker string, strategy_id int")
    start, end = FIRST + 300 * DAY, FIRST + 800 * DAY
    found = {r.ticker: r for r in batch.own_strategies(bars, choice, library, start, end).collect()}
    assert set(found) == set("ABCDE")
    for ticker, i in (("A", 1), ("B", 2)):
        own = backtest.run(bars.filter(F.col("ticker") == ticker), library[i], start, end).metrics.first()
        assert found[ticker].cagr == pytest.approx(own.cagr) and found[ticker].sharpe == pytest.approx(own.sharpe) and found[ticker].trade_count == own.trade_count
    own = backtest.run(bars.filter("ticker = 'E'"), staged, start, end).metrics.first()
    assert found["E"].cagr == pytest.approx(own.cagr)
    assert all(found[t].cagr == 0 and found[t].trade_count == 0 for t in "CD")
    assert batch.own_strategies(bars, choice, {}, start, end).filter("cagr <> 0").count() == 0


def test_groups_are_each_as_searched_alone(spark, bars, labelled):
    groups = spark.createDataFrame([("A", "leader"), ("B", "leader"), ("C", "growth"), ("D", "growth"), ("none", "value"), ("E", None)], "ticker string, style string")
    start, end = FIRST, FIRST + 899 * DAY
    bench = bars.filter("ticker = 'X'")
    rows = batch.tuned_groups(bars, groups, PAIR, labelled, bench, start, end).collect()
    assert len(rows) == 2 * 5 + 1 and {r.ticker for r in rows} == {*"ABCDE", "none"}
    (lonely,) = (r for r in rows if r.ticker == "E")
    assert lonely.reason == "no style" and lonely.config is None
    train, test = tuning.split(start, end)
    spans = batch.regime_spans(labelled, {"train": train, "test": test}).collect()
    for style, names in (("leader", "AB"), ("growth", "CD")):
        grid = tuning.grid(PAIR, style, "fast")
        own = bars.filter(F.col("ticker").isin(*names))
        for regime in batch.REGIMES:
            folds = [(s.start, s.end) for s in spans if s.part == "train" and s.regime == regime]
            ranked = tuning.walk_forward(tuning.evaluated(own, grid, folds), 2, len(folds)).orderBy("place").first()
            mine = [r for r in rows if r.style == style and r.regime == regime]
            best = ranked.candidate if ranked else grid.index(PAIR)
            assert {r.candidate for r in mine} == {best} and all(json.loads(r.config) == grid[best] for r in mine) and not any(r.insufficient for r in mine)
            assert all((r.score is None) == (ranked is None) and (ranked is None or r.score == pytest.approx(ranked.score)) for r in mine)
            a, b = max(((s.start, s.end) for s in spans if s.part == "test" and s.regime == regime), key=lambda s: (s[1] - s[0], -s[0].toordinal()))
            alone = {r.ticker: r.cagr for r in tuning.evaluated(own, [grid[best]], [(a, b)]).collect()}
            held = backtest.buy_and_hold(bench, a, b).metrics.first().cagr
            for r in mine:
                assert (r.test_start, r.test_end, r.reason) == (a, b, None) and r.cagr == pytest.approx(alone[r.ticker])
                assert r.excess_return == pytest.approx(round(alone[r.ticker] - held, 2))
    assert {(r.regime, r.reason) for r in rows if r.ticker == "none"} == {("bear", "no bars in the test segment"), ("bull", "no bars in the test segment")}


def test_groups_without_a_regime_keep_the_original(spark, bars, labelled):
    groups = spark.createDataFrame([("A", "leader")], "ticker string, style string")
    calm = labelled.withColumn("regime", F.lit("bull"))
    rows = {r.regime: r for r in batch.tuned_groups(bars, groups, PAIR, calm, bars.filter("ticker = 'X'"), FIRST, FIRST + 899 * DAY).collect()}
    assert rows["bear"].insufficient and rows["bear"].reason == "the test window has no such regime" and json.loads(rows["bear"].config) == PAIR and rows["bear"].cagr is None
    assert not rows["bull"].insufficient and rows["bull"].reason is None
    assert batch.tuned_groups(bars, groups.filter("false"), PAIR, calm, bars.filter("ticker = 'X'"), FIRST, FIRST + 899 * DAY).count() == 0
    found = batch.regime_matched_test(bars.filter("ticker = 'A'"), PAIR, calm, bars.filter("ticker = 'X'"), FIRST, FIRST + 400 * DAY).collect()
    assert {(r.regime, r.start, r.end is None, r.excess_return is None) for r in found} == {("bull", FIRST, False, False), ("bear", None, True, True)}


def test_choices_from_a_library(spark, bars):
    library = spark.createDataFrame([(1, "up one", "{}"), (2, "down one", "{}")], "id int, name string, config string")
    some = bars.filter("ticker in ('A', 'B', 'C')")
    as_of = FIRST + 899 * DAY
    asked = some.select("ticker").unionByName(spark.createDataFrame([("gone",)], "ticker string"))
    rows = {r.ticker: r for r in batch.trend_choice(some, {"up": 1, "down": 2, "sideways": 3}, library, as_of, asked).collect()}
    assert rows["gone"].trend is None and rows["gone"].strategy_id is None
    for t in "ABC":
        closes = [r.close for r in some.filter((F.col("ticker") == t) & (F.col("ts") >= as_of - 182 * DAY) & (F.col("ts") < as_of)).orderBy("ts").collect()]
        rate = ((closes[-1] / closes[0]) ** (365.25 / 181) - 1) * 100
        trend = "up" if rate >= 10 else "down" if rate <= -10 else "sideways"
        name = {"up": "up one", "down": "down one"}.get(trend)
        assert (rows[t].trend, rows[t].strategy_name) == (trend, name) and rows[t].strategy_id == {"up": 1, "down": 2}.get(trend)
    daily = spark.createDataFrame([("A", FIRST, "bear"), ("A", FIRST + DAY, "bull"), ("B", FIRST, "sideways")], "ticker string, ts date, regime string")
    live = {r.ticker: tuple(r)[2:] for r in batch.live_choice(daily, {"bull": 1, "sideways": 9}, library, asked).collect()}
    assert live == {"A": ("bull", 1, "up one", "{}", None), "B": ("sideways", None, None, None, None), "C": (None, None, None, None, "no bars"), "gone": (None, None, None, None, "no bars")}


def test_one_pass_has_the_figures_of_trades_and_curve(spark, bars):
    configs = [PAIR, {"expression": "close > sma(close, 20)"}, {"expression": "close > 0"}, {"expression": "close < 0"}]
    gaps = bars.filter("ticker in ('A', 'B')").withColumn("close", F.when(F.dayofyear("ts") % 37 != 0, F.col("close"))).unionByName(bars.filter(F.col("ts") == F.lit(FIRST)))
    for config in configs:
        for frame in (bars.filter("ticker <> 'X'"), gaps):
            curve = backtest.run(frame, config, FIRST + 100 * DAY, FIRST + 700 * DAY, max_holding_days=9 if config is PAIR else None).curve
            want = {r.ticker: r.asDict() for r in backtest.metrics(curve, backtest.trades_of(curve)).collect()}
            got = {r.ticker: r.asDict() for r in backtest.summarized(curve, F.count("*").alias("bars")).collect()}
            assert set(got) == set(want)
            for t, row in want.items():
                assert all(got[t][c] == pytest.approx(row[c], nan_ok=True) for c in row if c != "ticker"), (t, config)
    assert backtest.summarized(backtest.run(bars.filter("false"), PAIR).curve).count() == 0


def test_figures_of_curves_that_leave_a_doubles_range(spark):
    day = lambda i: FIRST + i * DAY
    swings = [100.0 if i % 2 else 1.0 for i in range(800)]  # held from each high to the next low: a factor of 0.01 every other bar
    rows = [("falls", day(i), c, float(i % 2)) for i, c in enumerate(swings)] + [("rises", day(i), c, float(i % 2 == 0)) for i, c in enumerate(swings)]
    rows += [("lost", day(i), c, 1.0) for i, c in enumerate([5.0, 4.0, 0.0, 3.0, 6.0])] + [("flat", day(i), 7.0, 0.0) for i in range(3)]
    curve = backtest.equity(spark.createDataFrame(rows, "ticker string, ts date, close double, position double").withColumns({"active": F.lit("in"), "inactive": F.lit("out")}))
    regimes = spark.createDataFrame([(day(i), "any") for i in range(800)], "ts date, regime string")
    logs = {r.ticker: r.log_return for r in backtest.by_regime(curve, regimes).collect()}
    for found in (backtest.summarized(curve), backtest.metrics(curve, backtest.trades_of(curve))):
        got = {r.ticker: r for r in found.collect()}
        for t, factor in (("falls", 0.01), ("rises", 100.0)):
            days = np.array([factor - 1, 0.0] * 400 if t == "rises" else [0.0, factor - 1] * 400)[:799]  # of the bars after the first
            log = np.log1p(days).sum()
            assert got[t].sharpe == pytest.approx(days.mean() / days.std() * np.sqrt(252))
            assert t == "rises" or got[t].cagr == pytest.approx((np.exp(log / (799 / 365.25)) - 1) * 100)
            assert logs[t] == pytest.approx(log)
        assert got["falls"].cumulative_return == got["falls"].mdd == pytest.approx(-100) and got["rises"].mdd == 0
        lost = np.array([-0.2, -1.0])  # after a total loss there is no change
        assert (got["lost"].cumulative_return, got["lost"].mdd, got["lost"].cagr) == (-100, -100, 0)
        assert got["lost"].sharpe == pytest.approx(lost.mean() / lost.std() * np.sqrt(252))
        assert (got["flat"].cumulative_return, got["flat"].mdd, got["flat"].cagr, got["flat"].sharpe) == (0, 0, 0, 0)


def test_comparison_in_one_pass_is_that_of_single_backtests(spark, bars):
    own = bars.filter("ticker in ('A', 'B', 'C')")
    start, end = FIRST + 200 * DAY, FIRST + 600 * DAY
    rows = {(r.leg, r.ticker): r for r in backtest.compared(own, PAIR, bars.filter("ticker = 'X'"), start, end).collect()}
    assert set(rows) == {("benchmark", "X"), *((leg, t) for leg in ("strategy", "ticker") for t in "ABC")}
    for leg, made in (("strategy", backtest.run(own, PAIR, start, end)), ("ticker", backtest.buy_and_hold(own, start, end))):
        for r in backtest.metrics(made.curve, made.trades).collect():
            found = rows[leg, r.ticker]
            assert (found.cagr, found.mdd, found.trade_count) == (pytest.approx(r.cagr), pytest.approx(r.mdd), r.trade_count)


def test_correlations_of_day_vectors(spark, bars):
    from barwright.operators import portfolio

    some = bars.filter("ticker in ('A', 'B', 'C')").filter("not (ticker = 'B' and dayofmonth(ts) = 7)")
    want = {(r.a, r.b): r["corr"] for r in portfolio.correlations(portfolio.daily_returns(some)).collect()}
    got = {(r.a, r.b): r["corr"] for r in portfolio.correlation_matrix(some).collect()}
    assert set(got) == set(want) == {("A", "A"), ("A", "B"), ("A", "C"), ("B", "B"), ("B", "C"), ("C", "C")} and all(got[k] == pytest.approx(want[k]) for k in want)
    assert portfolio.correlation_matrix(some.filter("false")).count() == 0


def test_digest_parts_hold_all_posts_in_order(spark):
    from barwright.operators import holdings

    at = dt.datetime(2024, 1, 10)
    posts = [(i, f"${'AAA' if i % 4 else 'BBB'} post {i}", at - dt.timedelta(hours=7 * (i % 23))) for i in range(90)] + [(99, None, at), (100, "$AAA old", at - dt.timedelta(days=8))]
    frame = holdings.summaries(spark.createDataFrame(posts, "id int, text string, created_at timestamp"))
    assert {(r.id, tuple(r.tickers), r.snippet) for r in frame.filter("id = 99").collect()} == {(99, (), "")}
    found = sorted(holdings.weekly_digest(frame, most=10).collect(), key=lambda r: (r.ticker, r.part))
    for ticker in ("AAA", "BBB"):
        own = sorted((t, i, x) for i, x, t in posts if x and ticker in x and t > at - dt.timedelta(days=7))
        parts = [r for r in found if r.ticker == ticker]
        assert [r.part for r in parts] == list(range(-(-len(own) // 10))) and {r.post_count for r in parts} == {len(own)} and {r.period_start for r in parts} == {own[0][0]}
        assert "\n".join(r.report_text for r in parts).split("\n") == [f"- {t:%Y-%m-%d}: {x}" for t, _, x in own]
        assert max(len(r.report_text.split("\n")) for r in parts) == 10
