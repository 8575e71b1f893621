"""The engine's operators against pandas, loops and constructed cases."""

import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barwright.functions import candles
from barwright.functions.indicators import Kernels
from barwright.operators import backtest, conditions, cycles, expression, holdings, portfolio, ranking, records, regime, sequential, tuning
from barwright.plans import intake, strategy
from barwright.plans import queries as engine
from barwright.sources import bars as B
from barwright.sources import readers
from barwright.streaming import live

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import compare  # noqa: E402

SCHEMA = "ticker string, ts date, open double, high double, low double, close double, volume double"
DAY = dt.date(2020, 1, 1)


def frame(spark, rows, ticker="A"):
    """Bars from (open, high, low, close[, volume]) tuples, a day each."""
    return spark.createDataFrame([(ticker, DAY + dt.timedelta(days=i), *map(lambda x: None if x is None else float(x), r[:4]), float(r[4]) if len(r) > 4 else 1000.0) for i, r in enumerate(rows)], SCHEMA)


def walk(spark, n, seed=0, ticker="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + rng.normal(0.0003, 0.02, n))
    open_ = close * (1 + rng.normal(0, 0.01, n))
    rows = list(zip(open_, np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99, close, rng.integers(1000, 9000, n), strict=True))
    return frame(spark, rows, ticker), pd.DataFrame(rows, columns=["open", "high", "low", "close", "volume"])


def column(k, name):
    return [r[0] for r in k.df.orderBy("ts").select(name).collect()]


# ------------------------------------------------------------ registered queries
@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare.differences(engine.QUERIES[name](spark, sf_dir), sf_dir, engine.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert engine.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


# ------------------------------------------------------------ indicators
@pytest.mark.parametrize(("n", "longest"), [(3, None), (20, None), (20, 3000)])
def test_ema_is_pandas_ewm_on_long_histories(spark, n, longest):
    size = 2600 if longest else 4000
    df, pdf = walk(spark, size)
    k = Kernels(df, longest)
    got = column(k, k.ema("close", n))
    want = pdf["close"].ewm(span=n, adjust=False, min_periods=n).mean()
    assert np.allclose([np.nan if x is None else x for x in got], want, rtol=1e-9, equal_nan=True)


def test_histories_beyond_a_single_sum_keep_their_signals(spark):
    df, pdf = walk(spark, 4000)
    held, same = {"expression": "ema(close, 12) < 1000000000"}, {"expression": "sma(close, 12) < 1000000000"}
    assert backtest.latest(df, held).first().in_position
    curve = [r.position for r in backtest.run(df, held).curve.orderBy("ts").collect()]
    assert curve == [float(i >= 11) for i in range(4000)]
    window = (DAY, DAY + dt.timedelta(days=4000))
    a, b = ((r.sharpe, r.trade_count) for r in tuning.evaluated(df, [held, same], [window]).orderBy("candidate").collect())
    assert a == b


def test_rsi_and_macd(spark):
    df, pdf = walk(spark, 300)
    k = Kernels(df)
    d = pdf["close"].diff()
    up, down = d.clip(lower=0).fillna(0), (-d).clip(lower=0).fillna(0)
    mean = lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    want = 100 - 100 / (1 + mean(up) / mean(down))
    assert np.allclose(pd.Series(column(k, k.rsi("close")), dtype=float), want, equal_nan=True)
    ema = lambda s, n: s.ewm(span=n, adjust=False, min_periods=n).mean()
    line = ema(pdf["close"], 12) - ema(pdf["close"], 26)
    names = k.macd("close")
    assert np.allclose(pd.Series(column(k, names[0]), dtype=float), line, equal_nan=True)
    assert np.allclose(pd.Series(column(k, names[1]), dtype=float).dropna(), ema(line.dropna(), 9).dropna())


def test_constant_prices_and_nulls(spark):
    k = Kernels(frame(spark, [(5, 5, 5, 5, 0)] * 30))
    assert column(k, k.rsi("close"))[-1] == 100.0
    assert column(k, k.percent_b("close"))[-1] is None and column(k, k.volume_ratio())[-1] is None
    k = Kernels(frame(spark, [(1, 1, 1, None)] * 3 + [(1, 1, 1, i + 1) for i in range(5)]))
    assert column(k, k.sma("close", 3)) == [None] * 5 + [2.0, 3.0, 4.0]
    assert column(k, k.ema("close", 3))[:5] == [None] * 5 and column(k, k.ema("close", 3))[5] is not None


def test_every_condition_is_never_null(spark):
    df, _ = walk(spark, 120)
    k = Kernels(df.withColumn("close", F.when(F.dayofmonth("ts") != 7, F.col("close"))))
    names = [conditions.evaluate(k, {"indicator": i}) for i in conditions.REGISTRY]
    assert len(names) == 30
    assert k.df.filter(" or ".join(f"{n} is null" for n in names)).count() == 0
    with pytest.raises(ValueError):
        conditions.evaluate(k, {"indicator": "nothing"})
    with pytest.raises(ValueError):
        conditions.evaluate(k, {"indicator": "rsi", "op": "=="})


def test_engulfing_bars(spark):
    rows = [(10, 10.5, 7.5, 8), (7, 11.5, 6.5, 11), (12, 12.5, 5.5, 6), (6.5, 6.7, 6, 6.2), (6.2, 6.6, 6, 6.5)]
    k = Kernels(frame(spark, rows))
    made = candles.engulfing(k)
    got = k.df.select("ts", made["bullish"].alias("b"), made["bearish"].alias("s")).orderBy("ts").collect()
    assert [r.b for r in got] == [False, True, False, False, True] and [r.s for r in got] == [False, False, True, False, False]


def test_inside_bar_breakout_fires_once(spark):
    rows = [(10, 12, 8, 10), (10, 11, 9, 10), (10, 13, 9.5, 12.5), (12, 14, 11, 13.5), (13, 15, 12, 14)]
    k = Kernels(frame(spark, rows))
    made = candles.inside_bar_breakout(k)
    assert [r[0] for r in k.df.orderBy("ts").select(made["bullish"].alias("b")).collect()] == [False, False, True, False, False]


def _loop_double(p, k=5, window=40, mult=1.5):
    mid, std = p.close.rolling(20).mean(), p.close.rolling(20).std(ddof=0)
    low, up, avg = mid - 2 * std, mid + 2 * std, p.volume.rolling(20).mean()
    pl, ph = p.low == p.low.rolling(2 * k + 1, center=True).min(), p.high == p.high.rolling(2 * k + 1, center=True).max()
    out, last, ready = [], {}, {}
    for i in range(len(p)):
        row, j = [False, False], i - k
        if j >= 0:
            for s, piv, outside, inside in ((0, pl, lambda a: p.low[a] < low[a], lambda b: p.low[b] >= low[b]), (1, ph, lambda a: p.high[a] > up[a], lambda b: p.high[b] <= up[b])):
                if piv[j]:
                    if s in last and j - last[s] <= window and outside(last[s]) and inside(j):
                        ready[s] = i + window
                    last[s] = j
                if i <= ready.get(s, -1) and p.volume[i] >= mult * avg[i]:
                    a, b = (p.close[i] - mid[i], p.close[i - 1] - mid[i - 1])
                    if (a > 0 >= b) if s == 0 else (a < 0 <= b):
                        row[s], ready[s] = True, -1
        out.append(tuple(row))
    return out


def test_double_pattern_against_a_loop(spark):
    hits = 0
    for seed in range(3):
        df, pdf = walk(spark, 700, seed)
        k = Kernels(df)
        made = sequential.double_pattern(k, volume_mult=1.1)
        got = list(zip(column(k, made["bullish"]), column(k, made["bearish"]), strict=True))
        want = _loop_double(pdf, mult=1.1)
        assert got == want
        hits += sum(map(any, want))
    assert hits > 0


# ------------------------------------------------------------ expressions
@pytest.mark.parametrize("text", ["__import__('os').system('x')", "close.__class__", "(lambda: 1)()", "[x for x in close]", "open('f')", "close[0] > 1", "exec('1')", "close", "1 + 1", "crossover(1, 2)", "sma(close) > 1", "close > 'a'", "sma(close, close) > 1", "close > ", "sma(*[close, 3]) > 1"])
def test_hostile_or_wrong_expressions(spark, text):
    assert expression.validate(spark, text) is not None


def test_expressions_and_missing_values(spark):
    assert expression.validate(spark, "CLOSE > sma(close, 20) and not rsi(close) < 30") is None
    k = Kernels(frame(spark, [(1, 1, 1, 1), (1, 1, 1, None), (1, 1, 1, 3)]))
    run = lambda t: column(k, expression.evaluate(k, t))
    assert run("close > 0") == [True, False, True] and run("not close > 0") == [False, True, False] and run("close != 1") == [False, True, True]
    assert run("min(close, 2) == 1") == [True, False, False] and run("1 < close <= 3") == [False, False, True]


def test_literals():
    text = "close > sma(close, 20) * 1.05 and rsi(close, 14) < 30"
    assert [v for v, *_ in expression.literals(text)] == [20, 1.05, 14, 30]
    assert expression.with_numbers(text, [10, 1.1, 7, 25]) == "close > sma(close, 10) * 1.1 and rsi(close, 7) < 25"


# ------------------------------------------------------------ backtests
def test_positions_lag_and_trades(spark):
    df = frame(spark, [(c, c, c, c) for c in (10, 11, 12, 11, 10, 12)])
    b = backtest.run(df, {"expression": "close > 10.5"})
    rows = b.curve.orderBy("ts").collect()
    assert [r.executed for r in rows] == [0, 0, 1, 1, 1, 0]
    assert rows[-1].equity == pytest.approx(100 * (12 / 11) * (11 / 12) * (10 / 11))
    (t,) = b.trades.collect()
    assert (t.entry_price, t.exit_price, t.exit_date) == (12.0, 12.0, DAY + dt.timedelta(days=5))
    m = b.metrics.first()
    assert m.trade_count == 1 and m.win_rate == 0 and m.mdd < 0


def test_holding_cap_against_a_loop(spark):
    rng = np.random.default_rng(3)
    up = rng.random(400) < 0.8
    df = frame(spark, [(1, 1, 1, 2 if u else 1) for u in up])
    got = [r.position for r in backtest.run(df, {"expression": "close > 1.5"}, max_holding_days=4).curve.orderBy("ts").collect()]
    want, streak = [], 0
    for u in up:
        streak = streak + 1 if u else 0
        want.append(float(u and streak <= 4))
        streak = 0 if streak > 4 else streak
    assert got == want


def staged_case(spark, close, entries, exits, emergency=None, stop=None, multiple=None):
    """Runs the state machine over columns given as lists of bar numbers."""
    df = frame(spark, [(c, c, c, c) for c in close])
    i = F.datediff("ts", F.lit(DAY))
    names = []

    def add(on):
        nonlocal df
        names.append(f"s{len(names)}")
        df = df.withColumn(names[-1], i.isin(list(on)) if on else F.lit(False))
        return names[-1]

    e = [(add(on), w, "why") for on, w in entries]
    x = [(add(on), "why") for on in exits]
    m = (add(emergency), "why") if emergency is not None else None
    df = df.withColumn("why", F.lit("r")).withColumn("level", F.lit(stop).cast("double"))
    k = Kernels(df)
    weight, events = sequential.staged(k, e, x, m, "level" if stop is not None else None, multiple)
    rows = k.df.orderBy("ts").select(weight, events).collect()
    return [r[0] for r in rows], [(ev.kind, ev.stage) for r in rows for ev in r[1]], k, events


def test_staged_order_partial_and_last_exit(spark):
    w, ev, _, _ = staged_case(spark, [10] * 8, [([1, 2], 0.2), ([2, 3], 0.3), ([4], 0.5)], [[5], [6]])
    assert w == pytest.approx([0, 0.2, 0.5, 0.5, 1.0, 0.8, 0, 0])
    assert ev == [("entry", 1), ("entry", 2), ("entry", 3), ("exit", 1), ("exit", 2), ("exit", 3)]


def test_staged_last_stage_may_jump_and_emergency(spark):
    w, ev, _, _ = staged_case(spark, [10] * 5, [([3], 0.4), ([1], 0.6)], [[9]], emergency=[2])
    assert w == pytest.approx([0, 0.6, 0, 0.4, 0.4]) and ev[1] == ("emergency_exit", 2)


def test_staged_stop_and_target(spark):
    assert staged_case(spark, [10, 10, 8.5, 8], [([1], 1.0)], [[9]], stop=9.0)[1] == [("entry", 1), ("stop_loss", 1)]
    assert staged_case(spark, [10, 10, 11, 12.1], [([1], 1.0)], [[9]], stop=9.0, multiple=2.0)[1] == [("entry", 1), ("take_profit", 1)]
    with pytest.raises(ValueError):
        strategy.staged_columns(Kernels(frame(spark, [(1, 1, 1, 1)])), {"entry_stages": [], "take_profit": {"multiple": 2}})


def test_staged_trades_average(spark):
    _, _, k, events = staged_case(spark, [10, 11, 12, 13, 14, 15, 16], [([0], 0.4), ([1], 0.6)], [[9], [3]])
    t = sequential.staged_trades(k.df, events).collect()
    assert len(t) == 1 and t[0].entry_price == pytest.approx(0.4 * 11 + 0.6 * 12) and t[0].exit_price == pytest.approx(14)
    _, _, k, events = staged_case(spark, [10, 11, 12], [([0], 1.0)], [[9]])
    (t,) = sequential.staged_trades(k.df, events).collect()
    assert t.exit_price == 12 and t.exit_date == DAY + dt.timedelta(days=2)


def test_staged_positions_against_rules_bar_by_bar(spark):
    """What holds after each bar follows from what held before: checked on random signals, for weights and events."""
    rng = np.random.default_rng(8)
    for _ in range(3):
        n = 150
        close = 10 + np.cumsum(rng.normal(0, 0.3, n))
        on = lambda p: [int(i) for i in np.flatnonzero(rng.random(n) < p)]
        entries, exits, emergency = [(on(0.2), 0.25), (on(0.2), 0.25), (on(0.1), 0.5)], [on(0.1), on(0.1), on(0.05)], on(0.02)
        weights, _, k, events = staged_case(spark, close, entries, exits, emergency, 9.0)
        log = [r[0] for r in k.df.orderBy("ts").select(events).collect()]
        held, opened = {}, {}
        for i, now in enumerate(log):
            first = not held
            for e in (e for e in now if e.kind == "entry"):
                assert i in entries[e.stage - 1][0] and e.stage not in opened
                assert e.stage == 3 and 3 not in opened or e.stage - 1 == max(opened, default=0)
                held[e.stage] = opened[e.stage] = entries[e.stage - 1][1]
            could = [s for s, (at, _) in enumerate(entries, 1) if i in at and s not in opened and (s == 3 or s - 1 == max(opened, default=0))]
            assert not could
            stop = 9.0
            kinds = {e.kind for e in now} - {"entry"}
            due = "emergency_exit" if i in emergency else "stop_loss" if close[i] < stop else "exit" if i in exits[2] else None
            if held and due:
                assert kinds == {due} and {e.stage for e in now if e.kind == due} == set(held), (i, first)
                held = {}
            else:
                gone = {s for s in held if s < 3 and i in exits[s - 1]}
                assert {e.stage for e in now if e.kind == "exit"} == gone and kinds <= {"exit"}
                held = {s: w for s, w in held.items() if s not in gone}
            opened = opened if held else {}
            assert weights[i] == pytest.approx(sum(held.values()))


# ------------------------------------------------------------ bars, regimes, ranks
def test_merge_resample_clamp(spark):
    a = frame(spark, [(i, i + 5, i - 5, i + 2, 10) for i in range(1, 11)])
    b = frame(spark, [(100, 101, 99, 100, 1)])
    merged = B.merge_bars(a, b)
    assert merged.count() == 10 and merged.orderBy("ts").first().close == 100
    week = B.resample(a, "W-FRI").orderBy("ts").collect()
    assert [r.ts for r in week] == [dt.date(2020, 1, 3), dt.date(2020, 1, 10)] and week[0].open == 1 and week[0].close == 5 and week[0].volume == 30
    assert B.clamp_start("5m", dt.date(2020, 1, 1), dt.date(2020, 12, 1)) == (dt.date(2020, 10, 2), True)
    assert B.clamp_start("1d", dt.date(1990, 1, 1), dt.date(2020, 12, 1))[1] is False


def test_store_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    B.append_bars(spark, path, frame(spark, [(1, 1, 1, 1), (2, 2, 2, 2)]))
    B.append_bars(spark, path, frame(spark, [(9, 9, 9, 9)], "B"))
    B.append_bars(spark, path, frame(spark, [(5, 5, 5, 5)]))
    got = {(r.ticker, r.ts.day): r.close for r in B.load_bars(spark, path).collect()}
    assert got == {("A", 1): 5.0, ("A", 2): 2.0, ("B", 1): 9.0}
    assert B.clear_bars(spark, path, "B") >= 1 and B.load_bars(spark, path).count() == 2


def test_regimes(spark):
    up = frame(spark, [(c, c * 1.01, c * 0.99, c) for c in 100 * 1.0015 ** np.arange(300)])
    down = frame(spark, [(c, c * 1.01, c * 0.99, c) for c in 100 * 0.997 ** np.arange(300)], "B")
    s = {r.ticker: r for r in regime.scores(up.unionByName(down)).collect()}
    assert (s["A"].trend_position, s["A"].ma_cross, s["A"].drawdown) == (25, 25, 0) and (s["B"].trend_position, s["B"].bear_market) == (-25, True)
    last = {r.ticker: r.regime for r in regime.daily(up.unionByName(down)).filter(F.col("ts") == DAY + dt.timedelta(days=299)).collect()}
    assert last == {"A": "bull", "B": "bear"}
    first = regime.daily(up).orderBy("ts").first()
    assert first.regime == "sideways"
    b = regime.breadth(up.unionByName(down)).first()
    assert (b.n_total, b.n_above, b.pct_above, b.score) == (2, 1, 50.0, 0.0)


def test_segments_need_ten_bars(spark):
    rows = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), "x" if i < 10 else "y" if i < 19 else "x") for i in range(32)], "ticker string, ts date, regime string")
    assert sorted((r.regime, r.bars) for r in regime.segments(rows).collect()) == [("x", 10), ("x", 13)]


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "ticker string, x double")
    want = {"keep": {"a": 100 / 3, "b": 250 / 3, "c": 250 / 3, "d": None}, "lowest": {"a": 50.0, "b": 87.5, "c": 87.5, "d": 25.0}, "highest": {"a": 25.0, "b": 62.5, "c": 62.5, "d": 100.0}}
    for how, expected in want.items():
        got = {r.ticker: r.s for r in df.select("ticker", ranking.rank_score("x", how).alias("s")).collect()}
        assert got == {k: None if v is None else pytest.approx(v) for k, v in expected.items()}
    none = df.withColumn("x", F.lit(None).cast("double"))
    assert {r.s for r in none.select(ranking.rank_score("x", "highest", 50.0).alias("s")).collect()} == {50.0}


def test_macro_and_risk(spark):
    s = spark.createDataFrame([("u", DAY + dt.timedelta(days=31 * i), 4.0 if i < 14 else 5.5) for i in range(17)], "series string, ts date, value double")
    assert cycles.sahm(s).orderBy(F.desc("ts")).first().triggered
    got = spark.range(1).select(regime.volatility_signal(F.lit(14.0)).alias("a"), regime.credit_signal(F.lit(11.0)).alias("b"), regime.curve_signal(F.lit(-0.1)).alias("c"), cycles.cfnai_state(F.lit(-0.8)).alias("d")).first()
    assert (got.a.score, got.b.score, got.c, got.d) == (10.0, -25.0, -20.0, "recession")


# ------------------------------------------------------------ valuation, portfolio, holdings, records
def test_closed_forms(spark):
    r = spark.range(1).select(portfolio.ddm(2.0).alias("ddm"), portfolio.ddm(2.0, 0.03, 0.05).alias("none"), portfolio.graham(4.0, 10.0).alias("g"), portfolio.dcf(100.0, 10.0, 0.0, 0.1, 0.0, 5).alias("dcf"), portfolio.dcf(100.0, 0.0).alias("zero")).first()
    flows = sum(100 / 1.1**i for i in range(1, 6)) + 100 / 1.1**5 / 0.1
    assert r.ddm == pytest.approx(34.3333, abs=1e-3) and r.none is None and r.g == pytest.approx(30) and r.dcf == pytest.approx(flows / 10) and r.zero is None


def test_pnl_weights(spark):
    h = spark.createDataFrame([("p", "A", 10.0, 5.0), ("p", "B", 1.0, 30.0), ("p", "C", 1.0, 1.0)], "portfolio string, ticker string, quantity double, purchase_price double")
    p = spark.createDataFrame([("A", 6.0), ("B", 40.0)], "ticker string, close double")
    got = {r.ticker: (r.pnl, r.weight) for r in portfolio.pnl(h, p).collect()}
    assert got == {"A": (10.0, 60.0), "B": (10.0, 40.0), "C": (None, None)}


def test_common_and_names(spark):
    rows = spark.createDataFrame([("A", "AAPL", 10.0), ("A", "MSFT", 5.0), ("A", None, 1.0), ("B", "AAPL", 20.0), ("B", "GOOG", 15.0)], "guru_name string, ticker string, weight_pct double")
    assert [tuple(r) for r in holdings.common(rows, ["A", "B"]).collect()] == [("AAPL", 30.0)]
    assert holdings.common(rows, ["A", "A"]).count() == 0
    got = spark.range(1).select(holdings.candidate_names(F.lit("occidental  pete corp new")).alias("n")).first().n
    assert got == ["OCCIDENTAL PETE CORP NEW", "OCCIDENTAL PETROLEUM CORP NEW", "OCCIDENTAL PETROLEUM CORP", "OCCIDENTAL PETROLEUM"]
    lookup = spark.createDataFrame([("OCCIDENTAL PETROLEUM", "OXY")], "name string, ticker string")
    filed = spark.createDataFrame([("Occidental Pete Corp",), ("Unknown Co",)], "issuer_name string")
    assert {r.issuer_name: r.ticker for r in holdings.resolve(filed, lookup).collect()} == {"Occidental Pete Corp": "OXY", "Unknown Co": None}


def test_tickers_and_members(spark):
    got = spark.range(1).select(holdings.tickers_in(F.lit("BUY $AAPL and MSFT, not TOOLONG or the CEO; AAPL")).alias("t")).first().t
    assert got == ["AAPL", "MSFT"]
    table = spark.createDataFrame([(dt.date(2020, 1, 1), ["A"]), (dt.date(2020, 6, 1), ["A", "B"])], "date date, tickers array<string>")
    days = spark.createDataFrame([(dt.date(2019, 1, 1),), (dt.date(2020, 3, 1),), (dt.date(2020, 6, 1),)], "day date")
    assert {r.day.isoformat(): r.tickers for r in holdings.members_as_of(table, days).collect()} == {"2019-01-01": ["A"], "2020-03-01": ["A"], "2020-06-01": ["A", "B"]}


def test_readers(spark, tmp_path):
    (tmp_path / "fred_GDPC1.csv").write_text(",GDPC1\n2020-01-01,1.5\n2020-04-01,\n")
    rows = readers.macro_series(spark, f"{tmp_path}/fred_*.csv").orderBy("ts").collect()
    assert [(r.series, r.value) for r in rows] == [("GDPC1", 1.5), ("GDPC1", None)]
    (tmp_path / "f.xml").write_text('<t xmlns="u"><infoTable><nameOfIssuer>Apple  Inc</nameOfIssuer><value>3</value><shrsOrPrnAmt><sshPrnamt>5</sshPrnamt></shrsOrPrnAmt></infoTable><infoTable><nameOfIssuer>APPLE INC</nameOfIssuer><value>1</value><shrsOrPrnAmt><sshPrnamt>2</sshPrnamt></shrsOrPrnAmt></infoTable></t>')
    (r,) = readers.filing(spark, f"{tmp_path}/f.xml").collect()
    assert (r.issuer_name, r.shares, r.value, r.weight_pct) == ("APPLE INC", 7, 4000, 100.0)
    (tmp_path / "ark.csv").write_text('date,fund,company,ticker,cusip,shares,"market value ($)","weight (%)"\n01/02/2024,ARKK,TESLA INC,TSLA,1,"1,000","$2,000.50",8.5%\n01/02/2024,ARKG,X,Y,1,1,1,1\n')
    (r,) = readers.fund_csv(spark, f"{tmp_path}/ark.csv", "ARKK").collect()
    assert (r.ticker, r.shares, r.value, r.weight_pct, r.filing_date) == ("TSLA", 1000.0, 2000.5, 8.5, dt.date(2024, 1, 2))
    up = readers.uploaded_holdings(spark, "제목\n\n종목코드,종목명,비중,보유수량\naapl,Apple,12.5%,\"1,000\"\n".encode(), "h.csv").collect()
    assert [(r.ticker, r.weight, r.shares) for r in up] == [("AAPL", 12.5, 1000.0)]


def test_watchlist_rules(spark):
    schema = "id long, ticker string, strategy_id long, memo string, added_at timestamp"
    empty = spark.createDataFrame([], schema)
    one = records.watch(empty, " aapl ", 1)
    assert one.first().ticker == "AAPL"
    again = records.watch(one, "AAPL", memo="m").collect()
    assert len(again) == 1 and (again[0].strategy_id, again[0].memo) == (1, "m")
    full = spark.createDataFrame([(i, f"T{i}", None, None, None) for i in range(50)], schema)
    with pytest.raises(ValueError):
        records.watch(full, "NEW")
    s = spark.createDataFrame([(1,), (2,)], "id long")
    ref = spark.createDataFrame([(1, 1), (2, 2)], "id long, strategy_id long")
    left, results, watched, alerts = records.delete_strategy(1, s, ref, ref, ref)
    assert left.count() == 1 and results.count() == 1 and watched.filter("strategy_id is null").count() == 1 and alerts.count() == 2


# ------------------------------------------------------------ search
def test_grid_and_folds():
    cfg = {"logic": "AND", "conditions": [{"indicator": "ma_cross", "short": 10, "long": 30}, {"indicator": "rsi", "op": "<", "value": 30, "period": 14}]}
    fine = tuning.grid(cfg, "growth", "fine")
    assert cfg in fine and len(fine) == 81 and tuning.grid(cfg, "growth", "fast") == tuning.grid(cfg, "growth", "fast") and len(tuning.grid(cfg, "growth", "fast")) in (20, 21)
    staged = tuning.grid(engine.STAGED, None, "fast")
    assert all(abs(sum(s["weight"] for s in c["entry_stages"]) - 1) < 1e-3 for c in staged[:-1])
    assert tuning.grid({"expression": "close > sma(close, 20)"}, None, "fast")[0]["expression"].startswith("close > sma(close, ")
    f = tuning.folds(dt.date(2020, 1, 1), dt.date(2020, 12, 31), 4)
    assert f[0][0] == dt.date(2020, 1, 1) and f[-1][1] == dt.date(2020, 12, 31) and all(b[0] == a[1] + dt.timedelta(days=1) for a, b in zip(f, f[1:], strict=False))
    assert tuning.split(dt.date(2020, 1, 1), dt.date(2020, 1, 9)) == ((dt.date(2020, 1, 1), dt.date(2020, 1, 7)), (dt.date(2020, 1, 8), dt.date(2020, 1, 9)))
    assert tuning.diff({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}]}) == [("a[1].b", 2, 3)]


def test_search_equals_single_backtests(spark):
    df = walk(spark, 500, 1)[0].unionByName(walk(spark, 500, 2, "B")[0])
    cands = [{"expression": "close > sma(close, 10)"}, {"conditions": [{"indicator": "rsi", "op": "<", "value": 50}]}]
    window = (DAY + dt.timedelta(days=420), DAY + dt.timedelta(days=490))
    many = {(r.ticker, r.candidate): (r.sharpe, r.trade_count) for r in tuning.evaluated(df, cands, [window]).collect()}
    for i, c in enumerate(cands):
        for r in backtest.run(df, c, *window).metrics.collect():
            assert many[r.ticker, i] == (pytest.approx(r.sharpe), r.trade_count)


def test_variants_choice_and_counts(spark):
    assert tuning.regime_switched("close > ") is None and "highest(close, " in tuning.regime_switched("rsi(close, 14) < 30")
    rows = [("A", "strategy", 5.0), ("B", "strategy", 1.0), ("A", "ticker", 4.0), ("B", "ticker", 0.5), ("X", "benchmark", 3.0)]
    got = {r.ticker: (r.beats_ticker, r.beats_benchmark, r.beats_both) for r in tuning.beats_both(spark.createDataFrame(rows, "ticker string, leg string, cagr double")).collect()}
    assert got == {"A": (True, True, True), "B": (True, False, False)}
    alerts = spark.createDataFrame([(1, False), (2, True)], "id long, is_read boolean")
    assert records.unread_count(alerts).first().n == 1 and records.unread_count(records.all_read(alerts)).first().n == 0
    stocks = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "sector string")
    assert [r.sector for r in records.sectors(stocks).collect()] == ["a", "b"] and records.watched_count(alerts).first().n == 2


def test_config_kinds_and_problems():
    assert [strategy.kind_of(c) for c in (engine.CROSS, engine.STAGED, {"expression": "close > 1"}, {"combine": "AND", "strategies": []}, "not json")] == ["regime", "staged", "expression", "combined", "regime"]
    assert strategy.problems(engine.STAGED) == [] and strategy.problems({"conditions": []}) and strategy.problems({"combine": "XOR", "strategies": [engine.CROSS]}) and strategy.problems("{")


# ------------------------------------------------------------ streaming
def test_stream_bars_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = events.selectExpr("event_id", "event_type as ticker", "ts", "value")
    ticks.unionByName(ticks.limit(20)).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.stream_bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.ticker, r.ts): (r.open, r.close, r.volume) for r in spark.table("bars_out").collect()}
    want = {(r.ticker, r.ts): (r.open, r.close, r.volume) for r in B.hourly_bars(spark, sf_dir).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= 0.9 * len(want)


def test_edge_alerts_across_batches(spark, tmp_path):
    schema = "ticker string, ts timestamp, hit boolean"
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    for n, rows in enumerate(([("A", at(0), False), ("A", at(1), True)], [("A", at(2), True), ("A", at(3), False), ("A", at(4), True), ("B", at(4), True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    source = f"{tmp_path}/all"
    os.makedirs(source)
    for n in (0, 1):
        for f in os.listdir(f"{tmp_path}/in{n}"):
            if f.endswith(".parquet"):
                os.rename(f"{tmp_path}/in{n}/{f}", f"{source}/{n}-{f}")
        alerts = live.edge_alerts(spark.readStream.schema(schema).parquet(source), "hit")
        q = alerts.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.ticker, r.ts.hour) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("A", 1), ("A", 4), ("B", 4)]


def test_strategy_texts_become_configs(spark):
    texts = {
        "볼린저 밴드 스퀴즈 매매": "staged", "밴드폭 지표가 하단 기준선 아래로 하락": "staged", "상승 다이버전스가 발생": "staged", "쌍봉형 패턴이 나오면": "staged", "RSI with MACD and Ichimoku": "staged",
        "이동평균 골든크로스가 뜨면 매수합니다": "골든크로스", "RSI and MACD": "RSI 눌림목", "과매수": "RSI 과매수", "과매수 or 과매도": "RSI 눌림목", "Golden, then dead cross at upper Bollinger": "골든크로스+데드크로스+볼린저 상단 돌파",
        "nothing known": "후보", "": "후보", None: "후보", "x " * 200_000 + "bollinger": "볼린저 하단 이탈",
    }
    rows = intake.interpreted(spark.createDataFrame([(t, 7) for t in texts] * 2, "text string, kind int"), out=("kind_read", "name", "config")).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert texts[r.text] in (r.kind_read, r["name"]) and r.kind == 7 and strategy.problems(r.config) == []
        assert strategy.kind_of(r.config) == r.kind_read
    assert intake.is_sane(intake.STAGED) and intake.interpreted(spark.createDataFrame([], "text string")).count() == 0
    one = {"conditions": [{"indicator": "rsi"}]}
    for wrong in ({}, {"entry_stages": [one]}, {"entry_stages": [one] * 7, "exit_stages": [one]}, {"entry_stages": [{"conditions": []}], "exit_stages": [one]}, {"entry_stages": [one], "exit_stages": [one], "emergency_exit": {"conditions": [{}] * 7}}):
        assert not intake.is_sane(wrong)


def test_scripts_and_candidate_names(spark):
    texts = {"one\n---\ntwo\n----\nthree\n": ["one", "two", "three"], "no line": ["no line"], "one\n---\n\n---\ntwo": ["one", "two"], "a --- b\r\n \t--- \n\u3000c\u3000": ["a --- b", "c"], "--\nx": ["--\nx"], "": [], None: [], "---": []}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", intake.scripts("text").alias("found")).collect()
    assert {r.text: r.found for r in rows} == texts
    name = lambda taken: intake.free_name(spark.createDataFrame([(t,) for t in taken], "name string")).first()["name"]
    assert name([]) == "후보1" and name(["후보2", None, "후보01", "후보99999999999999999999"]) == "후보1" and name(["후보1", "후보1", "후보2", "후보4"]) == "후보3"


def test_tunables_and_sanity(spark):
    found = tuning.tunables({"logic": "AND", "conditions": [{"indicator": "rsi", "period": 14, "op": "<", "value": 30, "flag": True}]})
    assert ("conditions[0]", "rsi", "value", 30.0, "threshold", "leader", 20.0, 40.0) in found and len(found) == 12
    assert {r[0] for r in tuning.tunables({"expression": "close > sma(close, 20) * 1.5"})} == {"expression[0]", "expression[1]"} and tuning.tunables({"conditions": []}) == []
    rows = [("A", "strategy", 12.0, 2), ("B", "strategy", 6.0, 1), ("A", "ticker", 1.0, 1), ("X", "benchmark", 8.0, 1)]
    validated = tuning.cross_validated(spark.createDataFrame(rows, "ticker string, leg string, cagr double, trade_count int"))
    assert {r.ticker: (r.trade_count, r.excess_return) for r in validated.collect()} == {"A": (2, 4.0), "B": (1, -2.0)}
    assert tuple(tuning.sanity(validated).first()) == (3, 1.0, True) and not tuning.sanity(validated, 4).first().passed
    assert tuple(tuning.sanity(validated.filter("false")).first()) == (0, None, False)
