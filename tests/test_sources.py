"""Coverage, tables in files, growing stores, reviews, configs in tables and themes, against plain Python."""

import datetime as dt
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from barwright.operators import configs, reviews, themes
from barwright.plans import strategy
from barwright.sources import coverage, tables

FIRST, DAY = dt.date(2020, 1, 1), dt.timedelta(days=1)
COVER = "ticker string, low date, high date"


def days(rows):
    return {(r.ticker, r.low.toordinal() + i) for r in rows for i in range((r.high - r.low).days + 1)}


def test_missing_days_are_those_that_no_interval_covers(spark):
    rnd = random.Random(4)
    covered = [(t, FIRST + a * DAY, FIRST + (a + rnd.randint(-1, 9)) * DAY) for t in "ABCD" for a in rnd.sample(range(100), 8)]
    asked = [(t, FIRST + rnd.randint(0, 40) * DAY, FIRST + rnd.randint(60, 120) * DAY) for t in "ABCE"] + [("A", FIRST, FIRST + 5 * DAY), ("D", FIRST + 30 * DAY, FIRST + 20 * DAY)]
    frame = spark.createDataFrame(covered, COVER)
    found = coverage.missing(spark.createDataFrame(asked, "ticker string, start date, end date"), frame).collect()
    have = {(t, a.toordinal() + i) for t, a, b in covered for i in range((b - a).days + 1)}
    want = {(t, a.toordinal() + i) for t, a, b in asked for i in range((b - a).days)} - have
    assert days(found) == want and len(days(found)) == sum((r.high - r.low).days + 1 for r in found)
    ranges = sorted((r.ticker, r.low, r.high) for r in found)
    assert not any(x[0] == y[0] and y[1] == x[2] + DAY and (x[0], x[2].toordinal()) in want and x[2] + DAY == y[1] for x, y in zip(ranges, ranges[1:], strict=False))
    assert days(coverage.merged(frame).collect()) == have and len(coverage.merged(frame).collect()) <= len(covered)


def test_full_histories_are_not_asked_for_older_days(spark):
    frame = spark.createDataFrame([("A", FIRST, FIRST + 9 * DAY), ("B", FIRST, FIRST + 9 * DAY)], COVER)
    asked = spark.createDataFrame([("A", None, FIRST + 12 * DAY), ("B", None, FIRST + 12 * DAY), ("C", None, FIRST), ("B", FIRST - 30 * DAY, FIRST)], "ticker string, start date, end date")
    full = spark.createDataFrame([("B",), ("C",)], "ticker string")
    found = {tuple(r) for r in coverage.missing(asked, frame, full).collect()}
    assert found == {("A", None, FIRST - DAY), ("A", FIRST + 10 * DAY, FIRST + 11 * DAY), ("B", FIRST + 10 * DAY, FIRST + 11 * DAY), ("C", None, FIRST - DAY)}
    bars = spark.createDataFrame([(t, FIRST + i * DAY) for t in "ABC" for i in range(-5, 20)], "ticker string, ts date")
    got = coverage.fetched(bars, coverage.missing(asked, frame, full))
    assert {(r.ticker, (r.ts - FIRST).days) for r in got.collect()} == {*(("A", i) for i in range(-5, 0)), ("A", 10), ("A", 11), ("B", 10), ("B", 11), *(("C", i) for i in range(-5, 0))}
    assert {tuple(r) for r in coverage.of_bars(bars.filter("ts < '2020-01-02' or ts > '2020-01-10'")).collect()} == {(t, a, b) for t in "ABC" for a, b in ((FIRST - 5 * DAY, FIRST), (FIRST + 10 * DAY, FIRST + 19 * DAY))}
    assert coverage.missing(asked.filter("false"), frame).count() == 0 and coverage.merged(frame.filter("false")).count() == 0


def test_html_tables_with_spans_and_missing_ends():
    read = lambda html: tables._Tables().tables(html)
    assert read("<table><tr><td rowspan=2>a<td>b<tr><td>c<td colspan='2'>d &amp;\n e</table>") == [(0, 0, ["a", "b"]), (0, 1, ["a", "c", "d & e", "d & e"])]
    assert read("<table><tr><td>x<table><tr><td>in</table>y</td></tr></table>") == [(1, 0, ["in"]), (0, 0, ["x y".replace(" ", "")])]
    assert read("<table><tr><td>a<td rowspan=3>b<tr><tr><td>c<script>no</script>") == [(0, 0, ["a", "b"]), (0, 1, ["", "b"]), (0, 2, ["c", "b"])]
    assert read("no table <td>x</td>") == [] and read("<table><td>1<br>2</table>") == [(0, 0, ["1 2"])] and read("<table><tr></table>") == []


def test_constituents_take_the_first_table_with_all_headings(spark, tmp_path):
    page = "<table><tr><th>Symbol<tr><td>no</table><table><tr><td>notes<tr><th>x<th>GICS Sector<th>Symbol<th>Security<tr><td>1<td>Energy<td>BRK.B<td>Berk &amp; Co<tr><td>2<td></td><td>A</table><table><tr><td>Symbol<td>Security<td>GICS Sector<tr><td>no<td>no<td>no</table>"
    (tmp_path / "a.html").write_text(page)
    (tmp_path / "b.html").write_text("<p>none")
    found = tables.constituents(tables.html_files(spark, f"{tmp_path}/*.html")).drop("path").collect()
    assert {tuple(r) for r in found} == {("BRK-B", "Berk & Co", "Energy"), ("A", None, None)} and len(found) == 2
    assert tables.constituents(spark.createDataFrame([(None, None), ("x", "")], "path string, html string")).count() == 0


def book(sheets, strings=()):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(strings)}</sst>")
        for i, rows in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {space}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    strings = ["<si><t>Name</t></si>", "<si><r><t>Tick</t></r><r><t>er</t></r><rPh><t>no</t></rPh></si>", "<si><t>Weight</t></si>"]
    head = '<row r="5"><c r="A5" t="s"><v>0</v></c><c r="C5" t="s"><v>1</v></c><c r="AA5" t="s"><v>2</v></c></row>'
    rows = '<row r="1"><c t="inlineStr"><is><t>note</t></is></c></row>' + head + '<row r="7"><c r="A7" t="str"><v>One</v></c><c r="C7"><v>7</v></c><c r="AA7"><v>1.5</v></c></row><row><c r="A8" t="str"><v>Two</v></c><c r="AA8" t="e"><v>#N/A</v></c></row><row r="9"><c r="C9" t="str"><v>nameless</v></c></row>'
    (tmp_path / "a.xlsx").write_bytes(book([rows, rows], strings))
    (tmp_path / "b.xlsx").write_bytes(book(['<row r="1"><c t="inlineStr"><is><t>Name</t></is></c></row>']))
    (tmp_path / "c.xlsx").write_bytes(b"no zip")
    files = tables.workbook_files(spark, str(tmp_path))
    assert files.count() == 3
    found = tables.fund_holdings(files).drop("path").collect()
    assert set(map(tuple, found)) == {("7", "One", 1.5, None, None), (None, "Two", None, None, None)} and len(found) == 2
    cells = {(r.part, r.row): r.cells for r in tables.workbook_cells(files).filter("path like '%a.xlsx'").collect()}
    assert len(cells) == 10 and cells["sheet1", 0] == ["note"] and cells["sheet2", 4][2] == "Ticker" and len(cells["sheet1", 4]) == 27 and cells["sheet1", 7][0] == "Two"


def test_stores_that_grow(spark, tmp_path):
    old, new = "id int, total float", "id long, total double, days int, note string"
    path = str(tmp_path / "store")
    tables.append_store(spark.createDataFrame([(1, 2.5)], old), path, "id long, total double")
    tables.append_store(spark.createDataFrame([("x", 2), (None, 3)], "note string, id int"), path, new)
    assert {tuple(r) for r in tables.read_store(spark, path, new).collect()} == {(1, 2.5, None, None), (2, None, None, "x"), (3, None, None, None)}
    with pytest.raises(ValueError, match="no column more"):
        tables.append_store(spark.createDataFrame([(1, 2)], "id long, more int"), path, new)
    with pytest.raises(Exception, match="CAST"):
        tables.evolved(spark.createDataFrame([("word",)], "id string"), new).collect()


def test_prices_as_of_a_day(spark):
    rnd = random.Random(9)
    bars = [(t, FIRST + d * DAY, float(d) if d % 7 else None) for t in "AB" for d in rnd.sample(range(1500), 60)] + [("C", FIRST + 3000 * DAY, 1.0)]
    rows = [(i, rnd.choice(["A", "B", "C", "D", None]), FIRST + rnd.randint(-5, 2000) * DAY if i % 9 else None) for i in range(300)] * 2
    table = spark.createDataFrame(rows, "id int, ticker string, day date").withColumn("row", F.col("id")).withColumn("year", F.lit("x"))
    found = reviews.as_of(table, spark.createDataFrame(bars, "ticker string, ts date, close double"))
    got = found.collect()
    assert len(got) == 600 and found.columns == ["id", "ticker", "day", "row", "year", "price"] and all(r.row == r.id and r.year == "x" for r in got)
    for r in got:
        before = [(d, c) for t, d, c in bars if t == r.ticker and r.day is not None and d <= r.day and c is not None]
        assert r.price == (max(before)[1] if before else None), r


def test_reviews_in_words(spark):
    bars = spark.createDataFrame([("A", FIRST, 1000.0), ("A", FIRST + 9 * DAY, 1250.0), ("Z", FIRST, 0.0)], "ticker string, ts date, close double")
    rows = spark.createDataFrame([(1, "A", FIRST + DAY, 500.0), (2, "B", FIRST, 5.0), (3, "Z", FIRST, 0.0), (4, "A", None, 1.0), (5, "A", FIRST - DAY, None)], "id int, ticker string, day date, paid double")
    now = F.lit(FIRST + 10 * DAY)
    then = {r.id: r for r in reviews.price_reviews(rows, bars, now).collect()}
    assert (then[1].price_then, then[1].price_now, then[1].elapsed_days, then[1].change_pct) == (1000.0, 1250.0, 9, 25.0)
    assert then[1].review == "1,000.00 then, 1,250.00 now: +25.0 % in 9 days."
    assert {then[i].review for i in (2, 3, 4, 5)} == {"No comparison: a price or the day is missing."} and then[5].price_now == 1250.0
    bought = {r.id: r for r in reviews.price_reviews(rows, bars, now, paid="paid").collect()}
    assert bought[1].review == "500.00 then, 1,250.00 now: +150.0 % in 9 days." and bought[2].change_pct is None


def test_freshness_of_files(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps([{"run_created_at": "2024-01-02T03:00:00", "x": {"y": 1}}, {"run_created_at": "soon"}, {"z": 1}, {"run_created_at": "2024-01-01"}]))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "broken.json").write_text('[{"run_created_at": "2024-01-02T03:00:00"')
    (tmp_path / "object.json").write_text("{}")
    names = [f"{tmp_path}/{n}.json" for n in ("ok", "empty", "broken", "object", "gone")]
    found = {r.path.rsplit("/", 1)[1]: r for r in reviews.stored_freshness(spark, names, F.lit("2024-01-02 05:30:00").cast("timestamp_ntz")).collect()}
    assert {n: (r.exists, r["count"], r.latest_run_at, r.hours_since) for n, r in found.items()} == {
        "ok.json": (True, 4, dt.datetime(2024, 1, 2, 3), 2.5), "empty.json": (True, 0, None, None),
        "broken.json": (False, 0, None, None), "object.json": (False, 0, None, None), "gone.json": (False, 0, None, None),
    }
    assert found["ok.json"].modified_at is not None and found["gone.json"].modified_at is None
    assert reviews.stored_freshness(spark, names[-1:], F.lit("2024-01-02").cast("timestamp_ntz")).first().exists is False


def test_config_tables(spark):
    a = {"logic": "AND", "conditions": [{"indicator": "rsi", "value": 30}, {"x": [], "y": {}}], "note": None}
    b = {"logic": "AND", "conditions": [{"indicator": "rsi", "value": 30.0}, {"x": [1]}], "more": "é"}
    rows = spark.createDataFrame([(1, json.dumps(a), json.dumps(b), True), (2, json.dumps(a), json.dumps(a), None), (3, None, "{", False)], "id long, before string, after string, flag boolean")
    assert {tuple(r) for r in configs.flattened(rows, "before").collect()} == {(i, p, v) for i in (1, 2) for p, v in (("logic", '"AND"'), ("conditions[0].indicator", '"rsi"'), ("conditions[0].value", "30"), ("conditions[1].x", "[]"), ("conditions[1].y", "{}"), ("note", "null"))}
    want = {("conditions[1].x", "[]", None), ("conditions[1].x[0]", None, "1"), ("conditions[1].y", "{}", None), ("note", "null", None), ("more", None, '"é"')}
    assert {(r.path, r.before, r.after) for r in configs.differences(rows).collect()} == want
    said = {r.id: r for r in configs.summarized(rows, replaced="flag").collect()}
    assert (said[1].changes, said[2].changes, said[3].changes) == (5, 0, 0) and said[1].summary.startswith("The structure was replaced") and "- more: nothing -> \"é\"" in said[1].summary
    assert said[2].summary == "Nothing was changed: the original did best."
    kinds = {r.id: r for r in configs.described(rows, "before").collect()}
    assert kinds[1].problems == "unknown indicator None" and kinds[3].problems == "no config" and kinds[3].explanation == ""
    assert configs.tunables(rows, "before").count() == 0


def test_every_indicator_has_words():
    from barwright.operators import conditions

    assert set(conditions.WORDING) == set(conditions.REGISTRY)
    for name in conditions.REGISTRY:
        said = {conditions.describe({"indicator": name, **more}) for more in ({}, {"direction": "bearish"}, {"direction": "down"}, {"direction": "dead"}, {"period": None})}
        assert all(said) and not any("{" in s for s in said)
    assert conditions.describe({"indicator": "rsi", "period": 7, "op": ">", "value": 70.5}) == "RSI(7) > 70.5"
    assert conditions.describe({"indicator": "macd_cross", "direction": "dead", "zone": "above_zero"}) == "MACD crosses its signal downwards above zero"
    assert strategy.explain({"expression": "close > 1"}) == "In the market while close > 1" and conditions.describe({}) == "condition"


def test_themes(spark):
    rows = spark.createDataFrame([("chips", "Tech", None), ("chips", "Tech", None), ("all", "Tech", None), ("all", "Energy", None), ("space", None, "RKT"), ("space", None, "A"), ("none", None, None), ("odd", "Void", "A")], "theme string, sector string, ticker string")
    stocks = spark.createDataFrame([("A", "Tech"), ("B", "Tech"), ("C", "Energy"), (None, "Tech"), ("D", None), ("A", "Tech")], "ticker string, sector string")
    assert sorted(map(tuple, themes.candidates(rows, stocks).collect())) == [("all", "A"), ("all", "B"), ("all", "C"), ("chips", "A"), ("chips", "B"), ("space", "A"), ("space", "RKT")]
    named = spark.createDataFrame([("chips", "Tech"), ("space", None), ("oil", "Energy")], "theme string, cycle_sector string")
    better = spark.createDataFrame([("expansion", "Tech"), ("slowdown", "Energy"), ("expansion", "Tech")], "phase string, sector string")
    phase, snap = spark.createDataFrame([("expansion",)], "phase string"), spark.createDataFrame([("bull",)], "regime string")
    found = {r.theme: tuple(r)[2:] for r in themes.context(named, phase, better, snap).collect()}
    assert found == {"chips": ("bull", "expansion", True), "space": ("bull", "expansion", None), "oil": ("bull", "expansion", False)}
    none = themes.context(named, phase.filter("false"), better, snap.filter("false")).collect()
    assert {tuple(r)[2:] for r in none} == {(None, None, None)} and len(none) == 3


def test_configs_are_read_once_a_batch_by_many_tasks(spark, tmp_path):
    from pyspark import TaskContext

    texts = ['{"a": 1, "b": [2, 3]}', None, "no JSON", "{}", '{"a": 1.5}']
    rows = [(i if i % 97 else None, texts[i % 5]) for i in range(5000)]
    frame = spark.createDataFrame(rows, "id long, config string").coalesce(1)
    want = {0: [("a", "1"), ("b[0]", "2"), ("b[1]", "3")], 3: [("", "{}")], 4: [("a", "1.5")]}
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, configs.flattened(frame).collect()), key=key) == sorted(((i, *x) for n, (i, _) in enumerate(rows) for x in want.get(n % 5, [])), key=key)
    assert configs.flattened(frame.filter("config is null")).count() == configs.flattened(frame.limit(0)).count() == 0

    def seen(text, c):
        (tmp_path / f"{TaskContext.get().partitionId()}-{hash(text)}").open("a").write(".")
        return [(0,)]

    assert configs._per_config(frame, "config", "x int", seen).count() == 5000
    calls = [p.stat().st_size for p in tmp_path.iterdir()]
    assert max(calls) == 1 and len({p.name.split("-")[0] for p in tmp_path.iterdir()}) > 1
