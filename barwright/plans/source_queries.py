"""Registered queries of sources, of configs held in tables, of reviews by price and of themes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import configs, reviews, themes
from ..sources import coverage, tables
from .queries import BARS, _bars, _r, _t, query


def _number(brand: str = "ticker"):
    return F.substring(brand, 7, 9).cast("int")


# ------------------------------------------------------------ what a store lacks
@query(f"""WITH {BARS}, d AS (SELECT ticker, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY ticker ORDER BY ts) <= 5 THEN 0 ELSE 1 END AS new FROM bars), r AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM d),
 co AS (SELECT ticker, min(ts) AS low, max(ts) AS high FROM r GROUP BY ticker, run), fi AS (SELECT ticker, min(low) AS first, max(high) AS last FROM co GROUP BY ticker),
 a0 AS (SELECT ticker, CAST(substr(ticker, 7) AS INT) AS n FROM (SELECT DISTINCT ticker FROM bars) UNION ALL SELECT n_name, n_nationkey FROM nation),
 a1 AS (SELECT a0.ticker, first, last, CASE n % 3 WHEN 1 THEN DATE '1994-06-01' WHEN 2 THEN DATE '1996-01-01' END AS start, n % 2 = 0 AND first IS NOT NULL AS whole FROM a0 LEFT JOIN fi USING (ticker)),
 a AS (SELECT ticker, last, DATE '2001-12-31' AS z, coalesce(CASE WHEN whole THEN greatest(coalesce(start, first), first) ELSE start END, DATE '0001-01-01') AS s FROM a1),
 g AS (SELECT a.ticker, greatest(s, coalesce(lag(high) OVER (PARTITION BY a.ticker ORDER BY low) + 1, s)) AS lo, least(z, low - 1) AS hi FROM a JOIN co ON co.ticker = a.ticker
  UNION ALL SELECT ticker, CASE WHEN last IS NULL THEN s ELSE greatest(s, last + 1) END, z FROM a)
 SELECT ticker, CASE WHEN lo > DATE '0001-01-01' THEN lo END AS low, hi AS high FROM g WHERE lo <= hi""")
def missing_history(spark, sf):
    """The days that would have to be fetched: what each brand's bars leave open in what is asked for, and all of nations, which have none."""
    d = _bars(spark, sf)
    covered = coverage.of_bars(d)
    names = d.select("ticker", _number().alias("n")).distinct().unionByName(_t(spark, sf, "nation").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").cast("int").alias("n")))
    start = F.when(F.col("n") % 3 == 1, "1994-06-01").when(F.col("n") % 3 == 2, "1996-01-01").cast("date")
    asked = names.select("ticker", start.alias("start"), F.lit("2002-01-01").cast("date").alias("end"))
    return coverage.missing(asked, covered, names.filter("n % 2 = 0").select("ticker"))


@query("""SELECT o_orderkey AS id, o_totalprice AS total, CAST(NULL AS INTEGER) AS max_holding_days, CAST(NULL AS VARCHAR) AS note FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_orderkey, o_totalprice, CAST(o_custkey % 200 AS INTEGER), o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0""")
def evolved_rows(spark, sf):
    """Rows from before two columns were added and from after, in one schema."""
    schema = "id long, total double, max_holding_days int, note string"
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), (F.col("o_custkey") % 200).cast("short").alias("max_holding_days"), F.col("o_orderpriority").alias("note"))
    old, new = o.filter("id % 3 = 0").select("id", "total"), o.filter("id % 3 <> 0").select("note", "max_holding_days", "total", "id")
    return tables.evolved(old, schema).unionByName(tables.evolved(new, schema))


# ------------------------------------------------------------ tables in files
def _pages(spark, sf):
    """Pages of 50 parts each, as tables whose sector spans all rows of a page."""
    p = _t(spark, sf, "part").withColumn("page", F.floor(F.col("p_partkey") / 50))
    cells = F.concat(F.lit("<td>P."), "p_partkey", F.lit("<td> "), F.replace("p_name", F.lit(" "), F.lit(" &amp;\n ")), F.lit("</td>"))
    rows = p.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("cells")))).alias("rows"))
    head = "<p>Members</p><table><tr><td>no members</table><table class=x><thead><tr><th>Symbol<th>Security</th><th>GICS Sector</tr></thead><tbody>"
    sector = lambda x, i: F.concat(F.lit("<tr>"), x["cells"], F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("rows"), F.lit(">Sector "), F.col("page"))).otherwise(""))
    return rows.select(F.concat(F.lit("page-"), "page").alias("path"), F.concat(F.lit(head), F.array_join(F.transform("rows", sector), "\n"), F.lit("</table>")).alias("html"))


@query("SELECT 'page-' || (p_partkey // 50) AS path, 'P-' || p_partkey AS ticker, replace(p_name, ' ', ' & ') AS name, 'Sector ' || (p_partkey // 50) AS sector FROM part")
def html_constituents(spark, sf):
    """An index's members out of HTML tables."""
    return tables.constituents(_pages(spark, sf))


def _workbook(rows: list[tuple]) -> bytes:
    """A fund's workbook: four rows of notes, then headings, then rows (ticker, name, weight, shares); names are shared strings."""
    names = sorted({r[1] for r in rows} | {"Name", "Ticker", "Weight", "Shares Held"})
    at = {n: i for i, n in enumerate(names)}
    shared = lambda column, row, text: f'<c r="{column}{row}" t="s"><v>{at[text]}</v></c>'
    lines = [f'<row r="1"><c r="A1" t="inlineStr"><is><t>{len(rows)} holdings</t></is></c></row>']
    lines += ['<row r="5">' + shared("A", 5, "Name") + shared("B", 5, "Ticker") + shared("D", 5, "Weight") + shared("E", 5, "Shares Held") + "</row>"]
    for i, (ticker, name, weight, shares) in enumerate(rows, 6):
        lines.append(f'<row r="{i}">{shared("A", i, name)}<c r="B{i}" t="str"><v>{escape(ticker)}</v></c><c r="D{i}"><v>{weight!r}</v></c><c r="E{i}"><v>{shares}</v></c></row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><r><t>{escape(n)}</t></r></si>" for n in names) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()


@query("SELECT 'fund-' || (p_partkey // 40) || '.xlsx' AS path, p_brand AS ticker, p_name || ' & ' || p_partkey AS name, p_retailprice / 100 AS weight_pct, CAST(p_size AS DOUBLE) AS shares, CAST(NULL AS VARCHAR) AS sector FROM part")
def fund_workbooks(spark, sf):
    """Holdings out of workbooks of 40 parts each, whose headings are in the fifth row."""
    row = F.struct(F.col("p_brand").alias("a"), F.concat("p_name", F.lit(" & "), "p_partkey").alias("b"), (F.col("p_retailprice") / 100).alias("c"), F.col("p_size").alias("d"))
    funds = _t(spark, sf, "part").groupBy(F.concat(F.lit("fund-"), F.floor(F.col("p_partkey") / 40), F.lit(".xlsx")).alias("path")).agg(F.collect_list(row).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            books = [_workbook([tuple(x.values()) for x in rows]) for rows in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(books, pa.binary())], ["path", "content"])

    return tables.fund_holdings(funds.mapInArrow(run, "path string, content binary"))


# ------------------------------------------------------------ reviews and freshness
@query("""WITH o AS (SELECT o_custkey AS id, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS made FROM orders), g AS (SELECT id, count(*) AS n, max(made) AS latest FROM o GROUP BY id)
 SELECT id, id % 10 > 1 AS "exists", CASE WHEN id % 10 > 1 THEN latest END AS latest_run_at, CAST(CASE WHEN id % 10 > 1 THEN n ELSE 0 END AS INTEGER) AS count, CASE WHEN id % 10 > 1 THEN round(date_diff('second', latest, TIMESTAMP '2002-01-01') / 3600.0, 6) END AS hours_since FROM g""")
def leaderboard_freshness(spark, sf):
    """How old the newest of each customer's stored results is; some files are broken or gone, some times can't be read."""
    stamp = F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    text = F.to_json(F.collect_list(F.struct(F.col("o_orderkey").alias("run_id"), stamp.alias("run_created_at"))))
    files = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(text.alias("text"))
    files = files.withColumn("content", F.when(F.col("id") % 10 == 0, F.expr("substring(text, 1, length(text) - 1)")).when(F.col("id") % 10 != 1, F.col("text")))
    found = reviews.freshness(files, F.lit("2002-01-01").cast("timestamp_ntz"))
    return found.select("id", "exists", "latest_run_at", "count", _r("hours_since").alias("hours_since"))


@query(f"""WITH {BARS}, n AS (SELECT ticker, ts, c, lead(ts) OVER (PARTITION BY ticker ORDER BY ts) AS until FROM bars), o AS (SELECT o_orderkey AS id, 'Brand#' || (o_custkey % 30) AS ticker, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
 p AS (SELECT o.*, n.c AS price_then FROM o LEFT JOIN n ON n.ticker = o.ticker AND n.ts <= day AND (until IS NULL OR day < until)), l AS (SELECT ticker, arg_max(c, ts) AS price_now FROM bars WHERE ts <= DATE '2000-06-30' GROUP BY ticker)
 SELECT id, p.ticker, price_then, price_now, CAST(DATE '2000-06-30' - day AS INTEGER) AS elapsed_days, round((price_now / price_then - 1) * 100, 4) AS change_pct FROM p LEFT JOIN l ON l.ticker = p.ticker""")
def price_reviews(spark, sf):
    """What became of every order's brand since its day; some brands have no bars, some orders no day."""
    o = _t(spark, sf, "orders")
    day = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("date"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Brand#"), F.col("o_custkey") % 30).alias("ticker"), day.alias("day"))
    found = reviews.price_reviews(rows, _bars(spark, sf), F.lit("2000-06-30").cast("date"))
    return found.select("id", "ticker", "price_then", "price_now", "elapsed_days", _r("change_pct", 4).alias("change_pct"))


# ------------------------------------------------------------ configs in tables
def _versions(spark, sf):
    """Two versions of a config for each part: numbers that differ, are written differently, and conditions that went."""
    before = """concat('{"logic": "AND", "conditions": [{"indicator": "rsi", "op": "<", "value": ', p_size, '}, {"indicator": "ma_cross", "short": 10, "long": 30}]}') AS before"""
    after = """CASE WHEN p_size % 13 = 0 THEN NULL ELSE concat('{"logic": "AND", "conditions": [{"indicator": "rsi", "op": "<", "value": ', CASE WHEN p_size % 7 = 0 THEN concat(p_size, '.0') ELSE concat(p_size, '.5') END, '}',
      CASE WHEN p_size % 11 = 0 THEN '' ELSE concat(', {"indicator": "ma_cross", "short": ', CASE WHEN p_size % 5 = 0 THEN 12 ELSE 10 END, ', "long": 30}') END, ']}') END AS after"""
    return _t(spark, sf, "part").selectExpr("p_partkey AS id", "p_size % 3 = 0 AS replaced", before, after)


DIFFS = """v AS (SELECT p_partkey AS id, p_size AS s FROM part), d AS (
 SELECT id, 'conditions[0].value' AS path, CAST(s AS VARCHAR) AS before, CASE WHEN s % 13 <> 0 THEN s || '.5' END AS after FROM v WHERE s % 13 = 0 OR s % 7 <> 0
 UNION ALL SELECT id, 'conditions[1].short', '10', '12' FROM v WHERE s % 5 = 0 AND s % 11 <> 0 AND s % 13 <> 0
 UNION ALL SELECT id, path, x, NULL FROM v, (VALUES ('conditions[1].indicator', '"ma_cross"'), ('conditions[1].short', '10'), ('conditions[1].long', '30')) q(path, x) WHERE s % 11 = 0 OR s % 13 = 0
 UNION ALL SELECT id, path, x, NULL FROM v, (VALUES ('logic', '"AND"'), ('conditions[0].indicator', '"rsi"'), ('conditions[0].op', '"<"')) q(path, x) WHERE s % 13 = 0)"""


@query(f"WITH {DIFFS} SELECT * FROM d")
def config_differences(spark, sf):
    """Where two versions of each part's config differ."""
    return configs.differences(_versions(spark, sf))


@query(f"""WITH {DIFFS}, l AS (SELECT id, count(*) AS n, string_agg('- ' || path || ': ' || before || ' -> ' || coalesce(after, 'nothing'), chr(10) ORDER BY path) AS lines FROM d GROUP BY id)
 SELECT v.id, coalesce(n, 0) AS changes, CASE WHEN s % 3 = 0 THEN 'The structure was replaced; only values in the same places are compared.' || chr(10) ELSE '' END || CASE WHEN n IS NULL THEN 'Nothing was changed: the original did best.' ELSE 'Changed:' || chr(10) || lines END AS summary FROM v LEFT JOIN l ON l.id = v.id""")
def config_summaries(spark, sf):
    """The differences in words."""
    return configs.summarized(_versions(spark, sf), replaced="replaced")


@query("""WITH p AS (SELECT p_partkey AS id, path, indicator, key, CASE WHEN original = 14 THEN 5 + p_size ELSE original END AS original, category FROM part, (VALUES ('entry_stages[0].conditions[0]', 'rsi_cross', 'period', 14.0, 'period'), ('entry_stages[0].conditions[0]', 'rsi_cross', 'level', 30.0, 'threshold'),
  ('entry_stages[1].conditions[0]', 'bollinger', 'period', 20.0, 'period'), ('entry_stages[1].conditions[0]', 'bollinger', 'std_dev', 2.0, 'band'), ('exit_stages[0].conditions[0]', 'bbw_squeeze_release', 'threshold', 0.1, 'ratio'),
  ('entry_stages[0]', '', 'weight', 0.4, 'weight'), ('entry_stages[1]', '', 'weight', 0.6, 'weight')) v(path, indicator, key, original, category) WHERE p_partkey % 5 <> 0),
 s(style, lo, hi) AS (VALUES ('leader', 0.3, 0.8), ('growth', 0.8, 2.0), ('value', 0.8, 1.5), ('cyclical', 0.7, 1.3), ('defensive', 1.0, 2.0), ('quality', 1.0, 2.5)), w AS (SELECT *, greatest(round(original * 0.3, 3), 0.02) AS width, CAST(original AS DOUBLE) * CAST(lo AS DOUBLE) AS x, CAST(original AS DOUBLE) * CAST(hi AS DOUBLE) AS y FROM p, s)
 SELECT id, path, indicator, key, CAST(original AS DOUBLE) AS original, category, style, CAST(CASE category WHEN 'period' THEN greatest(2, round_even(x, 0)) WHEN 'band' THEN original - 0.5 WHEN 'threshold' THEN original - 10 ELSE original - width END AS DOUBLE) AS low,
 CAST(CASE category WHEN 'period' THEN greatest(greatest(2, round_even(x, 0)) + 1, round_even(y, 0)) WHEN 'band' THEN original + 0.5 WHEN 'threshold' THEN original + 10 ELSE original + width END AS DOUBLE) AS high FROM w""")
def tunable_parameters(spark, sf):
    """What the search would vary in each part's staged config, and how far; every fifth config can't be used."""
    text = """concat('{"entry_stages": [{"weight": 0.4, "conditions": [{"indicator": "rsi_cross", "period": ', 5 + p_size, ', "level": 30}]}, {"weight": 0.6, "conditions": [{"indicator": "bollinger", "period": 20, "std_dev": 2.0}]}],
      "exit_stages": [', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '{"conditions": [{"indicator": "bbw_squeeze_release", "threshold": 0.1}]}' END, ']}') AS config"""
    return configs.tunables(_t(spark, sf, "part").selectExpr("p_partkey AS id", text))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 8 AS k, p_size AS n FROM part)
 SELECT id, CASE k WHEN 1 THEN 'staged' WHEN 2 THEN 'expression' WHEN 3 THEN 'combined' ELSE 'regime' END AS kind,
 CASE k WHEN 4 THEN 'conditions must not be empty' WHEN 5 THEN 'unknown indicator ''moon''' WHEN 6 THEN 'not JSON: Expecting value: line 1 column 1 (char 0)' WHEN 7 THEN 'no config' ELSE '' END AS problems,
 CASE k WHEN 0 THEN 'In the market while RSI(14) < ' || n || ' or the 10-bar sma is above the 30-bar one'
  WHEN 1 THEN 'Enter 30% when RSI(' || n || ') crosses 30 upwards, then 70% when the close falls below the cloud' || chr(10) || 'Leave in stages when volume is at least 2 times its 20-bar mean; the last one leaves altogether' || chr(10) || 'Leave at once when an evening star' || chr(10) || 'Stop at the lowest low of 20 bars, target at 2.5 times that distance'
  WHEN 2 THEN 'In the market while close > sma(close, ' || n || ')'
  WHEN 3 THEN 'In the market while all of 2 strategies are:' || chr(10) || '1. In the market while close > ' || n || chr(10) || '2. In the market while a long-legged doji' ELSE '' END AS explanation FROM p""")
def strategy_texts(spark, sf):
    """Kinds, problems and explanations of each part's config, of all four schemas and none."""
    text = """CASE p_partkey % 8
     WHEN 0 THEN concat('{"logic": "OR", "conditions": [{"indicator": "rsi", "op": "<", "value": ', p_size, '}, {"indicator": "ma_cross", "short": 10, "long": 30}]}')
     WHEN 1 THEN concat('{"entry_stages": [{"weight": 0.3, "conditions": [{"indicator": "rsi_cross", "period": ', p_size, '}]}, {"weight": 0.7, "conditions": [{"indicator": "ichimoku_cloud_break", "direction": "down"}]}], "exit_stages": [{"conditions": [{"indicator": "volume_spike"}]}],',
      '"emergency_exit": {"conditions": [{"indicator": "star_pattern", "direction": "bearish"}]}, "stop_loss": {"source": "lowest_low"}, "take_profit": {"multiple": 2.5}}')
     WHEN 2 THEN concat('{"expression": "close > sma(close, ', p_size, ')"}')
     WHEN 3 THEN concat('{"combine": "and", "strategies": [{"expression": "close > ', p_size, '"}, {"conditions": [{"indicator": "doji", "doji_type": "long_legged"}]}]}')
     WHEN 4 THEN '{"conditions": []}' WHEN 5 THEN '{"conditions": [{"indicator": "moon"}]}' WHEN 6 THEN 'buy low' END AS config"""
    return configs.described(_t(spark, sf, "part").selectExpr("p_partkey AS id", text))


# ------------------------------------------------------------ themes
THEMES = """SELECT r_name AS theme, CASE r_regionkey WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'none such' END AS sector, CAST(NULL AS STRING) AS ticker FROM {region}
 UNION ALL SELECT r_name, 'LARGE', NULL FROM {region} WHERE r_regionkey < 2 UNION ALL SELECT n_name, NULL, concat('P', n_nationkey * 7) FROM {nation}"""


@query("""WITH t AS (SELECT r_name AS theme, CASE r_regionkey WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' END AS sector FROM region WHERE r_regionkey < 2 UNION ALL SELECT r_name, 'LARGE' FROM region WHERE r_regionkey < 2)
 SELECT theme, 'P' || p_partkey AS ticker FROM t JOIN part ON p_type = sector UNION ALL SELECT n_name, 'P' || (n_nationkey * 7) FROM nation""")
def theme_candidates(spark, sf):
    """The stocks of themes: parts by type for some regions, tickers that nations name; other regions have none."""
    rows = spark.sql(THEMES, region=_t(spark, sf, "region"), nation=_t(spark, sf, "nation"))
    return themes.candidates(rows, _t(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("ticker"), F.col("p_type").alias("sector")))


@query("""WITH s AS (SELECT min(r_name) AS market_regime FROM region), p AS (SELECT CASE WHEN max(o_orderkey) % 2 = 0 THEN 'expansion' ELSE 'slowdown' END AS phase FROM orders), f AS (SELECT DISTINCT CASE WHEN p_type < 'M' THEN 'expansion' ELSE 'slowdown' END AS phase, p_type AS sector FROM part),
 t AS (SELECT n_name AS theme, CASE n_nationkey % 4 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' WHEN 2 THEN 'none such' END AS cycle_sector FROM nation)
 SELECT theme, cycle_sector, market_regime, p.phase, CASE WHEN cycle_sector IS NOT NULL THEN EXISTS (SELECT 1 FROM f WHERE f.phase = p.phase AND f.sector = cycle_sector) END AS is_favoured FROM t, s, p""")
def theme_context(spark, sf):
    """Each theme's sector, the market's regime and phase, and whether the phase favours the sector."""
    k = F.col("n_nationkey") % 4
    rows = _t(spark, sf, "nation").select(F.col("n_name").alias("theme"), F.when(k == 0, "ECONOMY").when(k == 1, "PROMO").when(k == 2, "none such").alias("cycle_sector"))
    phase = _t(spark, sf, "orders").agg(F.when(F.max("o_orderkey") % 2 == 0, "expansion").otherwise("slowdown").alias("phase"))
    favoured = _t(spark, sf, "part").select(F.when(F.col("p_type") < "M", "expansion").otherwise("slowdown").alias("phase"), F.col("p_type").alias("sector"))
    return themes.context(rows, phase, favoured, _t(spark, sf, "region").agg(F.min("r_name").alias("regime")))
