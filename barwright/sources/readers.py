"""Readers of macro series, fundamentals, filings and fund holdings, with fixed schemas; writers of snapshots."""

from __future__ import annotations

import io
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.holdings import from_filing, member_ticker

FUNDAMENTALS = "ticker string, name string, sector string, per double, pbr double, market_cap double, earnings_growth double, fcf double, total_cash double, total_debt double"
#: Column names of holdings files, exact or contained, lower case, in order of assignment.
ALIASES = {
    "ticker": ("ticker", "symbol", "종목코드", "티커", "코드"), "weight": ("weight_pct", "weight", "비중(%)", "비중", "구성비중", "구성비율"), "shares": ("shares held", "shares", "보유수량", "수량"),
    "sector": ("sector", "섹터", "업종"), "name": ("name", "종목명", "구성종목", "company", "종목"),
}


def number(x: Column) -> Column:
    """A number written with currency signs, thousands separators or per cents; null if it isn't one."""
    return F.regexp_replace(x.cast("string"), r"[$,%\s]", "").try_cast("double")


def macro_series(spark: SparkSession, path: str) -> DataFrame:
    """(series, ts, value) of files named fred_<series>.csv, each a date and a value a line; `path` may be a glob."""
    rows = spark.read.schema("ts string, value string").option("header", True).option("enforceSchema", True).csv(path).withColumn("file", F.input_file_name())
    return rows.select(F.regexp_extract("file", r"fred_(\w+)\.csv", 1).alias("series"), F.col("ts").try_cast("date").alias("ts"), number(F.col("value")).alias("value"))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, name, sector) of a constituents CSV with Symbol, Security and Sector; dots in tickers become dashes."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.translate("Symbol", ".", "-").alias("ticker"), F.col("Security").alias("name"), F.col("Sector").alias("sector"))


def fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document a ticker and line; fields that are missing are null."""
    return spark.read.schema(FUNDAMENTALS).json(path)


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    """Appends a snapshot with the time it was computed."""
    snapshot.withColumn("computed_at", F.current_timestamp()).write.mode("append").parquet(path)


def filing(spark: SparkSession, path: str) -> DataFrame:
    """A holdings filing's XML information table by issuer, with weights; `path` names one or many files."""
    schema = "nameOfIssuer string, value long, shrsOrPrnAmt struct<sshPrnamt: long>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "infoTable").option("ignoreNamespace", True).load(path)
    return from_filing(rows.select(F.input_file_name().alias("filing"), F.col("nameOfIssuer").alias("issuer_name"), F.col("shrsOrPrnAmt.sshPrnamt").alias("shares"), F.col("value").alias("value_thousands")))


def fund_csv(spark: SparkSession, path: str, fund: str) -> DataFrame:
    """A fund's daily holdings CSV: date (m/d/Y), fund, company, ticker, shares, market value, weight; heaviest first."""
    rows = spark.read.schema("date string, fund string, company string, ticker string, cusip string, shares string, value string, weight string").option("header", True).option("enforceSchema", True).csv(path)
    out = rows.filter(F.upper("fund") == fund.upper()).select(
        F.try_to_date("date", "M/d/yyyy").alias("filing_date"), F.col("company").alias("issuer_name"), F.nullif(F.trim("ticker"), F.lit("")).alias("ticker"), number(F.col("shares")).alias("shares"), number(F.col("value")).alias("value"), number(F.col("weight")).alias("weight_pct")
    )
    return out.orderBy(F.desc_nulls_last("weight_pct"), "issuer_name")


def guessed_columns(names: Sequence[str]) -> dict[str, str]:
    """Which column of a holdings file is what: an exact alias before a contained one, no column twice."""
    low, out = {n: str(n).strip().lower() for n in names}, {}
    for target, aliases in ALIASES.items():
        free = [n for n in names if n not in out.values()]
        hit = next((n for a in aliases for n in free if low[n] == a), None) or next((n for a in aliases for n in free if a in low[n]), None)
        if hit is not None:
            out[target] = hit
    return out


def uploaded_holdings(spark: SparkSession, data: bytes, filename: str) -> DataFrame:
    """(ticker, name, sector, shares, weight) of one uploaded CSV or spreadsheet, whose header is in the first rows.

    The header is the row among the first eight that explains most columns. A spreadsheet needs an Excel engine. The
    file is one person's upload and is parsed on the driver.
    """
    read = (lambda skip: pd.read_excel(io.BytesIO(data), header=skip, dtype=str)) if filename.lower().endswith((".xls", ".xlsx")) else (lambda skip: pd.read_csv(io.BytesIO(data), skiprows=skip, dtype=str, encoding_errors="replace", on_bad_lines="skip"))
    best: tuple[int, pd.DataFrame | None, dict] = (0, None, {})
    for skip in range(8):
        try:
            frame = read(skip)
        except (ValueError, pd.errors.ParserError):
            continue
        found = guessed_columns(list(frame.columns))
        if len(found) > best[0]:
            best = (len(found), frame, found)
    if best[1] is None or not {"ticker", "name"} & best[2].keys():
        raise ValueError("no holdings table found")
    rows = pd.DataFrame({t: best[1][best[2][t]] if t in best[2] else None for t in ("ticker", "name", "sector", "shares", "weight")}).astype(object)
    rows = rows.where(rows.notna(), None)
    out = spark.createDataFrame(list(rows.itertuples(index=False, name=None)), "ticker string, name string, sector string, shares string, weight string")
    keep = F.col("ticker").isNotNull() | F.col("name").isNotNull()
    return out.filter(keep).withColumn("ticker", F.upper(F.trim("ticker"))).withColumn("shares", number(F.col("shares"))).withColumn("weight", number(F.col("weight")))


def historical_constituents(spark: SparkSession, path: str) -> DataFrame:
    """(date, tickers) of a CSV with a date and a quoted comma list a line."""
    rows = spark.read.schema("date string, tickers string").option("header", True).option("enforceSchema", True).csv(path)
    parts = F.filter(F.transform(F.split("tickers", ","), member_ticker), lambda t: t != "")
    return rows.select(F.col("date").try_cast("date").alias("date"), F.array_sort(F.array_distinct(parts)).alias("tickers")).filter("date is not null")


def latest_filing(forms: Column, accessions: Column, prefix: str = "13F-HR") -> Column:
    """The accession of the first form with a prefix, from two parallel arrays."""
    hits = F.filter(F.arrays_zip(forms.alias("f"), accessions.alias("a")), lambda x: x["f"].startswith(prefix))
    return F.try_element_at(hits, F.lit(1))["a"]
