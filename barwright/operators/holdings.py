"""Fund holdings: issuer names, common holdings, point-in-time members; and tickers in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Abbreviations in filings and what they stand for; tokens that hinder a search; company suffixes.
ABBREVIATIONS = {"PETE": "PETROLEUM", "FINL": "FINANCIAL", "LTD": "LIMITED", "INTL": "INTERNATIONAL", "GRP": "GROUP", "HLDGS": "HOLDINGS", "HLDG": "HOLDING", "TECHS": "TECHNOLOGIES", "IND": "INDUSTRIES", "MTG": "MORTGAGE", "BK": "BANK"}
NOISE = ("SWITZ", "MTN", "BE", "DEB", "NOTE", "NOTES", "BOND", "COM", "NEW")
SUFFIXES = ("CORP", "CO", "INC", "LTD", "LIMITED", "PLC", "SA", "AG", "COMPANY", "INCORPORATED")
#: Upper-case words that look like tickers and aren't.
NOT_TICKERS = "A I THE AND OR IF IS IT TO OF ON IN FOR BUY SELL ALL NEW CEO IPO ETF USD GDP EPS PER PBR ATH YOY QOQ FOMO YOLO DD IMO".split()


def normal_name(name: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(name, r"\s+", " ")))


def _words(name: Column) -> Column:
    return F.split(name, " ")


def expanded(name: Column) -> Column:
    """Abbreviations spelled out, word by word."""
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(_words(name), lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def without(name: Column, words: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(_words(name), lambda w: ~w.isin(*words)), " ")


def candidate_names(name: Column) -> Column:
    """Names to search an issuer by, in order, distinct: as filed, spelled out, without noise, without suffixes."""
    first = F.regexp_replace(normal_name(name), "BANK AMERICA", "BANK OF AMERICA")
    second = expanded(first)
    third = without(second, NOISE)
    return F.filter(F.array_distinct(F.array(first, second, third, without(third, SUFFIXES))), lambda x: x != "")


def resolve(holdings: DataFrame, lookup: DataFrame) -> DataFrame:
    """holdings with the ticker of the first candidate name that `lookup` (name, ticker) knows; null if none."""
    names = holdings.withColumn("_row", F.xxhash64(*holdings.columns)).select("*", F.posexplode_outer(candidate_names(F.col("issuer_name"))).alias("_i", "_name"))
    found = names.join(lookup.select(F.col("name").alias("_name"), F.col("ticker").alias("_ticker")), "_name", "left")
    best = found.groupBy("_row").agg(F.min_by("_ticker", F.when(F.col("_ticker").isNotNull(), F.col("_i"))).alias("ticker"))
    return holdings.drop("ticker").withColumn("_row", F.xxhash64(*holdings.columns)).join(best, "_row").drop("_row")


def from_filing(entries: DataFrame) -> DataFrame:
    """A filing's rows (filing, issuer_name, shares, value_thousands) by issuer: shares, value, weight_pct, largest first."""
    rows = entries.groupBy("filing", normal_name(F.col("issuer_name")).alias("issuer_name")).agg(F.sum("shares").alias("shares"), (F.sum("value_thousands") * 1000).alias("value"))
    total = F.sum("value").over(Window.partitionBy("filing"))
    return rows.withColumn("weight_pct", F.round(F.try_divide(F.col("value"), F.nullif(total, F.lit(0))) * 100, 4)).orderBy("filing", F.desc("value"), "issuer_name")


def common(holdings: DataFrame, holders: list[str], holder: str = "guru_name") -> DataFrame:
    """(ticker, total_weight) of what all the named holders (two at least) have; rows without a ticker don't count."""
    names = sorted(set(holders))
    if len(names) < 2:
        return holdings.select("ticker", F.lit(0.0).alias("total_weight")).limit(0)
    rows = holdings.filter(F.col(holder).isin(names) & F.col("ticker").isNotNull())
    sums = rows.groupBy("ticker", holder).agg(F.sum(F.coalesce("weight_pct", F.lit(0.0))).alias("w")).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("w").alias("total_weight"))
    return sums.filter(F.col("n") == len(names)).select("ticker", "total_weight").orderBy(F.desc("total_weight"), "ticker")


def sync(stored: DataFrame, fresh: DataFrame, holder: str = "guru_name") -> DataFrame:
    """stored with the fresh holders' rows in place of their old ones."""
    return stored.join(fresh.select(holder).distinct(), holder, "left_anti").unionByName(fresh)


def last_sync(holdings: DataFrame, holder: str = "guru_name") -> DataFrame:
    return holdings.groupBy(holder).agg(F.max("filing_date").alias("last_filing"))


def member_ticker(raw: Column) -> Column:
    """A constituent's ticker without its leaving date, with dashes for dots."""
    return F.translate(F.regexp_replace(F.trim(raw), r"-\d{6}$", ""), ".", "-")


def constituents(table: DataFrame) -> DataFrame:
    """(date, tickers): comma lists as sorted arrays of distinct tickers."""
    parts = F.filter(F.transform(F.split("tickers", ","), member_ticker), lambda t: t != "")
    return table.select(F.col("date").cast("date").alias("date"), F.array_sort(F.array_distinct(parts)).alias("tickers"))


def members_as_of(table: DataFrame, days: DataFrame) -> DataFrame:
    """(day, tickers): the last list at or before each day, else the earliest list there is.

    A list holds until the next one's date; lists are few (one a change of an index), days may be many. Both meet by
    year, in each of which a list that holds then has a row.
    """
    until = F.lead("date").over(Window.partitionBy(F.lit(1)).orderBy("date"))
    ends = days.agg(F.year(F.max("day")).alias("_last")).crossJoin(table.agg(F.min_by("tickers", "date").alias("_first")))
    lists = table.select("date", "tickers").withColumn("_until", until).crossJoin(F.broadcast(ends.select("_last")))
    through = F.greatest(F.year("date"), F.least(F.coalesce(F.year("_until"), "_last"), "_last"))
    lists = lists.withColumn("_year", F.explode(F.sequence(F.year("date"), through))).drop("_last")
    found = days.withColumn("_year", F.year("day")).join(lists, "_year", "left").filter("date is null or (day >= date and (_until is null or day < _until))")
    asked = days.join(found.select("day", "tickers").filter("tickers is not null").dropDuplicates(["day"]), "day", "left")
    return asked.crossJoin(F.broadcast(ends.select("_first"))).select("day", F.coalesce("tickers", "_first").alias("tickers"))


def tickers_in(text: Column) -> Column:
    """Sorted distinct words of one to five capitals, with or without a dollar sign, that aren't common words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(\$?\b[A-Z]{1,5}\b)"), 1), lambda t: F.regexp_replace(t, r"\$", ""))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, NOT_TICKERS))))


def summaries(posts: DataFrame, snippet: int = 200) -> DataFrame:
    """posts with the tickers in their text and its first characters, white space being single spaces; dots mark a cut.

    A null text has no tickers and an empty line.
    """
    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return posts.withColumn("tickers", tickers_in(F.coalesce("text", F.lit("")))).withColumn("snippet", F.when(F.length(line) > snippet, F.concat(F.substring(line, 1, snippet), F.lit("..."))).otherwise(line))


def recent_with(summaries: DataFrame, ticker: str | None = None, limit: int = 200) -> DataFrame:
    """The newest `limit` summaries, then of these the ones with the ticker: the limit comes first."""
    newest = summaries.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return newest.filter(F.array_contains("tickers", ticker)) if ticker else newest


def tracked_tickers(summaries: DataFrame) -> DataFrame:
    return summaries.select(F.explode("tickers").alias("ticker")).distinct().orderBy("ticker")


def weekly_digest(summaries: DataFrame, days: int = 7, most: int = 1000) -> DataFrame:
    """(ticker, part, period_start, period_end, post_count, report_text): posts by ticker in the days before the newest one.

    The text is a bullet for each post in their order, in numbered parts of at most `most` posts, so that no ticker's posts
    have to fit in one row; period and count are the ticker's. Posts are numbered within their day, behind the counts of
    the days before.
    """
    end = summaries.agg(F.max("created_at").alias("_end"))
    rows = summaries.crossJoin(F.broadcast(end)).filter(F.col("created_at") > F.col("_end") - F.expr(f"interval {days} days"))
    rows = rows.select(F.explode("tickers").alias("ticker"), F.to_date("created_at").alias("day"), "created_at", "id", "snippet", "_end")
    by_day = rows.groupBy("ticker", "day").agg(F.count("*").alias("n"), F.min("created_at").alias("first"))
    all_days = Window.partitionBy("ticker")
    earlier = F.coalesce(F.sum("n").over(all_days.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_day = by_day.select("ticker", "day", earlier.alias("before"), F.sum("n").over(all_days).alias("post_count"), F.min("first").over(all_days).alias("period_start"))
    own = F.row_number().over(Window.partitionBy("ticker", "day").orderBy("created_at", "id", "snippet")) - 1
    placed = rows.withColumn("own", own).join(by_day, ["ticker", "day"]).withColumn("part", F.floor((F.col("before") + F.col("own")) / most).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("created_at", "id", "snippet")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), F.date_format(x["created_at"], "yyyy-MM-dd"), F.lit(": "), x["snippet"])), "\n")
    return placed.groupBy("ticker", "part").agg(F.first("period_start").alias("period_start"), F.max("_end").alias("period_end"), F.first("post_count").alias("post_count"), text.alias("report_text"))
