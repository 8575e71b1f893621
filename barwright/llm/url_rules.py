"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path. `||` at its start stands for the host's start or any of its later labels, `*` for
any run of characters, `^` for one separator or an edge; a pattern may end anywhere. A token is a run of characters
other than ASCII separators; those of a pattern that are bounded on both sides, so that a URL which fits must have them
whole, are its literal tokens. Tokens are counted over the URLs, and each rule is filed under the one that fewest of them
have. A URL's tokens fetch the rules filed under them, and only these run their regular expressions; rules without a
literal token are fetched by every URL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules as (verdict, host, path): they fit the host and its subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The method's own patterns, for URLs that no rule fits: words that unwanted hosts have in names with hyphens.
PATTERNS = (("block", "^spam-"), ("block", "^casino-"), ("block", "^adult-"), ("block", "^ads-"), ("block", "-bets."), ("block", "-pills."))
#: The most characters of patterns that are broadcast; larger rule tables meet the tokens in a shuffle.
BROADCAST = 8 << 20

_TOKEN = r"[^\x00-/:-@\[-`{-\x7f]"
_EDGE = r"[\x00-)+-/:-@\[-`{-\x7f]"  # a separator that is no wildcard
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path, both empty where the URL is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES, patterns: tuple[tuple[str, str], ...] = PATTERNS) -> DataFrame:
    """(layer, verdict, rule, pattern): host rules, named by host and path, in layer 1 and patterns in layer 0."""
    rows = [(1, v, host + path, f"||{host}{path}") for v, host, path in rules] + [(0, v, None, p) for v, p in patterns]
    return spark.createDataFrame(rows, "layer int, verdict string, rule string, pattern string").coalesce(1)


def compiled(rules: DataFrame) -> DataFrame:
    """`rules` with `regex` and `literals`, the pattern's literal tokens."""
    body = F.regexp_replace(F.regexp_replace("pattern", r"^\|\|", ""), r"([\\.\[\]{}()+?$|&#~-])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(r"(?:^|$|[\x00-/:-@\[-`{-\x7f])"))
    start = F.when(F.col("pattern").startswith("||"), F.lit(r"(?s)^(?:[^/]*\.)?")).otherwise(F.lit("(?s)"))
    literals = F.regexp_extract_all("pattern", F.lit(f"(?<={_EDGE}){_TOKEN}+(?={_EDGE})"), F.lit(0))
    return rules.withColumn("regex", F.concat(start, body)).withColumn("literals", F.array_distinct(literals))


def tokens(target: Column) -> Column:
    """The distinct tokens of a host and path."""
    return F.array_distinct(F.regexp_extract_all(target, F.lit(f"{_TOKEN}+"), F.lit(0)))


def indexed(rules: DataFrame, seen: DataFrame, hinted: Callable[[DataFrame], DataFrame] = F.broadcast) -> DataFrame:
    """(token, layer, verdict, rule, pattern, regex): each rule under its rarest literal token (ties: the first by code point).

    `seen` holds a row (token) for each URL and token; `hinted` is given what has at most a few rows for each rule, before
    it meets `seen`. A rule without literal tokens is filed under ''.
    """
    built = compiled(rules)
    literal = built.select("layer", "verdict", "rule", "pattern", "regex", F.explode_outer("literals").alias("token"))
    wanted = literal.select("token").distinct()
    counts = seen.join(hinted(wanted), "token").groupBy("token").agg(F.count("*").alias("urls"))
    keys = ["layer", "verdict", "rule", "pattern", "regex"]
    rarest = literal.join(hinted(counts), "token", "left").groupBy(*keys).agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("token", F.lit("")).alias("token"))).alias("at"))
    return rarest.select("at.token", *keys)


def decided(urls: DataFrame, rules: DataFrame, most: int = BROADCAST) -> DataFrame:
    """(target, verdict, rule, pattern) of the distinct `target`s (host and path) in `urls` that some rule fits.

    Of the rules that fit, the highest layer's longest pattern wins; of equally long ones a block, then the last by code
    point. Rules of up to `BROADCAST` characters are broadcast; more of them meet the tokens in a shuffle.
    """
    size = rules.agg(F.sum(F.length("pattern"))).first()[0] or 0
    hinted = F.broadcast if size <= most else lambda side: side
    targets = urls.select("target").distinct()
    each = targets.select("target", F.explode(tokens(F.col("target"))).alias("token"))
    index = indexed(rules, each, hinted)
    fetched = targets.select("target", F.explode(F.concat(tokens(F.col("target")), F.array(F.lit("")))).alias("token")).join(hinted(index), "token")
    fits = fetched.filter(F.expr("target RLIKE regex"))
    order = F.struct("layer", F.length("pattern").alias("length"), (F.col("verdict") == "block").alias("block"), "pattern", "rule", "verdict")
    return fits.groupBy("target").agg(F.max(order).alias("best")).select("target", "best.verdict", "best.rule", "best.pattern")


def judged(pages: DataFrame, rules: DataFrame | None = None, url_col: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule, pattern and verdict.

    The verdict is that of the best rule or pattern, `default` where none fits; `rule` is null unless a named rule
    decides. A null URL, or one without `://`, has an empty host and path and fits patterns that the empty text fits.
    Rows stay as they are, repeated ones too; an empty table gives none; columns of the result's names are replaced.
    Equal URLs are judged once.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    host, path = host_and_path(F.col(f"`{url_col}`"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "pattern", "verdict") or c == url_col]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path")).withColumn("target", F.concat("host", "path"))
    found = rows.join(decided(rows, rules), "target", "left")
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", "rule", "pattern", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns; `pattern` says which pattern decided."""
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")


#: The query in SQL, with the rules and patterns above written out.
SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
  CASE
    WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])casino-') THEN '^casino-'
    WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])adult-') THEN '^adult-'
    WHEN (host || path) LIKE '%-pills.%' THEN '-pills.'
    WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])spam-') THEN '^spam-'
    WHEN (host || path) LIKE '%-bets.%' THEN '-bets.'
    WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])ads-') THEN '^ads-' END AS own
  FROM split
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR own IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN '||' || rule ELSE own END AS pattern
FROM ruled
"""
