"""Tables in files of other kinds, read where Spark reads the files: HTML tables, workbooks, and stores that have grown columns."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CELLS = "path string, part string, row int, cells array<string>"
#: Headings of a constituents table, and of a fund's workbook whose header is in its fifth row.
CONSTITUENTS = {"ticker": "Symbol", "name": "Security", "sector": "GICS Sector"}
FUND, FUND_HEADER = {"ticker": "Ticker", "name": "Name", "weight_pct": "Weight", "shares": "Shares Held", "sector": "Sector"}, 5
#: Rows and columns that a cell spans at most, by the HTML standard.
MOST_ROWS, MOST_COLUMNS = 65_534, 1000


# ------------------------------------------------------------ HTML
class _Tables(HTMLParser):
    """Streams a page's tables as (table, row, cells); a cell that spans rows or columns stands in each of them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[int, int, list[str]]] = []
        self.open: list[dict] = []  # tables around here: number, row, cells, cell being read, cells from rows above
        self.count = self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag == "table":
            self.open.append({"number": self.count, "row": 0, "cells": None, "cell": None, "above": {}})
            self.count += 1
        elif self.open and tag == "tr":
            self._end_row()
            self.open[-1]["cells"] = []
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            t, spans = self.open[-1], dict(attrs)
            if t["cells"] is None:
                t["cells"] = []
            t["cell"] = ([], self._span(spans.get("rowspan"), MOST_ROWS), self._span(spans.get("colspan"), MOST_COLUMNS))
        elif self.open and tag == "br" and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(" ")

    @staticmethod
    def _span(text: str | None, most: int) -> int:
        found = re.match(r"\s*(\d{1,6})", text or "")
        return min(most, max(1, int(found[1]))) if found else 1

    def _from_above(self) -> None:
        """Takes the cells that rows above have put in the next places."""
        t = self.open[-1]
        while (at := len(t["cells"])) in t["above"]:
            text, left = t["above"][at]
            t["cells"].append(text)
            if left > 1:
                t["above"][at] = (text, left - 1)
            else:
                del t["above"][at]

    def _end_cell(self) -> None:
        t = self.open[-1]
        if t["cell"]:
            parts, rows, columns = t["cell"]
            t["cell"], text = None, " ".join("".join(parts).split())
            self._from_above()
            for _ in range(columns):
                if rows > 1:
                    t["above"][len(t["cells"])] = (text, rows - 1)
                t["cells"].append(text)

    def _end_row(self) -> None:
        t = self.open[-1]
        self._end_cell()
        if t["cells"] is not None:
            self._fill()
            if t["cells"]:
                self.done.append((t["number"], t["row"], t["cells"]))
                t["row"] += 1
            t["cells"] = None

    def _fill(self) -> None:
        t = self.open[-1]
        own = {i for i in t["above"] if i >= len(t["cells"])}
        self._from_above()
        while own and max(own) >= len(t["cells"]):
            t["cells"].append("")
            self._from_above()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif self.open and tag in ("td", "th"):
            self._end_cell()
        elif self.open and tag == "tr":
            self._end_row()
        elif self.open and tag == "table":
            self._end_row()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] and not self.hidden:
            self.open[-1]["cell"][0].append(data)

    def tables(self, html: str) -> list[tuple[int, int, list[str]]]:
        self.feed(html)
        self.close()
        while self.open:
            self._end_row()
            self.open.pop()
        return self.done


def _batches(found: Iterator[tuple[str | None, str, int, list[str | None]]], size: int = 2000) -> Iterator[pa.RecordBatch]:
    schema, held = pa.schema([("path", pa.string()), ("part", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))]), []
    for row in found:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def html_cells(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """(path, part, row, cells) of every row of every table in pages; `part` numbers a page's tables from 0.

    Cells are trimmed and their white space single; spans repeat a cell, tables inside of cells are tables of their own,
    missing end tags end where the next part begins. A page without tables, or null, has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), (x.as_py() or "" for x in b.column(1)), strict=True)
            yield from _batches((name, str(n), i, cells) for name, text in rows for n, i, cells in _Tables().tables(text))

    return pages.select(F.col(path).cast("string").alias("path"), F.col(html).alias("html")).mapInArrow(run, CELLS)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of saved pages, a file each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def by_heading(cells: DataFrame, headings: dict[str, str], header: int | None = None) -> DataFrame:
    """Rows of tables under their headings: path and one string column for each of `headings` (column: heading).

    `header` is the row (from 0) that holds headings; None takes a table's first row that has all of them. Only the first
    table of a path that has all headings counts, and rows after its header; headings that occur twice count first. A cell
    that is missing or empty is null.
    """
    names = F.array(*[F.lit(h) for h in headings.values()])
    heads = cells.filter(F.size(F.array_except(names, "cells")) == 0)
    if header is not None:
        heads = heads.filter(F.col("row") == header)
    order = F.struct(F.col("part").try_cast("int"), "part", "row")
    heads = heads.groupBy("path").agg(F.min_by(F.struct("part", "row", "cells"), order).alias("h")).select("path", F.col("h.part").alias("_part"), F.col("h.row").alias("_row"), F.col("h.cells").alias("_heads"))
    rows = cells.withColumnRenamed("path", "_path").join(heads, (F.col("_path") == F.col("path")) & (F.col("part") == F.col("_part")) & (F.col("row") > F.col("_row")))
    value = lambda h: F.nullif(F.get("cells", F.array_position("_heads", h).cast("int") - 1), F.lit(""))
    return rows.select("path", *[value(h).alias(c) for c, h in headings.items()])


def constituents(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """(path, ticker, name, sector) of pages with an index's members; dots in tickers become dashes."""
    return by_heading(html_cells(pages, path, html), CONSTITUENTS).withColumn("ticker", F.translate("ticker", ".", "-"))


# ------------------------------------------------------------ workbooks
def _column(reference: str) -> int:
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


def _text(node: ElementTree.Element) -> str:
    """The text of a string item or inline string: its runs, without phonetic hints."""
    return "".join(t.text or "" for part in node if not part.tag.endswith("rPh") for t in part.iter() if t.tag.endswith("}t") or t.tag == "t")


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells) of a workbook's sheets, streamed out of their XML; empty rows are left out.

    A file that is no workbook gives none.
    """
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    names, strings = book.namelist(), []
    if "xl/sharedStrings.xml" in names:
        for _, node in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if node.tag.endswith("}si"):
                strings.append(_text(node))
                node.clear()
    for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n.rsplit("/", 1)[1]))):
        number = 0
        for _, node in ElementTree.iterparse(book.open(name)):
            if not node.tag.endswith("}row"):
                continue
            number, cells = int(node.get("r") or number + 1), []
            for c in node:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = next((x.text for x in c if x.tag.endswith("}v")), None)
                kind = c.get("t")
                if kind == "s" and value is not None:
                    value = strings[int(value)]
                elif kind == "inlineStr":
                    value = "".join(_text(x) for x in c if x.tag.endswith("}is"))
                elif kind == "e":
                    value = None
                cells[at] = value
            if any(x is not None for x in cells):
                yield name.rsplit("/", 1)[1].removesuffix(".xml"), number - 1, cells
            node.clear()


def workbook_cells(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, part, row, cells) of every sheet of workbooks (binary): each file is read in the task that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), (x.as_py() or b"" for x in b.column(1)), strict=True)
            yield from _batches((name, sheet, i, cells) for name, data in rows for sheet, i, cells in sheet_rows(data))

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, CELLS)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of workbooks, a file each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def fund_holdings(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, ticker, name, weight_pct, shares, sector) of fund workbooks whose headings are in the fifth row.

    Rows without a name go; numbers that can't be read are null; a workbook without Name and Ticker there has no rows.
    The other headings may be missing.
    """
    cells = workbook_cells(files, path, content)
    heads = cells.filter((F.col("row") == FUND_HEADER - 1) & F.array_contains("cells", FUND["name"]) & F.array_contains("cells", FUND["ticker"]))
    heads = heads.groupBy("path").agg(F.min_by(F.struct("part", "cells"), "part").alias("h"))
    rows = cells.filter(F.col("row") >= FUND_HEADER).join(heads, "path").filter("part = h.part")
    at = {c: F.array_position("h.cells", h).cast("int") for c, h in FUND.items()}
    value = {c: F.nullif(F.trim(F.when(p > 0, F.get("cells", p - 1))), F.lit("")) for c, p in at.items()}
    found = rows.select("path", value["ticker"].alias("ticker"), value["name"].alias("name"), value["weight_pct"].try_cast("double").alias("weight_pct"), value["shares"].try_cast("double").alias("shares"), value["sector"].alias("sector"))
    return found.filter("name is not null")


# ------------------------------------------------------------ stores that grow
def evolved(df: DataFrame, schema: StructType | str) -> DataFrame:
    """`df` in the declared schema: columns that it lacks are nulls of their type, the others are cast.

    A column that the schema doesn't have, or a value that its type can't hold, is an error: a store only grows by
    declaring it.
    """
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    own = set(df.columns)
    if unknown := sorted(own - {f.name for f in declared}):
        raise ValueError(f"the store has no column {', '.join(unknown)}")
    return df.select(*[(F.col(f"`{f.name}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared])


def read_store(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A store's rows in the declared schema, also where older files lack columns that were added since."""
    return spark.read.schema(schema).parquet(path)


def append_store(df: DataFrame, path: str, schema: StructType | str) -> None:
    """Appends rows in the declared schema; older files stay as they are."""
    evolved(df, schema).write.mode("append").parquet(path)
