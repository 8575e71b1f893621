"""Strategy configs held in a column of JSON: what they are, what a search would vary, and how two versions differ, as tables.

Each config is read by a small helper in the task that holds it; joins and ranges over what comes out are Spark's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import strategy
from . import tuning

#: Configs whose rows are handed on together.
SLICE = 500


def _per_config(configs: DataFrame, config: str, schema: str, rows_of) -> DataFrame:
    """(id, ...) of what `rows_of` yields for each (id, config) text; null and unreadable texts are given as None.

    A text that a batch holds several times is read once. A config gives many rows, so the table is dealt over tasks by
    its rows first: a file's layout by size would leave most of the work to a few of them.
    """

    def parsed(text: str | None):
        try:
            return json.loads(text) if text is not None else None
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = pc.dictionary_encode(b.column(1), null_encoding="encode")
            made = [list(rows_of(text, parsed(text))) for text in coded.dictionary.to_pylist()]
            counts = np.array([len(m) for m in made], np.int64)
            starts, code = np.cumsum(counts) - counts, coded.indices.to_numpy(zero_copy_only=False)
            flat = [pa.array(c, f.type) for c, f in zip(zip(*(row for m in made for row in m), strict=True), list(arrow)[1:], strict=False)]
            for at in range(0, len(b) if flat else 0, SLICE):
                own = code[at : at + SLICE]
                n = counts[own]
                row = np.repeat(np.arange(at, at + len(own)), n)
                place = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(len(row))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *(c.take(pa.array(place)) for c in flat)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType.fromDDL("id long, " + schema)
    arrow = to_arrow_schema(whole)
    rows = configs.select(F.col("id").cast("long").alias("id"), F.col(config).cast("string").alias("config"))
    return rows.repartition(4 * configs.sparkSession.sparkContext.defaultParallelism, "id", "config").mapInArrow(run, whole)


def _leaves(value, path: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}".lstrip("."))
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{i}]")
    else:
        yield path, json.dumps(value, ensure_ascii=False)


def flattened(configs: DataFrame, config: str = "config") -> DataFrame:
    """(id, path, value): every value of each config under its path, as JSON; empty lists and objects are values.

    A null config, or one that is no JSON, has no rows.
    """
    return _per_config(configs, config, "path string, value string", lambda text, c: [] if c is None else _leaves(c))


def differences(configs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(id, path, before, after): values that differ between two configs of a row, null on the side that lacks the path.

    Numbers that are equal are the same however they are written.
    """
    a, b = (flattened(configs, c).withColumnRenamed("value", n) for c, n in ((before, "before"), (after, "after")))
    number = lambda n: F.col(n).try_cast("double")
    same = F.col("before").eqNullSafe(F.col("after")) | F.coalesce(number("before") == number("after"), F.lit(False))
    return a.join(b, ["id", "path"], "full").filter(~same).select("id", "path", "before", "after")


def summarized(configs: DataFrame, before: str = "before", after: str = "after", replaced: str | None = None) -> DataFrame:
    """(id, changes, summary): how many values differ, and a line for each, by path; `replaced` names a column of flags.

    A flagged row's structure was replaced, which its summary says first, since only equal paths can be compared.
    """
    diff = differences(configs, before, after)
    side = lambda n: F.coalesce(F.col(n), F.lit("nothing"))
    line = F.concat(F.lit("- "), "path", F.lit(": "), side("before"), F.lit(" -> "), side("after"))
    lines = diff.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("l"))
    flag = F.coalesce(F.col(replaced), F.lit(False)) if replaced else F.lit(False)
    rows = configs.select(F.col("id").cast("long").alias("id"), flag.alias("_replaced")).join(lines, "id", "left")
    text = F.when(F.col("n").isNull(), "Nothing was changed: the original did best.").otherwise(F.concat(F.lit("Changed:\n"), F.array_join("l.line", "\n")))
    first = F.when(F.col("_replaced"), "The structure was replaced; only values in the same places are compared.\n").otherwise("")
    return rows.select("id", F.coalesce("n", F.lit(0)).alias("changes"), F.concat(first, text).alias("summary"))


def tunables(configs: DataFrame, config: str = "config") -> DataFrame:
    """(id, path, indicator, key, original, category, style, low, high): what a search would vary in each config (see tuning.tunables)."""
    schema = "path string, indicator string, key string, original double, category string, style string, low double, high double"
    return _per_config(configs, config, schema, lambda text, c: tuning.tunables(c) if isinstance(c, dict) and not strategy.problems(c) else [])


def described(configs: DataFrame, config: str = "config") -> DataFrame:
    """(id, kind, problems, explanation) of each config; one with problems, or null, has no explanation."""

    def rows(text: str | None, c) -> list[tuple[str, str, str]]:
        found = strategy.problems(text if c is None else c) if text is not None else ["no config"]
        return [(strategy.kind_of(c if c is not None else "{"), "; ".join(found), "" if found else strategy.explain(c))]

    return _per_config(configs, config, "kind string, problems string, explanation string", rows)
