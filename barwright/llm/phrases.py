"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, the phrases' names into phrases again, and so on. At each level, runs
of one symbol become one symbol; deterministic coin tossing then turns symbols into small labels, in which neighbours
differ: the place and value of the lowest bit where a symbol differs from the one before it, three times over; phrases
begin at local minima of the labels. A boundary depends on four symbols before it and one after it, so equal
substrings are parsed alike save at their ends, wherever they stand. A fingerprint holds the smallest names (32 bits of
a 64-bit hash) of one level's phrases; two fingerprints estimate the share of phrases that their texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import texts

#: The level whose phrases make fingerprints, and the names that a fingerprint holds at most.
LEVEL, NAMES = 3, 64
_U = np.uint64
#: Code points that are parsed at once.
CHUNK = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _from_before(x: np.ndarray, at_start: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at_start] = ~x[at_start]
    return out


def climb(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: symbols and their documents (ascending) to the names and documents of their phrases."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(x))).astype(_U)
    x, owner = x[at], owner[at]
    x = np.where(run > 1, _mix(x ^ _mix(run)), x)
    start = np.ones(len(x), bool)
    start[1:] = owner[1:] != owner[:-1]
    label = x
    for _ in range(3):
        differs = label ^ _from_before(label, start)
        low = differs & (~differs + _U(1))
        label = (np.bitwise_count(low - _U(1)).astype(_U) << _U(1)) | ((label & low) != 0)
    label = label.astype(np.int16)
    falls = np.zeros(len(x), bool)
    falls[1:] = label[1:] < label[:-1]
    rises = np.zeros(len(x), bool)
    rises[:-1] = (label[:-1] < label[1:]) & ~start[1:]
    begin = np.flatnonzero(start | (falls & rises))
    size = np.diff(np.append(begin, len(x)))
    place = np.arange(len(x), dtype=np.int64) - np.repeat(begin, size)
    terms = _mix(x + (place + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
    return _mix(np.add.reduceat(terms, begin) + size.astype(_U)), owner[begin]


def fingerprints(batch: list[str], level: int = LEVEL, most: int = NAMES) -> list[np.ndarray]:
    """For each text the `most` smallest distinct 32-bit names of its phrases at `level`, ascending; empty text: none.

    A text's fingerprint depends on that text alone.
    """
    sizes = np.array([len(t) for t in batch], np.int64)
    if not sizes.sum():
        return [np.empty(0, np.uint32)] * len(batch)
    x = _mix(np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32).astype(_U) + _U(1))
    owner = np.repeat(np.arange(len(batch), dtype=np.int64), sizes)
    for _ in range(level):
        x, owner = climb(x, owner)
    keys = np.unique((owner << 32) | (x >> _U(32)).astype(np.int64))
    ends = np.searchsorted(keys, np.arange(1, len(batch) + 1, dtype=np.int64) << 32)
    names = (keys & 0xFFFFFFFF).astype(np.uint32)
    return [names[a : min(b, a + most)] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, most: int = NAMES) -> float:
    """The share of phrases in common, from the smallest names of both; exact where neither fingerprint is full.

    Two empty fingerprints are alike (1), an empty one and another are not (0).
    """
    one, two = set(a.tolist()), set(b.tolist())
    least = sorted(one | two)[:most]
    return sum(n in one and n in two for n in least) / len(least) if least else 1.0


def hexed(names: np.ndarray) -> str:
    return names.astype(">u4").tobytes().hex()


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, most: int = NAMES) -> DataFrame:
    """(doc_id, fingerprint): hex of each row's names; null text counts as empty, whose fingerprint is empty.

    Equal texts have equal fingerprints, whatever their rows; repeated rows and rows without an id give a row each; an
    empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [t or "" for t in b.column(1).to_pylist()], []
            for at, upto in _chunks(rows):
                out += [hexed(f) for f in fingerprints(rows[at:upto], level, most)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def _chunks(rows: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of rows that hold about CHUNK code points; a longer text is a span of its own."""
    at, held = 0, 0
    for i, t in enumerate(rows):
        if held and held + len(t) > CHUNK:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(rows):
        yield at, len(rows)


def edited(text: str, after: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first code points of `after`, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _with_successors(docs: DataFrame, rows_each: int = 2048) -> DataFrame:
    """(range, extra, key, doc_id, text) dealt out by ranges of the id, sorted inside; a range ends with the next one's first row.

    Ranges are cut at quantiles of the id, so all are about as large; of ranges, 65,536 at most, only first ids and
    numbers reach the driver. The last range ends with the first row of all.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long"), "text")
    n = keyed.count()
    parts = max(1, min(n // rows_each, 1 << 16))
    cuts = sorted({int(c) for c in keyed.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    bounds = np.array(cuts, np.int64)

    @pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int32))

    firsts = sorted((r["range"], r["first"]) for r in keyed.select("key", range_of("key").alias("range")).groupBy("range").agg(F.min("key").alias("first")).collect())
    heads = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @pandas_udf("int")
    def before(key: pd.Series) -> pd.Series:
        return key.map(heads.get).fillna(-1).astype(np.int32)

    places = F.array(F.struct(range_of("key").alias("range"), F.lit(0).alias("extra")), F.struct(before("key").alias("range"), F.lit(1).alias("extra")))
    rows = keyed.select("key", "doc_id", "text", F.explode(places).alias("at")).select("at.range", "at.extra", "key", "doc_id", "text").filter("range >= 0")
    spread = max(1, min(len(firsts), 1 << 16), spark.sparkContext.defaultParallelism)
    return rows.repartition(spread, "range").sortWithinPartitions("range", "extra", "key", F.xxhash64("text"))


def compared(docs: DataFrame, level: int = LEVEL, most: int = NAMES) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    Rows are in ascending order of the id (nulls first), rows that share an id in the order of their texts' hashes;
    the last row is followed by the first, a lone row by itself. Null text is empty. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next; an empty table gives none.
    """

    def finish(rows: list[tuple], out: list) -> None:
        """rows: (doc_id, text) and the successor of the last."""
        own = fingerprints([t for _, t in rows], level, most)
        changed = [edited(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False)]
        for i, (text, f) in enumerate(zip(changed, fingerprints(changed, level, most), strict=True)):
            out.append((rows[i][0], len(rows[i][1]), hashlib.sha256(text.encode()).hexdigest(), hexed(own[i]), hexed(f), likeness(own[i], f, most), likeness(own[i], own[i + 1], most)))

    def batch(out: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, over = [], 0, None, False
        for b in batches:
            out = []
            for number, extra, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), (x.as_py() or "" for x in b.column(3)), strict=True):
                if number != now:
                    held, size, now, over = [], 0, number, False
                if over:
                    continue
                held.append((doc_id, text))
                size += len(text)
                over = extra == 1
                if over or size > CHUNK and len(held) > 1:
                    finish(held, out)
                    held, size = [(doc_id, text)], len(text)
            if out:
                yield batch(out)

    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_successors(texts(docs, "doc_id", "text")).select("range", "extra", "doc_id", "text").mapInArrow(run, fields)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return compared(docs)
