"""Mixing sources to target weights: fixed-length token blocks, multinomial shard counts, permuted block indexes.

The documents of a source, in a hashed order, form one stream of tokens (words), cut into blocks of fixed length; a
document is a span of blocks. The mix is a list of slots, each holding a block. The slots of an output shard are dealt
to sources by a multinomial draw from what the sources still have to give, so that every shard mirrors the target
mix and the sums come out right. A source's slots are numbered through, and a keyed pseudorandom permutation for each
pass over the source turns numbers into block indexes: a pass takes every block once. Blocks and documents then meet
in a join on (source, block index).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import placed, row_hash, texts, written

#: Weights of sources in their order, repeating; the mix's size as a share of all; the passes at most.
WEIGHTS, SHARE, PASSES = (3.0, 1.0, 2.0), 1.5, 2
#: Ranges of shards that the driver plans at most; shards inside a range are dealt where it is laid out.
RANGES = 4096
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_counts(col: pa.Array, rows: int = 500) -> np.ndarray:
    """Words ([^\\x20\\x09-\\x0D]+) of each text of an Arrow column, counted on its byte buffer; null: 0.

    `rows` texts are looked at together, so that what is held beside the column is a few times their bytes.
    """
    parts = [_begins(col.slice(at, rows)) for at in range(0, len(col), rows)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _begins(col: pa.Array) -> np.ndarray:
    """How many bytes of each text begin a word: not blank, and first in the text or behind a blank."""
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    counts, filled = np.zeros(len(col), np.int64), (at[1:] > at[:-1]) & np.asarray(col.is_valid())
    if filled.any():
        blank = _BLANK[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
        at -= at[0]
        begins = ~blank
        begins[1:] &= blank[:-1]
        first = at[:-1][at[1:] > at[:-1]]
        begins[first] = ~blank[first]
        # texts that hold no byte take no part: reduceat sums from each start to the next one
        spans = np.flatnonzero(at[1:] > at[:-1])
        sums = np.zeros(len(col), np.int64)
        sums[spans] = np.add.reduceat(begins, at[:-1][spans], dtype=np.int64)
        counts[filled] = sums[filled]
    return counts


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, content): each row's words and a hash of its text, which orders rows that share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(word_counts(b.column(2)), pa.int64()), b.column(3)], ["doc_id", "source", "size", "content"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text", F.xxhash64("text").alias("content"))
    return rows.mapInArrow(run, "doc_id long, source string, size long, content long")


def targets(source_sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = PASSES) -> list[float]:
    """Each source's target: `share` of all sizes dealt by weight, at most `most` sizes a source.

    What a source can't take is dealt among the others by weight, until none is above its limit.
    """
    weight = [weights[i % len(weights)] for i in range(len(source_sizes))]
    left, open_ = share * sum(source_sizes), set(range(len(source_sizes)))
    out = [0.0] * len(source_sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        full = {i for i in open_ if left * weight[i] / total > most * source_sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = float(most * source_sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def deal(slots: list[int], shard_slots: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot number, count): multinomial draws by what sources have left; their sums are `slots`."""
    rng, left, done, out, shard = np.random.default_rng(seed), np.array(slots, np.int64), np.zeros(len(slots), np.int64), [], 0
    while left.sum():
        want, got = min(shard_slots, int(left.sum())), np.zeros(len(slots), np.int64)
        while want:
            rest = left - got
            draw = np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
            got += draw
            want -= int(draw.sum())
        out += [(shard, i, int(done[i]), int(n)) for i, n in enumerate(got) if n]
        left, done, shard = left - got, done + got, shard + 1
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1, elementwise: a four-round Feistel network, walked until in range."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            y = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            y ^= y >> np.uint64(29)
            y *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((y >> np.uint64(33)) & mask)
        return (a << np.uint64(half)) | b

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


class Mix:
    """A mix of `docs` (doc_id, text, source), planned: `documents`, `slots` and `spans` are DataFrames.

    Sources are ordered by code point, null last, and have `weights` in turn. The plan is drawn on the driver from one
    row a source (the number of sources is taken to be small) for `ranges` ranges of shards at most, however many shards
    there are; a range of several shards deals its own counts to them by the same draw, in the task that lays it out.
    The same input gives the same mix. Words are tokens; a row with null or wordless text takes no part in blocks. Rows
    that share an id are documents of their own, ordered by their texts' hashes.
    """

    def __init__(self, docs: DataFrame, block_words: int = 128, shard_slots: int = 1 << 16, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 1, ranges: int = RANGES):
        spark = docs.sparkSession
        self.block_words = block_words
        sized = written(sizes(texts(docs, "doc_id", "text", "source")), "mix-sizes")
        n = sized.count()
        by_source = sorted(((r.source, r.size) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
        self.blocks = [-(-size // block_words) for _, size in by_source]
        target = targets([size for _, size in by_source], weights, share)
        self.taken_slots = [min(PASSES * b, round(t * b / s)) if s else 0 for (_, s), b, t in zip(by_source, self.blocks, target, strict=True)]
        named = spark.createDataFrame([(i, s, z, t) for i, ((s, z), t) in enumerate(zip(by_source, target, strict=True))], "source_id int, source string, source_size long, target double")
        self.documents = written(self._placed(sized.join(F.broadcast(named), sized["source"].eqNullSafe(named["source"])).drop(named["source"]), n, seed), "mix-documents")
        self.slots = self._slots(spark, shard_slots, -(-sum(self.taken_slots) // (shard_slots * ranges)) or 1, seed)

    @staticmethod
    def _placed(rows: DataFrame, n: int, seed: int) -> DataFrame:
        """rows with `start`: the words of their source's earlier documents, in hashed order.

        Sums run inside ranges of the hash (a few thousand rows each, so a source's rows never meet in one task) and
        then over the ranges' totals.
        """
        ranges = max(1, min(n // 4096, 1 << 16))
        rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("range", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * ranges).cast("int"))
        inside = Window.partitionBy("source_id", "range").orderBy("h", "doc_id", "content", "size").rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy("source_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.groupBy("source_id", "range").agg(F.sum("size").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
        placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["source_id", "range"])
        return placed.withColumn("start", F.col("start") + F.col("base")).drop("base", "h", "range")

    def _slots(self, spark, shard_slots: int, shards: int, seed: int) -> DataFrame:
        """(shard, slot, source_id, block): what every slot of the mix holds, planned in ranges of `shards` shards."""
        blocks = self.blocks
        plan: dict[int, list[tuple[int, int, int]]] = {}
        for number, source, first, count in deal(self.taken_slots, shard_slots * shards, seed):
            plan.setdefault(number, []).append((source, first, count))

        def dealt(number: int, own: list) -> Iterator[tuple[int, int, int, int]]:
            """A range's shards; one shard takes the range as it is."""
            if shards == 1:
                yield from ((number, source, first, count) for source, first, count in own)
            else:
                for shard, i, first, count in deal([count for *_, count in own], shard_slots, seed * 1_000_033 + number + 1):
                    yield number * shards + shard, own[i][0], own[i][1] + first, count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for shard, source, first, count in dealt(number, [tuple(x.values()) for x in own]):
                        k, n = np.arange(first, first + count, dtype=np.int64), blocks[source]
                        block = np.empty(count, np.int64)
                        for e in np.unique(k // n):
                            turn = k // n == e
                            block[turn] = permuted(k[turn] % n, n, (seed * 1_000_003 + source) * 1_009 + int(e))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(count, shard), pa.int64()), pa.array(k), pa.array(np.full(count, source), pa.int32()), pa.array(block)], ["shard", "slot", "source_id", "block"])

        frame = spark.createDataFrame(list(plan.items()), "number long, own array<struct<source: int, first: long, count: long>>")
        frame = frame.repartition(max(1, min(len(plan), 4 * spark.sparkContext.defaultParallelism)), "number")
        return frame.mapInArrow(run, "shard long, slot long, source_id int, block long")

    @property
    def spans(self) -> DataFrame:
        """(doc_id, content, source_id, start, block, first_word, words, times): documents' shares of drawn blocks."""
        size, b = self.block_words, F.col("block")
        parts = self.documents.filter("size > 0").select("doc_id", "content", "source_id", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size))).alias("block"))
        times = self.slots.groupBy("source_id", "block").agg(F.count("*").alias("times"))
        low = F.greatest(F.col("start"), b * size)
        high = F.least(F.col("start") + F.col("size"), (b + 1) * size)
        return parts.join(times, ["source_id", "block"]).select("doc_id", "content", "source_id", "start", "block", (low - F.col("start")).alias("first_word"), (high - low).alias("words"), "times")

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every document; taken counts repeats."""
        sums = self.spans.groupBy("source_id", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.first("doc_id").alias("_id"))
        keyed = self.documents.join(sums.drop("_id").withColumn("some", F.lit(True)), (self.documents["source_id"] == sums["source_id"]) & (self.documents["start"] == sums["start"]) & (self.documents["size"] > 0), "left")
        return keyed.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans (first word, words; ascending), neighbours joined, with the text's own white space."""
    joined: list[list[int]] = []
    for first, n in spans:
        if joined and joined[-1][1] == first:
            joined[-1][1] += n
        else:
            joined.append([first, first + n])
    raw = np.frombuffer(data := text.encode(), np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if joined == [[0, len(starts)]]:
        return text
    return "\n".join(data[starts[a] : ends[b - 1]].decode() for a, b in joined)


def _cut_out(place: int, n: int):
    """Replaces the text, in column `place` of `n` before (spans, pass), by the words of the spans that are taken more than `pass` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                spans = ([(s["first_word"], s["words"]) for s in own if s["times"] > turn] for own, turn in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True))
                columns = list(b.columns[:n])
                columns[place] = pa.array([_cut(t.as_py(), own) for t, own in zip(columns[place], spans, strict=True)], columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, placed(n))

    return run


def mixed_documents(docs: DataFrame, **plan) -> DataFrame:
    """The mix as documents, in the columns of `docs`: a row for each document and pass that takes some of it.

    Pass p's text holds the document's blocks that the mix takes more than p times; n_chars, if there, follows it. A row
    with null or wordless text is in no block and so in no result; repeated rows and rows that share an id, or have
    none, are documents of their own, ordered by their content; an empty table gives none. Other columns stay as they
    are, whatever their names.
    """
    names = docs.columns
    spans = Mix(docs, **plan).spans
    packed = spans.groupBy("doc_id", "content", "source_id", "start").agg(F.sort_array(F.collect_list(F.struct("first_word", "words", "times"))).alias("spans"))
    packed = packed.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "content").orderBy("start"))).select("doc_id", "content", "nth", "spans")
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_content"), row_hash(docs).alias("row_hash"))
    rows = rows.withColumn("own_nth", F.row_number().over(Window.partitionBy("own_id", "own_content").orderBy("row_hash"))).drop("row_hash")
    found = rows.join(packed, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_content") == F.col("content")) & (F.col("own_nth") == F.col("nth")))
    taken = found.withColumn("pass", F.explode(F.sequence(F.lit(0), F.array_max("spans.times").cast("int") - 1)))
    own = taken.select(*[F.col("row").getField(c).alias(p) for c, p in zip(names, placed(len(names)), strict=True)], "spans", "pass")
    cut = own.mapInArrow(_cut_out(names.index("text"), len(names)), own.drop("spans", "pass").schema).toDF(*names)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cut


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return Mix(docs).taken()
