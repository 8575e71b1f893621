"""Packing along a space-filling curve: neighbours on the curve share sequences.

A document's token counts, hashed into a few hundred buckets, are projected to four dimensions; the cell it falls in
has a number along the Hilbert curve. Documents are range-sorted by that number (ties by a hash of the id, so that
copies spread over ranges), and the sorted documents form one stream of tokens that is cut every 4096 tokens. Places
in the stream come from running sums inside ranges and the ranges' totals. Only the stream's end is short of a
sequence; it is cut into powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, texts, written

BUCKETS, DIMENSIONS, CELL_BITS, TIE_BITS = 256, 4, 12, 15
END_ID, SEQUENCE = 2, 4096
#: Chunks whose ids a worker keeps at most; ranges of the curve at most, of which the driver holds a row each.
CACHED, RANGES = 600_000, 1 << 14
#: Lowered letters of ASCII and Latin-1: alone in a chunk they are one word, whatever the normalizer does.
_WORD = re.compile("[a-zß-öø-ÿ]+")
#: Letters and then ASCII marks: the tokenizer parts them, as an apostrophe is not among the marks.
_TAILED = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")


class Ids(dict):
    """White-space-free chunks of lowered text -> token ids as unsigned 16-bit bytes.

    The tokenizer drops white space and works inside chunks, so a text's ids are those of its chunks; marks behind
    letters are parted from them, so both are looked up by themselves. A chunk of plain letters is one word, which goes
    to the tokenizer's model without the steps before it, save the spelling of bytes as characters. Chunks are kept in
    two generations: when the younger is full, it becomes the older, and what is used again returns from there.
    """

    def __init__(self, path: str, kept: int = CACHED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}
        self.half = kept // 2
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in range(ord("ß"), 256)}
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._made(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def _made(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters
            return array("H", [t.id for t in self.model.tokenize(chunk.decode())]).tobytes()
        word = chunk.decode().lower()
        if _WORD.fullmatch(word):
            return array("H", [t.id for t in self.model.tokenize(word.translate(self.spelt))]).tobytes()
        if tailed := _TAILED.fullmatch(word):
            return self[tailed[1].encode()] + self[tailed[2].encode()]
        return array("H", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()

    def of(self, text: bytes) -> bytes:
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(1)
def _ids(path: str, kept: int) -> Ids:
    return Ids(path, kept)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of integer points (rows of `cells`, each coordinate of `bits` bits).

    Coordinates are turned, bit plane by bit plane from the top, into the curve's transposed index, whose bits are
    then interleaved.
    """
    x = [c.astype(np.uint64) for c in cells.T]
    n, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for i in range(n):
            high = (x[i] >> np.uint64(level)) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    out = np.zeros_like(flip)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | (((x[i] ^ flip) >> np.uint64(level)) & one)
    return out


def curve_places(counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """The Hilbert number of each row of hashed token counts: damped, scaled to length one, projected, put in cells."""
    v = np.sqrt(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    p = v @ np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    cells = np.clip((p + 4) / 8 * (1 << CELL_BITS), 0, (1 << CELL_BITS) - 1).astype(np.int64)
    return hilbert(cells, CELL_BITS).astype(np.int64)


def encoded(docs: DataFrame, path: str | None = None, kept: int = CACHED) -> DataFrame:
    """(doc_id, n, place, ids): each text's ids with the end id as 16-bit bytes, and its place along the curve.

    Null text is empty: the end id alone. `path` names the tokenizer's file, which every executor must have. A worker
    remembers `kept` chunks, also for what it runs later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = _ids(path or tokenizer_path(), kept), np.array([END_ID], np.uint16).tobytes()
        bucket = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                found = [ids.of(t) + end for t in rows_of(b, "text")]
                counts = np.array([np.bincount(bucket[np.frombuffer(f, np.uint16)], minlength=BUCKETS) for f in found], np.float64)
                place = (curve_places(counts) << TIE_BITS) | np.asarray(b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) // 2 for f in found], pa.int64()), pa.array(place), pa.array(found, pa.binary())], ["doc_id", "n", "place", "ids"])

    tie = F.coalesce(F.xxhash64("doc_id"), F.lit(0)).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", tie)
    return rows.mapInArrow(run, "doc_id long, n long, place long, ids binary")


def ordered(docs: DataFrame, path: str | None = None, range_tokens: int = 8 << 20, most: int = RANGES, kept: int = CACHED) -> tuple[DataFrame, int]:
    """(doc_id, n, ids, part, at) in ranges of the curve, `at` the tokens before a row in its range; and the sum of n.

    Ranges hold about `range_tokens` tokens, or more where there would be more than `most` of them: what the driver
    samples and holds is bounded, and larger ranges are sorted with spilling.
    """
    spark = docs.sparkSession
    rows = written(encoded(texts(docs, "doc_id", "text"), path, kept), "pack-ids")
    total = rows.agg(F.sum("n")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.asarray(b.column(1))
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(np.full(len(b), part), pa.int32()), pa.array(at, pa.int64())], ["doc_id", "n", "ids", "part", "at"])

    parts = int(min(most, max(spark.sparkContext.defaultParallelism, total // range_tokens + 1)))
    ranged = rows.repartitionByRange(parts, "place").sortWithinPartitions("place", "doc_id", "n", F.xxhash64("ids"))
    return written(ranged.mapInArrow(run, "doc_id long, n long, ids binary, part int, at long"), "pack-ranges"), int(total)


def tail_cuts(total: int, length: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the sequences that hold what is left after the last full one: powers of two, longest first."""
    at, cuts = total // length * length, []
    while at < total:
        size = 1 << ((total - at).bit_length() - 1)
        cuts.append((at, size))
        at += size
    return cuts


def pieces(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, **ranges: int) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece, ids as 16-bit bytes.

    All rows are packed, whole; rows that share an id, or have none, are packed as documents of their own, equal places
    on the curve by a hash of the id, the id and the ids' hash. An empty table gives no pieces; other columns, whatever
    their names, are not read. Sequences are numbered along the curve and filled without gaps.
    """
    spark = docs.sparkSession
    rows, total = ordered(docs, path, **ranges)
    full, tail = total // length, tail_cuts(total, length)
    sums, bases, base = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect(), [], 0  # at most RANGES rows
    for part, n in sums:
        bases.append((part, base))
        base += n
    placed = rows.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array([s for s, _ in tail], np.int64)
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.slice(lo, 1000)
                out = []
                for doc_id, n, ids, begin in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                    ids, at = ids.as_py(), 0
                    while at < n:
                        g = begin + at
                        if g < full * length:
                            seq, offset, room = g // length, g % length, length - g % length
                        else:
                            i = int(np.searchsorted(starts, g, "right")) - 1
                            seq, offset, room = full + i, g - tail[i][0], tail[i][0] + tail[i][1] - g
                        size = min(room, n - at)
                        out.append((doc_id, at, size, n, seq, offset, ids[2 * at : 2 * (at + size)]))
                        at += size
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.select("doc_id", "n", "ids", (F.col("base") + F.col("at")).alias("begin")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(docs: DataFrame, path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """(sequence_id, doc_ids, ids): the packed sequences, ids as 16-bit bytes; at most `length` tokens each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    packed = pieces(docs, path, length).groupBy("sequence_id").agg(parts.alias("p"))
    return packed.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def report(docs: DataFrame, path: str | None = None, **ranges: int) -> DataFrame:
    """The contract's columns: pieces with the CRC-32 of their ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_py(), np.uint16).astype("<u4").tobytes()) for x in b.column(6)]
            c = b.columns
            yield pa.RecordBatch.from_arrays([c[0], c[1], c[2], pa.array(crc, pa.int64()), c[3], c[4], c[5]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces(docs, path, **ranges).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
