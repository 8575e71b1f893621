"""Collocations: phrases that count-min sketches let through are counted exactly, scored and subsumed.

First every task counts the cells of its n-grams (of one word and more, per language) in each row of a count-min sketch;
the tasks' parts are added up block by block. A cell's sum is at least the count of any n-gram in it, so an n-gram that
has a sum below the least count in some row is rare for certain. What stays of the sketch is one bit a cell, whether it
reaches the least count, and this table of fixed size goes to all tasks. They pass over the texts again and count the
n-grams whose cells all reach it, by their words. A task sorts its n-grams by buckets of their hashes and sends a bucket's
as one compressed block; the blocks of a bucket meet in one task, which adds their counts up and drops the few n-grams
that reached the least count only with others. So nothing frequent is lost, and counts are exact. A candidate's score is that of its worst cut into two parts,
and a candidate is dropped where a longer one has at least half of its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written

#: Longest phrase in words, least count, share (in per cent) of a phrase that a longer one takes over, phrases a language.
WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Rows of the sketch; its cells a row are a power of two in these bounds; cells in a block; bytes of text for each cell.
ROWS, CELL_BITS, BLOCK, BYTES_A_CELL = 2, (16, 28), 1 << 16, 32
#: Bytes of text that are cut into words together, and cells that a task holds before it lets go of their counts.
CHUNK, HELD = 2 << 20, 16 << 20
#: Bytes of text for each bucket of n-grams, and bytes of counted n-grams that a task holds before it adds up or lets go.
BYTES_A_BUCKET, COUNTED = 8 << 20, 32 << 20
_MARK = b"."
_PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _MARK * 10 + b" ")
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_LANG = "und"


class Numbers(dict):
    """word -> its number by first occurrence; the mark between pieces is 0."""

    def __init__(self) -> None:
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Texts of one language as numbers of words, with marks between pieces, and hashes of their n-grams."""

    def __init__(self, lang: bytes, some: list[bytes]):
        tokens = _MARK.join(some).lower().translate(_PLAIN).replace(_MARK, b" . ").split()
        numbers = Numbers()
        self.ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        self.words = list(numbers)
        prefix = lang + b"\0"
        self.hashes = np.array([xxhash.xxh64_intdigest(prefix + w) for w in self.words], np.uint64)

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, hashes) of the n-grams of each length that lie within pieces."""
        inside = self.ids > 0
        single = self.hashes[self.ids]
        places, hashes = np.flatnonzero(inside), single[inside]
        for n in range(1, longest + 1):
            if n > 1:
                going = places + n - 1 < len(self.ids)
                places, hashes = places[going], hashes[going]
                going = inside[places + n - 1]
                places, hashes = places[going], hashes[going]
                hashes = (hashes ^ (hashes >> np.uint64(29))) * _SPREAD[2] + single[places + n - 1]
            yield n, places, hashes

    def counts(self, places: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct n-grams at places, by their words, how many times they are there, and the first of `places` of each."""
        codes = self.ids[places]
        for i in range(1, n):
            codes = np.unique(codes, return_inverse=True)[1] * len(self.words) + self.ids[places + i]
        _, first, count = np.unique(codes, return_index=True, return_counts=True)
        at = places[first]
        parts = [map(self.words.__getitem__, self.ids[at + i].tolist()) for i in range(n)]
        return list(map(b" ".join, zip(*parts, strict=True))), count, first


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, Chunk]]:
    """Texts of (lang, text) batches in chunks of one language; null languages are 'und', null texts empty."""
    for b in batches:
        held: dict[bytes, list[bytes]] = {}
        size = 0
        for lang, text in zip(b.column(0), b.column(1).cast(pa.binary() if pa.types.is_string(b.column(1).type) else pa.large_binary()), strict=True):
            lang, text = (lang.as_py() if lang.is_valid else _LANG).encode(), text.as_py() or b""
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= CHUNK:
                yield from ((at, Chunk(at, some)) for at, some in held.items())
                held, size = {}, 0
        yield from ((at, Chunk(at, some)) for at, some in held.items())


def cell(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cells of hashes in a row of the sketch."""
    mixed = hashes ^ (hashes >> np.uint64(32))
    return ((mixed * _SPREAD[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def packed(cells: np.ndarray, codec: pa.Codec) -> bytes:
    """Sorted cells below 65,536 as (number of bytes, then compressed:) steps' low bytes, their high bytes, counts up to 255."""
    places, counts = np.unique(cells, return_counts=True)
    steps = np.diff(places.astype(np.int64), prepend=-1) - 1
    raw = np.concatenate([steps & 255, steps >> 8, np.minimum(counts, 255)]).astype(np.uint8).tobytes()
    return len(raw).to_bytes(4, "little") + codec.compress(raw, asbytes=True)


def unpacked(data: bytes, codec: pa.Codec) -> tuple[np.ndarray, np.ndarray]:
    """The places and counts of `packed`."""
    size = int.from_bytes(data[:4], "little")
    low, high, counts = np.frombuffer(codec.decompress(data[4:], size), np.uint8).reshape(3, -1)
    return np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 8) + 1) - 1, counts


def _parts(batches: Iterator[pa.RecordBatch], longest: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A task's sketch in blocks: (row, block, cells), the cells that count and their counts as `packed`."""
    held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
    block, codec = min(BLOCK, 1 << bits), pa.Codec("zstd", 1)

    def told() -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            cells = np.concatenate(held[row])
            held[row] = []
            cells.sort()
            edges = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, block, dtype=np.uint64))
            blocks, found = [], []
            for i in np.flatnonzero(np.diff(edges)):
                blocks.append(int(i))
                found.append(packed(cells[edges[i] : edges[i + 1]] - np.uint32(i * block), codec))
            for at in range(0, len(blocks), 500):
                own = blocks[at : at + 500]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(own), pa.int32()), pa.array(own, pa.int32()), pa.array(found[at : at + 500], pa.binary())], ["row", "block", "cells"])

    size = 0
    for _, chunk in chunks(batches):
        for _, _, hashes in chunk.grams(longest):
            for row in range(ROWS):
                held[row].append(cell(hashes, row, bits))
            size += ROWS * len(hashes)
        if size > HELD:
            yield from told()
            size = 0
    if size:
        yield from told()


def _sums(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(row, block, often): which cells of sorted parts reach the least count, as packed bits."""
    block, codec, at, total = min(BLOCK, 1 << bits), pa.Codec("zstd"), None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["row", "block", "often"])

    for b in batches:
        for row, number, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if at != (row, number):
                if at is not None:
                    yield told()
                at, total = (row, number), np.zeros(block, np.int64)
            places, counts = unpacked(cells.as_py(), codec)
            total[places] += counts
    if at is not None:
        yield told()


def text_bytes(docs: DataFrame) -> int:
    """The length of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def cell_bits(size: int) -> int:
    """The logarithm of the cells a row for so many bytes of text."""
    return min(CELL_BITS[1], max(CELL_BITS[0], (size // BYTES_A_CELL).bit_length()))


def sketched(docs: DataFrame, longest: int = WORDS, least: int = LEAST, bits: int | None = None) -> np.ndarray:
    """The merged sketch of (lang, text): for each row a packed bit a cell, whether its sum reaches `least` (at most 255).

    `bits` is the logarithm of the cells a row; by default it follows the texts' length between `CELL_BITS`, so that
    what is collected and sent has at most ROWS * 2 ** CELL_BITS[1] / 8 bytes. With more text for each cell more rare
    n-grams pass, which costs time but changes no count.
    """
    if bits is None:
        bits = cell_bits(text_bytes(docs))
    if not 1 <= least <= 255:
        raise ValueError("a cell counts up to 255")
    parts = docs.select("lang", "text").mapInArrow(lambda batches: _parts(batches, longest, bits), "row int, block int, cells binary")
    merged = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(lambda batches: _sums(batches, least, bits), "row int, block int, often binary")
    block = max(1, min(BLOCK, 1 << bits) // 8)
    often = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for row, number, some in merged.collect():
        often[row, number * block : (number + 1) * block] = np.frombuffer(some, np.uint8)
    return often


def squeezed(raw: bytes | pa.Buffer, codec: pa.Codec) -> bytes:
    """Bytes as their number, then compressed."""
    return len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)


def unsqueezed(data: bytes, codec: pa.Codec) -> bytes:
    """The bytes of `squeezed`."""
    return codec.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def listed(bucket: np.ndarray, key: pa.Array, f: np.ndarray) -> pa.Table:
    """Counted n-grams of one language: their buckets, the n-grams with a line end behind each, and counts."""
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "key": key, "f": pa.array(f, pa.int64())})


def summed(some: list[pa.Table]) -> pa.Table:
    """`listed` tables as one, in which an n-gram comes once."""
    table = pa.concat_tables(some)
    kind = pa.binary() if table.nbytes < 1 << 30 else pa.large_binary()  # grouping by the small kind takes less memory
    table = table.set_column(1, "key", table["key"].cast(kind)).group_by(["bucket", "key"], use_threads=False).aggregate([("f", "sum")])
    return pa.table({"bucket": table["bucket"], "key": table["key"].cast(pa.large_binary()), "f": table["f_sum"]})


def blocks(table: pa.Table, codec: pa.Codec) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, n-grams, counts) of a `listed` table: a bucket's n-grams in order, and their counts byte plane by byte plane."""
    table = table.take(pc.sort_indices(table, [("bucket", "ascending"), ("key", "ascending")]))
    bucket, key, f = table["bucket"].to_numpy(), pa.concat_arrays(table["key"].chunks), table["f"].to_numpy()
    offsets = np.frombuffer(key.buffers()[1], np.int64)[key.offset : key.offset + len(key) + 1]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
    for i, j in zip(edges, edges[1:], strict=False):
        raw = key.buffers()[2].slice(int(offsets[i]), int(offsets[j] - offsets[i]))
        yield int(bucket[i]), squeezed(raw, codec), squeezed(np.ascontiguousarray(f[i:j]).view(np.uint8).reshape(-1, 8).T.tobytes(), codec)


def unblocked(bucket: int, keys: bytes, counts: bytes, codec: pa.Codec) -> pa.Table:
    """The `listed` table of a block."""
    raw = unsqueezed(keys, codec)
    f = np.ascontiguousarray(np.frombuffer(unsqueezed(counts, codec), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    offsets = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1])
    key = pa.Array.from_buffers(pa.large_binary(), len(f), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    return listed(np.full(len(f), bucket), key, f)


def _counts(batches: Iterator[pa.RecordBatch], often: np.ndarray, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, keys, counts): `blocks` of a task's n-grams whose cells are all set in `often`, and of its words at an empty n-gram."""
    bits, codec = (8 * often.shape[1]).bit_length() - 1, pa.Codec("zstd", 3)
    held: dict[bytes, list[pa.Table]] = {}
    size = 0

    def told() -> Iterator[pa.RecordBatch]:
        for lang, some in held.items():
            rows = list(blocks(some[0], codec))
            for at in range(0, len(rows), 500):
                bucket, keys, counts = zip(*rows[at : at + 500], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.binary()).cast(pa.string()), pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["lang", "bucket", "keys", "counts"])

    for lang, chunk in chunks(batches):
        for n, places, hashes in chunk.grams(longest):
            found = []
            if n == 1 and len(places):
                found.append(listed(np.zeros(1), pa.array([b"\n"], pa.large_binary()), np.array([len(places)])))
            for row in range(ROWS):
                at = cell(hashes, row, bits)
                going = (often[row][at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & 1 > 0
                places, hashes = places[going], hashes[going]
            if len(places):
                some, count, first = chunk.counts(places, n)
                found.append(listed((hashes[first] % np.uint64(buckets)).astype(np.int32), pa.array([x + b"\n" for x in some], pa.large_binary()), count))
            held.setdefault(lang, []).extend(found)
            size += sum(x.nbytes for x in found)
        if size > COUNTED:
            held = {at: [summed(some)] for at, some in held.items() if some}
            size = sum(some[0].nbytes for some in held.values())
            if size > COUNTED // 2:
                yield from told()
                held, size = {}, 0
    held = {at: [summed(some)] for at, some in held.items() if some}
    yield from told()


def _totals(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, f): the n-grams of sorted blocks that come at least `least` times, and the empty ones."""
    codec, at = pa.Codec("zstd"), None
    held: list[pa.Table] = []
    size, most = 0, COUNTED

    def told() -> pa.Table:
        found = summed(held)
        found = found.filter(pc.or_(pc.greater_equal(found["f"], least), pc.equal(found["key"], pa.scalar(b"\n", pa.large_binary()))))
        phrase = pc.utf8_rtrim(found["key"].cast(pa.large_string()), "\n").cast(pa.string())
        words = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1))
        return pa.table({"lang": pa.array([at[0]] * len(found), pa.string()), "words": words.cast(pa.int32()), "phrase": phrase, "f": found["f"]})

    for b in batches:
        for lang, bucket, keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            if at != (lang, bucket):
                if at is not None:
                    yield from told().to_batches()
                at, held, size, most = (lang, bucket), [], 0, COUNTED
            held.append(unblocked(bucket, keys.as_py(), counts.as_py(), codec))
            size += held[-1].nbytes
            if size > most:
                held = [summed(held)]
                size = held[0].nbytes
                most = max(COUNTED, 2 * size)
    if at is not None:
        yield from told().to_batches()


def counted(docs: DataFrame, longest: int = WORDS, least: int = LEAST, bits: int | None = None) -> DataFrame:
    """(lang, words, phrase, f): the exact counts of n-grams of (lang, text) that come at least `least` times.

    A row of no words and an empty phrase holds the language's number of words, if it has any. Blocks are shuffled, not
    rows of an n-gram each, since nearly all n-grams of a large table come often and so nearly all have to be shuffled.
    """
    size = text_bytes(docs)
    sent = docs.sparkSession.sparkContext.broadcast(sketched(docs, longest, least, cell_bits(size) if bits is None else bits))
    buckets = 1 + size // BYTES_A_BUCKET
    parts = docs.select("lang", "text").mapInArrow(lambda batches: _counts(batches, sent.value, longest, buckets), "lang string, bucket int, keys binary, counts binary")
    return parts.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(lambda batches: _totals(batches, least), "lang string, words int, phrase string, f long")


def scored(grams: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates in `grams` (see `counted`) that no longer candidate takes over.

    Scores are computed in decimals of 38 digits, exact for counts up to 10 ** 15.
    """
    parts = F.split("phrase", " ")
    phrases = grams.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ")})
    known = grams.filter("words > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    score = F.call_function("div", exact["a"] * exact["a"] * F.lit(1_000_000).cast("decimal(7,0)"), exact["l"] * exact["r"]).cast("long")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))))
    longer = phrases.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    own = worst.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
    return own.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best(phrases: DataFrame, top: int = TOP, spread: int = 64) -> DataFrame:
    """`phrases` with `rank`: each language's first by score, count and phrase; first among parts of it, then in all."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(spread))
    some = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Texts are split into pieces at .,;:!? and line ends and pieces into words at blanks and tabs, A-Z lowered. Null texts
    are empty, null languages 'und'; repeated rows count again; rows without a phrase seen often enough add to n alone;
    an empty table gives no rows; other columns are not read. Equal scores go by count, then by the phrase's bytes.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(_LANG)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    grams = written(counted(rows, longest, least, bits), "collocations")
    n = grams.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best(scored(grams, share), top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return collocations(texts(docs, "lang", "text"))


#: The query in SQL.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists WHERE len(w) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists WHERE len(w) >= 3
), f AS (SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE words = 1 GROUP BY lang
), candidates AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10
), cuts AS (
  SELECT lang, words, phrase, a, 1 AS k, w[1] AS p, CASE words WHEN 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS q FROM candidates
  UNION ALL SELECT lang, words, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE words = 3
), valued AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q
), worst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM valued) WHERE nth = 1
), longer AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS part, a FROM candidates WHERE words = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE words = 3
  ) GROUP BY lang, part
), ranked AS (
  SELECT v.*, row_number() OVER (PARTITION BY v.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM worst v LEFT JOIN longer o ON o.lang = v.lang AND o.part = v.phrase WHERE o.most IS NULL OR 100 * o.most < 50 * v.a
)
SELECT r.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
