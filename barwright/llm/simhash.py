"""SimHash near-duplicates, linked through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits agree in at least 6 of their 8 byte positions. The index has
posting lists of distinct fingerprints; a list stands for one byte position's content among fingerprints that share a
prefix. So that lists stay short, the prefix is the content of two of four position pairs (four bytes; one of the six
choices agrees for every link), and each of the four positions left has lists of its own. Partners are tallied over
these lists: a pair that the prefix and fewer than two further positions join falls out, since six are guaranteed, and
only what is left is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash, rows_of, texts, written
from .components import connected_components

#: Byte positions (0 is the lowest byte) in four pairs.
POSITION_PAIRS = ((0, 1), (2, 3), (4, 5), (6, 7))


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a UTF-8 text: A-Z lowered, shingles of `shingle` words, repeats counted.

    A bit is set where more than half of the shingles' XXH64 values have it. Fewer words than a shingle needs: the
    whole sequence is hashed. No word: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(line, seed)
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])])
    n = len(hashes) // 8
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(n, 64)
    whole = n // 255 * 255
    ones = bits[whole:].sum(0, dtype=np.uint8).astype(np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long; null text counts as empty.

    The long columns `carried` follow as they are.
    """
    names = ["doc_id", "fp", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, shingle, seed) for t in rows_of(b, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps, *[b.column(2 + i) for i in range(len(carried))]], names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *carried)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


#: The least number of byte positions in which linked fingerprints agree, and those that a prefix covers.
GUARANTEED, COVERED = 6, 4


def _byte(column: str, position: int) -> Column:
    return F.shiftright(F.col(column), 8 * position).bitwiseAND(F.lit(0xFF))


def _prefix(column: str, pairs: tuple[tuple[int, int], ...]) -> Column:
    """The 16-bit contents of two position pairs as one long."""
    parts = [F.shiftright(F.col(column), 8 * low).bitwiseAND(F.lit(0xFFFF)) for low, _ in pairs]
    return F.shiftleft(parts[0], 16).bitwiseOR(parts[1])


def postings(fps: DataFrame) -> DataFrame:
    """(slot, prefix, position, byte, fp): the inverted index of distinct `fp`, without prefixes that only one has.

    A fingerprint has six prefixes, one a slot, and under each a posting for each of the four positions left.
    """
    slots = list(combinations(POSITION_PAIRS, 2))
    each = F.array(*[F.struct(F.lit(i).alias("slot"), _prefix("fp", k).alias("prefix")) for i, k in enumerate(slots)])
    entries = fps.select("fp", F.explode(each).alias("at")).select("fp", "at.slot", "at.prefix")
    shared = entries.groupBy("slot", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("slot", "prefix")
    entries = entries.join(shared, ["slot", "prefix"])
    rest = F.lit(None)
    for i, k in enumerate(slots):
        left = [p for pair in POSITION_PAIRS if pair not in k for p in pair]
        rest = F.when(F.col("slot") == i, F.array(*[F.struct(F.lit(p).alias("position"), _byte("fp", p).alias("byte")) for p in left])).otherwise(rest)
    return entries.select("slot", "prefix", "fp", F.explode(rest).alias("at")).select("slot", "prefix", "at.position", "at.byte", "fp")


LIST = ["slot", "prefix", "position", "byte"]


def tallied(short: DataFrame) -> DataFrame:
    """(u, v, shared): pairs of the postings' fingerprints, u < v, with the byte positions that prefix and lists show equal."""
    a, b = short.withColumnRenamed("fp", "u"), short.withColumnRenamed("fp", "v")
    return a.join(b, LIST).filter("u < v").groupBy("slot", "u", "v").agg((F.count("*") + COVERED).alias("shared"))


def links(fps: DataFrame, max_bits: int = 2, long_list: int = 64) -> DataFrame:
    """(u, v): edges between distinct fingerprints (column fp) whose components are those of all links.

    Posting lists of at most `long_list` entries give their pairs: tallied, filtered by the guaranteed count, verified.
    A longer list holds fingerprints that agree in five bytes; a tally would take the square of it. There each entry is
    filed under itself and under its 24 one-bit changes in the bytes left: entries of one file differ by at most two
    bits, every pair of the list within two bits shares a file, and a file holds 25 entries at most. Joining each entry
    to its file's smallest keeps all components, at 25 rows an entry, however long the list. A pair that meets in a long
    list is linked there, any other one is tallied in full.
    """
    if max_bits != 2:
        raise ValueError("the index is laid out for links of at most 2 bits")
    index = written(postings(fps), "simhash-postings")
    sizes = index.groupBy(*LIST).agg(F.count("*").alias("n"))
    some, many = sizes.filter((F.col("n") > 1) & (F.col("n") <= long_list)), sizes.filter(F.col("n") > long_list)
    pairs = tallied(index.join(some.drop("n"), LIST)).filter(F.col("shared") >= GUARANTEED)
    near = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")

    slots = list(combinations(POSITION_PAIRS, 2))
    mask = lambda bit: (1 << bit) - (1 << 64 if bit == 63 else 0)
    changes = F.lit(None)
    for i, k in enumerate(slots):
        left = [p for pair in POSITION_PAIRS if pair not in k for p in pair]
        for p in left:
            bits = [8 * q + bit for q in left if q != p for bit in range(8)]
            changes = F.when((F.col("slot") == i) & (F.col("position") == p), F.array(F.lit(0).cast("long"), *[F.lit(mask(x)).cast("long") for x in bits])).otherwise(changes)
    filed = index.join(many.drop("n"), LIST).select("fp", F.explode(changes).alias("change")).select("fp", F.col("fp").bitwiseXOR(F.col("change")).alias("file")).distinct()
    least = filed.groupBy("file").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1")
    starred = filed.join(least, "file").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(starred)


def _rooted(distinct: DataFrame, max_bits: int) -> DataFrame:
    """`distinct`, a table of distinct fp, with its column root: the smallest fingerprint that fp reaches over links."""
    found = connected_components(links(distinct.select("fp"), max_bits)).select(F.col("node").alias("fp"), "component")
    return distinct.join(found, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): every row with its fingerprint and the smallest id it reaches over links.

    Rows link where their fingerprints differ in at most `max_bits` bits; equal fingerprints differ in none. Rows
    with null or wordless text have fingerprint zero and link like any other. Rows without an id link and are linked;
    repeated ids keep their rows, and rows that share an id link by their texts alone. A null id is a component's name
    only where no row of it has an id. An empty table gives no rows. Other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    rooted = _rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of `docs` with one row for each group of near-duplicates: the one of the smallest id.

    A row without an id stays only where no row of its group has one; of rows of a group that share the id, or have
    none, one stays, by its content's hash. Rows of different groups all stay, whatever their ids. All columns stay as
    they are, whatever their names.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(f"`{text_col}`")
    rows = docs.select(whole, F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), row_hash(docs).alias("row_hash"))
    key = ["id", "text_hash", "row_hash"]
    fps = written(fingerprints(rows, "id", "text", shingle, carried=("text_hash", "row_hash")).withColumnRenamed("doc_id", "id"), "simhash")
    first = F.struct(F.col("id").isNull().alias("none"), *key)
    rooted = _rooted(fps.groupBy("fp").agg(F.min(first).alias("first")), max_bits)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.struct(*[F.col(f"first.{k}").alias(k) for k in key]).alias("key"))
    # one hash of the key deals rows out for the join and for repeated rows, so whole rows move once; they are only sorted
    # a second time if any row is repeated as it is
    kept = kept.groupBy(F.xxhash64(*[f"key.{k}" for k in key]).alias("dealt")).agg(F.collect_set("key").alias("keys"))
    found = rows.withColumn("dealt", F.xxhash64(*key)).drop("text").join(kept, "dealt").filter(F.array_contains("keys", F.struct(*key)))
    repeated = not fps.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    one = found.dropDuplicates(["dealt", *key]) if repeated else found
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(texts(docs, "doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
