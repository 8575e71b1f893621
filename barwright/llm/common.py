"""Helpers that the corpus operators share: scratch tables, folds, column-safe selection."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one where it is unset in local mode.

    On a cluster a local folder would be another one on each machine, so there the setting has to be made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barwright-"))
        root = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/barwright/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lost executors never force what made it to run twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])


def placed(n: int) -> list[str]:
    """Names for n columns by their places, for functions over Arrow batches, which take no names with dots."""
    return [f"c{i}" for i in range(n)]


def filtered(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows of `df` that `run` leaves in its batches, whose columns are in the order of `df`."""
    plain = df.toDF(*placed(len(df.columns)))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def row_hash(df: DataFrame) -> Column:
    """A hash of all of a row's columns; maps and variants, which have no hash, count as their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in df.dtypes])


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id falls in fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def bounded_sample(df: DataFrame, id_col: str, most: int, seed: str) -> DataFrame:
    """About `most` rows chosen by a hash of the id, so that reruns agree, never more than twice as many; all rows if there are fewer.

    One count sets the share of the hash range that is kept. The hard bound only counts where a few ids hold many rows;
    which of these rows stay is open then.
    """
    n = df.count()
    if n <= most:
        return df
    some = df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_003)) < int(1_000_003 * most / n))
    return some.limit(2 * most) if some.count() > 2 * most else some


def rows_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a text column, row by row without a detour over str; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()):
        yield x.as_py() or b""


def crc_fold(doc_id: int, modulus: int) -> int:
    """The fold that `fold` gives, in Python."""
    return zlib.crc32(str(doc_id).encode()) % modulus
