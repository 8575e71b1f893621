"""From raw documents to packed sequences: filter by toxicity and language, drop near-duplicates, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. Null ids are ids that no row shares; a null text counts as empty, passes the toxicity stage and goes
in the language stage, as texts without letters do. Repeated rows stay until near-duplicates are dropped; an empty table
gives an empty result. Texts of any length are read whole. Ties: a score equal to a limit goes as toxic and stays as a
language; of near-duplicates that share the smallest id, or have none, one stays by its content's hash; equal ids and
places in mixing and packing are ordered by content. Columns beside those of documents, whatever their names, stay as
they are up to packing, which gives pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm import langid, mixing, packing, simhash, toxicity
from barwright.llm.common import written


#: Rows that a task holds as one Arrow batch: texts are long, and batches exist on both sides of Python.
BATCH_ROWS = 1000
#: Chunks of text whose tokens a worker remembers: it does so until it ends, beside whatever runs in it afterwards.
KEPT_CHUNKS = 60_000


def _in_batches(spark: SparkSession) -> None:
    """Bounds the batches of what is planned in this session from here on; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, as learned from the labels of those in `docs`, is below a half."""
    _in_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_civil(docs, toxicity.fit(docs, labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is decided with a probability of at least a half."""
    _in_batches(spark)
    return langid.keep_known(docs, langid.fit(docs), least=0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    _in_batches(spark)
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights, as documents: what each pass takes of a document is a row."""
    _in_batches(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    _in_batches(spark)
    return packing.report(docs, kept=KEPT_CHUNKS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, permutations and tokens are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
