"""From the raw documents to packed token sequences: five stages, each over all that the one before it kept.

All stages but the last return the columns they were given, whatever their names, and an empty table for an empty one. Very
long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens import runtime
from stratalens.llm.mixing import mix_documents
from stratalens.llm.ngram_join import drop_near_copies
from stratalens.llm.packing import pack_documents
from stratalens.llm.pii import hide_private
from stratalens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below one half. Null and empty texts score by its bias alone and stay;
    repeated rows stay or go together."""
    return drop_toxic(spark, docs, sf_dir)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Null and wordless texts and rows without an
    id stay; rows that share an id stay or go together."""
    return drop_near_copies(spark, docs, sf_dir)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; every row stays, a null text null. Equal texts get equal results."""
    return hide_private(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; documents taken more than once are repeated. Rows without words stay once, a
    null source is a source, and rows with the same hash share the border of a budget."""
    return mix_documents(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document, a null text being one end mark. Repeated rows are packed each."""
    return pack_documents(spark, docs, sf_dir)


STAGES = [
    ("toxicity", toxicity),
    ("near copies", near_copies),
    ("private data", private_data),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = runtime.scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
