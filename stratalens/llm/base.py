"""Registry of the pipeline queries, Arrow mapping over texts, small shared helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratalens import runtime

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CHUNK_BYTES = 1 << 19


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name, with its SQL when it has one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES,
                rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of text and ``rows`` texts; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def map_texts(df: DataFrame, text: str, fn, schema: str, keep_text: bool = False) -> DataFrame:
    """``fn(list of texts or None) -> dict of arrays`` over every row; the other columns of ``df`` pass through.

    ``schema`` names the new columns; the text itself is returned only if asked for, and never a column that has the
    name of a new one.
    """
    runtime.ship_package(df.sparkSession)
    new = {name.lower() for name in StructType.fromDDL(schema).names}
    kept = [c for c in df.columns if (keep_text or c != text) and c.lower() not in new]
    fields = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [schema])

    def run(batches):
        for part in text_slices(batches, text):
            made = fn(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in kept] + [pa.array(v) for v in made.values()], kept + list(made))

    return df.mapInArrow(run, fields)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as keep it apart from the columns there are."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, text: str) -> DataFrame:
    """``row``: the whole row as a struct, and its text, so that no column added later can clash with the input's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))


def sample_ids(labels: DataFrame, id_col: str, label_col: str, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` labelled ids, the ones with the smallest seeded hash: bounded and the same in every run.

    An id labelled twice counts once with its larger label.
    """
    rows = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    return rows.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), "id").limit(limit)
