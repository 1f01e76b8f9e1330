"""Reading and writing the survey tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scan_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """One wide table from files; an explicit schema avoids a footer or inference pass."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def normalise_names(df: DataFrame) -> DataFrame:
    """Upper-case every column name; names that differ only in case are an error."""
    upper = [c.upper() for c in df.columns]
    clash = sorted({c for c in upper if upper.count(c) > 1})
    if clash:
        raise ValueError(f"column names differ only in case: {clash}")
    return df.toDF(*upper)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: Sequence[str] = ()) -> None:
    writer = df.write.format(fmt).mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
