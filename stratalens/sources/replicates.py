"""Replicate records: one stored row per fit, read as one long row per (outcome, replicate, term).

A fit's row holds all its metrics and coefficients and whether it converged, so a fit is stored whole or not at all, and
a run that was interrupted knows which fits it need not make again. The folder of an outcome is its partition, so a
report on one outcome reads only that folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUES = T.MapType(T.StringType(), T.DoubleType())
RECORD_SCHEMA = T.StructType([
    T.StructField("replicate", T.IntegerType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("metrics", VALUES),
    T.StructField("coefs", VALUES),
    T.StructField("outcome", T.StringType()),
])
PREPARED_SCHEMA = "mark string, folder string"  # folders that begin with _ are no fits
KEYS = ["outcome", "replicate"]
KINDS = ("metrics", "coefs")


def write_replicate_results(metrics: DataFrame, coefs: DataFrame, path: str, append: bool = False) -> None:
    """Store long records (outcome, replicate, term, value, converged) of fits; a NULL value is not kept."""
    both = metrics.withColumn("kind", F.lit("metrics")).unionByName(coefs.withColumn("kind", F.lit("coefs")))
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(
        F.when((F.col("kind") == kind) & F.col("value").isNotNull(), F.struct("term", F.col("value").cast("double"))))))
    fits = both.groupBy("outcome", F.col("replicate").cast("int").alias("replicate")).agg(
        F.bool_and("converged").alias("converged"), *[of(k).cast(VALUES).alias(k) for k in KINDS])
    (fits.select("replicate", "converged", *KINDS, "outcome")
     .write.mode("append" if append else "errorifexists").partitionBy("outcome").parquet(path))


def stored_fits(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored fit; none where nothing has been written yet."""
    try:
        return spark.read.schema(RECORD_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD_SCHEMA)


def finished_fits(spark: SparkSession, path: str) -> DataFrame:
    return stored_fits(spark, path).select(*KEYS).distinct()


def finished_preparation(spark: SparkSession, path: str, mark: str) -> str | None:
    """Folder of the run, if there is one, that holds the stored preparation of this mark."""
    try:
        found = spark.read.schema(PREPARED_SCHEMA).parquet(f"{path}/_prepared").filter(F.col("mark") == mark).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return found["folder"] if found else None


def note_preparation(spark: SparkSession, path: str, mark: str, folder: str) -> None:
    """Written last, so that a preparation that was interrupted is not found."""
    spark.createDataFrame([(mark, folder)], PREPARED_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/_prepared")


def scan_replicates(spark: SparkSession, path: str) -> DataFrame:
    """Metrics and coefficients of every outcome and replicate, stacked, with the convergence of their fit."""
    fits = spark.read.schema(RECORD_SCHEMA).parquet(path)
    kinds = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*KINDS))
    return fits.select(*KEYS, "converged", F.explode(kinds).alias("kind", "values")).select(
        *KEYS, "kind", "converged", F.explode("values").alias("term", "value"))
