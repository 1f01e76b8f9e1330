"""Session services: checkpoint folder, materialising, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    A session that names none may only fall back to a local folder when it
    runs in local mode, as tests do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Functions that run in workers are pickled by reference, so the workers must
    be able to import them from wherever the driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_stratalens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._stratalens_shipped = True


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage at reliable storage so lost executors cost no recomputation."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def width_of(field) -> Column:
    """Bytes of one value: measured for texts and lists, the type's own for numbers."""
    kind, at = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(at), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType)) and not isinstance(getattr(kind, "elementType", kind), (T.StringType, T.StructType, T.MapType)):
        return F.coalesce(F.size(at), F.lit(0)) * 16 + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(at)), F.lit(0)) + 16
    return F.lit(16)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a frame has at most so many rows and bytes; no more than one row beyond the bound is looked at."""
    width = F.lit(0)
    for field in df.schema:
        width = width + width_of(field)
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the measured size allows it; otherwise Spark shuffles."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Full parallelism ahead of a step that multiplies rows.

    Adaptive execution packs small inputs into few partitions by their size
    before the step; an explicit count keeps it from doing so.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def spread_in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Like :func:`spread`, by ranges of the keys: a task gets neighbouring keys, whichever of them have many rows."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
