"""Embedding whitening by a bidiagonal qd solver.

Entries become integers, so counts and sums are exact and rows are centred without loss before anything is multiplied.
Every task reduces its centred rows block by block to a triangle R; triangles are stored and reduced in groups of
bounded size until one is left. The driver, which sees that one triangle of dimension by dimension numbers, makes it
bidiagonal, finds its singular values by qd sweeps and the directions by twisted factorisations (``bidiagonal``). Two more
scans measure the covariance of the whitened rows and whiten every row.

Dropped are rows whose vector is null, empty or holds null or non-finite entries, and, if lengths differ, all but the
most frequent length (of equally frequent ones the greatest). Repeated rows and ids count as often as they stand and
each gives its rows; null ids pass. Directions without variance, to working precision, are not components: fewer than
two different vectors give none, nor does an empty table. Values that tie share an arbitrary but orthonormal basis. Extra
columns come along whatever their names. An entry beyond 2 ** 30 or a vector longer than ``MOST_DIMENSIONS`` is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import query, table
from stratalens.llm.bidiagonal import EPS, right_singular

SCALE, OFFSET = 64.0, 1_000_000
LARGEST = 2.0 ** 30
MOST_DIMENSIONS = 4096
#: Bytes of centred rows reduced at once, and of triangles reduced in one group.
BLOCK_BYTES = 1 << 24


def vectors(column: pa.ListArray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each length, the rows whose vectors are whole and their integer entries."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), size)
    whole = size > 0
    whole[owner[~np.isfinite(flat)]] = False
    out = []
    for dim in np.unique(size[whole]):
        rows = np.flatnonzero(whole & (size == dim))
        c = flat[(whole & (size == dim))[owner]].reshape(-1, dim)
        if np.abs(c).max(initial=0) > LARGEST:
            raise ValueError("an entry is beyond 2 ** 30")
        out.append((int(dim), rows, np.floor(SCALE * c).astype(np.int64) + OFFSET))
    return size, out


def of_length(batches: Iterator[pa.RecordBatch], column: str, dim: int):
    for batch in batches:
        for found, rows, x in vectors(batch.column(column))[1]:
            if found == dim:
                for first in range(0, len(rows), step := max(1, BLOCK_BYTES // (8 * dim))):
                    yield batch, rows[first:first + step], x[first:first + step]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: whole numbers, as int64 or, beyond that, Python's."""
    fits = n * (np.abs(x).max(initial=0).item() + 1) < 1 << 62
    kind = np.int64 if fits and max(map(abs, sums), default=0) < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def deviations(d: np.ndarray) -> pa.Array:
    """Sums of squares, exact; null beyond 38 digits."""
    largest = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
    if largest ** 2 * d.shape[1] < 1 << 63:
        return pc.cast(pa.array((d.astype(np.int64) ** 2).sum(1)), pa.decimal128(38, 0))
    exact = [int(v) for v in (d.astype(object) ** 2).sum(1)]
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))


@dataclass
class Whitening:
    """What all rows need: ``n`` fitted rows, their exact ``sums``, ``directions`` divided by the root of their eigenvalue."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float

    def rows(self, d: np.ndarray) -> np.ndarray:
        return (d / self.n).astype(float) @ self.directions


def _totals(df: DataFrame, column: str) -> tuple[int, list[int]]:
    """Rows of the most frequent length, and their sums: one row per batch leaves a task, added up as decimals."""

    def run(batches):
        for batch in batches:
            for dim, rows, x in vectors(batch.column(column))[1]:
                if dim > MOST_DIMENSIONS:
                    raise ValueError(f"a vector has more than {MOST_DIMENSIONS} entries")
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(rows)], pa.int64()),
                                                  "sums": pa.array([x.sum(0)], pa.list_(pa.int64()))})

    parts = (df.mapInArrow(run, "dim int, n long, sums array<long>")
             .select("dim", F.posexplode(F.concat(F.array("n"), "sums")).alias("pos", "part"))
             .groupBy("dim", "pos").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")))
    parts = runtime.materialise(parts)
    best = parts.filter("pos = 0").orderBy(F.desc("part"), F.desc("dim")).select("dim").head(1)
    if not best:
        return 0, []
    found = [int(r.part) for r in parts.filter(F.col("dim") == best[0].dim).orderBy("pos").select("part").collect()]
    return found[0], found[1:]


def _stack(r: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, block]), mode="r")


def triangle(df: DataFrame, column: str, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows, at most dimension by dimension."""
    spark, dim = df.sparkSession, len(sums)
    schema = "part long, r array<double>"

    def reduce_rows(batches):
        r = np.zeros((0, dim))
        for _, _, x in of_length(batches, column, dim):
            r = _stack(r, (centred(x, n, sums) / n).astype(float))
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def reduce_group(key, group):
        group = group.sort_by("part")
        r = np.zeros((0, dim))
        for one in group.column("r"):
            r = _stack(r, one.values.to_numpy().reshape(-1, dim))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    fan = max(2, min(256, BLOCK_BYTES // (8 * dim * dim)))
    level = df.mapInArrow(reduce_rows, schema)
    while True:
        path = runtime.scratch_path(spark, "triangles")
        level.write.parquet(path)
        level = spark.read.parquet(path)
        last = level.agg(F.max("part")).first()[0]
        if last == 0 or level.count() == 1:
            return np.array(level.first().r).reshape(-1, dim)
        level = (level.withColumn("group", F.expr(f"part div {fan}")).groupBy("group").applyInArrow(reduce_group, schema))


def _identity_error(df: DataFrame, column: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from sums of products per batch."""
    dim, k = model.directions.shape

    def run(batches):
        for _, _, x in of_length(batches, column, dim):
            w = model.rows(centred(x, model.n, model.sums))
            yield pa.RecordBatch.from_pydict({"part": pa.array([np.concatenate([w.sum(0), (w.T @ w).ravel()])], pa.list_(pa.float64()))})

    sums = (df.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("pos", "x"))
            .groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect())
    flat = np.array([r.x for r in sums]) / model.n
    mean, second = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def fit(df: DataFrame, column: str = "embedding", components: int = 32) -> Whitening:
    runtime.ship_package(df.sparkSession)
    one = df.select(F.col(f"`{column}`").alias("vector"))
    n, sums = _totals(one, "vector")
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    dim = len(sums)
    r = triangle(one, "vector", n, sums)
    values, directions = right_singular(np.vstack([r, np.zeros((dim - len(r), dim))]))
    keep = min(components, int((np.sqrt(values) > 4 * dim * EPS * np.sqrt(values[0])).sum()))
    model = Whitening(n, sums, directions[:, :keep] / np.sqrt(values[:keep] / n), values[:keep] / max(values.sum(), 1e-300), 0.0)
    if keep:
        model.identity_error = _identity_error(one, "vector", model)
    return model


def whiten(df: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """``row`` (the input row as a struct), ``deviation`` and ``whitened``, an entry per component; dropped rows are left out."""
    runtime.ship_package(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(model)
    both = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{column}`").alias("vector"))

    def run(batches):
        m = known.value
        for batch, rows, x in of_length(batches, "vector", len(m.sums)):
            d = centred(x, m.n, m.sums)
            w = m.rows(d)
            cut = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), deviations(d),
                                              pa.ListArray.from_arrays(cut, pa.array(w.ravel(), pa.float64()))],
                                             ["row", "deviation", "whitened"])

    row = both.schema["row"].dataType.simpleString()
    return both.mapInArrow(run, f"row {row}, deviation decimal(38,0), whitened array<double>")


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it does not fit a long."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return (whiten(rows, model).select("row.vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"),
                                       F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error")))
