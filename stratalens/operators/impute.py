"""Iterative random-forest imputation.

In every round each column with gaps gets a forest from all other columns, as they stood after the round before, and its
gaps are filled anew. The trees of all columns of a round are one job: a task grows one tree at a time on a bootstrap
sample of a pool of rows that every task holds. A second job fills the rows with gaps, wherever they lie; rows without
gaps are read once and never touched again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.forest import MOST_BINS, Tree, grow
from stratalens.runtime import scratch_path, ship_package

MAX_ROUNDS = 10
POOL_ROWS = 50_000
MOST_LEAVES = 1024
TREE_FIELDS = "job int, feature binary, left_codes binary, child binary, value binary"
Levels = Mapping[str, Sequence[int] | None]


@dataclass
class Coding:
    """How the columns become codes: a factor by its place among its levels, a number by the cut points around it.

    The last code of a column stands for a gap.
    """

    columns: list[str]
    levels: dict[str, list[int] | None]
    cuts: dict[str, np.ndarray]

    @property
    def bins(self) -> np.ndarray:
        return np.array([len(self.cuts[c]) + 2 if self.levels[c] is None else len(self.levels[c]) + 1 for c in self.columns])

    @property
    def ordered(self) -> np.ndarray:
        return np.array([self.levels[c] is None for c in self.columns])

    def codes(self, j: int, values: np.ndarray) -> np.ndarray:
        """Codes of column ``j``; a factor comes as its place, NaN where it is missing."""
        c, gap = self.columns[j], np.isnan(values)
        if self.levels[c] is None:
            out = np.searchsorted(self.cuts[c], values, side="left")
        else:
            out = np.where(gap, 0, values).astype(np.int64)
        return np.where(gap, self.bins[j] - 1, out).astype(np.uint8)


def level_index(column: str, levels: Sequence[int]) -> str:
    """Place of a value among the levels; a value outside them is an error."""
    arms = " ".join(f"when {level} then {i}D" for i, level in enumerate(levels))
    wrong = f"cast(raise_error(concat('unknown level of {column}: ', {column})) as double)"
    return f"case {column} {arms} else if({column} is null, cast(null as double), {wrong}) end"


def first_fill(df: DataFrame, levels: Levels, targets: Sequence[str]) -> dict[str, float]:
    """Mode of a factor, mean of a number, in one aggregation."""
    row = df.agg(*[
        (F.avg(c) if levels[c] is None else F.mode(c, deterministic=True)).alias(c) for c in targets]).first()
    return row.asDict()


def _coding(df: DataFrame, levels: Levels) -> Coding:
    columns = list(levels)
    long = [c for c in columns if levels[c] is not None and len(levels[c]) > MOST_BINS - 1]
    if long:
        raise ValueError(f"more than {MOST_BINS - 1} levels: {long}")
    numbers = [c for c in columns if levels[c] is None]
    steps = [i / (MOST_BINS - 2) for i in range(1, MOST_BINS - 2)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, 10_000).alias(c) for c in numbers]).first() if numbers else {}
    cuts = {c: np.unique(np.array(found[c] or [], float)) for c in numbers}
    return Coding(columns, {c: None if levels[c] is None else list(levels[c]) for c in columns}, cuts)


def _matrix(batch: pa.RecordBatch, coding: Coding) -> np.ndarray:
    return np.stack([pc.fill_null(batch.column(c), float("nan")).to_numpy(zero_copy_only=False) for c in coding.columns], 1)


def _codes(values: np.ndarray, coding: Coding) -> np.ndarray:
    return np.stack([coding.codes(j, values[:, j]) for j in range(values.shape[1])], 1)


def _gaps(batch: pa.RecordBatch, targets: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(f"gap_{c}").to_numpy(zero_copy_only=False) for c in targets], 1).astype(bool)


def _forests(spark, codes: np.ndarray, values: np.ndarray, gaps: np.ndarray, coding: Coding, targets: Sequence[str], trees: int,
             most_leaves: int, seed: Sequence[int]) -> dict[int, list[Tree]]:
    """Trees of every target, by its place; a target without an observed row in the pool has none."""
    pool = spark.sparkContext.broadcast((codes, values, gaps))

    def run(batches):
        x, raw, missing = pool.value
        bins, ordered = coding.bins, coding.ordered
        for batch in batches:
            for job in batch.column("id").to_pylist():
                t = job // trees
                j = coding.columns.index(targets[t])
                seen = np.flatnonzero(~missing[:, t])
                if not len(seen):
                    continue
                rng = np.random.default_rng([*seed, job])
                weight = np.bincount(rng.integers(0, len(seen), len(seen)), minlength=len(seen)).astype(float)
                others = np.delete(np.arange(x.shape[1]), j)
                known = coding.levels[targets[t]]
                classes = 0 if known is None else len(known)
                tried = max(1, int(len(others) ** 0.5) if classes else len(others) // 3)
                tree = grow(x[seen][:, others], bins[others], ordered[others], raw[seen, j], weight, classes, rng, tried,
                            1 if classes else 5, most_leaves)
                feature = np.where(tree.feature >= 0, others[np.maximum(tree.feature, 0)], -1).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "job": pa.array([job], pa.int32()), "feature": [feature.tobytes()], "left_codes": [tree.left_codes.tobytes()],
                    "child": [tree.child.astype(np.int32).tobytes()], "value": [tree.value.astype(np.float64).tobytes()]})

    jobs = len(targets) * trees
    slots = min(jobs, 4 * spark.sparkContext.defaultParallelism)
    made = spark.range(0, jobs, 1, slots).mapInArrow(run, TREE_FIELDS).collect()
    pool.destroy()
    out: dict[int, list[Tree]] = {}
    for r in sorted(made, key=lambda r: r.job):
        out.setdefault(r.job // trees, []).append(Tree(
            np.frombuffer(r.feature, np.int32), np.frombuffer(r.left_codes, np.uint64),
            np.frombuffer(r.child, np.int32).astype(np.int64), np.frombuffer(r.value, float)))
    return out


def _fill(values: np.ndarray, codes: np.ndarray, gaps: np.ndarray, coding: Coding, targets: Sequence[str],
          forests: dict[int, list[Tree]]) -> np.ndarray:
    """The values with every gap predicted anew from the codes: majority of the trees, or their mean."""
    out = values.copy()
    for t, grown in forests.items():
        rows = np.flatnonzero(gaps[:, t])
        if not len(rows):
            continue
        j = coding.columns.index(targets[t])
        guesses = [tree.predict(codes[rows]) for tree in grown]
        known = coding.levels[targets[t]]
        if known is None:
            out[rows, j] = np.mean(guesses, 0)
        else:
            votes = np.zeros((len(rows), len(known)))
            for guess in guesses:
                votes[np.arange(len(rows)), guess.astype(np.int64)] += 1
            out[rows, j] = votes.argmax(1)
    return out


def rf_impute(df: DataFrame, levels: Levels, targets: Sequence[str] | None = None, row_id: str = "rid", trees: int = 100,
              seed: int = 1, max_rounds: int = MAX_ROUNDS, pool_rows: int = POOL_ROWS, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """Fill the NULL cells of ``targets`` (all columns of ``levels`` without it) from all columns of ``levels``.

    ``levels`` gives the level list of each factor and None for a number. Any column may have gaps: those of a column
    that is no target are a code of their own. First fills are the mode or the mean. After each round the change
    against the round before is measured over all filled cells, relative for numbers and as share of changed cells for
    factors; when it grows for every kind present, the round before is the result.

    The trees are fitted on at most ``pool_rows`` rows, those with the smallest hash of ``row_id`` (a documented bound, as
    is ``most_leaves`` per tree; depth has none); first fills, cut points, changes and the filling cover all rows. With
    fewer rows every tree draws its bootstrap sample from the whole table. A column without any value stays as it is.
    Filled numbers are doubles. Returns ``row_id`` and the columns of ``levels``.
    """
    spark, columns = df.sparkSession, list(levels)
    ship_package(spark)
    targets = columns if targets is None else list(targets)
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in targets]).first().asDict()
    order = [c for c in targets if 0 < counts[c] < counts["rows"]]
    plain = df.select(row_id, *columns)
    if not order:
        return plain
    coding, fill = _coding(df, levels), first_fill(df, levels, order)
    place = lambda c: f"cast({c} as double)" if levels[c] is None else level_index(c, levels[c])

    def coded(rows: DataFrame) -> DataFrame:
        """``row_id``, a double per column (place of a factor, a target filled) and a mark per target's gap."""
        full = rows.select(row_id, *[F.col(c).isNull().alias(f"gap_{c}") for c in order],
                           *[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in order else F.col(c) for c in columns])
        return full.select(row_id, *[f"gap_{c}" for c in order], *[F.expr(place(c)).alias(c) for c in columns])

    def stored(rows: DataFrame) -> DataFrame:
        path = scratch_path(spark, "imputed")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    some_gap = " or ".join(f"{c} is null" for c in order)
    state = stored(coded(df.filter(some_gap)))
    pool = coded(df.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id).limit(pool_rows)).toArrow()
    pool = pool.sort_by(row_id).combine_chunks().to_batches()[0]
    pool_values, pool_gaps = _matrix(pool, coding), _gaps(pool, order)
    kinds = {c: "numbers" if levels[c] is None else "factors" for c in order}
    parts = ("moved", "scale", "flipped", "cells")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema] + [f"{p}_ double" for p in parts])
    change: dict[str, float] | None = None
    for turn in range(max_rounds):
        pool_codes = _codes(pool_values, coding)
        forests = _forests(spark, pool_codes, pool_values, pool_gaps, coding, order, trees, most_leaves, [seed, turn])
        known = spark.sparkContext.broadcast(forests)

        def update(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                old, gaps = _matrix(batch, coding), _gaps(batch, order)
                new = _fill(old, _codes(old, coding), gaps, coding, order, known.value)
                sums = dict.fromkeys(parts, 0.0)
                for t, c in enumerate(order):
                    j, rows = columns.index(c), gaps[:, t]
                    if kinds[c] == "numbers":
                        sums["moved"] += ((new[rows, j] - old[rows, j]) ** 2).sum()
                        sums["scale"] += (new[rows, j] ** 2).sum()
                    else:
                        sums["flipped"] += (new[rows, j] != old[rows, j]).sum()
                        sums["cells"] += rows.sum()
                made = {c: pa.array(new[:, j], from_pandas=True) for j, c in enumerate(columns)}
                # the sums of a batch stand on its first row
                extra = {f"{p}_": pa.array(np.concatenate([[sums[p]], np.zeros(len(new) - 1)])) for p in parts}
                yield pa.RecordBatch.from_pydict({n: made.get(n, extra.get(n)) if n in made or n in extra else batch.column(n)
                                                  for n in [*batch.schema.names, *extra]})

        new = stored(state.mapInArrow(update, schema))
        row = new.agg(*[F.sum(f"{p}_").alias(p) for p in parts]).first()
        now = {}
        if "numbers" in kinds.values():
            now["numbers"] = row["moved"] / (row["scale"] or 1.0)
        if "factors" in kinds.values():
            now["factors"] = row["flipped"] / (row["cells"] or 1.0)
        if change is not None and all(now[k] >= change[k] for k in now):
            break
        state, change = new.drop(*[f"{p}_" for p in parts]), now
        pool_values = _fill(pool_values, pool_codes, pool_gaps, coding, order, forests)
        if not any(now.values()):
            break

    def decoded(c: str):
        if levels[c] is not None:
            value = F.get(F.array(*[F.lit(x) for x in levels[c]]), F.col(c).cast("int"))
        else:
            value = F.col(c)
        kind = "double" if levels[c] is None and c in order else df.schema[c].dataType
        return value.cast(kind).alias(c)

    whole = df.filter(f"not ({some_gap})").select(row_id, *[
        F.col(c).cast("double").alias(c) if levels[c] is None and c in order else F.col(c) for c in columns])
    return whole.unionByName(state.select(row_id, *[decoded(c) for c in columns]))
