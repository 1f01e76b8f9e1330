"""Order-based primitives that never sort a whole group in one task.

A group (a stratum, an item, an outcome) may hold a third of all rows, so a
plain ``Window.partitionBy(group)`` is not safe. Each primitive first reduces
rows to distinct values where that is exact, then cuts the value range into
slices at split points shared by all groups. Slices hold about the same number
of rows whichever group they come from; windows run per (group, slice) and a
short summary per slice carries the state across slice borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.runtime import materialise

ROWS_PER_SLICE = 2_000_000


def slice_count(n_rows: int, rows_per_slice: int = ROWS_PER_SLICE) -> int:
    return max(1, -(-n_rows // rows_per_slice))


def split_points(df: DataFrame, value: str, slices: int) -> list[float]:
    """At most ``slices - 1`` cut points; any points are correct, good ones balance the work."""
    if slices <= 1:
        return []
    steps = [i / slices for i in range(1, slices)]
    found = df.select(F.percentile_approx(value, steps, 10 * slices).alias("p")).first()["p"]
    return sorted(set(found or []))


def slice_of(value: Column, points: Sequence[float]) -> Column:
    """Index of the slice a value belongs to: the number of cut points below it."""
    if not points:
        return F.lit(0)
    number = value.cast("double")

    def below(low: int, high: int) -> Column:
        """Binary search among the cut points: one comparison per halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number > F.lit(float(points[middle])), below(middle + 1, high)).otherwise(below(low, middle))

    if len(points) <= 64:
        return below(0, len(points))
    # a first step of 64 keeps the expression small
    step = -(-len(points) // 64)
    cuts = F.array(*[F.lit(float(p)) for p in points])
    heads = [float(p) for p in points[::step]]
    block = F.size(F.filter(F.array(*map(F.lit, heads)), lambda c: c < number)) - 1
    inner = F.slice(cuts, F.greatest(block * step, F.lit(0)) + 1, step)
    return F.when(block < 0, 0).otherwise(block * step + F.size(F.filter(inner, lambda c: c < number)))


def running_sums(df: DataFrame, group: Sequence[str], order: str, sums: Sequence[str],
                 slices: int | None = None) -> DataFrame:
    """Distinct (group, order) values with the total and the sum strictly below of each column.

    Adds ``below_<c>`` per summed column ``c``. Without ``slices`` the number
    of distinct values decides how many there are; pass 1 where it is bounded.
    """
    points_df = df.groupBy(*group, order).agg(*[F.sum(c).alias(c) for c in sums])
    if slices is None:
        points_df = materialise(points_df)
        slices = slice_count(points_df.count())
    points = split_points(points_df, order, slices)
    cut = points_df.withColumn("slice", slice_of(F.col(order), points))
    inside = Window.partitionBy(*group, "slice").orderBy(order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    local = cut.withColumns(
        {f"below_{c}": F.coalesce(F.sum(c).over(before), zero) for c in sums}
    )
    if not points:
        return local.drop("slice")
    per_slice = cut.groupBy(*group, "slice").agg(*[F.sum(c).alias(f"slice_{c}") for c in sums])
    across = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *group, "slice",
        *[F.coalesce(F.sum(f"slice_{c}").over(across), zero).alias(f"carry_{c}") for c in sums],
    )
    joined = local.join(offsets, [*group, "slice"])
    return joined.select(
        *group, order, *sums,
        *[(F.col(f"below_{c}") + F.col(f"carry_{c}")).alias(f"below_{c}") for c in sums],
    )


def line_neighbours(queries: DataFrame, targets: DataFrame, group: Sequence[str], value: str,
                    row_id: str, k: int, slices: int | None = None) -> DataFrame:
    """The ``k`` nearest targets on a number line inside the group of each query.

    Both frames carry the group columns, ``value`` and ``row_id``; a query is
    never its own neighbour. Ties go to the smaller row id. Adds ``near``, an
    array of (value, id) structs ordered by distance and id. Groups without
    another target give an empty array.

    Exact: at one value only the ``k + 1`` smallest ids can matter, and on each
    side only the next ``k`` distinct values can.
    """
    group = list(group)
    slices = slice_count(targets.count()) if slices is None else slices
    smallest = Window.partitionBy(*group, value).orderBy(row_id)
    points_df = (
        targets.select(*group, value, row_id)
        .withColumn("place", F.row_number().over(smallest))
        .filter(F.col("place") <= k + 1)
        .groupBy(*group, value)
        .agg(F.sort_array(F.collect_list(row_id)).alias("ids"))
        .withColumn("point", F.struct(F.col(value).alias("at"), "ids"))
        .select(*group, value, "point")
    )
    asked = queries.select(*group, value).distinct()
    line = (
        points_df.unionByName(asked.withColumn("point", F.lit(None).cast(points_df.schema["point"].dataType)))
        .groupBy(*group, value)
        .agg(F.max("point").alias("point"), F.max(F.col("point").isNull()).alias("asked"))
    )
    points = split_points(line, value, slices)
    line = line.withColumn("slice", slice_of(F.col(value), points))
    over = f"over (partition by {', '.join([*group, 'slice'])} order by {value})"
    sides = {
        "lower": [F.expr(f"lag(point, {i}) ignore nulls {over}") for i in range(1, k + 1)],
        "upper": [F.expr(f"lead(point, {i}) ignore nulls {over}") for i in range(1, k + 1)],
    }
    near = line.withColumns({name: F.filter(F.array(*cols), lambda p: p.isNotNull())
                             for name, cols in sides.items()})
    if points:
        near = _carry_points(near, line, group, value, k)
    near = near.filter("asked").select(
        *group, value,
        F.concat(F.filter(F.array("point"), lambda p: p.isNotNull()), "lower", "upper").alias("points"),
    )
    spread = F.flatten(F.transform("points", lambda p: F.transform(
        p["ids"], lambda i: F.struct(
            F.abs(p["at"] - F.col(value)).alias("gap"), i.alias("id"), p["at"].alias("at")))))
    # a few ids beyond k cover the query itself being among them
    near = near.select(*group, value, F.slice(F.sort_array(spread), 1, k + 1).alias("found"))
    own = F.filter("found", lambda c: c["id"] != F.col(row_id))
    ranked = F.transform(F.slice(own, 1, k), lambda c: F.struct(c["at"].alias("value"), c["id"].alias("id")))
    return queries.join(near, [*group, value]).withColumn("near", ranked).drop("found")


def _carry_points(near: DataFrame, line: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """Complete the neighbour lists at slice borders with points of other slices."""
    targets = line.filter("point is not null")
    first = Window.partitionBy(*group, "slice").orderBy(value)
    last = Window.partitionBy(*group, "slice").orderBy(F.desc(value))
    heads = targets.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    tails = targets.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= k)
    head = heads.groupBy(*group, "slice").agg(F.sort_array(F.collect_list("point")).alias("head"))
    tail = tails.groupBy(*group, "slice").agg(F.sort_array(F.collect_list("point"), False).alias("tail"))
    summary = (
        line.select(*group, "slice").distinct()
        .join(head, [*group, "slice"], "left").join(tail, [*group, "slice"], "left")
    )
    # only non-empty slices can contribute, and k of them hold at least k points
    empty = F.array().cast(head.schema["head"].dataType)
    over = f"over (partition by {', '.join(group)} order by slice)"
    earlier = [F.coalesce(F.expr(f"lag(tail, {i}) ignore nulls {over}"), empty) for i in range(1, k + 1)]
    later = [F.coalesce(F.expr(f"lead(head, {i}) ignore nulls {over}"), empty) for i in range(1, k + 1)]
    carried = summary.select(
        *group, "slice",
        F.slice(F.concat(*earlier), 1, k).alias("before"),
        F.slice(F.concat(*later), 1, k).alias("after"),
    )
    return near.join(carried, [*group, "slice"]).withColumns({
        "lower": F.slice(F.concat("lower", "before"), 1, k),
        "upper": F.slice(F.concat("upper", "after"), 1, k),
    })
