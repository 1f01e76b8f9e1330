"""Guttman scale analysis: does initiation follow an assumed item order?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators.describe import modal_frequency_row
from stratalens.schema import NEVER_USED


def guttman_order_check(ages: Sequence[Column]) -> Column:
    """1 when the ages of a row are not non-decreasing (ties are in order); a missing age counts as never used."""
    ages = [F.coalesce(x, F.lit(NEVER_USED)) for x in ages]
    in_order = reduce(lambda a, b: a & b, [x <= y for x, y in zip(ages, ages[1:])])
    return F.when(in_order, F.lit(0)).otherwise(F.lit(1))


def guttman_inversions(ages: Sequence[Column]) -> Column:
    """The classical count: adjacent items out of order."""
    return reduce(lambda a, b: a + b, [(x > y).cast("int") for x, y in zip(ages, ages[1:])])


def guttman_scales(df: DataFrame, orderings: Mapping[str, Sequence[str]],
                   used: Mapping[str, Sequence[str]], classical: bool = False, known: Sequence[str] = ()) -> DataFrame:
    """CR and CS of several item orders.

    ``orderings`` maps a label to its columns, easiest item first; ``used``
    gives the EVER columns of which one must be nonzero; rows with a NULL in one
    of ``known`` are left out. A NULL age counts as never used. Rows are first
    counted per distinct age pattern; errors and modal counts then come from
    the pattern table.
    """
    entries = [
        F.when(
            reduce(lambda a, b: a | b, [F.col(c) != 0 for c in used[label]]),
            F.struct(F.lit(label).alias("scale"),
                     F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(NEVER_USED)) for c in columns]).alias("ages")),
        )
        for label, columns in orderings.items()
    ]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in known], F.lit(True))
    patterns = (
        df.withColumn("complete", complete).select("complete", F.explode(F.array(*entries)).alias("e")).filter("e is not null and complete")
        .groupBy("e.scale", "e.ages").agg(F.count("*").alias("n"))
    )
    width = len(next(iter(orderings.values())))
    ages = [F.col("ages")[i] for i in range(width)]
    error = guttman_inversions(ages) if classical else guttman_order_check(ages)
    per_row = patterns.groupBy("scale").agg(
        F.sum("n").alias("rows"),
        F.sum(error * F.col("n")).alias("errors"),
        F.sum(modal_frequency_row(ages) * F.col("n")).alias("modal_rows"),
    )
    per_item = (
        patterns.select("scale", F.posexplode("ages").alias("item", "age"), "n")
        .groupBy("scale", "item", "age").agg(F.sum("n").alias("n"))
        .groupBy("scale", "item").agg(F.max("n").alias("modal"))
        .groupBy("scale").agg(F.sum("modal").alias("modal_items"))
    )
    responses = F.col("rows") * width
    worst = F.least(responses - F.col("modal_items"), responses - F.col("modal_rows"))
    return per_row.join(per_item, "scale").select(
        "scale", "rows", "errors",
        (1 - F.col("errors") / responses).alias("CR"),
        (1 - F.col("errors") / F.when(worst > 0, worst)).alias("CS"),
    )


def guttman_ages(df: DataFrame, compat: bool = False) -> DataFrame:
    """Adds NIC, the first use of any nicotine.

    Row-wise by default; ``compat`` uses the single minimum over both columns.
    """
    if compat:
        return df.withColumn("NIC", df.agg(F.least(F.min("FSM"), F.min("VAP"))).scalar())
    return df.withColumn("NIC", F.least("FSM", "VAP"))


def guttman_all(df: DataFrame, items: Sequence[str], compat: bool = False,
                digits: int = 3) -> DataFrame:
    """CR and CS for every item and both orders (with and without vaping).

    A missing age counts as never used. Rows without any use, or with an
    unknown flag of any item, are left out first.
    """
    flags = [c for c in df.columns if c.startswith("EVER_")]
    scales, used = {}, {}
    for item in items:
        for first in ("FSM", "NIC"):
            label = f"{first}.{item}"
            scales[label] = [first, "ALC", "MRJ", item]
            used[label] = [f"EVER_{i}" for i in ("ALC", "FSM", "VAP", "MRJ", item)]
    result = guttman_scales(guttman_ages(df, compat), scales, used, known=flags)
    return result.select(
        F.substring_index("scale", ".", 1).alias("first_item"),
        F.substring_index("scale", ".", -1).alias("item"),
        F.round("CR", digits).alias("CR"), F.round("CS", digits).alias("CS"),
    )
