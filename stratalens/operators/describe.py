"""Weighted and unweighted descriptions of survey tables.

Rates over many columns are one wide aggregation whose single row is melted
afterwards, so the table is read once and only one row is reshaped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.ordered import running_sums
from stratalens.runtime import materialise

NUMBERS = {"byte", "short", "integer", "long", "float", "double", "decimal"}
DENSITY_BINS = 4096


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the whole weight, a NULL value adding nothing on top."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def _wide_then_long(df: DataFrame, columns: Sequence[str], measure, name: str, value: str) -> DataFrame:
    wide = df.agg(*[measure(c).alias(c) for c in columns])
    return wide.unpivot([], list(columns), name, value)


def weighted_rate(df: DataFrame, columns: Sequence[str], weight: str,
                  name: str = "Drug", value: str = "Proportion") -> DataFrame:
    return _wide_then_long(df, columns, lambda c: weighted_mean(F.col(c), F.col(weight)), name, value)


def unweighted_rate(df: DataFrame, columns: Sequence[str], scale: float = 100.0,
                    name: str = "Drug", value: str = "Proportion") -> DataFrame:
    return _wide_then_long(df, columns, lambda c: F.try_divide(F.sum(c) * scale, F.count(c)), name, value)


def order_levels_by_value(rates: DataFrame, name: str, value: str) -> DataFrame:
    """Position of each category when ordered by its measure: one row per column name, so one task orders them."""
    return rates.withColumn("position", F.row_number().over(Window.orderBy(value, name)))


def weighted_group_rate(long: DataFrame, keys: Sequence[str], value: str, weight: str,
                        name: str = "share") -> DataFrame:
    return long.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(weight)).alias(name))


def crosstab_long(df: DataFrame, outcomes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Counts by (outcome, ever, variable, value) over the complete cases of each outcome.

    ``outcomes`` maps an EVER column to its predictor columns. Rows are first
    counted per whole answer pattern, so the melt runs over patterns.
    """
    entries = []
    for outcome, predictors in outcomes.items():
        complete = " and ".join(f"{c} is not null" for c in [outcome, *predictors])
        cells = ", ".join(f"named_struct('befor_var', '{p}', 'befor_value', {p})" for p in predictors)
        entries.append(f"if({complete}, named_struct('outcome', '{outcome}', 'ever', {outcome},"
                       f" 'cells', array({cells})), null)")
    rows = df.select(F.expr(f"explode(array({', '.join(entries)})) as e")).filter("e is not null")
    patterns = rows.groupBy("e").agg(F.count("*").alias("n"))
    return (
        patterns.select("e.outcome", "e.ever", F.inline("e.cells"), "n")
        .groupBy("outcome", "ever", "befor_var", "befor_value")
        .agg(F.sum("n").alias("frequency"))
    )


def category_totals(df: DataFrame, columns: Sequence[str], weight: str | None = None,
                    name: str = "variable", value: str = "category") -> DataFrame:
    """Total weight (or row count) per category of each column."""
    ids = [weight] if weight else []
    total = F.sum(weight) if weight else F.count("*")
    return df.select(*ids, *columns).unpivot(ids, list(columns), name, value).groupBy(name, value).agg(
        total.alias("total"))


def share_in_group(totals: DataFrame, group: str = "variable", total: str = "total") -> DataFrame:
    """Share of each category in the total of its facet."""
    whole = F.sum(total).over(Window.partitionBy(group))
    return totals.withColumn("share", F.try_divide(F.col(total), whole))


def quantiles_of_counts(counts: DataFrame, item: str, value: str, n: str, probs: Mapping[str, float],
                        slices: int | None = None) -> DataFrame:
    """Interpolated quantiles per item of a (item, value, count) table.

    Ranks come from running counts, so no task holds all values of an item.
    """
    points = running_sums(counts, [item], value, [n], slices)
    totals = points.groupBy(item).agg(F.sum(n).alias("total"))
    ranked = points.join(totals, item)
    first, last = F.col(f"below_{n}"), F.col(f"below_{n}") + F.col(n)

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < last), F.col(value)))

    out = []
    for name, q in probs.items():
        place = (F.col("total") - 1) * F.lit(float(q))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return ranked.groupBy(item).agg(*out)


def weighted_points(long: DataFrame, item: str, value: str, weight: str,
                    slices: int | None = None) -> DataFrame:
    """Distinct values of each item with their weight and the weight below them."""
    return running_sums(long, [item], value, [weight], slices)


def weighted_quantiles(long: DataFrame, item: str, value: str, weight: str,
                       slices: int | None = None) -> DataFrame:
    """Box statistics per item: quartiles, 1.5 IQR whiskers, share of weight outside them.

    A quartile is the smallest value whose cumulative weight reaches its share.
    """
    points = weighted_points(long, item, value, weight, slices)
    totals = points.groupBy(item).agg(F.sum(weight).alias("whole"))
    reached = points.join(totals, item).withColumn("cum", (F.col(f"below_{weight}") + F.col(weight)) * 4)
    box = reached.groupBy(item).agg(*[
        F.min(F.when(F.col("cum") >= F.col("whole") * q, F.col(value))).alias(f"q{q}") for q in (1, 2, 3)
    ])
    spread = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - 1.5 * spread) & (F.col(value) <= F.col("q3") + 1.5 * spread)
    return points.join(box, item).groupBy(item, "q1", "q2", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col(weight)).otherwise(0)).alias("outlier_weight"),
    )


def weighted_density(long: DataFrame, item: str, value: str, weight: str,
                     grid_points: int = 64, slices: int | None = None, bins: int = DENSITY_BINS) -> DataFrame:
    """Weighted Gaussian kernel density of each item on a grid between its extremes.

    The bandwidth is 0.9 min(sd, IQR / 1.34) n^(-1/5) of the unweighted values; where
    that is zero the sd, the value itself or 1 takes the place of the minimum, in this order.
    Rows are reduced to distinct values first; each of them adds its kernel to
    every grid point, so the work does not depend on the row count. An item with
    more than ``bins`` distinct values is first laid on that many equal steps,
    each value giving the two steps around it its weight by nearness, so that a
    continuous value costs no more than a discrete one.
    """
    points = materialise(long.groupBy(item, value).agg(F.count("*").alias("n"), F.sum(weight).alias("w")))
    n, s, ss = F.sum("n"), F.sum(F.col(value) * F.col("n")), F.sum(F.col(value) * F.col(value) * F.col("n"))
    stats = points.groupBy(item).agg(
        n.alias("rows"), F.sum("w").alias("whole"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.sqrt(F.try_divide(ss * n - s * s, n * (n - 1))).alias("sd"), F.count("*").alias("distinct"),
    )
    box = quantiles_of_counts(points.select(item, value, "n"), item, value, "n", {"low4": 0.25, "high4": 0.75}, slices)
    stats = stats.join(box, item).withColumn("iqr", F.col("high4") - F.col("low4"))
    narrow = F.least(F.col("sd"), F.col("iqr") / 1.34)
    width = F.coalesce(*[F.when(x > 0, x) for x in (narrow, F.col("sd"), F.abs(F.col("low")))], F.lit(1.0))
    stats = stats.withColumn("bw", 0.9 * width * F.pow(F.col("rows"), F.lit(-0.2)))
    step = (F.col("high") - F.col("low")) / F.lit(grid_points - 1)
    at = F.col("low") + F.col("slot") * step
    z = (F.col("at") - F.col(value)) / F.col("bw")
    kernel = F.col("w") * F.exp(-0.5 * z * z)
    norm = F.first("whole") * F.first("bw") * F.lit((2 * 3.141592653589793) ** 0.5)
    dense = stats.filter(F.col("distinct") > bins).select(item, F.col("low").alias("from"), ((F.col("high") - F.col("low")) / (bins - 1)).alias("width"))
    place = (F.col(value) - F.col("from")) / F.col("width")
    lower = F.least(F.floor(place), F.lit(bins - 2))
    share = place - lower
    laid = points.join(dense, item).select(item, "from", "width", F.explode(F.array(
        F.struct(lower.alias("step"), (F.col("w") * (1 - share)).alias("w")),
        F.struct((lower + 1).alias("step"), (F.col("w") * share).alias("w")))).alias("s")).groupBy(item, "from", "width", "s.step").agg(
        F.sum("s.w").alias("w")).select(item, (F.col("from") + F.col("step") * F.col("width")).alias(value), "w")
    few = points.join(dense.select(item), item, "left_anti").select(item, F.col(value).cast("double").alias(value), F.col("w").cast("double").alias("w"))
    return (
        few.unionByName(laid).join(stats, item)
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))))
        .withColumn("at", at)
        .groupBy(item, "slot", "at").agg((F.sum(kernel) / norm).alias("density"))
    )


def column_profile(df: DataFrame, numeric: Sequence[str], factors: Sequence[str] = (),
                   slices: int | None = None) -> DataFrame:
    """Per column: missing, complete rate, mean, sd, quartiles; distinct and top count of factors.

    Moments of all columns come from one pass with one row per task. Quartiles, distinct and top values come from a
    table of (column, value, count), combined before it is shuffled, numbers and texts side by side; a factor may be of
    any type and its commonest value (the smallest of several) is given as text.
    """
    columns = [*numeric, *factors]
    wide = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in columns],
                  *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in numeric],
                  *[F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}") for c in numeric])
    none = F.lit(None).cast("double")
    out = wide.select("rows", F.inline(F.array(*[F.struct(
        F.lit(c).alias("variable"), F.col(f"n_{c}").alias("known"),
        (F.col(f"m_{c}") if c in numeric else none).alias("mean"), (F.col(f"s_{c}") if c in numeric else none).alias("sd"))
        for c in columns])))
    text = [c for c in factors if df.schema[c].dataType.typeName() not in NUMBERS]
    cells = [F.struct(F.lit(c).alias("variable"), (none if c in text else F.col(c).cast("double")).alias("number"),
                      F.col(c).cast("string").alias("value")) for c in factors]
    cells += [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("number"), F.lit(None).cast("string").alias("value"))
              for c in numeric]
    counts = materialise(df.select(F.inline(F.array(*cells))).filter("number is not null or value is not null")
                         .groupBy("variable", "number", "value").agg(F.count("*").alias("n")))
    tops = counts.filter("value is not null").groupBy("variable").agg(
        F.count("*").alias("n_unique"), F.min(F.struct(-F.col("n"), "number", "value")).alias("top"))
    probs = {f"p{p}": p / 100 for p in (0, 25, 50, 75, 100)}
    boxes = quantiles_of_counts(counts.filter("value is null"), "variable", "number", "n", probs, slices)
    return out.join(boxes, "variable", "left").join(tops, "variable", "left").select(
        "variable", (F.col("rows") - F.col("known")).alias("n_missing"), F.try_divide("known", "rows").alias("complete_rate"),
        "mean", "sd", *probs,
        F.when(F.col("variable").isin(*factors), F.coalesce("n_unique", F.lit(0))).alias("n_unique"),
        F.col("top.value").alias("top_value"), (-F.col("top.col1")).alias("top_count"))


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with missing cells and their missing share, most missing first."""
    return (
        missing_counts(df, columns).filter(F.col("N") > 0)
        .select("variable", "N",
                F.format_string("%.2f", F.bround(F.col("N") / F.col("rows"), 2)).alias("Missing share"))
        .orderBy(F.desc("N"), "variable")
    )


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(F.count("*").alias("rows"), *[F.expr(f"count_if({c} is null) as {c}") for c in columns])
    return wide.unpivot(["rows"], list(columns), "variable", "N")


def rows_with_any_null(df: DataFrame) -> DataFrame:
    any_null = " or ".join(f"{c} is null" for c in df.columns)
    return df.agg(F.expr(f"count_if({any_null}) as rows_with_null"))


def table_dims(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def order_violation_check(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Per item: is the first flag above the second in any row? Unknown pairs are ignored."""
    wide = df.agg(*[F.expr(f"coalesce(bool_or(({a}) > ({b})), false) as {n}") for n, (a, b) in pairs.items()])
    return wide.unpivot([], list(pairs), "item", "violated")


def global_min_scalar(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """One minimum over whole columns on every row, as a scalar subquery."""
    least = F.least(*[F.min(c) for c in columns]) if len(columns) > 1 else F.min(columns[0])
    return df.withColumn(name, df.agg(least).scalar())


def modal_frequency_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count of the most frequent value of each column."""
    return (
        df.unpivot([], list(columns), "variable", "value").filter("value is not null")
        .groupBy("variable", "value").agg(F.count("*").alias("n"))
        .groupBy("variable").agg(F.max("n").alias("modal_count"))
    )


def modal_frequency_row(columns: Sequence[Column]) -> Column:
    """Largest repetition of one value inside a row."""
    cells = F.array(*columns)
    repeats = F.transform(cells, lambda x: F.size(F.filter(cells, lambda y: y == x)))
    return F.array_max(repeats)


def min_max_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def weighted_prevalence_cutoff(long: DataFrame, by: Sequence[str], y: str, weight: str) -> DataFrame:
    return long.groupBy(*by).agg(weighted_mean(F.col(y), F.col(weight)).alias("cutoff"))


def mean_sd_by_term(records: DataFrame, exponentiate: bool = False) -> DataFrame:
    """Mean and SD over all replicates, with their number and how many fits did not converge."""
    value = F.exp("value") if exponentiate else F.col("value")
    return records.groupBy("outcome", "term").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.count("value").alias("n_replicates"), F.count_if(~F.col("converged")).alias("n_not_converged"))


def bootstrap_p_value(records: DataFrame) -> DataFrame:
    above, below = F.count_if(F.col("value") > 0), F.count_if(F.col("value") < 0)
    return records.groupBy("outcome", "term").agg(
        F.try_divide(2 * F.least(above, below), F.count("value")).alias("p_val"))
