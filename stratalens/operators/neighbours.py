"""Exact nearest neighbours within groups, without forming the pairs of a group.

Rows carry categories and one number. Both searches use that rows sharing a
category pattern lie on a number line, where neighbours are found by order
(:func:`line_neighbours`). Patterns are bounded by the category levels; rows
are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.operators.ordered import ROWS_PER_SLICE, line_neighbours, slice_count
from stratalens.runtime import broadcast_if_small, materialise, ship_package, spread

PATTERN = "pattern"
EVERYONE = "*"      # stands for all rows of a group; no pattern text has a bare star, as categories are joined by bars
MARGIN = 1.0 + 1e-9  # keeps float rounding from cutting off a candidate
SLAB_POINTS = 2048    # points of a group that are compared with each other, about
SLABS_AT_ONCE = 64    # slabs in which the points of a pattern are ordered together
CUTS_PER_HEAD = 16
ASKING_AT_ONCE = 20_000  # points of other slabs that one task looks up in a slab
BLOCK = 256           # points whose distances to a slab are held at once


def category_text(category: str) -> str:
    """A category as text in which the separator and the marks cannot occur; NULL stays NULL."""
    return f"replace(replace(cast({category} as string), '^', '^^'), '|', '^p')"


def pattern_text(categories: Sequence[str], schema: T.StructType) -> str:
    """Category pattern of a row as one text; different patterns never share one. NULL has its own mark."""
    text = lambda c: f"cast({c} as string)" if isinstance(schema[c].dataType, T.IntegralType) else category_text(c)
    return "concat_ws('|', " + ", ".join(f"coalesce({text(c)}, '^n')" for c in categories) + ")"


def blocks_of(size: int, parts: int) -> list[list[int]]:
    """The positions of ``size`` categories in ``parts`` runs of about equal length."""
    edges = [i * size // parts for i in range(parts + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def mismatches(categories: Sequence[str], a: str, b: str) -> str:
    """How many categories of two rows differ; a missing one differs from everything."""
    return " + ".join(f"if({a}.{c} = {b}.{c}, 0, 1)" for c in categories)


def pairs_within(asked: DataFrame, patterns: DataFrame, group: list[str], categories: Sequence[str], parts: int) -> DataFrame:
    """(group, pattern, ``other``, ``size``, ``level``): all pairs of patterns with fewer than ``parts`` mismatches.

    The categories are cut into ``parts`` blocks, so such a pair agrees on one block at least: it is met where the
    texts of a block are equal, once, under the first block that agrees. A pattern meets itself when it has two rows.
    """
    blocks = blocks_of(len(categories), parts)
    text = lambda block: "concat_ws('|', " + ", ".join(category_text(categories[i]) for i in block) + ")"
    known = lambda block: " and ".join(f"{categories[i]} is not null" for i in block)
    pieces = "explode(array(" + ", ".join(
        f"if({known(b)}, struct({i} as block, {text(b)} as key), null)" for i, b in enumerate(blocks)) + ")) as piece"
    cut = lambda df: df.selectExpr(
        *group, PATTERN, "size", f"struct({', '.join(categories)}) as at", pieces).filter("piece is not null").selectExpr(
        *group, PATTERN, "size", "at", "piece.block", "piece.key")
    held = cut(patterns).withColumnsRenamed({PATTERN: "other", "at": "other_at", "size": "other_size"})
    agree = lambda block: " and ".join(f"coalesce(at.{categories[i]} = other_at.{categories[i]}, false)" for i in block)
    first = "case " + " ".join(f"when {agree(b)} then {i}" for i, b in enumerate(blocks)) + " end"
    met = cut(asked).join(held, [*group, "block", "key"]).filter(f"({PATTERN} <> other or size > 1) and {first} = block")
    return met.selectExpr(*group, PATTERN, "other", "other_size as size", f"{mismatches(categories, 'at', 'other_at')} as level").filter(
        f"level < {parts}")


def nearest_patterns(patterns: DataFrame, group: list[str], categories: Sequence[str]) -> DataFrame:
    """(group, pattern, ``other``, ``level``): of every pattern those with the fewest mismatches.

    Patterns of two rows or more without a gap are their own nearest. The others are looked up with 2, 4, 8, ...
    blocks, which find all pairs of fewer mismatches than blocks; one that met anything is settled, as no nearer pair
    can be missing. The number of passes grows with the logarithm of the number of categories. A pattern that agrees
    with none in any category meets ``EVERYONE``, at a mismatch in all of them.
    """
    size = len(categories)
    whole = " and ".join(f"{c} is not null" for c in categories)
    solved = [patterns.filter(f"size > 1 and {whole}").selectExpr(*group, PATTERN, f"{PATTERN} as other", "0 as level")]
    open_, parts = patterns.filter(f"not (size > 1 and {whole})"), 1
    while parts < size:
        parts = min(2 * parts, size)
        best = Window.partitionBy(*group, PATTERN)
        found = pairs_within(open_, patterns, group, categories, parts).withColumn("least", F.min("level").over(best))
        found = materialise(found.filter("level = least").select(*group, PATTERN, "other", "level"))
        solved.append(found)
        open_ = materialise(open_.join(found.select(*group, PATTERN).distinct(), [*group, PATTERN], "left_anti"))
        if open_.isEmpty():
            break
    else:
        solved.append(open_.selectExpr(*group, PATTERN, f"'{EVERYONE}' as other", f"{size} as level"))
    out = solved[0]
    for part in solved[1:]:
        out = out.unionByName(part)
    return out


def patterns_one_further(wanted: DataFrame, patterns: DataFrame, group: list[str], categories: Sequence[str]) -> DataFrame:
    """(group, pattern, ``other``, ``level``): the patterns that differ from a wanted one in ``level`` + 1 categories."""
    size, out = len(categories), None
    for level in sorted(r["level"] for r in wanted.select("level").distinct().collect()):  # at most one per category
        some = wanted.filter(F.col("level") == level)
        if level + 1 < size:
            found = pairs_within(some.drop("level"), patterns, group, categories, level + 2).filter(
                F.col("level") == level + 1).select(*group, PATTERN, "other", "level")
        elif level + 1 == size:  # whoever has the same number differs in all categories, or were nearer
            found = some.selectExpr(*group, PATTERN, f"'{EVERYONE}' as other", f"{size} as level")
        else:
            continue
        out = found if out is None else out.unionByName(found)
    return out


@dataclass(frozen=True)
class HeomSpace:
    """Target rows prepared once for any number of overlap-metric searches."""

    group: list[str]
    categories: list[str]
    number: str
    row_id: str
    rows: DataFrame
    patterns: DataFrame
    pairs: DataFrame
    spans: DataFrame
    settled: DataFrame  # rows whose nearest pattern is their own, with their nearest row
    some_missing: bool
    slices: int

    @classmethod
    def of(cls, targets: DataFrame, group: Sequence[str], categories: Sequence[str], number: str, row_id: str,
           slices: int | None = None) -> HeomSpace:
        group, categories = list(group), list(categories)
        rows = materialise(with_pattern(targets, group, categories, number, row_id))
        counted = rows.groupBy(*group, *categories, PATTERN).agg(F.count("*").alias("size"))
        patterns = materialise(spread(counted, *group, PATTERN))
        sizes = broadcast_if_small(patterns.select(*group, PATTERN, "size"))
        pairs = materialise(nearest_patterns(patterns, group, categories).join(sizes, [*group, PATTERN]))
        lines = pairs.groupBy(*group, "other").agg(F.sum("size").alias("asking")).join(
            patterns.select(*group, F.col(PATTERN).alias("other"), F.col("size").alias("held")), [*group, "other"])
        short = lines.filter(f"asking + held <= {ROWS_PER_SLICE}").select(*group, "other", F.lit(True).alias("short"))
        calm = f"{PATTERN} = other and size <= {ROWS_PER_SLICE}"
        pairs = materialise(pairs.join(broadcast_if_small(short), [*group, "other"], "left").selectExpr(
            *group, PATTERN, "other", "level", f"{calm} as calm", "coalesce(short, false) as short"))
        mine = broadcast_if_small(pairs.filter("calm").select(*group, PATTERN))
        settled = materialise(next_of_pattern(
            rows.filter(f"{number} is not null").join(mine, [*group, PATTERN], "left_semi"), group, number, row_id))
        spans = materialise(rows.groupBy(*group).agg(
            (F.max(number) - F.min(number)).cast("double").alias("span"), F.count_if(F.col(number).isNull()).alias("blanks"),
            F.count("*").alias("rows")))
        state = spans.agg(F.coalesce(F.sum("blanks"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        return cls(group, categories, number, row_id, rows, patterns, pairs, spans.select(*group, "span"), settled, state[0] > 0,
                   slice_count(state[1]) if slices is None else slices)


def with_pattern(df: DataFrame, group: Sequence[str], categories: Sequence[str], number: str, row_id: str) -> DataFrame:
    return df.selectExpr(*group, *categories, number, row_id, f"{pattern_text(categories, df.schema)} as {PATTERN}")


def next_of_pattern(rows: DataFrame, group: list[str], number: str, row_id: str) -> DataFrame:
    """(group, pattern, number, id, ``value``, ``nn``): the nearest row of the same pattern, ties to the smaller id.

    One sort: the two smallest ids of a number answer for all rows that share it, and a row alone at its number has
    its neighbours before and behind it. A task holds whole patterns, so the caller keeps large ones out.
    """
    place = [*group, PATTERN, number]
    same = Window.partitionBy(*place).orderBy(row_id).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    along = Window.partitionBy(*group, PATTERN).orderBy(number, row_id)
    lined = spread(rows.select(*place, row_id), *group, PATTERN).withColumns({
        "low": F.min(row_id).over(same), "second": F.nth_value(row_id, 2).over(same)}).withColumns({
        "before": F.lag(F.struct(F.col(number).alias("at"), "low")).over(along),
        "behind": F.lead(F.struct(F.col(number).alias("at"), "low")).over(along)})
    offer = lambda side: f"if({side} is null, null, struct(abs({side}.at - {number}) as gap, {side}.low as id, {side}.at as at))"
    shared = f"struct({number} - {number} as gap, if(low <> {row_id}, low, second) as id, {number} as at)"
    best = f"if(second is not null, {shared}, least({offer('before')}, {offer('behind')}))"
    return lined.selectExpr(*place, row_id, f"{best} as best").filter(f"best.id <> {row_id}").selectExpr(
        *place, row_id, "best.at as value", "best.id as nn")


def next_on_lines(asked: DataFrame, targets: DataFrame, group: list[str], number: str, row_id: str) -> DataFrame:
    """Every asking row with ``value`` and ``nn``, the nearest row of the line (group, pattern) it asks, ties to the smaller id.

    One sort, as in :func:`next_of_pattern`, with askers that need not lie on the line: at a number they stand before
    the rows of the line, so an asker alone at its number skips one row to look behind itself. A task holds whole
    lines with all who ask them, so the caller keeps large ones out. Neither side has a missing number.
    """
    place = [*group, PATTERN, number]
    both = targets.select(*place, row_id).withColumn("held", F.lit(True)).unionByName(
        asked.withColumn("held", F.lit(False)), allowMissingColumns=True)
    same = Window.partitionBy(*place).orderBy("held", row_id).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    along = f"over (partition by {', '.join([*group, PATTERN])} order by {number}, held, {row_id})"
    own = F.when(F.col("held"), F.col(row_id))
    lined = spread(both, *group, PATTERN).withColumns({
        "low": F.min(own).over(same), "second": F.nth_value(own, 2, True).over(same)}).withColumn(
        "point", F.when(F.col("held"), F.struct(F.col(number).alias("at"), "low"))).withColumns({
        "before": F.expr(f"lag(point, 1) ignore nulls {along}"), "behind": F.expr(f"lead(point, 1) ignore nulls {along}"),
        "beyond": F.expr(f"lead(point, 2) ignore nulls {along}")})
    offer = lambda side: f"if({side}.at is null, null, struct(abs({side}.at - {number}) as gap, {side}.low as id, {side}.at as at))"
    shared = f"struct({number} - {number} as gap, if(low <> {row_id}, low, second) as id, {number} as at)"
    alone = f"least({offer('before')}, {offer('if(low is null, behind, beyond)')})"
    best = f"if(second is not null or low <> {row_id}, {shared}, {alone}) as best"
    return lined.filter("not held").selectExpr(*asked.columns, best).filter(f"best.id <> {row_id}").selectExpr(
        *asked.columns, "best.at as value", "best.id as nn")


def heom_nearest(queries: DataFrame, targets: DataFrame, group: Sequence[str], categories: Sequence[str],
                 number: str, row_id: str, slices: int | None = None) -> DataFrame:
    """Nearest target of every query under the overlap metric; see :func:`heom_search`."""
    return heom_search(queries, HeomSpace.of(targets, group, categories, number, row_id, slices))


def heom_search(queries: DataFrame, space: HeomSpace) -> DataFrame:
    """Nearest row of the space for every query, ties to the smaller id.

    The queries are rows of the space. Every mismatch adds 1 to the squared
    distance and the number at most 1, so a row's neighbour lies in a pattern
    with the fewest mismatches. These patterns are found on the pattern table,
    and only they are searched, each along its number line; where it is the row's
    own, the space has ordered all its rows at once. A missing number is
    as far from any other as the whole range; rows with one are offered by id.

    A best gap equal to the whole range ties with an equal number one mismatch
    further away; such rows are looked up there as well.

    Returns (group, id, ``nn``, ``mismatches``, ``gap``: the whole range where a
    number is missing); queries alone in their group have no row.
    """
    group, categories, number, row_id = space.group, space.categories, space.number, space.row_id
    rows, patterns, slices = space.rows, space.patterns, space.slices
    asked = materialise(with_pattern(queries, group, categories, number, row_id))
    spans = broadcast_if_small(space.spans)
    line = rows.select(*group, PATTERN, number, row_id)

    def far_off(keyed: DataFrame, lean: DataFrame) -> DataFrame:
        """Rows at the whole range: those without a number for all, any row for those without one, by id."""
        firsts = lean.groupBy(*group, PATTERN).agg(
            F.expr(f"min(if({number} is null, {row_id}, null)) as blank"), F.min(row_id).alias("low"))
        seconds = lean.join(firsts, [*group, PATTERN]).filter(f"{row_id} > low").groupBy(*group, PATTERN).agg(
            F.min(row_id).alias("next"))
        return keyed.join(firsts.join(seconds, [*group, PATTERN], "left"), [*group, PATTERN]).selectExpr(
            *group, row_id, number, "level", f"if({number} is null, {number}, null) as value",
            f"if({number} is not null, blank, if(low = {row_id}, next, low)) as nn").filter("nn is not null")

    def search(who: DataFrame, pairs: DataFrame) -> DataFrame:
        keyed = who.select(*group, PATTERN, number, row_id).join(broadcast_if_small(pairs), [*group, PATTERN]).selectExpr(
            *group, f"other as {PATTERN}", number, row_id, "level", "calm", "short")
        everyone = pairs.filter(F.col("other") == EVERYONE).select(*group).distinct()
        lean = line.unionByName(line.join(broadcast_if_small(everyone), group, "left_semi").withColumn(PATTERN, F.lit(EVERYONE)))
        abroad = keyed.filter(f"not calm and {number} is not null").drop("calm")

        def sought(of: str) -> DataFrame:
            asking = who.select(*group, PATTERN).distinct()
            lines = pairs.filter(f"not calm and {of}").join(asking, [*group, PATTERN], "left_semi").selectExpr(
                *group, f"other as {PATTERN}").distinct()
            return lean.filter(f"{number} is not null").join(broadcast_if_small(lines), [*group, PATTERN], "left_semi")

        hits = next_on_lines(abroad.filter("short").drop("short"), sought("short"), group, number, row_id).select(
            *group, row_id, number, "level", "value", "nn")
        if not pairs.filter("not calm and not short").isEmpty():
            near = line_neighbours(abroad.filter("not short").drop("short"), sought("not short"),
                                   [*group, PATTERN], number, row_id, 1, slices)
            hits = hits.unionByName(near.filter("size(near) > 0").selectExpr(
                *group, row_id, number, "level", "near[0].value as value", "near[0].id as nn"))
        at_home = keyed.filter("calm").join(space.settled, [*group, PATTERN, number, row_id])
        hits = hits.unionByName(at_home.select(*group, row_id, number, "level", "value", "nn"))
        if space.some_missing:
            hits = hits.unionByName(far_off(keyed, lean))
        gap = f"cast(coalesce(abs(value - {number}), span, 0) as double)"
        best = f"min(struct({gap} as gap, cast(nn as bigint) as nn, level))"
        return hits.join(spans, group, "left").groupBy(*group, row_id).agg(F.expr(f"{best} as best")).selectExpr(
            *group, row_id, "best.nn", "best.level as mismatches", "best.gap")

    found = materialise(search(asked, space.pairs))
    edge = found.join(spans, group).filter("gap = span and span > 0")
    if edge.isEmpty():
        return found
    ends = materialise(asked.join(edge.select(*group, row_id, F.col("mismatches").alias("level")), [*group, row_id]))
    wanted = patterns.join(ends.select(*group, PATTERN, "level").distinct(), [*group, PATTERN])
    beyond = patterns_one_further(wanted, patterns, group, categories)
    if beyond is None:
        return found
    further = search(ends.drop("level"), beyond.withColumns({"calm": F.lit(False), "short": F.lit(False)}))
    offers = further.filter("gap = 0").selectExpr(*group, row_id, "nn as far_nn", "mismatches as far_level", "gap as far_gap")
    wins = "coalesce(far_nn < nn, false)"
    return found.join(offers, [*group, row_id], "left").selectExpr(
        *group, row_id, f"if({wins}, far_nn, nn) as nn", f"if({wins}, far_level, mismatches) as mismatches",
        f"if({wins}, far_gap, gap) as gap")


def variance_of(df: DataFrame, number: str):
    """Sample variance; whole numbers are summed exactly so that it does not depend on order."""
    if df.schema[number].dataType.typeName() in ("integer", "long", "short", "byte"):
        exact = f"cast({number} as decimal(19,0))"
        top = f"count({number}) * sum({exact} * {exact}) - sum({exact}) * sum({exact})"
        return F.expr(f"try_divide(cast({top} as double), cast(count({number}) * (count({number}) - 1) as double))")
    return F.var_samp(number)


def class_probabilities(rows: DataFrame, group: Sequence[str], categories: Sequence[str], y: str) -> DataFrame:
    """P(class 1 | value) per group as one map 'column=value' -> probability.

    Rows are counted per pattern first; a NULL counts as a value of its own.
    """
    group = list(group)
    counts = rows.groupBy(*group, *categories).agg(F.count("*").alias("n"), F.sum(y).alias("ones"))
    entries = ", ".join(f"concat('{c}=', coalesce({category_text(c)}, '^n'))" for c in categories)
    long = counts.selectExpr(*group, f"explode(array({entries})) as value", "n", "ones")
    p = long.groupBy(*group, "value").agg((F.sum("ones") / F.sum("n")).alias("p"))
    return p.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("value", "p"))).alias("p_one"))


def coordinates(categories: Sequence[str], probabilities: str = "p_one") -> str:
    parts = [f"try_element_at({probabilities}, concat('{c}=', coalesce({category_text(c)}, '^n')))" for c in categories]
    return f"array({', '.join(parts)})"


def hvdm_knn(rows: DataFrame, group: Sequence[str], categories: Sequence[str], number: str, row_id: str,
             y: str, k: int = 5, slices: int | None = None) -> DataFrame:
    """The ``k`` nearest class-1 rows of every class-1 row under the value difference metric.

    Rows of one pattern and number are one point, of which the ``k + 1`` smallest ids can matter. The number line of a
    group is cut into slabs of about ``SLAB_POINTS`` points. A point first meets the points of its own slab; the
    distance of its ``k + 1``-th hit, or a closer bound from its own pattern, then says which other slabs can hold a
    nearer one, and only these are searched. A task holds one slab and a bounded number of points that look into it.

    Returns (group, id, ``neighbours``: ids by distance, then id).
    """
    group = list(group)
    c = len(categories)
    spread_of = rows.groupBy(*group).agg(variance_of(rows, number).alias("var"))
    space = class_probabilities(rows, group, categories, y).join(spread_of, group)
    pattern = pattern_text(categories, rows.schema)
    lean = rows.filter(F.col(y) == 1).selectExpr(*group, *categories, f"{pattern} as {PATTERN}", number, row_id)
    patterns = materialise(
        lean.groupBy(*group, *categories, PATTERN).agg(F.count("*").alias("size")).join(space, group)
        .selectExpr(*group, PATTERN, "monotonically_increasing_id() as pid", "var", f"{coordinates(categories)} as at"))
    small = broadcast_if_small(patterns.select(*group, PATTERN, "pid"))
    lean = materialise(lean.drop(*categories).filter(f"{number} is not null").join(small, [*group, PATTERN]).select(
        *group, "pid", number, row_id))
    firsts = Window.partitionBy(*group, "pid", number).orderBy(row_id)
    kept = lean.groupBy(*group, "pid", number, row_id).agg(F.count("*").alias("times")).withColumn(
        "place", F.row_number().over(firsts)).filter(F.col("place") <= k + 1)
    kept = materialise(kept.selectExpr(*group, "pid", number, f"cast({row_id} as bigint) as id", "times", "place"))
    cuts = broadcast_if_small(_slab_cuts(kept.filter("place = 1"), group, number, slices))
    placed = kept.drop("place").join(cuts, group).selectExpr(*group, "pid", number, "id", "times", f"{_slab_of(number)} as slab")
    placed = placed.join(broadcast_if_small(patterns.select(*group, "pid", "var", "at")), [*group, "pid"]).selectExpr(
        *group, "slab", "pid", number, "id", "times", "coalesce(var, 0D) as var", *[f"at[{i}] as c{i}" for i in range(c)])
    placed = materialise(placed)

    key = [*group, "slab"]
    search = _SlabSearch(number, c, k)
    found = T.StructType([
        *[placed.schema[n] for n in (*group, "slab", "pid", number, "var")], *[placed.schema[f"c{i}"] for i in range(c)],
        T.StructField("r2", T.DoubleType()), *search.hits])
    ship_package(rows.sparkSession)
    near = spread(placed, *key).groupBy(*key).applyInPandas(search.within(found), found)
    # the k-th point on one side in its own pattern bounds the distance too, and closer the more rows there are
    own = Window.partitionBy(*group, "pid", F.expr(f"slab div {SLABS_AT_ONCE}")).orderBy(number)
    step = F.least(F.col(number) - F.lag(number, k).over(own), F.lead(number, k).over(own) - F.col(number)).cast("double")
    near = near.withColumn("side", step)
    apart = F.expr("if(var > 0, side * side / (16D * var), null)")
    near = materialise(near.withColumn("r2", F.least("r2", apart)).drop("side").join(cuts, group).withColumn(
        "far", F.expr(f"sqrt(r2 * 16D * var) * {MARGIN} + abs({number}) * 1e-15")).selectExpr(
        "* except (cuts, heads, far)",
        f"if(var > 0 and far is not null, {_slab_of(f'(cast({number} as double) - far)')}, 0) as low",
        f"if(var > 0 and far is not null, {_slab_of(f'(cast({number} as double) + far)')}, size(cuts)) as high"))

    asking = near.filter("low < slab or high > slab").selectExpr(
        "* except (slab, low, high, ids, times, dists)",
        "explode(filter(sequence(low, high), s -> s <> slab)) as slab")
    load = asking.groupBy(*key).agg(F.count("*").alias("asking"))
    load = broadcast_if_small(materialise(load.selectExpr(*key, f"cast(ceil(asking / {ASKING_AT_ONCE}) as int) as parts")))
    part = [*key, "part"]
    asking = asking.join(load, key).withColumn("part", F.expr(f"pmod(hash(pid, {number}), parts)")).drop("parts")
    asked = placed.join(load, key).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    more_schema = T.StructType([*[placed.schema[n] for n in (*group, "pid", number)], *search.hits])
    more = asking.groupBy(*part).cogroup(asked.groupBy(*part)).applyInPandas(search.across(more_schema), more_schema)
    point = [*group, "pid", number]
    hits = "arrays_zip(dists, ids, times) as hits"
    crossing = near.filter("low < slab or high > slab").selectExpr(*point, hits).unionByName(more.selectExpr(*point, hits))
    merged = crossing.groupBy(*point).agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    best = near.filter("low = slab and high = slab").selectExpr(*point, hits).unionByName(merged)
    listed = f"flatten(transform(filter(hits, h -> h.ids <> {row_id}), h -> array_repeat(struct(h.dists, h.ids), cast(least(h.times, {k}) as int))))"
    top = lean.join(best, point).selectExpr(*group, row_id, f"slice({listed}, 1, {k}) as hits").filter("size(hits) > 0")
    top = top.groupBy(*group, row_id).agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
    kind = rows.schema[row_id].dataType.simpleString()
    return top.selectExpr(*group, row_id, f"transform(hits, h -> struct(cast(h.ids as {kind}) as id, h.dists as dist2)) as neighbours")


def _slab_cuts(points: DataFrame, group: list[str], number: str, slices: int | None) -> DataFrame:
    """(group, ``cuts``, ``heads``: every ``CUTS_PER_HEAD``-th): values that cut the points of each group into even slabs."""
    sizes = materialise(points.groupBy(*group).agg(F.count("*").alias("points")))
    most = sizes.agg(F.max("points")).first()[0] or 1
    slabs = slices or max(1, -(-most // SLAB_POINTS))
    if slabs == 1:
        return sizes.selectExpr(*group, "cast(array() as array<double>) as cuts", "cast(array() as array<double>) as heads")
    at = F.percentile_approx(number, [i / slabs for i in range(1, slabs)], 10 * slabs).cast("array<double>").alias("p")
    mine = f"greatest(1, cast(ceil(points * {slabs} / {most}) as int))"
    cuts = points.groupBy(*group).agg(at, F.count("*").alias("points")).selectExpr(
        *group, f"if({mine} = 1, cast(array() as array<double>), array_distinct(transform(sequence(1, greatest(1, {mine} - 1)), "
        f"j -> p[cast(round(j * {slabs} / {mine}) as int) - 1]))) as cuts")
    return materialise(cuts.withColumn("heads", F.expr(f"filter(cuts, (x, i) -> i % {CUTS_PER_HEAD} = 0)")))


def _slab_of(value: str) -> str:
    """Number of cuts below a value, found among the heads first."""
    head = f"size(filter(heads, x -> x < {value}))"
    inner = f"size(filter(slice(cuts, ({head} - 1) * {CUTS_PER_HEAD} + 1, {CUTS_PER_HEAD}), x -> x < {value}))"
    return f"if({head} = 0, 0, ({head} - 1) * {CUTS_PER_HEAD} + {inner})"


@dataclass(frozen=True)
class _SlabSearch:
    """Nearest ids of points among the rows of one slab, in blocks of distances."""

    number: str
    c: int
    k: int

    @property
    def hits(self) -> list[T.StructField]:
        return [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())),
                T.StructField("dists", T.ArrayType(T.DoubleType()))]

    def within(self, schema: T.StructType):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            asking = rows.drop_duplicates(["pid", self.number]).reset_index(drop=True)
            ids, times, dists = self._look(asking, rows, None)
            r2 = [d[-1] if len(d) > self.k else None for d in dists]
            return asking.assign(ids=ids, times=times, dists=dists, r2=pd.array(r2, dtype="Float64"))[schema.fieldNames()]
        return run

    def across(self, schema: T.StructType):
        def run(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            reach = pd.to_numeric(asking["r2"]).astype(float).fillna(np.inf).to_numpy()
            ids, times, dists = self._look(asking, rows, reach)
            out = asking.assign(ids=ids, times=times, dists=dists)
            return out[[len(i) > 0 for i in ids]][schema.fieldNames()]
        return run

    def _look(self, asking: pd.DataFrame, rows: pd.DataFrame, reach: np.ndarray | None) -> tuple[list, list, list]:
        """Per asking point at most k + 1 ids by distance, then id, with how often a row has the id."""
        if not len(asking) or not len(rows):
            return ([[] for _ in range(len(asking))],) * 3
        rows = rows.sort_values(["pid", self.number], kind="stable")
        new = ((rows["pid"].to_numpy()[1:] != rows["pid"].to_numpy()[:-1])
               | (rows[self.number].to_numpy()[1:] != rows[self.number].to_numpy()[:-1]))
        start = np.concatenate(([0], np.flatnonzero(new) + 1))
        held = np.diff(np.append(start, len(rows)))
        points = rows.iloc[start]
        id_of, times_of = rows["id"].to_numpy(), rows["times"].to_numpy()
        var = float(points["var"].iloc[0])
        theirs, their_at = self._places(points)
        ours, our_at = self._places(asking)
        scale, origin = np.sqrt(1 / (16 * var)) if var > 0 else 0.0, their_at[0]
        a = np.column_stack([*(x * np.sqrt(2) for x in ours), (our_at - origin) * scale])
        b = np.column_stack([*(x * np.sqrt(2) for x in theirs), (their_at - origin) * scale])
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
        slack = 1e-13 * (a2 + b2.max())
        out_ids, out_times, out_dists = [], [], []
        for at in range(0, len(a), BLOCK):
            now = slice(at, min(at + BLOCK, len(a)))
            rough = b2 - 2 * (a[now] @ b.T)  # squared distance less that of the asking point from the origin
            if reach is not None:
                limit = reach[now] * MARGIN - a2[now]
            elif rough.shape[1] > self.k + 1:
                limit = np.partition(rough, self.k, axis=1)[:, self.k]
            else:
                limit = np.full(len(rough), np.inf)
            q, t = np.nonzero(rough <= (limit + 2 * slack[now])[:, None])
            exact = np.zeros(len(q))
            for x, z in zip(ours, theirs):
                d = x[now][q] - z[t]
                exact = exact + 2.0 * (d * d)
            if var > 0:
                gap = their_at[t] - our_at[now][q]
                exact = exact + (gap * gap).astype(float) / (16.0 * var)
            if reach is not None:
                inside = exact <= reach[now][q] * MARGIN
                q, t, exact = q[inside], t[inside], exact[inside]
            n = held[t]
            row = np.repeat(start[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, exact = np.repeat(q, n), np.repeat(exact, n)
            order = np.lexsort((id_of[row], exact, q))
            q, exact, row = q[order], exact[order], row[order]
            first = np.searchsorted(q, np.arange(now.stop - now.start))
            last = np.minimum(np.append(first[1:], len(q)), first + self.k + 1)
            for i, j in zip(first, last):
                out_ids.append(id_of[row[i:j]])
                out_times.append(times_of[row[i:j]])
                out_dists.append(exact[i:j])
        return out_ids, out_times, out_dists

    def _places(self, df: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
        at = df[self.number].to_numpy()
        return [df[f"c{i}"].to_numpy(dtype=float) for i in range(self.c)], at if at.dtype == np.int64 else at.astype(
            np.int64 if at.dtype.kind in "iu" else float)
