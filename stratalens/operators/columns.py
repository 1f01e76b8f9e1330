"""Column selection, row filters and sorting driven by names and level lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.labels import level_position


def matching(columns: Sequence[str], pattern: str) -> list[str]:
    """Names in which the pattern is found anywhere (anchor it for a full match)."""
    return [c for c in columns if re.search(pattern, c)]


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    return df.select(*columns)


def select_by_regex(df: DataFrame, *patterns: str, keep: Sequence[str] = ()) -> DataFrame:
    wanted = set(keep).union(*(matching(df.columns, p) for p in patterns))
    return df.select(*[c for c in df.columns if c in wanted])


def drop_by_regex(df: DataFrame, *patterns: str, any_of: Sequence[str] = ()) -> DataFrame:
    """Drop by pattern; names in ``any_of`` may be absent."""
    unwanted = set(any_of).union(*(matching(df.columns, p) for p in patterns))
    return df.select(*[c for c in df.columns if c not in unwanted])


def rename_dictionary(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    return df.withColumnsRenamed(dict(names))


def across_map(df: DataFrame, columns: Sequence[str], fn: Callable[[str], str],
               name: str = "{}") -> DataFrame:
    """One SQL expression template over many columns, in one projection."""
    return df.withColumns({name.format(c): F.expr(fn(c)) for c in columns})


def strip_outcome_suffix(df: DataFrame, outcome: str, stem: str = "_befor") -> DataFrame:
    """``ALC_befor_COC`` -> ``ALC_befor`` so that all models share term names."""
    suffix = f"{stem}_{outcome}"
    return df.withColumnsRenamed(
        {c: c[: -len(suffix)] + stem for c in df.columns if c.endswith(suffix)}
    )


def with_levels(df: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """Mark columns as factors: each level list travels, in its order, in the column's metadata.

    Parquet keeps the metadata, so a factor read back knows its levels, also those without a row; text formats lose it.
    """
    return df.select(*[
        F.col(c).alias(c, metadata={**df.schema[c].metadata, "levels": [str(x) for x in levels[c]]}) if c in levels else F.col(c)
        for c in df.columns])


def levels_of(df: DataFrame) -> dict[str, list[str]]:
    """The level lists of the factors of a table, as texts."""
    return {f.name: list(f.metadata["levels"]) for f in df.schema.fields if "levels" in f.metadata}


def level_counts(df: DataFrame) -> DataFrame:
    """Rows of every level of every factor, in level order, levels without a row included."""
    known = levels_of(df)
    wide = df.agg(*[F.count_if(F.col(c).cast("string") == level).alias(f"{c}_{i}")
                    for c, levels in known.items() for i, level in enumerate(levels)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.lit(i + 1).alias("position"), F.lit(level).alias("level"), F.col(f"{c}_{i}").alias("n"))
        for c, levels in known.items() for i, level in enumerate(levels)])))


def filter_complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(columns))


def filter_any_nonzero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where some flag is not 0; an unknown flag alone does not keep a row."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns]))


def filter_rowsum_positive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with at least one nonzero flag; a row with any NULL flag is dropped."""
    total = reduce(lambda a, b: a + b, [(F.col(c) != 0).cast("int") for c in columns])
    return df.filter(total > 0)


def filter_name_matches_row(df: DataFrame, name: str, other: str, width: int,
                            always: Sequence[str] = ()) -> DataFrame:
    """Rows whose name ends with the value of another column, or is listed."""
    tail = F.right(F.col(name), F.lit(width))
    return df.filter((tail == F.col(other)) | F.col(name).isin(*always))


def sort_by_custom_order(df: DataFrame, column: str, order: Sequence[str],
                         *then: str) -> DataFrame:
    """Sort by place in an explicit list; values outside the list come last."""
    return df.orderBy(level_position(F.col(column), order).asc_nulls_last(), *then)


def apply_by_outcome(df: DataFrame, outcomes: Sequence[str],
                     columns: Callable[[str], Mapping[str, str]],
                     keep: Sequence[str] = ()) -> DataFrame:
    """Stack one row per (row, outcome) with outcome-independent column names.

    The per-outcome columns travel in an array of structs that is exploded, so
    the table is read once for all outcomes and no union of scans is planned.
    """
    entries = [
        "named_struct(" + ", ".join([f"'outcome', '{o}'", *[f"'{n}', {e}" for n, e in columns(o).items()]]) + ")"
        for o in outcomes
    ]
    return df.select(*keep, F.expr(f"inline(array({', '.join(entries)}))"))
