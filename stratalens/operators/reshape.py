"""Wide and long forms. ``DataFrame.unpivot`` keeps NULL cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_all(df: DataFrame, name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot([], df.columns, name, value)


def unpivot_keep_ids(df: DataFrame, ids: Sequence[str], columns: Sequence[str],
                     name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def unpivot_pairs(df: DataFrame, ids: Sequence[str],
                  pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Melt outcomes and predictors together over the valid pairs only.

    ``pairs`` holds (outcome label, outcome column, variable label, predictor
    column). Melting twice and filtering names afterwards would first emit
    every outcome x predictor combination.
    """
    entries = [
        f"named_struct('Drug', '{label}', 'variable', '{variable}',"
        f" 'initiation', {outcome}, 'category', cast({predictor} as int))"
        for label, outcome, variable, predictor in pairs
    ]
    return df.select(*ids, F.expr(f"inline(array({', '.join(entries)}))"))


def transpose_small(df: DataFrame, row_key: str, key_values: Sequence[str],
                    name: str = "measure") -> DataFrame:
    """Swap rows and columns of a small result table with known row keys."""
    measures = [c for c in df.columns if c != row_key]
    long = df.unpivot([row_key], measures, name, "value")
    return long.groupBy(name).pivot(row_key, list(key_values)).agg(F.first("value"))


def bind_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
