"""Raw survey -> analysis dataset, as one lazy plan of three projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import recode
from stratalens.operators.columns import matching, rename_dictionary, select_columns
from stratalens.schema import (
    AGGREGATES, DEMOGRAPHIC, HARD, ITEMS, NONMEDICAL, PRESCRIPTION, PRIOR_USE, RAW_COLUMNS,
    RENAME, SOFT, befor, ever,
)
from stratalens.sources.tables import normalise_names


def selected_survey(raw: DataFrame, row_id: str = "RID") -> DataFrame:
    """The 42 survey columns under their analysis names, plus the row id."""
    picked = select_columns(normalise_names(raw), [row_id, *RAW_COLUMNS])
    return rename_dictionary(picked, {**RENAME, row_id: "rid"})


def exprs(columns: dict[str, str]) -> list:
    """Columns of an SQL expression dictionary, named by its keys."""
    return [F.expr(text).alias(name) for name, text in columns.items()]


def with_aggregates(df: DataFrame) -> DataFrame:
    """MED, NMD and HDG: the row minimum over their member items."""
    minima = {name: recode.rowwise_min(members) for name, members in AGGREGATES.items()}
    return df.select("*", *exprs(minima))


def befor_columns(soft_items=SOFT, hard_items=HARD) -> dict[str, str]:
    return {befor(x, h): recode.befor_flag(x, h) for x in soft_items for h in hard_items}


def smoking_columns(hard_items=HARD) -> dict[str, str]:
    """First use plus daily use: 0, 1 or 2."""
    return {
        befor("SMK", h): recode.befor_sum(recode.befor_flag("FSM", h), recode.befor_flag("ESM", h))
        for h in hard_items
    }


def prior_use_columns(hard_items=HARD) -> dict[str, str]:
    return {**befor_columns([x for x in SOFT if x in PRIOR_USE], hard_items),
            **smoking_columns(hard_items)}


def ever_columns(compat: bool = False) -> dict[str, str]:
    """EVER flags of all items.

    The row minimum of HDG mixes codes: a non-user code of one item hides the
    unknown-age code of another. By default HDG is therefore the OR of its
    members; ``compat`` reads it from the minimum.
    """
    out = {ever(i): recode.ever_flag_basic(i) for i in [*SOFT, "NMD", *NONMEDICAL]}
    out.update({ever(i): recode.ever_flag_known_or_993(i) for i in ["MED", *PRESCRIPTION]})
    if compat:
        out[ever("HDG")] = recode.ever_flag_known_or_993("HDG")
    else:
        out[ever("HDG")] = recode.any_flag([out[ever(m)] for m in AGGREGATES["HDG"]])
    return out


def demographic_columns() -> dict[str, str]:
    out = {c: c for c in DEMOGRAPHIC}
    out["ETHNIC"] = recode.ethnicity_groups("ETHNIC")
    out["RLGINF"] = recode.religion_influence("AGECAT", "RLGIFY", "RLGIFA")
    return out


def analysis_dataset(selected: DataFrame, compat: bool = False) -> DataFrame:
    """Design columns, ages, prior-use flags, EVER flags, imputation flags, demographics."""
    df = with_aggregates(selected)
    imputation = matching(df.columns, "_IMP")
    return df.select(
        "rid", "VEREP", "VESTR_C", "ANALWT2_C", *ITEMS, *AGGREGATES,
        *exprs(prior_use_columns()),
        *exprs(ever_columns(compat)),
        *exprs({c: recode.imputation_recode(c) for c in imputation}),
        *exprs(demographic_columns()),
    )
