"""Expressions that recode sentinel-coded ages and category codes.

Every function takes SQL expression texts (mostly column names) and returns
one. The wide tables need more than a hundred generated columns; as text each
of them is parsed once, so building the plan stays cheap, and all of them end
up in one code-generated projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from stratalens.schema import (
    AGE_BAND_LOWER,
    NEVER_USED,
    REAL_AGE_BELOW,
    SOFT_USER_BELOW,
    USER_AGE_UNKNOWN,
)


def as_flag(condition: str) -> str:
    """1 / 0 / NULL for a three-valued condition."""
    return f"cast(({condition}) as int)"


def befor_flag(soft: str, hard: str) -> str:
    """Did use of the soft item come before use of the hard item?

    A soft user whose hard age is unknown cannot be compared (NULL); a soft
    user who never used the hard item counts as before.
    """
    used = f"{soft} < {SOFT_USER_BELOW}"
    return (
        f"case when {hard} in ({USER_AGE_UNKNOWN}, {NEVER_USED}) then"
        f" case when {used} and {hard} = {USER_AGE_UNKNOWN} then null else {as_flag(used)} end"
        f" else {as_flag(f'{soft} < {hard}')} end"
    )


def befor_sum(first: str, second: str) -> str:
    return f"({first}) + ({second})"


def rowwise_min(columns: Sequence[str]) -> str:
    """Smallest value of a row, NULL when any of the values is NULL."""
    complete = " and ".join(f"{c} is not null" for c in columns)
    return f"case when {complete} then least({', '.join(columns)}) end"


def rowwise_min_skipna(columns: Sequence[str]) -> str:
    return f"least({', '.join(columns)})"


def rowwise_max_skipna(columns: Sequence[str]) -> str:
    return f"greatest({', '.join(columns)})"


def sentinel_to_null(age: str) -> str:
    return f"case when {age} <= {REAL_AGE_BELOW} then {age} end"


def null_to_sentinel(age: str) -> str:
    return f"coalesce({age}, {NEVER_USED})"


def ever_flag_basic(age: str) -> str:
    return as_flag(f"{age} < {REAL_AGE_BELOW}")


def ever_flag_known_or_993(age: str) -> str:
    return as_flag(f"{age} < {REAL_AGE_BELOW} or {age} = {USER_AGE_UNKNOWN}")


def any_flag(flags: Sequence[str]) -> str:
    """1 when any member flag is 1, else NULL when any is NULL, else 0."""
    return as_flag(" or ".join(f"({f}) = 1" for f in flags))


def imputation_recode(code: str) -> str:
    """0 for an observed answer (codes 1 and 9), 1 for everything else, NULL included."""
    return f"case when {code} in (1, 9) then 0 else 1 end"


def ethnicity_groups(code: str) -> str:
    return f"case when {code} in (3, 4, 5, 6) then 4 when {code} in (1, 2) then {code} when {code} = 7 then 3 end"


def religion_influence(age_group: str, youth: str, adult: str) -> str:
    """Youth answer for the youngest age group, adult answer for the others."""
    return (
        f"case when {age_group} = 1 and {youth} in (1, 2, 3, 4) then {youth}"
        f" when {age_group} <> 1 and {adult} in (1, 2, 3, 4) then {adult} end"
    )


def bounded_level(code: str, levels: Sequence[int]) -> str:
    """The code itself inside the level set, NULL outside it."""
    return f"case when {code} in ({', '.join(map(str, levels))}) then {code} end"


def age_band_lower(band: str) -> str:
    arms = " ".join(f"when {k} then {v}" for k, v in AGE_BAND_LOWER.items())
    return f"case {band} {arms} end"


def init_before(age: str, limit: int = 20) -> str:
    return as_flag(f"{age} <= {limit}")
