"""Column expressions for labels, classes, level orders and texts.

Small fixed dictionaries are literal maps inside the expression, so a lookup
costs no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.schema import USAGE_LABELS, USAGE_OTHER


def code_lookup(code: Column, values: Mapping) -> Column:
    """Value of a small fixed dictionary; NULL for a code that is not in it."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)


def label_lookup(variable: Column, code: Column, labels: Mapping[str, Sequence[str]],
                 default_code: bool = True) -> Column:
    """Label of (variable, code), codes counting from 1.

    The dictionary is a literal map, so no join is needed. Without a label the
    code itself is shown when ``default_code`` is set, else NULL.
    """
    flat = {f"{v}={i}": text for v, texts in labels.items() for i, text in enumerate(texts, 1)}
    label = code_lookup(F.concat_ws("=", variable, code.cast("string")), flat)
    return F.coalesce(label, code.cast("string")) if default_code else label


def usage_label(code: Column) -> Column:
    chain = F.when(code.isNull(), F.lit(None).cast("string"))
    for value, text in USAGE_LABELS.items():
        chain = chain.when(code == value, F.lit(text))
    return chain.otherwise(F.lit(USAGE_OTHER))


def classify_by_regex(name: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First class whose pattern matches the name."""
    chain = F.when(F.lit(False), F.lit(default))
    for pattern, text in rules:
        chain = chain.when(name.rlike(pattern), F.lit(text))
    return chain.otherwise(F.lit(default))


def classify_by_set(name: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Class whose member list holds the name, NULL when none does."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for members, text in rules:
        chain = chain.when(name.isin(*members), F.lit(text))
    return chain


def level_position(name: Column, order: Sequence[str]) -> Column:
    """1-based place of a value in an explicit order, NULL when it is absent."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), name)
    return F.when(place > 0, place).cast("int")


def interaction_key(*columns: Column) -> Column:
    return F.concat_ws(".", *[c.cast("string") for c in columns])


def remove_by_column(text: Column, prefix: str, other: Column) -> Column:
    """Remove ``prefix`` followed by the value of another column, once."""
    return F.regexp_replace(text, F.concat(F.lit(prefix), other), F.lit(""))


def fixed_decimals(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)
