"""Row distances over categories and one number, as SQL expression texts."""

from __future__ import annotations

from collections.abc import Sequence


def mismatch(left: str, right: str) -> str:
    """Overlap distance of one category: 0 when equal, 1 when different or missing."""
    return f"if({left} = {right}, 0, 1)"


def scaled_gap(left: str, right: str, span: str) -> str:
    """Range-scaled difference of a number; 1 when missing, 0 when nothing varies."""
    return f"if({span} = 0, 0D, coalesce(abs({left} - {right}) / {span}, 1D))"


def heom(categories: Sequence[str], number: str, span: str, left: str = "l", right: str = "r") -> str:
    """Overlap for categories, range-scaled difference for the number."""
    parts = [mismatch(f"{left}.{c}", f"{right}.{c}") for c in categories]
    gap = scaled_gap(f"{left}.{number}", f"{right}.{number}", span)
    return f"sqrt({' + '.join(parts)} + {gap} * {gap})"


def vdm_squared(left: str, right: str, size: int) -> str:
    """Squared value difference of two arrays of P(class 1 | value).

    With two classes both terms of the class sum are equal, so each column
    adds twice the squared difference and rows are points of a Euclidean space.
    """
    return " + ".join(
        f"2 * (({left}[{i}] - {right}[{i}]) * ({left}[{i}] - {right}[{i}]))" for i in range(size))


def hvdm_squared(category_part: str, gap: str, variance: str) -> str:
    """Squared category part plus the squared difference over four standard deviations."""
    return f"({category_part}) + if({variance} > 0, cast({gap} * {gap} as double) / (16D * {variance}), 0D)"
