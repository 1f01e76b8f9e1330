"""Named queries over the given tables, one per operator, with SQL counterparts."""

from __future__ import annotations

from importlib import import_module

PARTS = ["shaping", "recoding", "describing", "modelling", "resampling", "imputing"]


def load():
    for part in PARTS:
        import_module(f"{__name__}.{part}")
    from stratalens.catalog.base import ORACLE, QUERIES

    return QUERIES, ORACLE
