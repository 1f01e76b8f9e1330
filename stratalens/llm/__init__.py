"""Operators of a training-data pipeline: one module per operator, each with its registered query."""

from __future__ import annotations

from importlib import import_module

PARTS = ["pii", "embedding_dedup", "quality", "ngram_join", "sharding", "language", "mixing", "rules", "toxicity",
         "packing", "line_dedup", "whitening", "filter_audit"]


def load():
    for part in PARTS:
        import_module(f"{__name__}.{part}")
    from stratalens.llm.base import ORACLE, QUERIES

    return QUERIES, ORACLE
