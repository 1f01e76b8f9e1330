"""Registry of named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stratalens.catalog import respondents
from stratalens.plans import analysis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """The input tables of one scale factor and the survey views over them."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def respondents(self) -> DataFrame:
        return respondents.respondents(self.spark, self.sf_dir)

    def raw(self) -> DataFrame:
        return respondents.raw_survey(self.spark, self.sf_dir)

    def selected(self) -> DataFrame:
        return analysis.selected_survey(self.raw())

    def analysis(self, compat: bool = False) -> DataFrame:
        return analysis.analysis_dataset(self.selected(), compat)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL when it has one."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
