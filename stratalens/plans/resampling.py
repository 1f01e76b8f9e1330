"""Resampled fits: clean, rebalance, fit and score many replicates in one job."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import logit, resample
from stratalens.operators.design import covariate_cells, merge_cells
from stratalens.operators.logit import Formula
from stratalens.plans.modelling import FULL, fit_metrics, metric_records
from stratalens.runtime import broadcast_if_small, materialise, spread
from stratalens.schema import METRIC_TERMS, PREDICTOR_LEVELS
from stratalens.sources.replicates import (
    finished_preparation, note_preparation, scan_replicates, stored_fits, write_replicate_results,
)

GROUP = ["outcome", "stratum"]
CATEGORIES = [*PREDICTOR_LEVELS, "psu"]
KEYS = ["outcome", "replicate"]


def cleaned_frame(frame: DataFrame, slices: int | None = None) -> DataFrame:
    """The model frame without majority rows that form a Tomek link."""
    links = resample.tomek_links(frame, GROUP, CATEGORIES, "w", "rid", slices=slices)
    return resample.drop_tomek_majority(frame, links, GROUP, "rid")


def replicate_cells(cleaned: DataFrame, replicates: int, seed: int, formula: Formula = FULL,
                    slices: int | None = None) -> DataFrame:
    """Covariate cells of every replicate.

    The cleaned rows are the same in each replicate and are summed once; only
    synthetic rows are drawn per replicate, and the task that draws them adds
    them up to cells before anything is shuffled.
    """
    base = materialise(covariate_cells(cleaned, ["outcome"], formula))
    parents = resample.smote_parents(cleaned, GROUP, CATEGORIES, "w", "rid", slices=slices)
    return _with_base(base, _synthetic_cells(parents, 1, int(replicates), seed, formula), 1, int(replicates), formula)


def _synthetic_cells(parents: DataFrame, first: int, last: int, seed: int, formula: Formula) -> DataFrame:
    """Cells of the rows drawn for these replicates, drawn once whatever is asked of them later."""
    if resample.sums_in_tasks(parents, GROUP, CATEGORIES, "rid", formula):
        return resample.smote_cells(parents, GROUP, CATEGORIES, "w", "rid", last, seed, formula, first)
    drawn = resample.smote(parents, GROUP, CATEGORIES, "w", "rid", last, seed, first)
    # kept first: the checks of the fit would otherwise move below the draws and repeat them for every predictor
    return materialise(covariate_cells(drawn, KEYS, formula))


def _with_base(base: DataFrame, synthetic: DataFrame, first: int, last: int, formula: Formula) -> DataFrame:
    """Synthetic cells on top of the base cells of each replicate number, dealt by fit so that nothing moves again before it."""
    numbers = base.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("replicate"))
    repeated = spread(base, "outcome", *formula.variables).crossJoin(F.broadcast(numbers))
    columns = [*KEYS, *formula.variables, "n", F.col("w").cast("double").alias("w"), F.col("wy").cast("double").alias("wy")]
    return merge_cells(spread(repeated.select(*columns).unionByName(synthetic.select(*columns)), *KEYS), KEYS, formula)


def replicate_fits(frame: DataFrame, replicates: int, seed: int = 1, formula: Formula = FULL,
                   slices: int | None = None) -> DataFrame:
    cleaned = materialise(cleaned_frame(frame, slices))
    return materialise(logit.svy_logistic(replicate_cells(cleaned, replicates, seed, formula, slices), KEYS, formula))


def replicate_driver(frame: DataFrame, replicates: int = 1000, seed: int = 1, formula: Formula = FULL,
                     compat: bool = False, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Metric and coefficient records of every outcome and replicate.

    Fits are made on the rebalanced replicates and scored on the original rows.
    """
    fits = replicate_fits(frame, replicates, seed, formula, slices)
    cells = materialise(covariate_cells(frame, ["outcome"], formula))
    wide = fit_metrics(cells, fits, formula, KEYS, ["outcome"], compat)
    return metric_records(wide, KEYS, METRIC_TERMS), coef_records(fits, formula)


def replicate_run(frame: DataFrame, path: str, replicates: int = 1000, seed: int = 1, formula: Formula = FULL,
                  compat: bool = False, at_once: int = 100) -> DataFrame:
    """The records of :func:`replicate_driver`, stored under ``path`` while they are made.

    Replicates are made ``at_once`` at a time. Fits that an earlier run has stored are found by an anti-join and not
    made again, so a run that was interrupted goes on where it ended, and more replicates can be added later; a run
    with everything stored reads it only. What all replicates are drawn from is stored as well and read again for the
    same frame and formula. Returns all stored records up to ``replicates``.
    """
    spark = frame.sparkSession
    wanted = frame.select("outcome").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(int(replicates)))))
    todo = materialise(wanted.join(stored_fits(spark, path).select(*KEYS), KEYS, "left_anti"))
    if not todo.isEmpty():
        base, parents, cells = prepared_run(frame, path, formula)
        for first in range(1, int(replicates) + 1, at_once):
            last = min(first + at_once - 1, int(replicates))
            now = todo.filter(F.col("replicate").between(first, last))
            if now.isEmpty():
                continue
            drawn = _synthetic_cells(parents, first, last, seed, formula)
            made = _with_base(base, drawn, first, last, formula).join(broadcast_if_small(now), KEYS, "left_semi")
            fits = materialise(logit.svy_logistic(materialise(made), KEYS, formula))
            wide = fit_metrics(cells, fits, formula, KEYS, ["outcome"], compat)
            write_replicate_results(metric_records(wide, KEYS, METRIC_TERMS), coef_records(fits, formula), path, append=True)
    return scan_replicates(spark, path).filter(F.col("replicate") <= int(replicates))


def prepared_run(frame: DataFrame, path: str, formula: Formula) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base cells, parents and scored cells of a run, made once per frame and formula and stored beside the fits.

    They are known by the count and hashes of the frame's rows, and found only after all of them have been written.
    """
    spark = frame.sparkSession
    row = F.xxhash64(*sorted(frame.columns))
    mark = frame.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    mark = "|".join(map(str, (*mark, [(v, list(levels)) for v, levels in formula.factors.items()], list(formula.numbers))))
    folder = finished_preparation(spark, path, mark)
    if folder is None:
        folder = f"_prepared-{uuid.uuid4().hex}"
        cleaned = materialise(cleaned_frame(frame))
        parts = {"base": covariate_cells(cleaned, ["outcome"], formula), "cells": covariate_cells(frame, ["outcome"], formula),
                 "parents": resample.parents_of(cleaned, GROUP, CATEGORIES, "w", "rid")}
        for name, part in parts.items():
            part.write.parquet(f"{path}/{folder}/{name}")
        note_preparation(spark, path, mark, folder)
    base, parents, cells = (spark.read.parquet(f"{path}/{folder}/{name}") for name in ("base", "parents", "cells"))
    return base, parents, cells


def coef_records(fits: DataFrame, formula: Formula) -> DataFrame:
    return logit.coefficients(fits, KEYS, formula).select(*KEYS, "term", F.col("estimate").alias("value"), "converged")


def needed_columns(outcomes: Sequence[str]) -> list[str]:
    """Columns of the analysis dataset that the model frames of these outcomes use."""
    from stratalens.schema import MODEL_DEMOGRAPHIC, PRIOR_USE, PSU, STRATUM, WEIGHT, befor, ever

    flags = [c for h in outcomes for c in (ever(h), *[befor(x, h) for x in PRIOR_USE])]
    return ["rid", PSU, STRATUM, WEIGHT, *MODEL_DEMOGRAPHIC, *flags]
