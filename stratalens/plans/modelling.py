"""Model frames, fits and scoring for many outcomes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import describe, logit, metrics
from stratalens.operators.columns import apply_by_outcome, filter_complete_cases, sort_by_custom_order
from stratalens.operators.design import covariate_cells, linearised_variance, merge_cells
from stratalens.operators.logit import Formula
from stratalens.runtime import broadcast_if_small, materialise
from stratalens.schema import (
    HARD, METRIC_LABELS, METRIC_ORDER, MODEL_DEMOGRAPHIC, PREDICTOR_LEVELS, PRIOR_USE, TERM_ORDER, WEIGHT,
    befor, ever,
)

FULL = Formula(PREDICTOR_LEVELS)


def formula_of(*names: str) -> Formula:
    return Formula({n: PREDICTOR_LEVELS[n] for n in names})


def model_frame(analysis: DataFrame, outcomes: Sequence[str] = HARD, complete: bool = True) -> DataFrame:
    """Long model frame: one row per respondent and outcome, shared predictor names.

    Columns: outcome, y, the seven predictors, w, stratum, psu, rid. Rows with
    a missing cell are left out of a fit, as any model would.
    """

    def columns(item: str) -> dict[str, str]:
        return {"y": ever(item), **{f"{x}_befor": befor(x, item) for x in PRIOR_USE}}

    shared = [F.col("rid"), F.col("VESTR_C").alias("stratum"), F.col("VEREP").alias("psu"),
              F.col(WEIGHT).alias("w"), *MODEL_DEMOGRAPHIC]
    frame = apply_by_outcome(analysis, outcomes, columns, shared)
    return filter_complete_cases(frame, ["y", *PREDICTOR_LEVELS]) if complete else frame


def fit_outcomes(frame: DataFrame, formula: Formula = FULL, by: Sequence[str] = ("outcome",)):
    """Cells and fits of every group of a model frame.

    The cells are a few rows per fit and every later step needs them, so they
    are kept at reliable storage: the table behind them is scanned once.
    """
    cells = materialise(covariate_cells(frame, by, formula))
    return cells, logit.svy_logistic(cells, by, formula)


def fit_with_variance(frame: DataFrame, formula: Formula = FULL, by: Sequence[str] = ("outcome",)) -> DataFrame:
    """Fits with their design-based covariance, from one scan of the frame."""
    by = list(by)
    cells = materialise(covariate_cells(frame, [*by, "stratum", "psu"], formula))
    fits = materialise(logit.svy_logistic(merge_cells(cells, by, formula), by, formula))
    return linearised_variance(cells, fits, by, formula)


def fit_metrics(cells: DataFrame, fits: DataFrame, formula: Formula, by: Sequence[str] = ("outcome",),
                cell_by: Sequence[str] = ("outcome",), compat: bool = False) -> DataFrame:
    """R_boot, R_NK, recall, precision, F1 and AUC of fits applied to cells.

    ``cells`` are keyed by ``cell_by``, fits by ``by``, which contains it; the
    cutoff is the weighted prevalence of the cells. The cells are few: the
    product of the factor levels per key.
    """
    by = list(by)
    fits = materialise(fits)
    # the cells are the small side, so the fits are never moved to meet them
    small = F.broadcast if not formula.numbers else broadcast_if_small
    cutoffs = cells.groupBy(*cell_by).agg(F.try_divide(F.sum("wy"), F.sum("w")).alias("cutoff"))
    scored = logit.predict_prob(small(cells.join(cutoffs, list(cell_by))), fits, cell_by, formula, key=by,
                                few_cells=not formula.numbers and len(by) > len(cell_by))
    scored = scored.withColumn("predicted", (F.col("prob") >= F.col("cutoff")).cast("int"))
    rates = metrics.confusion(metrics.contingency_weighted(scored, by), by)
    return (
        metrics.nagelkerke_train(fits, by).join(fits.select(*by, "converged"), by)
        .join(metrics.nagelkerke_holdout(scored, by, "prob", fits if compat else None), by)
        .join(rates, by)
        .join(metrics.weighted_auc(scored, by, "prob", slices=1), by)
    )


def replicate_coef_table(records: DataFrame) -> DataFrame:
    """Odds ratio, its SD and the two-sided share p-value per term, in model order."""
    coefs = records.filter(F.col("term").isin(*TERM_ORDER))
    table = describe.mean_sd_by_term(coefs, exponentiate=True).join(
        describe.bootstrap_p_value(coefs), ["outcome", "term"])
    rounded = table.select("outcome", "term", F.round("mean", 3).alias("odds_ratio"),
                           F.round("sd", 3).alias("se"), F.round("p_val", 4).alias("p_val"),
                           "n_replicates", "n_not_converged")
    return sort_by_custom_order(rounded, "term", TERM_ORDER, "outcome")


def replicate_fit_table(records: DataFrame) -> DataFrame:
    """Mean and SD per metric, in report order with report labels."""
    table = describe.mean_sd_by_term(records.filter(F.col("term").isin(*METRIC_ORDER)))
    label = F.coalesce(*[F.when(F.col("term") == k, F.lit(v)) for k, v in METRIC_LABELS.items()], F.col("term"))
    ordered = sort_by_custom_order(table, "term", METRIC_ORDER, "outcome")
    return ordered.select("outcome", label.alias("metric"), F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"),
                          "n_replicates", "n_not_converged")


def metric_records(wide: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    ids = [*by, "converged"]
    return wide.select(*ids, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        ids, list(names), "term", "value").filter("value is not null")
