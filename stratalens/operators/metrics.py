"""Weighted fit metrics on scored rows or cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators.logit import null_deviance
from stratalens.operators.ordered import running_sums


def contingency_weighted(scored: DataFrame, by: Sequence[str], w: str = "w", wy: str = "wy") -> DataFrame:
    """Weight by (observed, predicted), in long form with all observed classes."""
    sums = scored.groupBy(*by, "predicted").agg(F.sum(wy).alias("one"), (F.sum(w) - F.sum(wy)).alias("zero"))
    cells = F.array(F.struct(F.lit(0).alias("observed"), F.col("zero").alias("weight")),
                    F.struct(F.lit(1).alias("observed"), F.col("one").alias("weight")))
    return sums.select(*by, F.inline(cells), "predicted")


def confusion(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Recall, precision, F1 and accuracy from a weighted table.

    When only one class is predicted recall and precision are 0 and F1 is NULL.
    """

    def cell(observed: int, predicted: int) -> Column:
        hit = (F.col("observed") == observed) & (F.col("predicted") == predicted)
        return F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0))

    sums = table.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"),
        (F.min("predicted") != F.max("predicted")).alias("both"))
    recall = F.when(F.col("both"), F.try_divide("tp", F.col("tp") + F.col("fn"))).otherwise(0.0)
    precision = F.when(F.col("both"), F.try_divide("tp", F.col("tp") + F.col("fp"))).otherwise(0.0)
    whole = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    rates = sums.select(*by, recall.alias("Recall"), precision.alias("Precision"), "both",
                        F.try_divide(F.col("tp") + F.col("tn"), whole).alias("Accuracy"))
    f1 = F.when(F.col("both"), F.try_divide(
        2 * F.col("Precision") * F.col("Recall"), F.col("Precision") + F.col("Recall")))
    return rates.withColumn("F1_Score", f1).drop("both")


def weighted_auc(scored: DataFrame, by: Sequence[str], prob: str, w: str = "w", wy: str = "wy",
                 slices: int | None = None) -> DataFrame:
    """Weighted concordance, ties counting half; NULL when a class is empty."""
    split = scored.select(*by, F.col(prob).alias("prob"), F.col(wy).alias("one"), (F.col(w) - F.col(wy)).alias("zero"))
    points = running_sums(split, list(by), "prob", ["one", "zero"], slices)
    won = F.sum(F.col("one") * (F.col("below_zero") + F.col("zero") / 2))
    pairs = F.sum("one").cast("double") * F.sum("zero").cast("double")
    return points.groupBy(*by).agg(F.try_divide(won, pairs).alias("AUC"))


def nagelkerke(deviance: Column, null_deviance: Column, whole: Column) -> Column:
    """Pseudo R-squared from the model and null deviances and the total weight."""
    cox_snell = 1 - F.exp(F.try_divide(deviance - null_deviance, whole))
    return F.try_divide(cox_snell, 1 - F.exp(F.try_divide(-null_deviance, whole)))


def nagelkerke_train(fits: DataFrame, by: Sequence[str], name: str = "R_boot") -> DataFrame:
    return fits.select(*by, nagelkerke(F.col("deviance"), F.col("null_deviance"), F.col("sum_w")).alias(name))


def holdout_deviance(scored: DataFrame, by: Sequence[str], prob: str, w: str = "w", wy: str = "wy") -> DataFrame:
    """Deviance, null deviance and size of the data a fit is applied to."""
    hit, miss = F.col(wy), F.col(w) - F.col(wy)
    # a probability that rounds to 0 or 1 must not meet a class of zero weight
    loglik = F.when(hit > 0, hit * F.ln(prob)).otherwise(0.0) + F.when(miss > 0, miss * F.ln(1 - F.col(prob))).otherwise(0.0)
    sums = scored.groupBy(*by).agg(
        (-2 * F.sum(loglik)).alias("deviance"), F.sum(w).alias("whole"), F.sum(wy).alias("ones"),
        F.sum("n").alias("rows"))
    return sums.withColumn("null_deviance", null_deviance("ones", "whole"))


def nagelkerke_holdout(scored: DataFrame, by: Sequence[str], prob: str = "prob",
                       fits: DataFrame | None = None, name: str = "R_NK") -> DataFrame:
    """Pseudo R-squared of a fit on other data.

    The null deviance is that of the data the fit is applied to. Given the
    fits, it is scaled by the ratio of the row counts (compatibility).
    """
    sums = holdout_deviance(scored, by, prob)
    null = F.col("null_deviance")
    if fits is not None:
        sums = sums.join(fits.select(*by, F.col("rows").alias("fit_rows")), list(by))
        null = null * F.col("rows") / F.col("fit_rows")
    return sums.select(*by, nagelkerke(F.col("deviance"), null, F.col("whole")).alias(name))
