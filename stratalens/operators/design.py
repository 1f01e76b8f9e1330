"""Complex sample designs: PSUs nested in strata, weights, covariate cells, linearised variance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.operators.logit import MOST_FITS, Formula
from stratalens.runtime import broadcast_if_small, materialise, ship_package


@dataclass(frozen=True)
class SurveyDesign:
    """A table with its design columns; a PSU label counts within its stratum."""

    df: DataFrame
    psu: str = "psu"
    stratum: str = "stratum"
    weight: str = "w"

    def psus(self, by: Sequence[str] = ()) -> DataFrame:
        return self.df.groupBy(*by, self.stratum, self.psu).agg(
            F.count("*").alias("rows"), F.sum(self.weight).alias("weight"))

    def strata(self, by: Sequence[str] = ()) -> DataFrame:
        """PSU count and weight per stratum, with a warning where the variance is undefined."""
        return self.psus(by).groupBy(*by, self.stratum).agg(
            F.count("*").alias("n_psu"), F.sum("rows").alias("rows"), F.sum("weight").alias("weight"),
        ).withColumn("warnings", F.when(F.col("n_psu") < 2, F.lit("single PSU")))


def covariate_cells(frame: DataFrame, by: Sequence[str], formula: Formula, y: str = "y",
                    weight: str = "w") -> DataFrame:
    """Rows reduced to covariate patterns: ``n``, ``w`` and ``wy`` per (by, pattern).

    The predictors are categories, so the number of patterns is fixed by their
    levels; a logistic fit on patterns has the same coefficients as on rows.
    """
    return frame.groupBy(*by, *formula.variables).agg(
        F.count("*").alias("n"), F.sum(F.col(weight)).alias("w"), F.sum(F.col(weight) * F.col(y)).alias("wy"))


def merge_cells(cells: DataFrame, by: Sequence[str], formula: Formula) -> DataFrame:
    """Cells of a coarser key from cells of a finer one."""
    return cells.groupBy(*by, *formula.variables).agg(*[F.sum(c).alias(c) for c in ("n", "w", "wy")])


def linearised_variance(cells: DataFrame, fits: DataFrame, by: Sequence[str], formula: Formula,
                        st: str = "stratum", psu: str = "psu") -> DataFrame:
    """Adds the design-based covariance ``vcov`` to fits, with PSU and stratum counts.

    ``cells`` are keyed by (by, stratum, PSU). Score totals per PSU are centred
    within their stratum; strata with one PSU add nothing and are counted in
    ``single_psu_strata``. Everything up to the k x k sums is grouped
    aggregation, one row per fit reaches the algebra.
    """
    by = list(by)
    k = len(formula.terms)
    scored = cells.join(broadcast_if_small(materialise(fits.select(*by, "coef")), MOST_FITS), by)
    residual = f"(wy - w / (1 + exp(-({formula.eta_sql('coef')}))))"
    totals = scored.groupBy(*by, st, psu).agg(*[
        F.expr(f"sum({residual} * ({x})) as z{j}") for j, x in enumerate(formula.design_sql())])
    means = totals.groupBy(*by, st).agg(F.count("*").alias("n_psu"), *[F.avg(f"z{j}").alias(f"m{j}") for j in range(k)])
    centred = totals.join(means, [*by, st]).select(
        *by, st, "n_psu", *[(F.col(f"z{j}") - F.col(f"m{j}")).alias(f"d{j}") for j in range(k)])
    factor = "if(n_psu > 1, n_psu / (n_psu - 1), 0)"
    meat = centred.groupBy(*by).agg(
        F.count("*").alias("n_psu"), F.count_distinct(st).alias("n_strata"),
        F.expr(f"count(distinct case when n_psu = 1 then {st} end) as single_psu_strata"),
        F.expr("array(" + ", ".join(
            f"sum({factor} * d{i} * d{j})" for i in range(k) for j in range(i, k)) + ") as meat"),
    )
    joined = fits.join(meat, by)
    ship_package(fits.sparkSession)
    schema = T.StructType([f for f in joined.schema.fields if f.name != "meat"]
                          + [T.StructField("vcov", T.ArrayType(T.DoubleType()))])
    names = schema.fieldNames()

    def sandwich(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(k)
        for pdf in batches:
            out = []
            for bread, flat in zip(pdf["bread"], pdf["meat"]):
                a = np.array(bread, dtype=float).reshape(k, k)
                b = np.zeros((k, k))
                b[upper] = flat
                b = b + np.triu(b, 1).T
                out.append((a @ b @ a).ravel().tolist())
            yield pdf.drop(columns="meat").assign(vcov=out)[names]

    return joined.mapInPandas(sandwich, schema)


def student_p(t: np.ndarray, df: float) -> np.ndarray:
    """Two-sided p-value of Student's t (normal limit for large df, NaN without df)."""
    if not df > 0:
        return np.full(np.shape(t), np.nan)
    grid = np.linspace(0.0, 1.0, 4001)
    simpson = np.ones(4001)
    simpson[1:-1:2], simpson[2:-1:2] = 4.0, 2.0

    def tail(low):
        """Area from ``low`` to where the integrand has fallen by e^-40: the tail itself, so small values keep digits."""
        at = np.asarray(low, dtype=float)[..., None]
        drop = np.exp(-40.0 / max(df - 1, 1.0)) if df > 1 else 0.0
        high = np.minimum(np.arccos(np.clip(np.cos(at) * drop, 0.0, 1.0)), np.pi / 2)
        x = at + (high - at) * grid
        return ((high - at)[..., 0] / 12000.0) * (simpson * np.cos(x) ** (df - 1)).sum(-1)

    start = np.arctan(np.abs(np.asarray(t, dtype=float)) / np.sqrt(df))
    return np.clip(tail(start) / tail(np.zeros(())), 0.0, 1.0)


def map_fits(fits: DataFrame, keep: Sequence[str], fields: Sequence[T.StructField],
             fn: Callable[[dict], list[dict]]) -> DataFrame:
    """Expand each fit (one row) to the rows ``fn`` makes of it."""
    schema = T.StructType([f for f in fits.schema.fields if f.name in keep] + list(fields))
    names = schema.fieldNames()
    ship_package(fits.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{**{k: r[k] for k in keep}, **x} for r in pdf.to_dict("records") for x in fn(r)]
            yield pd.DataFrame(rows, columns=names)

    return fits.mapInPandas(run, schema)


def coefficient_table(fits: DataFrame, by: Sequence[str], formula: Formula,
                      cov: str = "vcov") -> DataFrame:
    """One row per term: estimate, standard error, t and p from the covariance column.

    The degrees of freedom are those of the design, or rows minus terms for a
    plain fit.
    """
    terms = formula.terms
    fields = [T.StructField("term", T.StringType())] + [
        T.StructField(n, T.DoubleType()) for n in ("estimate", "se", "t", "p_value")]
    keep = list(by)
    has_design = "n_psu" in fits.columns

    def expand(row: dict) -> list[dict]:
        k = len(terms)
        beta = np.array(row["coef"], dtype=float)
        se = np.sqrt(np.clip(np.diag(np.array(row[cov], dtype=float).reshape(k, k)), 0, None))
        used = int(np.isfinite(beta).sum())
        df = row["n_psu"] - row["n_strata"] + 1 - used if has_design else row["rows"] - used
        with np.errstate(divide="ignore", invalid="ignore"):
            t = beta / se
        p = student_p(t, df)
        clean = lambda v: float(v) if np.isfinite(v) else None
        return [{"term": terms[i], "estimate": clean(beta[i]), "se": clean(se[i]), "t": clean(t[i]),
                 "p_value": clean(p[i])} for i in range(k)]

    return map_fits(fits, keep, fields, expand)


def gvif(fits: DataFrame, by: Sequence[str], formula: Formula, cov: str = "vcov") -> DataFrame:
    """Generalised variance inflation per predictor, with GVIF^(1 / (2 Df))."""
    blocks = formula.blocks()
    k = len(formula.terms)
    fields = [T.StructField("variable", T.StringType()), T.StructField("df", T.IntegerType()),
              T.StructField("gvif", T.DoubleType()), T.StructField("gvif_scaled", T.DoubleType())]

    def expand(row: dict) -> list[dict]:
        v = np.array(row[cov], dtype=float).reshape(k, k)[1:, 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            sd = np.sqrt(np.diag(v))
            r = v / np.outer(sd, sd)
        out = []
        for name, idx in blocks.items():
            own = np.array(idx) - 1
            rest = np.setdiff1d(np.arange(k - 1), own)
            det = np.linalg.det
            g = det(r[np.ix_(own, own)]) * det(r[np.ix_(rest, rest)]) / det(r) if np.isfinite(r).all() else np.nan
            ok = np.isfinite(g) and g > 0
            out.append({"variable": name, "df": len(idx), "gvif": float(g) if ok else None,
                        "gvif_scaled": float(g ** (0.5 / len(idx))) if ok else None})
        return out

    return map_fits(fits, list(by), fields, expand)
