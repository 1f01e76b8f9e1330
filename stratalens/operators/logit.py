"""Weighted logistic regression on covariate cells, many fits in one job."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.runtime import broadcast_if_small, materialise, scratch_path, ship_package, spread

MAX_ITERATIONS = 25
TOLERANCE = 1e-11
MOST_FITS = 20_000  # rows of fits that are sent to every task
SEPARATED = 1e-8  # a fitted probability this close to 0 or 1 means the data are separated


@dataclass(frozen=True)
class Formula:
    """Predictors of a model: factors with their levels (first is the base) and numbers."""

    factors: Mapping[str, Sequence[int]]
    numbers: Sequence[str] = field(default_factory=tuple)

    @property
    def variables(self) -> list[str]:
        return [*self.factors, *self.numbers]

    @property
    def terms(self) -> list[str]:
        dummies = [f"{v}{level}" for v, levels in self.factors.items() for level in levels[1:]]
        return ["(Intercept)", *dummies, *self.numbers]

    def blocks(self) -> dict[str, list[int]]:
        """Positions of each predictor's terms."""
        out, at = {}, 1
        for v in self.variables:
            size = len(self.factors[v]) - 1 if v in self.factors else 1
            out[v] = list(range(at, at + size))
            at += size
        return out

    def design_sql(self) -> list[str]:
        """One SQL expression per term: the columns of the design matrix."""
        dummies = [f"if({self.known_sql(v)} = {level}, 1, 0)" for v, levels in self.factors.items() for level in levels[1:]]
        return ["1", *dummies, *self.numbers]

    def known_sql(self, v: str) -> str:
        """A factor as it is; a level outside its list is an error, as no model has a term for it."""
        levels = ", ".join(map(str, self.factors[v]))
        return (f"case when {v} is null or {v} in ({levels}) then {v} "
                f"else raise_error(concat('unknown level of {v}: ', {v})) end")

    def eta_sql(self, coef: str) -> str:
        """Linear predictor from an array column of coefficients; an unknown level is an error."""
        parts, at = [f"coalesce({coef}[0], 0D)"], 1
        for v, levels in self.factors.items():
            arms = "".join(f" when {level} then coalesce({coef}[{at + i}], 0D)" for i, level in enumerate(levels[1:]))
            other = f"if({v} is null, cast(null as double), cast(raise_error(concat('unknown level of {v}: ', {v})) as double))"
            parts.append(f"case {v} when {levels[0]} then 0D{arms} else {other} end")
            at += len(levels) - 1
        parts += [f"coalesce({coef}[{at + i}], 0D) * {v}" for i, v in enumerate(self.numbers)]
        return " + ".join(parts)

    def matrix(self, cells: pd.DataFrame) -> np.ndarray:
        columns = [np.ones(len(cells))]
        for v, levels in self.factors.items():
            codes = cells[v].to_numpy()
            columns += [(codes == level).astype(float) for level in levels[1:]]
        columns += [cells[v].to_numpy(dtype=float) for v in self.numbers]
        return np.column_stack(columns)


def fit_schema(by: Sequence[T.StructField]) -> T.StructType:
    numbers = T.ArrayType(T.DoubleType())
    return T.StructType([
        *by,
        T.StructField("coef", numbers), T.StructField("bread", numbers),
        T.StructField("deviance", T.DoubleType()), T.StructField("null_deviance", T.DoubleType()),
        T.StructField("rows", T.LongType()), T.StructField("sum_w", T.DoubleType()),
        T.StructField("sum_wy", T.DoubleType()), T.StructField("iterations", T.IntegerType()),
        T.StructField("converged", T.BooleanType()),
    ])


def _deviance(w: np.ndarray, wy: np.ndarray, p: np.ndarray) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.where(wy > 0, wy * np.log(p), 0.0)
        miss = np.where(w - wy > 0, (w - wy) * np.log1p(-p), 0.0)
    return float(-2.0 * (hit.sum() + miss.sum()))


def _independent(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Columns that add rank, left to right; the others are aliased."""
    r = np.abs(np.diag(np.linalg.qr(x * np.sqrt(w)[:, None], mode="r"))) if len(x) >= x.shape[1] else None
    scale = np.sqrt((x * x * w[:, None]).sum(0))
    if r is not None and (r > 1e-9 * np.maximum(scale, 1e-300)).all() and (scale > 0).all():
        return np.arange(x.shape[1])
    kept: list[int] = []
    for j in range(x.shape[1]):
        trial = x[:, [*kept, j]] * np.sqrt(w)[:, None]
        if np.linalg.matrix_rank(trial) == len(kept) + 1:
            kept.append(j)
    return np.array(kept)


def irls(x: np.ndarray, w: np.ndarray, wy: np.ndarray) -> dict:
    """Newton steps on cell sums; stops on a stable deviance or after the iteration limit."""
    use = w > 0
    x, w, wy = x[use], w[use], wy[use]
    k = x.shape[1]
    if not use.any():
        return {"coef": [None] * k, "bread": [0.0] * (k * k), "deviance": None, "null_deviance": None,
                "sum_w": 0.0, "sum_wy": 0.0, "iterations": 0, "converged": False}
    rate = wy.sum() / w.sum()
    null = _deviance(w, wy, np.full(len(w), rate))
    cols = _independent(x, w)
    xi = x[:, cols]
    beta = np.zeros(len(cols))
    beta[0] = np.log(rate / (1 - rate)) if 0 < rate < 1 else 0.0
    old, done, steps, hessian = null, False, 0, np.eye(len(cols))
    for steps in range(1, MAX_ITERATIONS + 1):
        p = 1.0 / (1.0 + np.exp(-(xi @ beta)))
        hessian = (xi * (w * p * (1 - p))[:, None]).T @ xi
        try:
            beta = beta + np.linalg.solve(hessian, xi.T @ (wy - w * p))
        except np.linalg.LinAlgError:
            break
        new = _deviance(w, wy, 1.0 / (1.0 + np.exp(-(xi @ beta))))
        if not np.isfinite(new):
            break
        done = abs(new - old) <= TOLERANCE * (abs(new) + 0.1)
        old = new
        if done:
            break
    p = 1.0 / (1.0 + np.exp(-(xi @ beta)))
    done = done and bool(((p > SEPARATED) & (p < 1 - SEPARATED)).all())
    coef, bread = np.full(k, np.nan), np.zeros((k, k))
    coef[cols] = beta
    try:
        bread[np.ix_(cols, cols)] = np.linalg.inv((xi * (w * p * (1 - p))[:, None]).T @ xi)
    except np.linalg.LinAlgError:
        done = False
    return {"coef": [None if np.isnan(c) else float(c) for c in coef], "bread": bread.ravel().tolist(),
            "deviance": old, "null_deviance": null, "sum_w": float(w.sum()), "sum_wy": float(wy.sum()),
            "iterations": steps, "converged": bool(done)}


def svy_logistic(cells: DataFrame, by: Sequence[str], formula: Formula, w: str = "w",
                 wy: str = "wy", n: str = "n") -> DataFrame:
    """One weighted logistic regression per group of cells.

    Of factors alone a group holds at most the product of their levels, whatever
    the size of the table behind it (a level outside its list is an error), and is
    solved as one. With numbers the cells have no such bound and stay where they
    are: see :func:`newton`. Aliased terms get a NULL coefficient; separation
    shows as ``converged = false``.
    """
    ship_package(cells.sparkSession)
    by = list(by)
    if formula.numbers:
        return newton(cells, by, formula, w, wy, n)
    schema = fit_schema([cells.schema[b] for b in by])
    names = schema.fieldNames()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = irls(formula.matrix(pdf), pdf[w].to_numpy(dtype=float), pdf[wy].to_numpy(dtype=float))
        keys = {b: pdf[b].iloc[0] for b in by}
        return pd.DataFrame([{**keys, **found, "rows": int(pdf[n].sum())}], columns=names)

    factors = [F.expr(formula.known_sql(v)).alias(v) for v in formula.factors]
    slim = cells.select(*by, *factors, *formula.numbers, w, wy, n).dropna(subset=formula.variables)
    return slim.groupBy(*by).applyInPandas(solve, schema)


def newton(cells: DataFrame, by: Sequence[str], formula: Formula, w: str = "w", wy: str = "wy", n: str = "n") -> DataFrame:
    """Logistic regressions of all groups by distributed Newton steps.

    A step is one aggregation over the cells of all unfinished fits: every batch
    adds up score, Hessian and deviance per fit, and these few sums are combined
    map-side before one row per fit and batch group is shuffled. The state (one
    row of coefficients per fit) is kept between the steps and joined to the
    cells, broadcast while it is small. Numbers are standardised inside.
    """
    spark, by = cells.sparkSession, list(by)
    ship_package(spark)
    k = len(formula.terms)
    at = [formula.terms.index(v) for v in formula.numbers]
    upper = np.triu_indices(k)
    factors = [F.expr(formula.known_sql(v)).alias(v) for v in formula.factors]
    path = scratch_path(spark, "model-cells")
    slim = cells.select(*by, *factors, *[F.col(v).cast("double").alias(v) for v in formula.numbers],
                        F.col(w).cast("double").alias("w_"), F.col(wy).cast("double").alias("wy_"), F.col(n).cast("long").alias("n_"))
    slim.dropna(subset=[*formula.variables, "w_"]).write.parquet(path)
    data = spark.read.parquet(path)
    moments = data.agg(*[f(v).alias(f"{name}_{v}") for v in formula.numbers for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    shift = np.array([moments[f"m_{v}"] or 0.0 for v in formula.numbers])
    scale = np.array([moments[f"s_{v}"] or 1.0 for v in formula.numbers])
    keys = [data.schema[b] for b in by]
    numbers = T.ArrayType(T.DoubleType())

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        x = formula.matrix(pdf)
        x[:, at] = (x[:, at] - shift) / scale
        return x

    sums_schema = T.StructType([*keys, T.StructField("sums", numbers), T.StructField("low", T.DoubleType()),
                                T.StructField("high", T.DoubleType())])

    def batch_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]:
                x, wt, hit = matrix(part), part["w_"].to_numpy(), part["wy_"].to_numpy()
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(part["beta"].iloc[0]), -700, 700)))
                hessian = (x * (wt * p * (1 - p))[:, None]).T @ x
                out.append([*(key if isinstance(key, tuple) else (key,)),
                            [wt.sum(), hit.sum(), float(part["n_"].sum()), _deviance(wt, hit, p), *(x.T @ (hit - wt * p)), *hessian[upper]],
                            p[wt > 0].min(initial=1.0), p[wt > 0].max(initial=0.0)])
            yield pd.DataFrame(out, columns=sums_schema.fieldNames())

    width = 4 + k + len(upper[0])
    add = F.expr("array(" + ", ".join(f"sum(sums[{i}])" for i in range(width)) + ") as sums")
    state_schema = T.StructType([*keys, T.StructField("beta", numbers), T.StructField("cols", T.ArrayType(T.IntegerType())),
                                 T.StructField("sums", numbers), T.StructField("old", T.DoubleType()),
                                 T.StructField("step", T.IntegerType()), T.StructField("open", T.BooleanType()),
                                 T.StructField("done", T.BooleanType()), T.StructField("low", T.DoubleType()),
                                 T.StructField("high", T.DoubleType())])

    def hessian_of(sums: np.ndarray) -> np.ndarray:
        h = np.zeros((k, k))
        h[upper] = sums[4 + k:]
        return h + np.triu(h, 1).T

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums at the present coefficients: stop on a stable deviance, else one step on."""
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                sums, beta, step = np.array(r["total"]), np.array(r["beta"]), r["step"]
                new = {**r, "sums": sums.tolist(), "low": r["new_low"], "high": r["new_high"], "old": float(sums[3])}
                cols = np.array(r["cols"] if r["cols"] is not None else [], dtype=int)
                if step < 0:  # the first sums were taken at zero coefficients and only give the start
                    rate = sums[1] / sums[0] if sums[0] > 0 else 0.0
                    beta = np.zeros(k)
                    beta[0] = np.log(rate / (1 - rate)) if 0 < rate < 1 else 0.0
                    cols = independent_columns(hessian_of(sums))
                    new |= {"beta": beta.tolist(), "cols": cols.tolist(), "step": 0, "open": bool(sums[0] > 0), "old": None, "done": False}
                    out.append(new)
                    continue
                stable = r["old"] is not None and not np.isnan(r["old"]) and abs(sums[3] - r["old"]) <= TOLERANCE * (abs(sums[3]) + 0.1)
                if stable or step >= MAX_ITERATIONS or not np.isfinite(sums[3]):
                    new |= {"open": False, "done": bool(stable)}
                else:
                    h = hessian_of(sums)[np.ix_(cols, cols)]
                    try:
                        beta[cols] += np.linalg.solve(h, sums[4:4 + k][cols])
                        new |= {"beta": beta.tolist(), "step": step + 1}
                    except np.linalg.LinAlgError:
                        new |= {"open": False, "done": False}
                out.append(new)
            yield pd.DataFrame(out, columns=state_schema.fieldNames())

    def stored(df: DataFrame) -> DataFrame:
        at_path = scratch_path(spark, "model-state")
        df.write.parquet(at_path)
        return spark.read.parquet(at_path)

    first = (data.select(*by).distinct() if by else spark.range(1)).select(
        *by, F.array(*[F.lit(0.0)] * k).alias("beta"), F.lit(None).cast("array<int>").alias("cols"), F.lit(None).cast(numbers).alias("sums"),
        F.lit(None).cast("double").alias("old"), F.lit(-1).alias("step"), F.lit(True).alias("open"), F.lit(False).alias("done"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    state, finished = stored(first), []
    for _ in range(MAX_ITERATIONS + 2):
        open_ = state.filter("open")
        if open_.isEmpty():
            break
        finished.append(state.filter("not open"))
        met = data.join(broadcast_if_small(open_.select(*[F.col(b).alias(f"k_{b}") for b in by], "beta"), MOST_FITS),
                        _same(by), "inner").drop(*[f"k_{b}" for b in by])
        total = met.mapInPandas(batch_sums, sums_schema).groupBy(*by).agg(
            add, F.min("low").alias("new_low"), F.max("high").alias("new_high")).withColumnRenamed("sums", "total")
        total = total.withColumnsRenamed({b: f"k_{b}" for b in by})
        state = stored(open_.join(total, _same(by)).drop(*[f"k_{b}" for b in by]).mapInPandas(advance, state_schema))
    finished.append(state)
    ended = finished[0]
    for part in finished[1:]:
        ended = ended.unionByName(part)
    schema = fit_schema(keys)
    back = np.eye(k)
    back[at, at] = 1 / scale
    back[0, at] = -shift / scale

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                sums, cols = np.array(r["sums"]), np.array(r["cols"], dtype=int)
                key = {b: r[b] for b in by}
                if not sums[0] > 0:
                    out.append({**key, "coef": [None] * k, "bread": [0.0] * (k * k), "deviance": None, "null_deviance": None,
                                "rows": int(sums[2]), "sum_w": 0.0, "sum_wy": 0.0, "iterations": 0, "converged": False})
                    continue
                bread, done = np.zeros((k, k)), r["done"] and r["low"] > SEPARATED and r["high"] < 1 - SEPARATED
                try:
                    bread[np.ix_(cols, cols)] = np.linalg.inv(hessian_of(sums)[np.ix_(cols, cols)])
                except np.linalg.LinAlgError:
                    done = False
                beta = back @ np.array(r["beta"])
                rate = np.array([sums[1] / sums[0]])
                null = _deviance(sums[:1], sums[1:2], rate)
                out.append({**key, "coef": [float(beta[j]) if j in cols else None for j in range(k)],
                            "bread": (back @ bread @ back.T).ravel().tolist(), "deviance": float(sums[3]), "null_deviance": null,
                            "rows": int(sums[2]), "sum_w": float(sums[0]), "sum_wy": float(sums[1]), "iterations": int(r["step"]),
                            "converged": bool(done)})
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return ended.mapInPandas(report, schema)


def _same(by: Sequence[str]) -> Column:
    """Equal keys of a frame and one whose keys are named with ``k_``; NULL keys are equal."""
    out = F.lit(True)
    for b in by:
        out = out & F.col(b).eqNullSafe(F.col(f"k_{b}"))
    return out


def independent_columns(gram: np.ndarray) -> np.ndarray:
    """Columns that add rank, left to right, from the matrix of their products."""
    kept: list[int] = []
    for j in range(len(gram)):
        if gram[j, j] <= 0:
            continue
        rest = gram[j, j]
        if kept:
            own = gram[np.ix_(kept, kept)]
            rest -= gram[j, kept] @ np.linalg.solve(own, gram[kept, j])
        if rest > 1e-9 * gram[j, j]:
            kept.append(j)
    return np.array(kept, dtype=int)


def coefficients(fits: DataFrame, by: Sequence[str], formula: Formula) -> DataFrame:
    """Long form (by, term, estimate, converged)."""
    terms = F.array(*[F.lit(t) for t in formula.terms])
    return fits.select(*by, "converged", F.inline(F.arrays_zip(terms.alias("term"), F.col("coef").alias("estimate"))))


def null_deviance(ones: str, whole: str) -> Column:
    """Deviance of the constant rate; a class without weight adds nothing."""
    one, zero = F.col(ones), F.col(whole) - F.col(ones)
    part = lambda x: F.when(x > 0, x * F.ln(F.try_divide(x, F.col(whole)))).otherwise(0.0)
    return -2 * (part(one) + part(zero))


def svy_logistic_null(cells: DataFrame, by: Sequence[str], w: str = "w", wy: str = "wy", n: str = "n") -> DataFrame:
    """Intercept-only model: the logit of the weighted rate, with its deviance."""
    sums = cells.groupBy(*by).agg(F.sum(w).alias("sum_w"), F.sum(wy).alias("sum_wy"), F.sum(n).alias("rows"))
    odds = F.try_divide(F.col("sum_wy"), F.col("sum_w") - F.col("sum_wy"))
    return sums.withColumns({"intercept": F.ln(odds), "null_deviance": null_deviance("sum_wy", "sum_w")})


def predict_prob(data: DataFrame, fits: DataFrame, by: Sequence[str], formula: Formula,
                 name: str = "prob", key: Sequence[str] | None = None, few_cells: bool = False) -> DataFrame:
    """Inverse logit of the linear predictor for rows or cells.

    Joins on ``by``; ``key`` is the full key of the fits when it is longer. A few
    rows of fits are broadcast, so that a hot key of the data stays where it is.
    With ``few_cells`` the data are the side that is broadcast, and the fits are
    dealt by their key: what is summed per fit later does not move again.
    """
    known = fits.select(*(key or by), "coef")
    known = spread(known, *(key or by)) if few_cells else broadcast_if_small(materialise(known), MOST_FITS)
    scored = known.join(data, list(by))
    return scored.withColumn(name, F.expr(f"1 / (1 + exp(-({formula.eta_sql('coef')})))")).drop("coef")


def predict_class(scored: DataFrame, cutoffs: DataFrame, by: Sequence[str], prob: str = "prob") -> DataFrame:
    """1 where the probability reaches the cutoff of its group; cutoffs are one number per group."""
    return scored.join(broadcast_if_small(materialise(cutoffs.select(*by, "cutoff")), MOST_FITS), list(by)).withColumn(
        "predicted", (F.col(prob) >= F.col("cutoff")).cast("int"))


def loglik_aic(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Log likelihood and AIC; aliased terms do not count as parameters."""
    k = F.size(F.filter("coef", lambda c: c.isNotNull()))
    loglik = -F.col("deviance") / 2
    return fits.select(*by, "rows", loglik.alias("loglik"), (-2 * loglik + 2 * k).alias("aic"))
