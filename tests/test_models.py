import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from stratalens.operators import design, logit, metrics
from stratalens.operators.logit import Formula
from stratalens.plans import modelling

FORMULA = Formula({"x": [0, 1, 2], "g": [1, 2]})


def model_rows(seed=1, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, g = rng.randrange(3), rng.choice([1, 2])
        y = int(rng.random() < 1 / (1 + np.exp(-(-1 + 0.8 * x - 0.5 * (g == 2)))))
        rows.append(("o", i % 4, (i // 4) % 3, x, g, rng.randrange(1, 50), y))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(model_rows(), "outcome string, stratum int, psu int, x int, g int, w int, y int")


@pytest.fixture(scope="module")
def fitted(frame):
    return modelling.fit_outcomes(frame, FORMULA)


def test_matches_generalized_linear_regression(frame, fitted):
    _, fits = fitted
    coef = fits.first()["coef"]
    ready = frame.selectExpr("y", "double(w) as w", *[f"double({x}) as d{i}" for i, x in enumerate(FORMULA.design_sql()[1:])])
    ready = VectorAssembler(inputCols=["d0", "d1", "d2"], outputCol="features").transform(ready)
    glr = GeneralizedLinearRegression(family="binomial", weightCol="w", labelCol="y", tol=1e-10).fit(ready)
    assert coef == pytest.approx([glr.intercept, *glr.coefficients], abs=1e-6)
    assert fits.first()["deviance"] == pytest.approx(glr.summary.deviance, rel=1e-8)
    assert fits.first()["null_deviance"] == pytest.approx(glr.summary.nullDeviance, rel=1e-8)


def test_weighted_score_is_zero(frame, fitted):
    _, fits = fitted
    scored = logit.predict_prob(frame, fits, ["outcome"], FORMULA)
    sums = scored.agg(*[F.expr(f"sum(w * (y - prob) * ({x})) as s{i}") for i, x in enumerate(FORMULA.design_sql())]).first()
    total = frame.agg(F.sum("w")).first()[0]
    assert all(abs(v) < 1e-6 * total for v in sums)


def test_scale_and_duplication(frame, fitted):
    coef = fitted[1].first()["coef"]
    scaled = modelling.fit_outcomes(frame.withColumn("w", F.col("w") * 7), FORMULA)[1].first()
    doubled = modelling.fit_outcomes(frame.unionByName(frame), FORMULA)[1].first()
    assert scaled["coef"] == pytest.approx(coef, abs=1e-8)
    assert doubled["coef"] == pytest.approx(coef, abs=1e-8)


def test_empty_level_is_aliased_and_separation_is_reported(spark):
    rows = [("a", 0, 1, 5, 0), ("a", 0, 1, 5, 1), ("a", 1, 2, 3, 1), ("a", 1, 2, 3, 0), ("a", 0, 2, 2, 1), ("a", 0, 2, 4, 0)]
    rows += [("b", 0, 1, 5, 0), ("b", 1, 1, 5, 1), ("b", 0, 1, 1, 0)]
    df = spark.createDataFrame(rows, "outcome string, x int, g int, w int, y int")
    fits = {r["outcome"]: r for r in modelling.fit_outcomes(df, FORMULA)[1].collect()}
    assert fits["a"]["converged"] and fits["a"]["coef"][2] is None
    assert not fits["b"]["converged"]


def test_linearised_variance_against_numpy(frame):
    fit = modelling.fit_with_variance(frame, FORMULA).first()
    rows = frame.collect()
    x = np.array([[1, r["x"] == 1, r["x"] == 2, r["g"] == 2] for r in rows], dtype=float)
    w, y = np.array([r["w"] for r in rows], float), np.array([r["y"] for r in rows], float)
    p = 1 / (1 + np.exp(-x @ np.array(fit["coef"])))
    a = np.linalg.inv((x * (w * p * (1 - p))[:, None]).T @ x)
    b = np.zeros((4, 4))
    for h in range(4):
        z = np.array([((w * (y - p))[:, None] * x)[[r["stratum"] == h and r["psu"] == i for r in rows]].sum(0) for i in range(3)])
        d = z - z.mean(0)
        b += 3 / 2 * d.T @ d
    assert np.array(fit["vcov"]).reshape(4, 4) == pytest.approx(a @ b @ a, rel=1e-8)
    assert (fit["n_psu"], fit["n_strata"], fit["single_psu_strata"]) == (12, 4, 0)
    table = design.coefficient_table(modelling.fit_with_variance(frame, FORMULA), ["outcome"], FORMULA).collect()
    assert [r["se"] for r in table] == pytest.approx(list(np.sqrt(np.diag(a @ b @ a))))


def test_single_psu_stratum(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (1, 1, 1.0), (1, 2, 4.0)], "stratum int, psu int, w double")
    rows = {r["stratum"]: r for r in design.SurveyDesign(df).strata().collect()}
    assert rows[0]["warnings"] == "single PSU" and rows[1]["warnings"] is None and rows[1]["weight"] == 5.0


def test_student_p():
    # two-sided 5 % points of Student's t
    for t, df in ((12.706, 1), (2.571, 5), (2.042, 30), (1.960, 10**6)):
        assert design.student_p(np.array([t]), df)[0] == pytest.approx(0.05, abs=2e-4)
    assert np.isnan(design.student_p(np.array([1.0]), 0)).all()


def test_gvif_of_unrelated_predictors_is_one(spark):
    rows = [("o", x, g, 1, y) for x in (0, 1, 2) for g in (1, 2) for y in (0, 1)]
    df = spark.createDataFrame(rows, "outcome string, x int, g int, w int, y int")
    _, fits = modelling.fit_outcomes(df, FORMULA)
    out = {r["variable"]: r for r in design.gvif(fits, ["outcome"], FORMULA, cov="bread").collect()}
    assert out["x"]["df"] == 2 and out["g"]["df"] == 1
    assert out["x"]["gvif"] == pytest.approx(1) and out["g"]["gvif_scaled"] == pytest.approx(1)


def brute_auc(rows):
    won = total = 0
    for p, y, w in rows:
        for q, z, v in rows:
            if y == 1 and z == 0:
                total += w * v
                won += w * v * (1 if p > q else 0.5 if p == q else 0)
    return won / total if total else None


def auc(spark, rows, slices=None):
    df = spark.createDataFrame(rows, "p double, y int, w int").withColumn("wy", F.col("w") * F.col("y"))
    return metrics.weighted_auc(df, [], "p", slices=slices).first()["AUC"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.1, 0.2, 0.5, 0.9]), st.integers(0, 1), st.integers(1, 9)), min_size=2, max_size=25))
def test_auc_properties(spark, rows):
    want = brute_auc(rows)
    got = auc(spark, rows)
    if want is None:
        assert got is None
    else:
        assert got == pytest.approx(want)
        assert auc(spark, [(-p, y, w) for p, y, w in rows], 3) == pytest.approx(1 - want)


def test_one_predicted_class(spark):
    df = spark.createDataFrame([("o", 1, 10, 4), ("o", 1, 5, 0)], "outcome string, predicted int, w int, wy int")
    r = metrics.confusion(metrics.contingency_weighted(df, ["outcome"]), ["outcome"]).first()
    assert (r["Recall"], r["Precision"], r["F1_Score"]) == (0.0, 0.0, None)
    assert r["Accuracy"] == pytest.approx(4 / 15)
