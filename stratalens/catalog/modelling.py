"""Survey-weighted logistic regression and its metrics.

Models with one factor are saturated, so SQL can state them in closed form;
the full seven-predictor model is registered as well and covered by tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens import schema as s
from stratalens.catalog.base import Tables, query
from stratalens.catalog.views import survey
from stratalens.operators import columns as c
from stratalens.operators import describe, design, logit, metrics
from stratalens.operators.logit import Formula
from stratalens.plans import modelling as m
from stratalens.runtime import materialise, scratch_path
from stratalens.sources import replicates

SMK = m.formula_of("SMK_befor")
BY = ["outcome"]


def smoking_frame(t: Tables):
    frame = m.model_frame(t.analysis(), complete=False)
    return c.filter_complete_cases(frame, ["y", "SMK_befor"])


FRAME = "frame AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{h}' AS outcome, rid, VESTR_C AS stratum, VEREP AS psu, ANALWT2_C AS w, EVER_{h} AS y, "
    f"SMK_befor_{h} AS smk, GENDER, ETHNIC FROM analysis WHERE EVER_{h} IS NOT NULL AND SMK_befor_{h} IS NOT NULL"
    for h in s.HARD) + ")"
CELLS = ("cells AS MATERIALIZED (SELECT outcome, smk, count(*) AS n, CAST(sum(w) AS DOUBLE) AS w, "
         "CAST(sum(w * y) AS DOUBLE) AS wy, CAST(sum(y) AS DOUBLE) AS ny, CAST(sum(w * y) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS p "
         "FROM frame GROUP BY ALL)")
TOTAL = ("total AS (SELECT outcome, sum(n) AS n, sum(w) AS w, sum(wy) AS wy, sum(wy) / sum(w) AS p0 FROM cells GROUP BY outcome)")
LOGIT = "ln({p} / (1 - {p}))"


def rounded(df, *names: str, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def closed_form(cells: str = "cells", p: str = "p", keys: str = "outcome", level: str = "smk",
                name: str = "SMK_befor", base: int = 0) -> str:
    """Coefficients of a saturated one-factor model."""
    using = f"USING ({keys})"
    return (f"SELECT {keys}, CASE WHEN a.{level} = {base} THEN '(Intercept)' ELSE '{name}' || a.{level} END AS term, "
            f"round(ln(a.{p} / (1 - a.{p})) - CASE WHEN a.{level} = {base} THEN 0 ELSE ln(b.{p} / (1 - b.{p})) END, 6) AS estimate "
            f"FROM {cells} a JOIN (SELECT * FROM {cells} WHERE {level} = {base}) b {using}")


def smoking_fit(t: Tables):
    frame = smoking_frame(t)
    cells, fits = m.fit_outcomes(frame, SMK)
    return frame, cells, fits


@query("survey_design", survey(
    "SELECT VESTR_C AS stratum, count(DISTINCT VEREP) AS n_psu, count(*) AS rows, CAST(sum(ANALWT2_C) AS BIGINT) AS weight, "
    "CASE WHEN count(DISTINCT VEREP) < 2 THEN 'single PSU' END AS warnings FROM analysis GROUP BY VESTR_C"))
def _(t: Tables):
    df = t.analysis().select(F.col("VESTR_C").alias("stratum"), F.col("VEREP").alias("psu"), F.col(s.WEIGHT).alias("w"))
    return design.SurveyDesign(df).strata()


MODEL_COLUMNS = ["rid", "outcome", "y", *s.PREDICTOR_LEVELS]


@query("design_matrix", survey(" UNION ALL ".join(
    f"SELECT rid, '{h}' AS outcome, EVER_{h} AS y, 1 AS \"(Intercept)\", " + ", ".join(
        f"CASE WHEN {v.replace('_befor', '_befor_' + h)} = {x} THEN 1 ELSE 0 END AS {v}{x}"
        for v, levels in s.PREDICTOR_LEVELS.items() for x in levels[1:])
    + " FROM analysis WHERE " + " AND ".join(
        f"{v.replace('_befor', '_befor_' + h)} IS NOT NULL" for v in ["EVER_" + h, *s.PREDICTOR_LEVELS]) for h in s.HARD)))
def _(t: Tables):
    frame = m.model_frame(t.analysis())
    return frame.select("rid", "outcome", "y", *[
        F.expr(x).alias(n) for n, x in zip(m.FULL.terms, m.FULL.design_sql())])


@query("svy_logistic", survey(closed_form(), FRAME, CELLS))
def _(t: Tables):
    _, _, fits = smoking_fit(t)
    return rounded(logit.coefficients(fits, BY, SMK).drop("converged"), "estimate")


SIX = Formula({"smk_gender": [1, 2, 11, 12, 21, 22]})


@query("svy_logistic_interaction", survey(
    closed_form("cells6", level="k", name="smk_gender", base=1), FRAME,
    "cells6 AS (SELECT outcome, smk * 10 + GENDER AS k, CAST(sum(w * y) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS p "
    "FROM frame GROUP BY ALL)"))
def _(t: Tables):
    frame = smoking_frame(t).withColumn("smk_gender", F.expr("SMK_befor * 10 + GENDER"))
    _, fits = m.fit_outcomes(frame, SIX)
    return rounded(logit.coefficients(fits, BY, SIX).drop("converged"), "estimate")


@query("svy_logistic_full")
def _(t: Tables):
    _, fits = m.fit_outcomes(m.model_frame(t.analysis()))
    return logit.coefficients(fits, BY, m.FULL)


# --- models with a number: the age of the first use of any soft item ------------------------

FIRST_USE = "MIN_INIT"
WITH_AGE = Formula({}, (FIRST_USE,))
FULL_WITH_AGE = Formula(s.PREDICTOR_LEVELS, (FIRST_USE,))
REAL_AGES = [f"CASE WHEN {x} < 100 THEN {x} END" for x in s.SOFT]


def first_use_frame(t: Tables):
    """Model frame of respondents with a known first use; the number is joined by respondent."""
    data = t.analysis()
    ages = data.select("rid", F.least(*[F.expr(x) for x in REAL_AGES]).alias(FIRST_USE))
    return m.model_frame(data, complete=False).join(ages, "rid").dropna(subset=["y", FIRST_USE])


# Newton steps of intercept and slope over the cells of each outcome; the age is centred to keep the sums tame
AGE_STEPS = [
    "aframe AS (" + " UNION ALL ".join(
        f"SELECT '{h}' AS outcome, (least({', '.join(REAL_AGES)}) - 40) / 20.0::DOUBLE AS v, ANALWT2_C AS w, EVER_{h} AS y FROM analysis "
        f"WHERE EVER_{h} IS NOT NULL" for h in s.HARD) + ")",
    "acells AS (SELECT outcome, v, CAST(sum(w) AS DOUBLE) AS w, CAST(sum(w * y) AS DOUBLE) AS wy FROM aframe WHERE v IS NOT NULL GROUP BY ALL)",
    "newton(step, outcome, v, w, wy, b0, b1, dev, done) AS ("
    "SELECT 0, outcome, v, w, wy, ln(r / (1 - r)), 0.0::DOUBLE, -2 * sum(wy * ln(r) + (w - wy) * ln(1 - r)) OVER (PARTITION BY outcome), false "
    "FROM (SELECT *, sum(wy) OVER (PARTITION BY outcome) / sum(w) OVER (PARTITION BY outcome) AS r FROM acells) "
    "UNION ALL SELECT step + 1, outcome, v, w, wy, n0, n1, dev2, abs(dev2 - dev) <= 1e-11 * (abs(dev2) + 0.1) FROM ("
    "SELECT *, -2 * sum(wy * ln(q) + (w - wy) * ln(1 - q)) OVER (PARTITION BY outcome) AS dev2 FROM ("
    "SELECT *, 1 / (1 + exp(-(n0 + n1 * v))) AS q FROM ("
    "SELECT *, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS n0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS n1 FROM ("
    "SELECT *, sum(w * p * (1 - p)) OVER o AS h00, sum(w * p * (1 - p) * v) OVER o AS h01, sum(w * p * (1 - p) * v * v) OVER o AS h11, "
    "sum(wy - w * p) OVER o AS g0, sum((wy - w * p) * v) OVER o AS g1 FROM ("
    "SELECT *, 1 / (1 + exp(-(b0 + b1 * v))) AS p FROM newton WHERE NOT done AND step < 25) WINDOW o AS (PARTITION BY outcome))))))",
    "afits AS (SELECT outcome, arg_max(b0, step) AS b0, arg_max(b1, step) AS b1 FROM newton GROUP BY outcome)",
]


@query("svy_logistic_number", "WITH RECURSIVE " + survey(
    "SELECT outcome, '(Intercept)' AS term, round(b0 - 2 * b1, 6) AS estimate FROM afits UNION ALL "
    f"SELECT outcome, '{FIRST_USE}', round(b1 / 20, 6) FROM afits", *AGE_STEPS).removeprefix("WITH "))
def _(t: Tables):
    _, fits = m.fit_outcomes(first_use_frame(t), WITH_AGE)
    return rounded(logit.coefficients(fits, BY, WITH_AGE).drop("converged"), "estimate")


@query("svy_logistic_number_score", " UNION ALL ".join(
    f"SELECT '{h}' AS outcome, '{x}' AS term, 0.0::DOUBLE AS score, true AS converged" for h in s.HARD for x in FULL_WITH_AGE.terms))
def _(t: Tables):
    """The full model with the number: at its coefficients every weighted score is zero."""
    frame = first_use_frame(t).dropna(subset=list(s.PREDICTOR_LEVELS))
    cells, fits = m.fit_outcomes(frame, FULL_WITH_AGE)
    fits = materialise(fits)
    scored = logit.predict_prob(cells, F.broadcast(fits), BY, FULL_WITH_AGE)
    sums = scored.groupBy("outcome").agg(*[
        F.expr(f"sum((wy - w * prob) * ({x})) / sum(w)").alias(f"s{i}") for i, x in enumerate(FULL_WITH_AGE.design_sql())])
    long = sums.join(fits.select("outcome", "converged"), "outcome").select("outcome", "converged", F.inline(F.array(*[
        F.struct(F.lit(x).alias("term"), (F.round(F.col(f"s{i}"), 6) + 0.0).alias("score")) for i, x in enumerate(FULL_WITH_AGE.terms)])))
    return long.select("outcome", "term", "score", "converged")


@query("svy_logistic_null", survey(
    f"SELECT outcome, round({LOGIT.format(p='p0')}, 6) AS intercept, "
    "round(-2 * (wy * ln(p0) + (w - wy) * ln(1 - p0)) / w, 6) AS mean_deviance FROM total", FRAME, CELLS, TOTAL))
def _(t: Tables):
    null = logit.svy_logistic_null(design.covariate_cells(smoking_frame(t), BY, SMK), BY)
    return null.select("outcome", F.round("intercept", 6).alias("intercept"),
                       F.round(F.col("null_deviance") / F.col("sum_w"), 6).alias("mean_deviance"))


def unweighted_fit(t: Tables, formula=SMK, frame=None):
    frame = (smoking_frame(t) if frame is None else frame).withColumn("w", F.lit(1))
    return m.fit_outcomes(frame, formula)


@query("logistic_unweighted", survey(
    closed_form("ucells"), FRAME, CELLS, "ucells AS (SELECT outcome, smk, ny / n AS p FROM cells)"))
def _(t: Tables):
    _, fits = unweighted_fit(t)
    return rounded(logit.coefficients(fits, BY, SMK).drop("converged"), "estimate")


@query("loglik_aic", survey(
    "SELECT outcome, CAST(sum(n) AS BIGINT) AS rows, round(sum(ny * ln(ny / n) + (n - ny) * ln(1 - ny / n)), 6) AS loglik, "
    "round(-2 * sum(ny * ln(ny / n) + (n - ny) * ln(1 - ny / n)) + 6, 6) AS aic FROM cells GROUP BY outcome", FRAME, CELLS))
def _(t: Tables):
    _, fits = unweighted_fit(t)
    return rounded(logit.loglik_aic(fits, BY), "loglik", "aic")


LINEARISED = [
    FRAME, CELLS,
    "score AS (SELECT f.outcome, f.stratum, f.psu, l.smk, sum(CASE WHEN f.smk = l.smk THEN f.w * (f.y - p) ELSE 0 END) AS z "
    "FROM frame f JOIN cells l USING (outcome) GROUP BY ALL)",
    "dev AS (SELECT *, z - avg(z) OVER (PARTITION BY outcome, stratum, smk) AS d, "
    "count(*) OVER (PARTITION BY outcome, stratum, smk) AS nh FROM score)",
    "b AS (SELECT x.outcome, x.smk AS i, y.smk AS j, sum(x.nh / (x.nh - 1.0) * x.d * y.d) AS v FROM dev x JOIN dev y "
    "USING (outcome, stratum, psu) GROUP BY ALL)",
    "v AS (SELECT b.outcome, i, j, v / (ci.w * ci.p * (1 - ci.p) * cj.w * cj.p * (1 - cj.p)) AS v FROM b "
    "JOIN cells ci ON ci.outcome = b.outcome AND ci.smk = i JOIN cells cj ON cj.outcome = b.outcome AND cj.smk = j)",
    "se AS (SELECT v.outcome, i, sqrt(v + CASE WHEN i = 0 THEN 0 ELSE v00 - 2 * v0 END) AS se FROM v "
    "JOIN (SELECT outcome, v AS v00 FROM v WHERE i = 0 AND j = 0) USING (outcome) "
    "JOIN (SELECT outcome, j AS i, v AS v0 FROM v WHERE i = 0) x USING (outcome, i) WHERE v.i = v.j)",
]


def linearised(t: Tables, formula=SMK, frame=None):
    return m.fit_with_variance(smoking_frame(t) if frame is None else frame, formula)


# ten PSUs in five strata and three terms leave 3 degrees of freedom, for which Student's t has a closed form
@query("linearised_se", survey(
    "SELECT outcome, term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate / se, 5) AS t, "
    "round(1 - 2 / pi() * (x / (1 + x * x) + atan(x)), 6) AS p_value FROM (SELECT *, abs(estimate) / se / sqrt(3) AS x FROM ("
    + closed_form().replace("round(", "(", 1).replace(", 6) AS estimate", ") AS estimate") + ") JOIN "
    "(SELECT outcome, CASE WHEN i = 0 THEN '(Intercept)' ELSE 'SMK_befor' || i END AS term, se FROM se) USING (outcome, term))",
    *LINEARISED))
def _(t: Tables):
    table = design.coefficient_table(linearised(t), BY, SMK)
    return rounded(table.select("outcome", "term", "estimate", "se", "t", "p_value"), "estimate", "se", "p_value").withColumn(
        "t", F.round("t", 5))


@query("linearised_se_full")
def _(t: Tables):
    return design.coefficient_table(linearised(t, m.FULL, m.model_frame(t.analysis())), BY, m.FULL)


@query("gvif")
def _(t: Tables):
    return design.gvif(linearised(t, m.FULL, m.model_frame(t.analysis())), BY, m.FULL)


@query("gvif_unweighted")
def _(t: Tables):
    _, fits = unweighted_fit(t, m.FULL, m.model_frame(t.analysis()))
    return design.gvif(fits, BY, m.FULL, cov="bread")


TWO = m.formula_of("ALC_befor", "GENDER")
# Newton steps of three coefficients over the four cells of each outcome, by Cramer's rule; a step takes the sums at the old ones
TWO_STEPS = [
    "tcells AS (SELECT outcome, x, g, CAST(count(*) AS DOUBLE) AS w, CAST(sum(y) AS DOUBLE) AS wy FROM (" + " UNION ALL ".join(
        f"SELECT '{h}' AS outcome, ALC_befor_{h} AS x, GENDER - 1 AS g, EVER_{h} AS y FROM analysis "
        f"WHERE EVER_{h} IS NOT NULL AND ALC_befor_{h} IS NOT NULL AND GENDER IS NOT NULL" for h in s.HARD) + ") GROUP BY ALL)",
    "newton(step, outcome, x, g, w, wy, b0, b1, b2, h00, h01, h02, h11, h12, h22) AS ("
    "SELECT 0, outcome, x, g, w, wy, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, "
    "0.0::DOUBLE, 0.0::DOUBLE FROM tcells UNION ALL "
    "SELECT step + 1, outcome, x, g, w, wy, "
    "b0 + (s0 * (k11 * k22 - k12 * k12) - s1 * (k01 * k22 - k12 * k02) + s2 * (k01 * k12 - k11 * k02)) / det, "
    "b1 + (-s0 * (k01 * k22 - k02 * k12) + s1 * (k00 * k22 - k02 * k02) - s2 * (k00 * k12 - k01 * k02)) / det, "
    "b2 + (s0 * (k01 * k12 - k02 * k11) - s1 * (k00 * k12 - k02 * k01) + s2 * (k00 * k11 - k01 * k01)) / det, "
    "k00, k01, k02, k11, k12, k22 FROM (SELECT *, k00 * (k11 * k22 - k12 * k12) - k01 * (k01 * k22 - k12 * k02) + k02 * (k01 * k12 - k11 * k02) AS det FROM ("
    "SELECT *, sum(v) OVER o AS k00, sum(v * x) OVER o AS k01, sum(v * g) OVER o AS k02, sum(v * x) OVER o AS k11, sum(v * x * g) OVER o AS k12, "
    "sum(v * g) OVER o AS k22, sum(wy - w * p) OVER o AS s0, sum((wy - w * p) * x) OVER o AS s1, sum((wy - w * p) * g) OVER o AS s2 FROM ("
    "SELECT *, w * p * (1 - p) AS v FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x + b2 * g))) AS p FROM newton WHERE step < 12)) "
    "WINDOW o AS (PARTITION BY outcome))))",
    "tfits AS (SELECT DISTINCT outcome, h00 * h11 - h01 * h01 AS c22, h00 * h22 - h02 * h02 AS c11, -(h00 * h12 - h01 * h02) AS c12 "
    "FROM newton WHERE step = 12)",
]


@query("gvif_two_factors", "WITH RECURSIVE " + survey(
    "SELECT outcome, variable, CAST(1 AS INTEGER) AS df, round(1 / (1 - c12 * c12 / (c11 * c22)), 6) AS gvif, "
    "round(sqrt(1 / (1 - c12 * c12 / (c11 * c22))), 6) AS gvif_scaled FROM tfits, (SELECT unnest(['ALC_befor', 'GENDER']) AS variable)",
    *TWO_STEPS).removeprefix("WITH "))
def _(t: Tables):
    """Variance inflation in a model small enough for SQL to state its Newton steps."""
    frame = m.model_frame(t.analysis(), complete=False).dropna(subset=["y", *TWO.variables])
    _, fits = unweighted_fit(t, TWO, frame)
    return rounded(design.gvif(fits, BY, TWO, cov="bread"), "gvif", "gvif_scaled")


# --- scoring ------------------------------------------------------------------------------

@query("score_join", survey(
    "SELECT outcome, smk AS SMK_befor, n, round(p, 6) AS prob FROM cells", FRAME, CELLS))
def _(t: Tables):
    _, cells, fits = smoking_fit(t)
    scored = logit.predict_prob(F.broadcast(cells), fits, BY, SMK)
    return scored.select("outcome", "SMK_befor", "n", F.round("prob", 6).alias("prob"))


def scored_rows(t: Tables):
    frame, cells, fits = smoking_fit(t)
    # one fit and one cutoff per outcome
    return cells, logit.predict_prob(frame, F.broadcast(fits), BY, SMK)


@query("predict_prob", survey(
    "SELECT rid, outcome, round(p, 6) AS prob FROM frame JOIN cells USING (outcome, smk)", FRAME, CELLS))
def _(t: Tables):
    _, scored = scored_rows(t)
    return scored.select("rid", "outcome", F.round("prob", 6).alias("prob"))


@query("predict_class", survey(
    "SELECT rid, outcome, CAST(p >= p0 AS INTEGER) AS predicted FROM frame JOIN cells USING (outcome, smk) "
    "JOIN total USING (outcome)", FRAME, CELLS, TOTAL))
def _(t: Tables):
    cells, scored = scored_rows(t)
    cutoffs = cells.groupBy("outcome").agg((F.sum("wy") / F.sum("w")).alias("cutoff"))
    return logit.predict_class(scored, F.broadcast(cutoffs), BY).select("rid", "outcome", "predicted")


TABLE = ("ct AS (SELECT outcome, CAST(p >= p0 AS INTEGER) AS predicted, sum(cells.wy) AS one, sum(cells.w - cells.wy) AS zero "
         "FROM cells JOIN total USING (outcome) GROUP BY ALL)")
RATES = ("rates AS (SELECT outcome, tp / (tp + fn) AS Recall, tp / (tp + fp) AS Precision, (tp + tn) / (tp + tn + fp + fn) AS Accuracy "
         "FROM (SELECT outcome, sum(one) FILTER (predicted = 1) AS tp, sum(zero) FILTER (predicted = 1) AS fp, "
         "sum(one) FILTER (predicted = 0) AS fn, sum(zero) FILTER (predicted = 0) AS tn FROM ct GROUP BY outcome))")


def scored_cells(t: Tables):
    _, cells, fits = smoking_fit(t)
    cutoffs = cells.groupBy("outcome").agg((F.sum("wy") / F.sum("w")).alias("cutoff"))
    return logit.predict_class(logit.predict_prob(F.broadcast(cells), fits, BY, SMK), F.broadcast(cutoffs), BY)


@query("contingency_weighted", survey(
    "SELECT outcome, predicted, 1 AS observed, CAST(one AS BIGINT) AS weight FROM ct UNION ALL "
    "SELECT outcome, predicted, 0, CAST(zero AS BIGINT) FROM ct", FRAME, CELLS, TOTAL, TABLE))
def _(t: Tables):
    return metrics.contingency_weighted(scored_cells(t), BY)


@query("recall_precision_f1", survey(
    "SELECT outcome, Recall, Precision, 2 * Precision * Recall / (Precision + Recall) AS F1_Score FROM rates",
    FRAME, CELLS, TOTAL, TABLE, RATES))
def _(t: Tables):
    rates = metrics.confusion(metrics.contingency_weighted(scored_cells(t), BY), BY)
    return rates.select("outcome", "Recall", "Precision", "F1_Score")


@query("accuracy_weighted", survey("SELECT outcome, Accuracy FROM rates", FRAME, CELLS, TOTAL, TABLE, RATES))
def _(t: Tables):
    return metrics.confusion(metrics.contingency_weighted(scored_cells(t), BY), BY).select("outcome", "Accuracy")


@query("weighted_auc", survey(
    "SELECT a.outcome, round(sum(a.wy * (b.w - b.wy) * CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / "
    "(any_value(t.wy) * (any_value(t.w) - any_value(t.wy))), 9) AS AUC FROM cells a JOIN cells b USING (outcome) "
    "JOIN total t USING (outcome) GROUP BY a.outcome", FRAME, CELLS, TOTAL))
def _(t: Tables):
    return rounded(metrics.weighted_auc(scored_cells(t), BY, "prob", slices=1), "AUC", digits=9)


@query("weighted_auc_rows", survey(
    "SELECT round(sum(a.w1 * (b.below0 + a.w0 / 2)) / (sum(a.w1) * sum(a.w0)), 9) AS AUC FROM "
    "(SELECT TOTINC * 1000 - ALC AS p, CAST(sum(ANALWT2_C * EVER_COC) AS DOUBLE) AS w1, "
    "CAST(sum(ANALWT2_C * (1 - EVER_COC)) AS DOUBLE) AS w0 FROM analysis GROUP BY p) a JOIN "
    "(SELECT p, coalesce(sum(w0) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below0 FROM "
    "(SELECT TOTINC * 1000 - ALC AS p, CAST(sum(ANALWT2_C * (1 - EVER_COC)) AS DOUBLE) AS w0 FROM analysis GROUP BY p)) b USING (p)"))
def _(t: Tables):
    """AUC of a score over whole rows, cut into slices of the score."""
    scored = t.analysis().select(
        F.expr("TOTINC * 1000 - ALC").alias("score"), F.col(s.WEIGHT).alias("w"),
        (F.col(s.WEIGHT) * F.col("EVER_COC")).alias("wy"))
    return rounded(metrics.weighted_auc(scored, [], "score", slices=4), "AUC", digits=9)


DEVIANCES = ("devs AS (SELECT outcome, -2 * sum(cells.wy * ln(p) + (cells.w - cells.wy) * ln(1 - p)) AS d1, "
             "any_value(-2 * (total.wy * ln(p0) + (total.w - total.wy) * ln(1 - p0))) AS d0, any_value(total.w) AS whole "
             "FROM cells JOIN total USING (outcome) GROUP BY outcome)")
NAGELKERKE = "round((1 - exp((d1 - d0) / whole)) / (1 - exp(-d0 / whole)), 6)"


@query("nagelkerke_train", survey(f"SELECT outcome, {NAGELKERKE} AS R_boot FROM devs", FRAME, CELLS, TOTAL, DEVIANCES))
def _(t: Tables):
    _, _, fits = smoking_fit(t)
    return rounded(metrics.nagelkerke_train(fits, BY), "R_boot")


# a model fitted on the first PSU of every stratum, applied to all rows
TRAIN = [
    FRAME, CELLS, TOTAL,
    "train AS (SELECT outcome, smk, count(*) AS n, CAST(sum(w * y) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS p FROM frame "
    "WHERE psu = 1 GROUP BY ALL)",
    "sizes AS (SELECT outcome, sum(n) AS fit_rows FROM train GROUP BY outcome)",
    "devs AS (SELECT outcome, -2 * sum(cells.wy * ln(train.p) + (cells.w - cells.wy) * ln(1 - train.p)) AS d1, "
    "any_value(-2 * (total.wy * ln(p0) + (total.w - total.wy) * ln(1 - p0))) AS d0, any_value(total.w) AS whole, "
    "any_value(total.n) AS n FROM cells JOIN total USING (outcome) JOIN train USING (outcome, smk) GROUP BY outcome)",
]


def holdout(t: Tables, compat: bool):
    frame = smoking_frame(t)
    _, fits = m.fit_outcomes(frame.filter("psu = 1"), SMK)
    scored = logit.predict_prob(F.broadcast(design.covariate_cells(frame, BY, SMK)), fits, BY, SMK)
    return rounded(metrics.nagelkerke_holdout(scored, BY, "prob", fits if compat else None), "R_NK")


@query("nagelkerke_holdout", survey(f"SELECT outcome, {NAGELKERKE} AS R_NK FROM devs", *TRAIN))
def _(t: Tables):
    return holdout(t, False)


@query("nagelkerke_holdout_compat", survey(
    f"SELECT outcome, {NAGELKERKE.replace('d0', '(d0 * n / fit_rows)')} AS R_NK FROM devs JOIN sizes USING (outcome)", *TRAIN))
def _(t: Tables):
    return holdout(t, True)


# --- replicate records: fits on ten groups of respondents ---------------------------------

KEYS = ["outcome", "replicate"]
GENDER = m.formula_of("GENDER")


def group_fits(t: Tables):
    frame = m.model_frame(t.analysis(), complete=False).filter("y is not null")
    keyed = frame.withColumn("replicate", F.expr("cast(rid % 10 as int)"))
    cells, fits = m.fit_outcomes(keyed, GENDER, KEYS)
    return design.covariate_cells(frame, BY, GENDER), fits


def coef_records(t: Tables, fits=None):
    fits = group_fits(t)[1] if fits is None else fits
    return logit.coefficients(fits, KEYS, GENDER).filter("estimate is not null").select(
        *KEYS, "term", F.col("estimate").alias("value"), "converged")


def digits(name: str, places: int = 4):
    """Significant digits: a separated fit has estimates of any size, exact to a few digits only."""
    return F.format_string(f"%.{places - 1}e", name).cast("double").alias(name)


def digits_sql(expression: str, name: str, places: int = 4) -> str:
    return f"CAST(printf('%.{places - 1}e', {expression}) AS DOUBLE) AS {name}"


# the model of one factor is saturated, so a Newton step moves each cell by itself; the fit ends by the deviance of all
# log of the probability of a 0, or with a minus sign of a 1, kept exact far from zero
LOG_P = "CASE WHEN {s}{e} < -15 THEN -exp({s}{e}) * (1 - exp({s}{e}) / 2) ELSE -ln(1 + exp({s}{e})) END"
RECORDS = [
    "gframe AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT '{h}' AS outcome, CAST(rid % 10 AS INTEGER) AS replicate, GENDER, ANALWT2_C AS w, EVER_{h} AS y FROM analysis"
        for h in s.HARD) + ")",
    "start AS (SELECT *, sum(wy) OVER g / sum(w) OVER g AS r FROM (SELECT outcome, replicate, GENDER, CAST(sum(w) AS DOUBLE) AS w, "
    "CAST(sum(w * y) AS DOUBLE) AS wy FROM gframe GROUP BY ALL) WINDOW g AS (PARTITION BY outcome, replicate))",
    "newton(step, outcome, replicate, GENDER, w, wy, eta, dev, done) AS ("
    "SELECT 0, outcome, replicate, GENDER, w, wy, CASE WHEN r > 0 AND r < 1 THEN ln(r / (1 - r)) ELSE 0.0 END, "
    "CASE WHEN r > 0 AND r < 1 THEN -2 * sum(wy * ln(r) + (w - wy) * ln(1 - r)) OVER (PARTITION BY outcome, replicate) ELSE 0.0 END, false FROM start "
    "UNION ALL SELECT step + 1, outcome, replicate, GENDER, w, wy, e, dev2, abs(dev2 - dev) <= 1e-11 * (abs(dev2) + 0.1) FROM ("
    "SELECT *, -2 * sum(CASE WHEN wy > 0 THEN wy * (" + LOG_P.format(s="-", e="e") + ") ELSE 0 END + CASE WHEN w - wy > 0 THEN (w - wy) * ("
    + LOG_P.format(s="", e="e") + ") ELSE 0 END) OVER (PARTITION BY outcome, replicate) AS dev2 FROM ("
    "SELECT *, eta + (wy / w - 1 / (1 + exp(-eta))) * (1 + exp(-eta)) * (1 + exp(eta)) AS e FROM newton WHERE NOT done AND step < 25)))",
    "gcells AS MATERIALIZED (SELECT outcome, replicate, GENDER, arg_max(eta, step) AS eta, 1 / (1 + exp(-arg_max(eta, step))) AS p, "
    "arg_max(done, step) AS done, arg_max(dev, step) AS d1, arg_min(dev, step) AS d0, any_value(w) AS w FROM newton GROUP BY ALL)",
    "gfits AS MATERIALIZED (SELECT outcome, replicate, bool_and(done AND p > 1e-8 AND p < 1 - 1e-8) AS converged, "
    "any_value(d1) AS d1, any_value(d0) AS d0, sum(w) AS whole FROM gcells GROUP BY ALL)",
    "records AS MATERIALIZED (SELECT a.outcome, a.replicate, '(Intercept)' AS term, a.eta AS value, converged FROM gcells a "
    "JOIN gfits USING (outcome, replicate) WHERE GENDER = 1 "
    "UNION ALL SELECT a.outcome, a.replicate, 'GENDER2', a.eta - b.eta, converged FROM gcells a "
    "JOIN gcells b USING (outcome, replicate) JOIN gfits USING (outcome, replicate) WHERE a.GENDER = 2 AND b.GENDER = 1)",
]
COUNTED = "count(value) AS n_replicates, count(*) FILTER (NOT converged) AS n_not_converged"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("mean_sd_by_term", recursive(survey(
    f"SELECT outcome, term, {digits_sql('avg(exp(value))', 'mean')}, {digits_sql('stddev_samp(exp(value))', 'sd')}, {COUNTED} "
    "FROM records GROUP BY ALL", *RECORDS)))
def _(t: Tables):
    table = describe.mean_sd_by_term(coef_records(t), exponentiate=True)
    return table.select("outcome", "term", digits("mean"), digits("sd"), "n_replicates", "n_not_converged")


@query("exp_transform", recursive(survey(
    f"SELECT outcome, replicate, term, {digits_sql('exp(value)', 'odds_ratio')}, converged FROM records", *RECORDS)))
def _(t: Tables):
    odds = coef_records(t).withColumn("odds_ratio", F.exp("value"))
    return odds.select(*KEYS, "term", digits("odds_ratio"), "converged")


P_VALUE = "2.0 * least(count(*) FILTER (value > 0), count(*) FILTER (value < 0)) / count(value)"


@query("bootstrap_p_value", recursive(survey(
    f"SELECT outcome, term, round(CAST({P_VALUE} AS DOUBLE), 6) AS p_val FROM records GROUP BY ALL", *RECORDS)))
def _(t: Tables):
    return rounded(describe.bootstrap_p_value(coef_records(t)), "p_val")


@query("replicate_coef_table", recursive(survey(
    f"SELECT outcome, term, {digits_sql('round(avg(exp(value)), 3)', 'odds_ratio')}, {digits_sql('round(stddev_samp(exp(value)), 3)', 'se')}, "
    f"round(CAST({P_VALUE} AS DOUBLE), 4) AS p_val, {COUNTED} FROM records GROUP BY ALL", *RECORDS)))
def _(t: Tables):
    table = m.replicate_coef_table(coef_records(t))
    return table.select("outcome", "term", digits("odds_ratio"), digits("se"), "p_val", "n_replicates", "n_not_converged")


# a fit of one binary factor scored on all rows: recall, precision and F1 in closed form
SCORED = [
    *RECORDS,
    "whole AS (SELECT outcome, GENDER, CAST(sum(w) AS DOUBLE) AS w, CAST(sum(w * y) AS DOUBLE) AS wy FROM gframe GROUP BY ALL)",
    "cut AS (SELECT outcome, sum(wy) / sum(w) AS p0, sum(wy) AS wy1, sum(w) - sum(wy) AS w0 FROM whole GROUP BY outcome)",
    "marked AS (SELECT outcome, replicate, GENDER, gcells.p, gcells.eta, whole.w, whole.wy, p0, wy1, w0, gcells.p >= p0 AS hit "
    "FROM gcells JOIN whole USING (outcome, GENDER) JOIN cut USING (outcome))",
    "per_rep AS (SELECT outcome, replicate, CASE WHEN bool_and(hit) OR NOT bool_or(hit) THEN 0.0 ELSE sum(wy) FILTER (hit) / any_value(wy1) END AS Recall, "
    "CASE WHEN bool_and(hit) OR NOT bool_or(hit) THEN 0.0 ELSE sum(wy) FILTER (hit) / sum(w) FILTER (hit) END AS Precision, "
    "0.5 + 0.5 * sum(CASE WHEN GENDER = 1 THEN sign(p - q) ELSE 0 END * (wy * (v - vy) - vy * (w - wy))) / any_value(wy1 * w0) AS AUC, "
    "-2 * sum(wy * (" + LOG_P.format(s="-", e="eta") + ") + (w - wy) * (" + LOG_P.format(s="", e="eta") + ")) AS d1, "
    "any_value(-2 * (wy1 * ln(p0) + w0 * ln(1 - p0))) AS d0, sum(w) AS whole "
    "FROM marked JOIN (SELECT outcome, replicate, 3 - GENDER AS GENDER, p AS q, w AS v, wy AS vy FROM marked) USING (outcome, replicate, GENDER) GROUP BY ALL)",
    "mrec AS MATERIALIZED (SELECT outcome, replicate, term, value, converged FROM ("
    "SELECT outcome, replicate, 'Recall' AS term, Recall AS value FROM per_rep UNION ALL "
    "SELECT outcome, replicate, 'Precision', Precision FROM per_rep UNION ALL "
    "SELECT outcome, replicate, 'F1_Score', CASE WHEN Recall > 0 THEN 2 * Recall * Precision / (Recall + Precision) END FROM per_rep UNION ALL "
    "SELECT outcome, replicate, 'AUC', AUC FROM per_rep UNION ALL "
    "SELECT outcome, replicate, 'R_NK', (1 - exp((d1 - d0) / whole)) / (1 - exp(-d0 / whole)) FROM per_rep UNION ALL "
    "SELECT outcome, replicate, 'R_boot', CASE WHEN d0 > 0 THEN (1 - exp((d1 - d0) / whole)) / (1 - exp(-d0 / whole)) END FROM gfits) "
    "JOIN (SELECT outcome, replicate, converged FROM gfits) USING (outcome, replicate) WHERE value IS NOT NULL)",
]


def metric_rows(t: Tables, names=s.METRIC_TERMS):
    cells, fits = group_fits(t)
    wide = m.fit_metrics(cells, fits, GENDER, KEYS, BY)
    return m.metric_records(wide, KEYS, names)


@query("replicate_fit_table", recursive(survey(
    "SELECT outcome, CASE term WHEN 'F1_Score' THEN 'F1 score' WHEN 'R_NK' THEN 'R_{NK}' ELSE term END AS metric, "
    f"{digits_sql('round(avg(value), 4)', 'mean')}, {digits_sql('round(stddev_samp(value), 4)', 'sd')}, {COUNTED} "
    "FROM mrec WHERE term <> 'R_boot' GROUP BY ALL", *SCORED)))
def _(t: Tables):
    table = m.replicate_fit_table(metric_rows(t))
    return table.select("outcome", "metric", digits("mean"), digits("sd"), "n_replicates", "n_not_converged")


def stored_records(t: Tables):
    """Metrics and coefficients written as one folder per outcome, and read again."""
    cells, fits = group_fits(t)
    path = scratch_path(t.spark, "replicates")
    wide = m.fit_metrics(cells, fits, GENDER, KEYS, BY)
    replicates.write_replicate_results(m.metric_records(wide, KEYS, s.METRIC_TERMS), coef_records(t, fits), path)
    back = replicates.scan_replicates(t.spark, path)
    return back.select(*KEYS, "kind", "term", digits("value", 3), "converged")


BOTH = (f"SELECT outcome, replicate, 'coefs' AS kind, term, {digits_sql('value', 'value', 3)}, converged FROM records UNION ALL "
        f"SELECT outcome, replicate, 'metrics', term, {digits_sql('value', 'value', 3)}, converged FROM mrec")


@query("write_replicate_results", recursive(survey(
    f"SELECT outcome, kind, term, converged, count(*) AS n FROM ({BOTH}) GROUP BY ALL", *SCORED)))
def _(t: Tables):
    return stored_records(t).groupBy("outcome", "kind", "term", "converged").agg(F.count("*").alias("n"))


@query("scan_replicates", recursive(survey(BOTH, *SCORED)))
def _(t: Tables):
    return stored_records(t)
