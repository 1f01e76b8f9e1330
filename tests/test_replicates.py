"""The replicate drivers: nothing is drawn twice for a fit, and a run that is taken up again prepares nothing twice."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens import schema
from stratalens.catalog import resampling as catalog
from stratalens.catalog.base import QUERIES
from stratalens.functions import digests
from stratalens.operators import logit, resample
from stratalens.operators.design import covariate_cells, merge_cells
from stratalens.operators.logit import Formula
from stratalens.plans import resampling
from stratalens.plans.modelling import FULL
from stratalens.runtime import scratch_path

FORMULA = Formula({"GENDER": [1, 2]})


def survey_frame(spark, n=160, seed=5):
    rng = random.Random(seed)
    names = [c for c in resampling.CATEGORIES if c not in ("psu", "GENDER")]
    rows = [("COC", i % 2, 1 + i // 2 % 2, i, rng.randrange(100, 999), int(rng.random() < 0.4), rng.choice([1, 2]),
             *[rng.choice([0, 1]) for _ in names]) for i in range(n)]
    schema = "outcome string, stratum int, psu int, rid long, w long, y int, GENDER int, " + ", ".join(f"{c} int" for c in names)
    return spark.createDataFrame(rows, schema)


def test_cells_are_kept_before_they_are_fitted(spark, monkeypatch):
    """The checks of the fit moved below the draws and took their digests once per predictor and level."""
    plans, fit = [], logit.svy_logistic

    def seen(cells, *rest):
        plans.append(cells._jdf.queryExecution().optimizedPlan().toString())
        return fit(cells, *rest)

    monkeypatch.setattr(logit, "svy_logistic", seen)
    frame = survey_frame(spark)
    resampling.replicate_fits(frame, 2, 1, FORMULA)
    resampling.replicate_run(frame, scratch_path(spark, "kept"), 2, 1, FORMULA)
    assert len(plans) == 2 and not any("md5" in p or "Generate" in p for p in plans)


def records(df):
    return sorted((r.outcome, r.replicate, r.kind, r.term, round(r.value, 9), r.converged) for r in df.collect())


def test_a_run_taken_up_again_is_not_prepared_again(spark, monkeypatch):
    made, clean = [], resampling.cleaned_frame

    def seen(frame, *rest):
        made.append(1)
        return clean(frame, *rest)

    monkeypatch.setattr(resampling, "cleaned_frame", seen)
    frame, path = survey_frame(spark), scratch_path(spark, "again")
    want = records(resampling.replicate_run(frame, scratch_path(spark, "whole"), 2, 3, FORMULA))
    made.clear()
    resampling.replicate_run(frame, path, 1, 3, FORMULA)
    assert records(resampling.replicate_run(frame.repartition(3), path, 2, 3, FORMULA)) == want and len(made) == 1
    # other rows are prepared anew
    other = frame.unionByName(frame.withColumn("outcome", F.lit("HER")))
    got = resampling.replicate_run(other, path, 2, 3, FORMULA)
    assert len(made) == 2 and {r.outcome for r in got.select("outcome").distinct().collect()} == {"COC", "HER"}


def whole_frame(spark, n=90, seed=2):
    """Rows of one outcome with every level of every predictor."""
    rng = random.Random(seed)
    levels = schema.PREDICTOR_LEVELS
    rows = [("COC", i % 2, 1 + i // 2 % 2, i, rng.randrange(100, 999), int(rng.random() < 0.4), *[v[(i // 3 + j) % len(v)] if i < 30 else rng.choice(v)
             for j, v in enumerate(levels.values())]) for i in range(n)]
    return spark.createDataFrame(rows, "outcome string, stratum int, psu int, rid long, w long, y int, " + ", ".join(f"{c} int" for c in levels))


def test_the_registered_driver_makes_every_replicate(spark, monkeypatch):
    """It stopped after 20 of the 1000 replicates."""
    frame = whole_frame(spark)
    monkeypatch.setattr(catalog, "resampling_frame", lambda t, complete: frame)
    got = QUERIES["replicate_driver"](spark, "unused").groupBy("replicate").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms")).collect()
    assert sorted(r.replicate for r in got) == list(range(1, 1001))
    assert all(r.n == r.terms >= len(FULL.terms) + 4 for r in got)  # F1 and the like may be undefined


def odd_parents(spark, ids="bigint"):
    """Two outcomes, a group of one row, missing categories and weights, a repeated id, negative ids and ids of many lengths."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        pick = lambda: None if rng.random() < 0.1 else rng.randrange(2)
        mates = [(k, i, None if rng.random() < 0.1 else rng.randrange(900), pick(), pick(), pick()) for k in range(1 + i % 5)]
        rows.append(("é" if i % 3 else "COC", i % 2, (-1) ** i * i ** (1 + i % 3) if i % 50 else 7, None if i % 17 == 0 else i, pick(), pick(), pick(), mates))
    rows.append(("COC", 5, 1, 1, 0, 0, 0, [(0, 1, 1, 0, 0, 0)]))
    df = spark.createDataFrame(rows, "outcome string, stratum int, rid bigint, w bigint, a int, b int, c int, "
                               "partners array<struct<slot int, nn bigint, nn_number bigint, nn_a int, nn_b int, nn_c int>>")
    need = df.groupBy("outcome", "stratum").agg(F.floor(F.count("*") / 2).cast("int").alias("need"))
    return df.join(need, ["outcome", "stratum"]).withColumn("rid", F.col("rid").cast(ids)).repartition(3)


def rounded(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_cells_drawn_in_tasks_are_those_of_the_drawn_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "MOST_SUMS", 50)
    group, cats = ["outcome", "stratum"], ["a", "b", "c"]
    formula, keys = Formula({"c": [0, 1], "a": [0, 1]}), ["outcome", "replicate", "c", "a"]
    parents = odd_parents(spark)
    assert resample.sums_in_tasks(parents, group, cats, "rid", formula)
    drawn = resample.smote(parents, group, cats, "w", "rid", 12, 3, 8)
    want = covariate_cells(drawn, ["outcome", "replicate"], formula).selectExpr(*keys, "n", "w", "wy")
    for conf in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", conf)
        try:
            got = merge_cells(resample.smote_cells(parents, group, cats, "w", "rid", 12, 3, formula, 8), ["outcome", "replicate"], formula)
            assert rounded(got.selectExpr(*keys, "n", "w", "wy")) == rounded(want)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception, match="unknown level of a: 1"):
        resample.smote_cells(parents, group, cats, "w", "rid", 2, 3, Formula({"a": [0]})).collect()
    assert not resample.sums_in_tasks(odd_parents(spark, "string"), group, cats, "rid", formula)


@pytest.mark.parametrize("band", [0.01, 3.0])
def test_cuts_are_found_in_any_band(spark, monkeypatch, band):
    monkeypatch.setattr(resample, "BAND", band)
    group = ["outcome", "stratum"]
    parents = odd_parents(spark)
    want = resample._cuts_by_digits(parents, group, "rid", 95, 105, 3)
    assert rounded(resample.replicate_cuts(parents, group, "rid", 95, 105, 3).select(*want.columns)) == rounded(want)
    none = parents.withColumn("need", F.lit(1000))  # more than there are: nothing is taken, as before
    assert resample.replicate_cuts(none, group, "rid", 1, 2, 3).isEmpty() and resample._cuts_by_digits(none, group, "rid", 1, 2, 3).isEmpty()


def test_digests_of_texts_of_any_length():
    for head, ids in (("7|COC", ["10", "99", "31"]), ("x" * 40, ["-5"]), ("é" * 30, [f"{i:019d}" for i in range(5)])):
        tails = np.frombuffer("".join(ids).encode(), np.uint8).reshape(len(ids), -1)
        seen = set()
        for which, part, words in digests.replicate_digests(head, np.array([1, 9, 10, 1000]), tails):
            for i, r in enumerate(which):
                for j, tail in enumerate(ids[part]):
                    seen.add((r, tail))
                    number = (1, 9, 10, 1000)[r]
                    assert "".join(f"{int(w[i, j]):08x}" for w in words) == hashlib.md5(f"{head}|{number}|{tail}".encode()).hexdigest()
        assert len(seen) == 4 * len(ids)
