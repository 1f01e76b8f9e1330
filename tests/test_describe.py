import pytest
from pyspark.sql import functions as F

from stratalens.operators import describe, guttman, html, impute, reshape
from stratalens.plans import resampling
from stratalens.runtime import broadcast_if_small, fits_broadcast, scratch_path, shared_dir
from stratalens.sources import replicates

PAGE = """<html><!-- <table><tr><td>no</td></tr></table> --><table><tr><th>x</table>
<TABLE class="t"><tr><th>Year<th colspan=2>Deaths</tr>
<tr><th>Year</th><th>Number</th><th>Rate &amp; CI</th></tr>
<tr><td> 2001 </td><td>5</td><td><b>1.5</b></td></tr><tr><td>2002</td><td>x</td></tr></TABLE></html>"""


def test_html_grid(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "no tables")], "page_id int, html string")
    tables = html.html_tables(pages)
    grids = {r["table_no"]: r["grid"] for r in tables.collect()}
    assert grids[1] == [["x"]]
    assert grids[2] == [["Year", "Deaths", "Deaths"], ["Year", "Number", "Rate & CI"], ["2001", "5", "1.5"], ["2002", "x", None]]
    kept = html.header_column_filter(html.nth_table(tables, 2), ["Year", "Rate"]).collect()
    assert [(r["Year"], r["Rate"]) for r in kept] == [("2001", "1.5"), ("2002", None)]


def test_weighted_equals_unweighted_for_unit_weights(spark):
    df = spark.createDataFrame([(1, 0, 1), (0, 0, 1), (1, 1, 1)], "a int, b int, w int")
    weighted = describe.weighted_rate(df, ["a", "b"], "w").collect()
    plain = describe.unweighted_rate(df, ["a", "b"], scale=1.0).collect()
    assert {r[0]: r[1] for r in weighted} == {r[0]: r[1] for r in plain}


@pytest.mark.parametrize("slices", [None, 3])
def test_weighted_quantiles(spark, slices):
    rows = [("x", v, 1) for v in range(1, 9)] + [("x", 100, 1), ("y", 5, 3)]
    df = spark.createDataFrame(rows, "item string, v int, w int")
    got = {r["item"]: r for r in describe.weighted_quantiles(df, "item", "v", "w", slices).collect()}
    assert tuple(got["x"])[1:] == (3, 5, 7, 1, 8, 1)
    assert tuple(got["y"])[1:] == (5, 5, 5, 5, 5, 0)


def test_density_integrates_to_one(spark):
    df = spark.range(400).selectExpr("'a' as item", "cast(20 + id % 37 as int) as v", "1 + id % 3 as w")
    rows = describe.weighted_density(df, "item", "v", "w", 200).orderBy("slot").collect()
    step = rows[1]["at"] - rows[0]["at"]
    assert 0.85 < sum(r["density"] for r in rows) * step < 1.0  # the tails beyond the extremes are cut


def test_guttman_small(spark):
    rows = [(10, 12, 15, 20), (10, 10, 10, 991), (12, 10, 15, 20), (991, 991, 991, 991), (14, 15, 16, 17), (20, 19, 18, 17)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "a int, b int, c int, d int, e int")
    r = guttman.guttman_scales(df, {"s": ["a", "b", "c", "d"]}, {"s": ["e"]}).first()
    assert (r["rows"], r["errors"], r["CR"]) == (6, 2, pytest.approx(1 - 2 / 24))
    # column maxima 2+2+2+2 = 8 -> 16 possible errors; row maxima 1+3+1+4+1+1 = 11 -> 13
    assert r["CS"] == pytest.approx(1 - 2 / 13)
    classical = guttman.guttman_scales(df, {"s": ["a", "b", "c", "d"]}, {"s": ["e"]}, classical=True).first()
    assert classical["errors"] == 4


def test_unpivot_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, 2)], "id int, a int, b int")
    assert reshape.unpivot_keep_ids(df, ["id"], ["a", "b"]).count() == 2


def test_missing_report_order(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 2, 1), (3, 4, 1)], "a int, b int, c int")
    assert [tuple(r) for r in describe.missing_report(df, ["a", "b", "c"]).collect()] == [("a", 2, "0.67"), ("b", 1, "0.33")]


def test_rf_impute_learns_and_keeps_observed(spark):
    df = spark.range(400).selectExpr(
        "id as rid", "cast(id % 3 as int) as g", "cast(id % 7 as double) as z",
        "if(id % 5 = 0, null, cast(id % 3 as int)) as f", "if(id % 11 = 0, null, 10D * (id % 3)) as n")
    levels = {"g": [0, 1, 2], "z": None, "f": [0, 1, 2], "n": None}
    out = impute.rf_impute(df, levels, ["f", "n"], "rid", trees=15, max_rounds=2)
    both = out.join(df.select("rid", F.col("f").alias("f0"), F.col("n").alias("n0")), "rid")
    assert out.count() == 400 and out.filter("f is null or n is null").count() == 0
    assert both.filter("f0 is not null and f <> f0 or n0 is not null and n <> n0").count() == 0
    assert both.filter("f0 is null and f <> g").count() <= 4
    assert both.filter("n0 is null and abs(n - 10 * g) > 3").count() <= 4


def test_replicate_records_round_trip(spark):
    df = spark.createDataFrame([("COC", 1, "AUC", 0.5, True), ("HER", 2, "AUC", None, False)],
                               "outcome string, replicate int, term string, value double, converged boolean")
    path = scratch_path(spark, "records")
    replicates.write_replicate_results(df, df.withColumns({"term": F.lit("GENDER2"), "value": F.lit(2.0)}), path)
    back = {(r.outcome, r.kind): (r.term, r.value, r.converged) for r in replicates.scan_replicates(spark, path).collect()}
    assert back == {("COC", "metrics"): ("AUC", 0.5, True), ("COC", "coefs"): ("GENDER2", 2.0, True),
                    ("HER", "coefs"): ("GENDER2", 2.0, False)}
    assert {(r.outcome, r.replicate) for r in replicates.finished_fits(spark, path).collect()} == {("COC", 1), ("HER", 2)}
    assert replicates.finished_fits(spark, path + "-none").count() == 0


def test_runtime(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert fits_broadcast(spark.range(10), 10) and not fits_broadcast(spark.range(11), 10)
    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) as t", "array_repeat(1D, 100) as a", "map('k', 'v') as m")
    assert fits_broadcast(wide, 10, 50_000) and not fits_broadcast(wide, 10, 20_000)
    small = spark.range(3).join(broadcast_if_small(spark.range(5), 10), "id")
    assert small.count() == 3


def survey_frame(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(400):
        alc, vap, smk, mrj = rng.randrange(2), rng.randrange(2), rng.randrange(3), rng.randrange(2)
        y = int(rng.random() < 0.2 + 0.15 * mrj + 0.1 * smk)
        rows.append(("COC", i % 2, 1 + i % 3, i, rng.randrange(100, 900), y, alc, vap, smk, mrj,
                     rng.choice([1, 2]), rng.choice([1, 2, 3, 4]), rng.choice([1, 2, 3, 4])))
    df = spark.createDataFrame(rows, "outcome string, stratum int, psu int, rid long, w long, y int, ALC_befor int, "
                                     "VAP_befor int, SMK_befor int, MRJ_befor int, GENDER int, ETHNIC int, RLGINF int")
    return df


def test_replicate_driver(spark):
    df = survey_frame(spark)
    metric_rows, coef_rows = resampling.replicate_driver(df, 3, 1)
    m, c = metric_rows.collect(), coef_rows.collect()
    assert len(m) == 3 * 6 and len(c) == 3 * 13
    auc = [r["value"] for r in m if r["term"] == "AUC"]
    assert all(0.5 < x < 0.9 for x in auc)


@pytest.mark.parametrize("slices", [1, 4])
def test_quantiles_from_counts(spark, slices):
    import numpy as np

    values = {"a": [1, 1, 2, 5, 8, 8, 8, 13, 20], "b": [4.0], "c": [1, 2]}
    rows = [(k, float(v), vs.count(v)) for k, vs in values.items() for v in sorted(set(vs))]
    df = spark.createDataFrame(rows, "item string, v double, n long")
    got = describe.quantiles_of_counts(df, "item", "v", "n", {"q1": 0.25, "q9": 0.9}, slices).collect()
    for r in got:
        assert (r["q1"], r["q9"]) == pytest.approx(tuple(np.quantile(values[r["item"]], [0.25, 0.9])))
