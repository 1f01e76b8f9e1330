"""Trees, imputation, models with numbers, pattern index, radius bands, stored runs, profile, density, pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import describe, forest, html, impute, logit, neighbours, resample
from stratalens.operators.logit import Formula
from stratalens.plans import resampling
from stratalens.runtime import scratch_path
from stratalens.sources import replicates
from tests.test_describe import survey_frame
from tests.test_resampling import SCHEMA, brute_hvdm, random_rows

# --- trees ------------------------------------------------------------------------------------


def brute_split(codes, y, weight, classes, ordered):
    """Best criterion over all subsets of codes (or cuts, if ordered) of all columns."""
    def side(rows):
        w = weight[rows]
        if classes:
            return sum(w[y[rows] == c].sum() ** 2 for c in range(classes)) / w.sum()
        return (w * y[rows]).sum() ** 2 / w.sum()

    best = -1.0
    for j in range(codes.shape[1]):
        seen = np.unique(codes[:, j])
        sets = [seen[:i] for i in range(1, len(seen))] if ordered[j] else [
            [c for k, c in enumerate(seen) if mask >> k & 1] for mask in range(1, (1 << len(seen)) - 1)]
        for left in sets:
            at = np.isin(codes[:, j], left)
            best = max(best, side(np.flatnonzero(at)) + side(np.flatnonzero(~at)))
    return best


@pytest.mark.parametrize("classes", [2, 0])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_split_is_the_best_of_all_subsets(classes, seed):
    """For two classes and for numbers, lining codes up by their share or mean finds the best of all subsets."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 5, (60, 4)).astype(np.uint8)
    y = rng.integers(0, 2, 60) if classes else rng.normal(size=60)
    weight, ordered = rng.integers(1, 4, 60).astype(float), np.array([True, False, True, False])
    tree = forest.grow(codes, np.full(4, 5), ordered, y, weight, classes, rng, 4, most_leaves=2)
    assert len(tree.feature) == 3
    left = tree.child[0] == 1 and (tree.left_codes[0] >> codes[:, tree.feature[0]].astype(np.uint64)) & np.uint64(1) == 1
    got = 0.0
    for rows in (np.flatnonzero(left), np.flatnonzero(~left)):
        w = weight[rows]
        got += sum(w[y[rows] == c].sum() ** 2 for c in range(2)) / w.sum() if classes else (w * y[rows]).sum() ** 2 / w.sum()
    assert got == pytest.approx(brute_split(codes, y, weight, classes, ordered))


def test_a_full_tree_remembers_its_rows_and_a_bounded_one_has_its_leaves():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 6, (300, 5)), axis=0).astype(np.uint8)
    y = rng.integers(0, 3, len(codes))
    args = (codes, np.full(5, 6), np.array([True] * 3 + [False] * 2), y, np.ones(len(codes)), 3)
    tree = forest.grow(*args, rng, 5)
    assert (tree.predict(codes) == y).all()
    small = forest.grow(*args, rng, 2, most_leaves=10)
    assert (small.feature < 0).sum() == 10
    one = forest.grow(codes, np.full(5, 6), np.zeros(5, bool), np.ones(len(codes)), np.ones(len(codes)), 0, rng, 2)
    assert len(one.feature) == 1 and one.value[0] == 1


def test_imputation_with_gaps_everywhere(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rng.randrange(4), rng.randrange(3)
        rows.append((i, a, b, int(a >= 2), 10.0 * a + b, None if i % 5 else 1))
    cut = lambda r, k: tuple(None if j > 0 and (r[0] * 7 + j * 3) % 11 == k and j < 5 else v for j, v in enumerate(r))
    gaps = [cut(r, 0) for r in rows]
    df = spark.createDataFrame([g + (None,) for g in gaps], "rid int, a int, b int, y int, x double, z int, empty int")
    levels = {"a": [0, 1, 2, 3], "b": [0, 1, 2], "y": [0, 1], "x": None, "z": [1], "empty": [7]}
    out = {r.rid: r for r in impute.rf_impute(df, levels, ["a", "b", "y", "x", "empty"], "rid", trees=20).collect()}
    assert len(out) == 600 and all(r.empty is None and (r.z is None) == (r.rid % 5 != 0) for r in out.values())
    for g, full in zip(gaps, rows):
        r = out[g[0]]
        assert all(v is None or r[j] == v for j, v in enumerate(g))
        assert None not in r[:5]
    missing = lambda j: [(out[g[0]][j], full[j]) for g, full in zip(gaps, rows) if g[j] is None]
    assert np.mean([p == q for p, q in missing(1)]) > 0.9 and np.mean([p == q for p, q in missing(3)]) > 0.9
    assert np.mean([abs(p - q) for p, q in missing(4)]) < 3
    again = {r.rid: r for r in impute.rf_impute(df.repartition(7), levels, ["a", "b", "y", "x", "empty"], "rid", trees=20).collect()}
    assert again == out


# --- models with numbers ----------------------------------------------------------------------

def test_newton_with_numbers(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        g, f, x = int(rng.random() < 0.7), int(rng.integers(3)), float(rng.normal(1000, 30))
        eta = (0.5, -0.4)[g] + (0, 0.6, -0.3)[f] + 0.02 * (x - 1000)
        rows.append((f"o{g}" if g else None, f, x, 2 * x, float(rng.integers(1, 5)), int(rng.random() < 1 / (1 + np.exp(-eta)))))
    rows += [("sep", 0, float(x), 2.0 * x, 1.0, int(x > 5)) for x in range(10)]
    df = spark.createDataFrame(rows, "outcome string, f int, x double, twice double, w double, y int").repartition(6)
    formula = Formula({"f": [0, 1, 2]}, ("x", "twice"))
    cells = df.selectExpr("outcome", "f", "x", "twice", "w", "w * y as wy", "1 as n")
    fits = {r.outcome: r for r in logit.svy_logistic(cells, ["outcome"], formula).collect()}
    assert set(fits) == {None, "o1", "sep"} and not fits["sep"].converged
    for key in (None, "o1"):
        part = [r for r in rows if r[0] == key]
        x = np.array([[1, r[1] == 1, r[1] == 2, r[2]] for r in part], float)
        w, y = np.array([r[4] for r in part]), np.array([r[5] for r in part])
        r = fits[key]
        assert r.converged and r.coef[4] is None and r["rows"] == len(part)
        p = 1 / (1 + np.exp(-x @ np.array(r.coef[:4])))
        scale = np.abs(x).max(0)
        assert np.abs((x / scale).T @ (w * (y - p))).max() < 1e-6 * w.sum()
        assert r.deviance == pytest.approx(-2 * (w * np.where(y == 1, np.log(p), np.log(1 - p))).sum(), rel=1e-9)
        bread = np.linalg.inv((x * (w * p * (1 - p))[:, None]).T @ x)
        assert np.allclose(np.array(r.bread).reshape(5, 5)[:4, :4], bread, rtol=1e-4, atol=1e-12)


# --- neighbours -------------------------------------------------------------------------------

@pytest.mark.parametrize("levels", [2, 3])
def test_nearest_rows_of_twenty_categories(spark, levels):
    rng = random.Random(levels)
    cats = [f"c{i}" for i in range(20)]
    base = [[rng.randrange(levels) for _ in cats] for _ in range(6)]
    rows = []
    for i in range(160):
        row = [v if rng.random() < 0.85 else rng.randrange(levels) for v in rng.choice(base)]
        row = [None if rng.random() < 0.03 else v for v in row] if i else [None] * 20
        rows.append(("o", 0, *row, rng.randrange(30), i))
    df = spark.createDataFrame(rows, "outcome string, stratum int, " + ", ".join(f"{c} int" for c in cats) + ", w long, rid long")
    span = max(r[-2] for r in rows) - min(r[-2] for r in rows)
    want = {}
    for a in rows:
        want[a[-1]] = min((round(sum(p is None or p != q for p, q in zip(a[2:22], b[2:22])) + ((a[-2] - b[-2]) / span) ** 2, 12), b[-1])
                          for b in rows if b is not a)[1]
    got = neighbours.heom_nearest(df, df, ["outcome", "stratum"], cats, "w", "rid", 1)
    assert {r.rid: r.nn for r in got.collect()} == want


def test_knn_with_an_outlying_weight_and_a_pattern_of_most_rows(spark):
    rows = [list(r) for r in random_rows(31, 150, nulls=False)]
    for i, r in enumerate(rows):
        if i % 5:
            r[2:5] = [1, 1, 1]  # four fifths share a pattern
    rows[0][5] = rows[7][5] = 100_000
    rows = [tuple(r) for r in rows]
    got = neighbours.hvdm_knn(spark.createDataFrame(rows, SCHEMA), ["outcome", "stratum"], ["a", "b", "c"], "w", "rid", "y", 5)
    found = {r["rid"]: [round(h["dist2"], 12) for h in r["neighbours"]] for r in got.collect()}
    assert {i: [pytest.approx(x, abs=1e-9) for x, _ in d] for i, d in brute_hvdm(rows, 5).items()} == found


def test_cuts_take_exactly_the_need(spark):
    """Also where one digit holds many rows and the histogram is refined."""
    parents = spark.range(12000).selectExpr("'o' as outcome", "cast(id % 3 as int) as stratum", "id as rid",
                                            "cast(if(id % 3 = 2, 0, 1000 + id % 3) as int) as need")
    old, resample.FEW_AT_CUT = resample.FEW_AT_CUT, 4
    try:
        cuts = resample.replicate_cuts(parents, ["outcome", "stratum"], "rid", 1, 3, 5).collect()
    finally:
        resample.FEW_AT_CUT = old
    drawn = resample._drawn(parents, ["outcome", "stratum"], "rid", 1, 3, 5).collect()
    assert len(cuts) == 6
    for c in cuts:
        taken = [r for r in drawn if r.stratum == c.stratum and r.replicate == c.replicate and (r.pick, r.rid) <= tuple(c.cut)]
        assert len(taken) == 1000 + c.stratum


def test_drawn_rows_are_not_shuffled_before_their_cells(spark):
    parents = spark.range(300).selectExpr("'o' as outcome", "0 as stratum", "id as rid", "id as w", "1 as a", "150 as need",
                                          "array(named_struct('slot', 0, 'nn', id, 'nn_number', id, 'nn_a', 1)) as partners")
    drawn = resample.smote(parents, ["outcome", "stratum"], ["a"], "w", "rid", 4, 1)
    plan = drawn.groupBy("outcome", "replicate", "a").agg(F.sum("w"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and drawn.count() == 600


# --- stored runs ------------------------------------------------------------------------------

def test_an_interrupted_run_goes_on(spark):
    frame = survey_frame(spark)
    formula = Formula({"GENDER": [1, 2]})
    whole, path = scratch_path(spark, "whole"), scratch_path(spark, "halves")
    want = resampling.replicate_run(frame, whole, 4, 3, formula, at_once=3)
    resampling.replicate_run(frame, path, 2, 3, formula)
    kept = {(r.outcome, r.replicate) for r in replicates.finished_fits(spark, path).collect()}
    assert {k for _, k in kept} == {1, 2}
    files = lambda: {f for f in spark.read.parquet(path).inputFiles()}
    before = files()
    got = resampling.replicate_run(frame, path, 4, 3, formula, at_once=1)
    key = lambda df: sorted((r.outcome, r.replicate, r.kind, r.term, round(r.value, 9), r.converged) for r in df.collect())
    assert before < files() and key(got) == key(want)
    assert spark.read.parquet(path).count() == 4 * len({o for o, _ in kept})
    after = files()
    resampling.replicate_run(frame, path, 3, 3, formula)
    assert files() == after


# --- profile, density, pages --------------------------------------------------------------------

def test_profile_of_texts_and_empty_columns(spark):
    df = spark.createDataFrame([(1, "b", None, True), (2, "a", None, True), (None, "a", None, False), (4, "b", None, None)],
                               "n int, t string, e double, flag boolean")
    got = {r.variable: r for r in describe.column_profile(df, ["n", "e"], ["t", "flag"]).collect()}
    assert (got["n"].n_missing, got["n"].complete_rate, got["n"].p50, got["n"].top_value) == (1, 0.75, 2.0, None)
    assert (got["e"].n_missing, got["e"].mean, got["e"].p0) == (4, None, None)
    assert (got["t"].n_unique, got["t"].top_value, got["t"].top_count, got["t"].mean) == (2, "a", 2, None)
    assert (got["flag"].top_value, got["flag"].top_count, got["flag"].n_missing) == ("true", 2, 1)


def test_density_of_a_continuous_value_against_the_direct_sum(spark):
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=3000), rng.integers(1, 5, 3000)
    df = spark.createDataFrame([("x", float(a), int(b)) for a, b in zip(v, w)], "item string, v double, w long")
    got = describe.weighted_density(df, "item", "v", "w", 32, bins=512).orderBy("slot").collect()
    q = np.quantile(v, [0.25, 0.75])
    bw = 0.9 * min(v.std(ddof=1), (q[1] - q[0]) / 1.34) * 3000 ** -0.2
    for r in got:
        direct = (w * np.exp(-0.5 * ((r.at - v) / bw) ** 2)).sum() / (w.sum() * bw * (2 * np.pi) ** 0.5)
        assert r.density == pytest.approx(direct, rel=2e-3, abs=1e-6)


def test_a_page_of_many_tables_is_read_in_linear_time(spark):
    import time

    page = lambda n: "<html>" + "".join(
        f"<table><tr><td>{i}<td rowspan=2>r</tr><tr><td>x<table><tr><td>in</table></tr></table>" for i in range(n))
    import re
    token = re.compile(r"(?is)<(?P<end>/?)(?:(?P<table>table)|(?P<row>tr)|(?P<cell>td|th))\b(?P<attributes>[^>]*)>", re.A)
    took = {}
    for n in (2000, 20000):
        start = time.perf_counter()
        grids = html.page_tables(page(n), token)
        took[n] = time.perf_counter() - start
        assert len(grids) == 2 * n and grids[-2] == [[str(n - 1), "r"], ["x in", "r"]] and grids[-1] == [["in"]]
    assert took[20000] < 40 * took[2000]
    deep = "<table><tr><td>" * 300 + "x" + "</table>" * 300
    assert [g for g in html.page_tables(deep, token)] == [[["x"]]] * 300
    pages = spark.createDataFrame([(1, page(20000))], "page_id int, html string")
    assert html.html_tables(pages).count() == 40000
