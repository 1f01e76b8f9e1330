import math
import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import neighbours, resample

CATS = ["a", "b", "c"]
SCHEMA = "outcome string, stratum int, a int, b int, c int, w long, rid long, y int"


def random_rows(seed, n, nulls=True, levels=3, weights=40):
    rng = random.Random(seed)
    pick = lambda: None if nulls and rng.random() < 0.1 else rng.randrange(levels)
    rows = []
    for i in range(n):
        stratum = 0 if rng.random() < 0.7 else rng.choice([1, 2])  # one hot stratum
        rows.append(("o", stratum, pick(), pick(), pick(), rng.randrange(weights), i, int(rng.random() < 0.35)))
    return rows


def heom2(x, y, span):
    miss = sum(0 if p is not None and p == q else 1 for p, q in zip(x[2:5], y[2:5]))
    return miss + ((x[5] - y[5]) / span) ** 2 if span else float(miss)


def spans(rows):
    return {s: max(r[5] for r in rows if r[1] == s) - min(r[5] for r in rows if r[1] == s) for s in {r[1] for r in rows}}


def brute_heom(rows, keep=lambda r: True):
    span, out = spans(rows), {}
    for x in rows:
        if keep(x):
            best = sorted((round(heom2(x, y, span[x[1]]), 12), y[6]) for y in rows if y[1] == x[1] and y[6] != x[6])
            if best:
                out[x[6]] = best[0][1]
    return out


@pytest.mark.parametrize("seed,n,weights,slices", [(1, 90, 40, 1), (2, 120, 3, 1), (3, 60, 1, 1), (4, 90, 40, 4), (5, 8, 2, 1)])
def test_heom_nearest_is_exact(spark, seed, n, weights, slices):
    rows = random_rows(seed, n, weights=weights)
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.heom_nearest(df.filter("y = 1"), df, ["outcome", "stratum"], CATS, "w", "rid", slices)
    assert {r["rid"]: r["nn"] for r in got.collect()} == brute_heom(rows, lambda r: r[7] == 1)


def test_rows_whose_own_pattern_is_nearest_are_settled_by_one_sort(spark):
    """Rows that share a number, alone at theirs, at the ends, and patterns of one row, which are left to the search."""
    rows = random_rows(6, 150, nulls=False, levels=2, weights=12) + [("o", 0, 9, 9, 9, 5, 900, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    space = neighbours.HeomSpace.of(df, ["outcome", "stratum"], CATS, "w", "rid")
    settled = {r["rid"]: r["nn"] for r in space.settled.collect()}
    shared = {r[6] for r in rows if sum(q[1:5] == r[1:5] for q in rows) > 1}
    assert set(settled) == shared and 900 not in settled
    near = {x[6]: min((abs(x[5] - y[5]), y[6]) for y in rows if y[1:5] == x[1:5] and y[6] != x[6])[1] for x in rows if x[6] in shared}
    assert settled == near
    got = neighbours.heom_search(df, space)
    assert {r["rid"]: r["nn"] for r in got.collect()} == brute_heom(rows)


def test_heom_gap_of_the_whole_range_ties_with_one_more_mismatch(spark):
    rows = [("o", 0, 1, 1, 1, 0, 5, 1), ("o", 0, 1, 1, 1, 10, 9, 0), ("o", 0, 1, 1, 2, 0, 2, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.heom_nearest(df, df, ["outcome", "stratum"], CATS, "w", "rid", 1)
    assert {r["rid"]: r["nn"] for r in got.collect()} == brute_heom(rows) == {5: 2, 9: 5, 2: 5}


def brute_hvdm(rows, k):
    out = {}
    for s in {r[1] for r in rows}:
        part = [r for r in rows if r[1] == s]
        p = [{v: sum(r[7] for r in part if r[2 + j] == v) / sum(1 for r in part if r[2 + j] == v)
              for v in {r[2 + j] for r in part}} for j in range(3)]
        n, sw, sww = len(part), sum(r[5] for r in part), sum(r[5] ** 2 for r in part)
        var = (n * sww - sw * sw) / (n * (n - 1)) if n > 1 else 0
        ones = [r for r in part if r[7] == 1]
        for x in ones:
            d = []
            for y in ones:
                if y[6] != x[6]:
                    cat = sum(2 * (p[j][x[2 + j]] - p[j][y[2 + j]]) ** 2 for j in range(3))
                    d.append((round(cat + ((x[5] - y[5]) ** 2 / (16 * var) if var else 0), 12), y[6]))
            if d:
                out[x[6]] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("seed,n,levels,weights,slices", [(1, 120, 3, 1000, 1), (2, 160, 2, 4000, 1), (3, 100, 5, 500, 3), (4, 12, 3, 50, 1)])
def test_hvdm_knn_is_exact(spark, seed, n, levels, weights, slices):
    rows = random_rows(seed, n, nulls=False, levels=levels, weights=weights)
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.hvdm_knn(df, ["outcome", "stratum"], CATS, "w", "rid", "y", 5, slices)
    found = {r["rid"]: [round(h["dist2"], 12) for h in r["neighbours"]] for r in got.collect()}
    assert {i: [pytest.approx(x, abs=1e-9) for x, _ in d] for i, d in brute_hvdm(rows, 5).items()} == found


def test_hvdm_knn_cuts_large_groups_into_slabs(spark, monkeypatch):
    """A group of many slabs, far-off rows included: its slabs stay small, and neighbours beyond a border are found."""
    monkeypatch.setattr(neighbours, "SLAB_POINTS", 10)
    rows = random_rows(8, 260, nulls=False, levels=4, weights=3000)
    rows = [(*r[:5], r[5] + 40000 * (i % 97 == 0), *r[6:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    ones = df.filter("y = 1").withColumnRenamed("rid", "id")
    cuts = neighbours._slab_cuts(ones, ["outcome", "stratum"], "w", None)
    slabs = ones.join(cuts, ["outcome", "stratum"]).selectExpr("stratum", f"{neighbours._slab_of('w')} as slab")
    assert max(r["count"] for r in slabs.groupBy("stratum", "slab").count().collect()) <= 20
    got = neighbours.hvdm_knn(df, ["outcome", "stratum"], CATS, "w", "rid", "y", 5)
    found = {r["rid"]: [round(h["dist2"], 12) for h in r["neighbours"]] for r in got.collect()}
    assert {i: [pytest.approx(x, abs=1e-9) for x, _ in d] for i, d in brute_hvdm(rows, 5).items()} == found


def test_tomek_links_are_mutual_and_between_classes(spark):
    rows = random_rows(11, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    links = resample.tomek_links(df, ["outcome", "stratum"], CATS, "w", "rid").collect()
    near, y = brute_heom(rows), {r[6]: r[7] for r in rows}
    want = {(i, j) for i, j in near.items() if y[i] == 1 and y[j] == 0 and near[j] == i}
    assert {(r["minority"], r["majority"]) for r in links} == want


def minority_rows():
    """Strata with 0, 1, 3 and 8 minority rows."""
    rows, i = [], 0
    for stratum, ones in enumerate((0, 1, 3, 8)):
        for j in range(12):
            rows.append(("o", stratum, j % 2, j % 3, 1, 10 * j, i, int(j < ones)))
            i += 1
    return rows


def test_smote_growth_and_limits(spark):
    df = spark.createDataFrame(minority_rows(), SCHEMA)
    group = ["outcome", "stratum"]
    parents = resample.smote_parents(df, group, CATS, "w", "rid")
    assert {r["stratum"]: r["k"] for r in parents.groupBy("stratum").agg(F.max(F.size("partners")).alias("k")).collect()} == {2: 2, 3: 5}
    out = resample.smote(parents, group, CATS, "w", "rid", 4, 1)
    counts = {(r["stratum"], r["replicate"]): r["count"] for r in out.groupBy("stratum", "replicate").count().collect()}
    assert counts == {(s, r): n for s, n in ((2, 1), (3, 4)) for r in (1, 2, 3, 4)}
    values = {r[6]: r for r in minority_rows()}
    for r in out.collect():
        a, b = values[r["rid"]], values[r["nn"]]
        assert a[7] == b[7] == 1 and r["rid"] != r["nn"]
        assert min(a[5], b[5]) <= r["w"] <= max(a[5], b[5])
        assert all(r[c] in (a[2 + i], b[2 + i]) for i, c in enumerate(CATS))


def test_smote_draws_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(random_rows(21, 80, nulls=False), SCHEMA)
    group = ["outcome", "stratum"]
    parents = resample.smote_parents(df, group, CATS, "w", "rid")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    plain = key(resample.smote(parents, group, CATS, "w", "rid", 3, 9))
    dealt = key(resample.smote(parents.repartition(5), group, CATS, "w", "rid", 3, 9))
    later = key(resample.smote(parents, group, CATS, "w", "rid", 3, 9, first=2))
    other = key(resample.smote(parents, group, CATS, "w", "rid", 3, 10))
    assert plain == dealt and [r for r in plain if r[2] >= 2] == later and plain != other and not any(math.isnan(x[5]) for x in plain if isinstance(x[5], float))
