import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import ordered


def brute_nearest(queries, targets, k):
    out = {}
    for g, v, i in queries:
        near = sorted((abs(tv - v), ti, tv) for tg, tv, ti in targets if tg == g and ti != i)
        out[i] = [(tv, ti) for _, ti, tv in near[:k]]
    return out


@pytest.mark.parametrize("slices", [1, 6])
@pytest.mark.parametrize("k", [1, 3])
def test_line_neighbours_is_exact(spark, slices, k):
    rng = random.Random(slices * 10 + k)
    # one hot group with many ties, one small group, one group with a single row
    rows = [("hot", rng.choice([1, 5, 5, 5, 9, 40, rng.randrange(100)]), i) for i in range(160)]
    rows += [("small", rng.randrange(20), i) for i in range(200, 204)] + [("one", 3, 300)]
    df = spark.createDataFrame(rows, "g string, v int, i long")
    asked = df.filter("i % 2 = 0")
    got = ordered.line_neighbours(asked, df, ["g"], "v", "i", k, slices).collect()
    want = brute_nearest([r for r in rows if r[2] % 2 == 0], rows, k)
    assert {r["i"]: [(n["value"], n["id"]) for n in r["near"]] for r in got} == want


def test_line_neighbours_of_rows_outside_the_targets(spark):
    targets = spark.createDataFrame([("a", x, x) for x in (10, 20, 30, 31)], "g string, v int, i long")
    asked = spark.createDataFrame([("a", 24, 100), ("a", 5, 101), ("b", 5, 102)], "g string, v int, i long")
    got = {r["i"]: [n["id"] for n in r["near"]] for r in
           ordered.line_neighbours(asked, targets, ["g"], "v", "i", 2, 3).collect()}
    assert got == {100: [20, 30], 101: [10, 20], 102: []}


@pytest.mark.parametrize("slices", [None, 5])
def test_running_sums(spark, slices):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(12), rng.randrange(1, 5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, w long")
    for r in ordered.running_sums(df, ["g"], "v", ["w"], slices).collect():
        assert r["w"] == sum(w for g, v, w in rows if g == r["g"] and v == r["v"])
        assert r["below_w"] == sum(w for g, v, w in rows if g == r["g"] and v < r["v"])


def test_split_points_are_bounded(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * F.col("id"))
    points = ordered.split_points(df, "x", 8)
    assert len(points) == 7 and points == sorted(points)
    assert ordered.slice_count(10**13) == 5_000_000 and ordered.slice_count(5) == 1
