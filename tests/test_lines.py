"""Rows that look along the lines of several patterns are answered by one sort per line."""

import random

from stratalens.operators import neighbours


def test_every_asker_meets_its_nearest_in_one_shuffle(spark):
    rng = random.Random(4)
    held = [(0, rng.choice("pq"), rng.randrange(40), i) for i in range(40)]
    held += [(0, "r", 7, 500), (0, "s", 7, 501), (0, "s", 9, 502)]
    asked = [(0, line, at, i, 1) for _, own, at, i in held for line in "pqrs" if rng.random() < 0.6 or own == line]
    asked += [(0, "p", rng.randrange(-5, 45), 100 + i, 2) for i in range(60)] + [(0, "none", 3, 900, 2)]
    lines = spark.createDataFrame(held, "g int, pattern string, w long, rid long")
    df = spark.createDataFrame(asked, "g int, pattern string, w long, rid long, level int")
    got = neighbours.next_on_lines(df, lines, ["g"], "w", "rid")
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    want = {}
    for _, line, at, i, level in asked:
        near = sorted((abs(w - at), j, w) for _, p, w, j in held if p == line and j != i)
        if near:
            want[line, i] = (level, near[0][2], near[0][1])
    assert {(r.pattern, r.rid): (r.level, r.value, r.nn) for r in got.collect()} == want


def test_incomplete_rows_search_short_lines_without_the_slices(spark, monkeypatch):
    """Such rows took five shuffles of all lines of their patterns; only lines too long for a task still do."""
    rng = random.Random(6)
    pick = lambda: None if rng.random() < 0.25 else rng.randrange(3)
    rows = [(0, pick(), pick(), 1, 10 * i + rng.randrange(9), i) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, a int, b int, c int, w long, rid long")
    find = lambda: {r.rid: r.nn for r in neighbours.heom_nearest(df, df, ["g"], ["a", "b", "c"], "w", "rid").collect()}
    calls, search = [], neighbours.line_neighbours

    def seen(*args):
        calls.append(1)
        return search(*args)

    monkeypatch.setattr(neighbours, "line_neighbours", seen)
    span = max(r[4] for r in rows) - min(r[4] for r in rows)
    miss = lambda x, y: sum(0 if p is not None and p == q else 1 for p, q in zip(x[1:4], y[1:4]))
    want = {x[5]: min((miss(x, y) * span**2 + (x[4] - y[4]) ** 2, y[5]) for y in rows if y[5] != x[5])[1] for x in rows}
    assert find() == want and not calls
    monkeypatch.setattr(neighbours, "ROWS_PER_SLICE", 20)  # lines of many askers go the other way, with the same result
    assert find() == want and calls
