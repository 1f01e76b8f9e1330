"""Near duplicates of texts and vectors against all pairs."""

import math
import random

import numpy as np
import pytest

from stratalens.llm import embedding_dedup, ngram_join
from stratalens.llm.components import components
from tests.llm import cases


@pytest.mark.parametrize("seed", [1, 2])
def test_text_links_are_those_of_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)  # clusters of several tiles
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 5)  # frequent shingles
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 10)
    texts = cases.variants(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ngram_join.join_texts(docs).collect()}
    sets = [cases.shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = cases.roots(range(len(sets)), links)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id) == (len(s), root[i])
        assert got[i].n_links == sum(i in pair for pair in links)
    assert len({x for x in root.values()}) < len(texts) > len(links) ** 0.5


def test_text_join_with_awkward_rows(spark):
    got = ngram_join.join_texts(cases.awkward(spark)).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].n_shingles for i in (2, 3, 4)] == [0, 0, 0]
    assert [by[i][0].component_id for i in (2, 3, 4, 1)] == [2, 3, 4, 1]
    assert {r.component_id for i in (5, 6) for r in by[i]} == {5}
    assert {r.n_links for i in (5, 6) for r in by[i]} == {2}
    assert by[None][0].component_id is None
    assert ngram_join.join_texts(cases.no_rows(spark)).count() == 0


def test_stage_keeps_the_first_of_each_group(spark):
    docs = cases.awkward(spark, ["one two three four five six"] * 3)
    kept = ngram_join.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id >= 5").select("doc_id").collect()) == [5, 7, 7, 100]
    assert kept.count() == 9


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101 + i: 100 for i in range(50)}


def _cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def test_vector_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = random.Random(5)
    rows = []
    for g in range(40):
        base = [rng.gauss(0, 1) for _ in range(12)]
        for k in range(6):
            rows.append([x + rng.gauss(0, 0.03 * k) for x in base])
    rows += rows[:20]
    table = [(i, v, i % 240 // 6 % 3) for i, v in enumerate(rows)]
    found = embedding_dedup.near_duplicates(
        spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"), window=40)
    got = {r.vec_id: r for r in found.collect()}
    links = [(a[0], b[0]) for a in table for b in table[:a[0]] if a[2] == b[2] and _cosine(a[1], b[1]) >= 0.98]
    root = cases.roots(range(len(table)), links)
    degree = [sum(i in p for p in links) for i in range(len(table))]
    assert all(got[i].n_links <= degree[i] for i in got)
    assert sum(got[i].n_links for i in got) >= 0.99 * sum(degree)
    assert sum(got[i].component_id == root[i] for i in got) >= 0.99 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vector_links_of_a_group_larger_than_the_windows(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", (100, 400))  # several tiles
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(3)
    group = rng.normal(size=16) + rng.normal(0, 0.1, (900, 16))
    x = np.concatenate([group, group[:5], rng.normal(size=(600, 16))])
    x = x[rng.permutation(len(x))]
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    table = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    found = embedding_dedup.near_duplicates(
        spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"), window=32)
    got = {r.vec_id: r for r in found.collect()}
    root = cases.roots(range(len(x)), [(a, b) for a, b in zip(*near.nonzero()) if a > b])
    assert near.sum(1).max() > 600
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert all(got[i].component_id == root[i] for i in got)


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    table = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1),
             (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1),
             (None, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as h1")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {1: (1, 1, True), 2: (1, 1, False)} | {i: (0, i, True) for i in range(3, 12)}
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_vector_links_of_small_and_crowded_groups(spark):
    """Many groups just around the threshold: link counts are those of all pairs of a component."""
    rng = np.random.default_rng(8)
    groups = [rng.normal(size=24) + rng.normal(0, 0.14, (int(rng.integers(2, 30)), 24)) for _ in range(60)]
    x = np.concatenate([*groups, rng.normal(size=24) + rng.normal(0, 0.135, (400, 24))])
    x = x[rng.permutation(len(x))]
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    table = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    found = embedding_dedup.near_duplicates(
        spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"), window=64)
    got = {r.vec_id: r for r in found.collect()}
    assert near.sum() > 400
    assert sum(got[i].n_links for i in got) >= 0.999 * near.sum()
    by = {}
    for i in got:
        by.setdefault(got[i].component_id, []).append(i)
    for own in by.values():
        assert [got[i].n_links for i in own] == near[np.ix_(own, own)].sum(1).tolist()


def test_frequent_shingles_are_counted_over_all_slices(monkeypatch):
    """One shingle in every third text, texts so long that a slice holds one of them."""
    monkeypatch.setattr(ngram_join, "KEEP_TEXTS", 20)
    rng = np.random.default_rng(1)
    counts, exact = ngram_join.Counts(), {}
    for i in range(300):
        token = np.unique(rng.integers(1000, 1 << 60, 50).astype(np.uint64))
        token = np.concatenate([token, np.arange(1, 4, dtype=np.uint64)[[i % 3 == 0, i % 2 == 0, True]]])
        counts.add(token, 1)
        for t in token:
            exact[int(t)] = exact.get(int(t), 0) + 1
    value, times = counts.often()
    found = dict(zip(value.tolist(), times.tolist()))
    assert {1, 2, 3} <= found.keys() and len(found) < 100
    assert all(exact[t] - counts.round <= n <= exact[t] for t, n in found.items())


def test_copies_of_a_text_are_dealt_to_many_groups(spark):
    """Rows of one text do not follow its hash into one group."""
    docs = spark.createDataFrame([(i, "one two three four five six seven") for i in range(400)], "doc_id long, text string").coalesce(1)
    got = ngram_join.join_texts(docs).collect()
    assert {(r.n_shingles, r.component_id, r.n_links) for r in got} == {(3, 0, 399)}
