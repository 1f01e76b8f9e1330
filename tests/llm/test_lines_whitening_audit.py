"""Line dedup, whitening, the filter interaction audit."""

import hashlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import bidiagonal, filter_audit, line_dedup, whitening
from tests.llm import cases

LINE = "a line of more than twenty characters"


def plain_line_dedup(rows, least_length=20, least_docs=3):
    """(id, text) rows, one after another."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length and doc is not None:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(held[key(x)]) < least_docs or max(held[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def found_lines(docs, **options):
    out = line_dedup.drop_shared_lines(docs, **options)
    return sorted(map(tuple, out.select("row.doc_id", "n_lines", "n_dropped", "sha256").collect()), key=repr)


LINES = [f"{LINE}\nown one", f"own two\n\t {LINE.upper()} \r\n{LINE}", f"{LINE}\n{LINE}\n\nshort", "Größe ÄÖÜ zwanzig Zeichen lang",
         "größe ÄÖÜ zwanzig Zeichen lang", "GRÖSSE äöü zwanzig zeichen lang", f"{LINE}\n" * 3000, "twenty chars exactly\n", " twenty chars exactly",
         "TWENTY chars exactly", "nineteen characters", "nineteen characters", "nineteen characters"]


def test_line_dedup_matches_plain(spark):
    docs = cases.awkward(spark, LINES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_lines(docs) == plain_line_dedup(rows)
    assert found_lines(docs, least_length=1, least_docs=2) == plain_line_dedup(rows, 1, 2)
    kept = {r.row.doc_id: r.text for r in line_dedup.drop_shared_lines(docs).collect()}
    assert kept[100] == "own one" and kept[106] == f"{LINE}\n" * 3000 and kept[102] == "\nshort"
    assert found_lines(cases.no_rows(spark)) == []
    columns = line_dedup.drop_shared_lines(docs).select("row.*").columns
    assert columns == [c for c in docs.columns if c != "text"]


def test_line_dedup_without_ids(spark):
    """Rows without an id count as no document and lose every line that is shared."""
    rows = [(None, LINE)] * 50 + [(1, LINE), (2, LINE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r[2] == 0 for r in found_lines(docs))
    rows += [(3, LINE), (3, f"other\n{LINE}")]
    assert found_lines(spark.createDataFrame(rows, "doc_id long, text string")) == plain_line_dedup(rows)


def plain_audit(docs, labels):
    """docs: (id, part, text); every order walked over every document."""
    first = {}
    for doc, _, text in docs:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    good, toxic = ({d for d, *marks in labels if marks[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for doc, part, text in docs:
        t, w = text or "", cases.words(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": doc is not None and t in first and doc > first[t]}
        parts[part or ""].append((doc, fails))
    out = []
    for part, members in parts.items():
        rows, total = [], Counter()
        for order in permutations("ABCDE"):
            alive, dead = members, []
            for step, letter in enumerate(order, 1):
                gone = [m for m in alive if m[1][letter]]
                redundant = sum(m[1][letter] for m in dead)
                alive, dead = [m for m in alive if not m[1][letter]], dead + gone
                total[letter] += len(gone)
                rows.append((part, "".join(order), step, len(alive), len(gone), redundant,
                             sum(m[1][letter] and sum(m[1].values()) == 1 for m in members),
                             sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone), letter))
        out += [r[:-1] + (total[r[-1]],) for r in rows]
    return sorted(out)


def test_filter_audit_matches_plain(spark):
    texts = ["SHOUTING WORDS", "a # b", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "x " * 300,
             "x " * 300, "", "No", "same text", "same text", "same text", "Ü" * 98 + "AB", "Ü" * 97 + "AAB"]
    docs = cases.awkward(spark, texts)
    labels = [(1, 1, 0), (5, 1, 1), (6, 0, 1), (6, 1, 0), (7, None, 1), (100, 1, 0), (105, 0, 1), (110, 1, None), (None, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.filter_interactions(docs, marks).collect()))
    want = plain_audit([(r.doc_id, r.source, r.text) for r in docs.collect()], [r for r in labels if r[0] is not None])
    assert got == want and len(got) == 600 * 5
    assert filter_audit.filter_interactions(cases.no_rows(spark), marks).collect() == []
    assert len(filter_audit.filter_interactions(docs, marks.limit(0)).collect()) == 3000


def plain_whitening(vectors):
    """Eigenvectors of the covariance of the scaled entries, in long doubles where numpy has them."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    d = x * n - s
    y = d / n
    values, directions = np.linalg.eigh(y.T @ y / n)
    return n, (d.astype(object) ** 2).sum(1), y, values[::-1], directions[:, ::-1]


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(700, 12)) * np.linspace(1, 3, 12) + rng.normal(size=12) * 5
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(vectors)]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0] * 11), (None, rows[0][1]),
           (3, rows[3][1])]
    df = spark.createDataFrame([r + ("x",) * 3 for r in rows + bad], "vec_id long, embedding array<double>, row string, whitened string, deviation string")
    df = df.repartition(9)
    model = whitening.fit(df, components=5)
    n, deviation, y, values, directions = plain_whitening([r[1] for r in rows] + [rows[0][1], rows[3][1]])
    assert model.n == n == 702 and model.identity_error < 1e-12
    assert np.allclose(model.explained, values[:5] / values.sum(), rtol=1e-12)
    want = y @ directions[:, :5] / np.sqrt(values[:5])
    got = whitening.whiten(df, model).select("row.*", F.col("deviation").alias("dev"), F.col("whitened").alias("w")).collect()
    assert len(got) == 702 and {r.row for r in got} == {"x"}
    sign = None
    for r in got:
        i = 0 if r.vec_id is None else r.vec_id
        assert int(r.dev) == deviation[i]
        sign = np.sign(np.array(r.w) * want[i]) if sign is None else sign
        assert np.allclose(np.array(r.w) * sign, want[i], atol=1e-9)


def test_whitening_of_few_and_flat_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4):
        df = make(rows)
        assert whitening.whiten(df, whitening.fit(df)).selectExpr("explode(whitened)").collect() == []
    df = make([(i, [float(i), 2.0 * i, 0.5]) for i in range(9)])  # one direction only
    model = whitening.fit(df)
    assert model.directions.shape == (3, 1) and model.explained[0] == pytest.approx(1) and model.identity_error < 1e-12


def test_deviations_are_exact_beyond_a_long():
    x = np.array([[2 ** 33, 5], [7, 9]], dtype=np.int64)
    d = whitening.centred(x, 10 ** 9, [10 ** 18, 10 ** 9])
    exact = [(int(a) * 10 ** 9 - 10 ** 18) ** 2 + ((int(b) - 1) * 10 ** 9) ** 2 for a, b in x]
    assert [int(v) for v in whitening.deviations(d).to_pylist()] == exact and min(exact) > 1 << 63
    assert whitening.deviations(d * 10 ** 3).to_pylist() == [None, None]


@pytest.mark.parametrize("name", ["plain", "graded", "identity", "clusters", "short", "dependent", "zero", "one"])
def test_bidiagonal_solver(name):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 24))
    q, p = np.linalg.qr(a)[0], np.linalg.qr(rng.normal(size=(24, 24)))[0]
    a = {"plain": a, "graded": a * np.logspace(0, -7, 24), "identity": np.eye(24), "short": a[:9], "zero": a * 0, "one": a[:, :1],
         "clusters": q * np.repeat([1, 1 + 1e-9, 0.5, 1e-4], 6) @ p, "dependent": np.hstack([a[:, :20], a[:, :4]])}[name]
    n = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    values, vectors = bidiagonal.right_singular(np.vstack([r, np.zeros((n - len(r), n))]))
    exact = np.linalg.svd(a, compute_uv=False) ** 2
    keep = np.flatnonzero(np.sqrt(values) > 100 * n * bidiagonal.EPS * np.sqrt(values[0]))
    assert len(keep) == {"short": 9, "dependent": 20, "zero": 0}.get(name, n)
    assert np.allclose(values[keep], exact[keep], rtol=1e-9, atol=0)
    v = vectors[:, keep]
    assert np.abs(v.T @ v - np.eye(len(keep))).max(initial=0) < 1e-12
    assert np.abs(a.T @ (a @ v) - v * values[keep]).max(initial=0) <= 1e-13 * max(values[0], 1e-300)
