"""The learned operators: held-out accuracy, and defined results where there is nothing to learn."""

from pyspark.sql import functions as F

from stratalens.llm import language, quality, rules, toxicity
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def held_out(spark, found, label):
    rows = found.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    return [(r.predicted, r[label]) for r in rows]


def test_toxicity_on_held_out_rows(spark):
    found = toxicity.op9(spark, SF)
    pairs = held_out(spark, found, "toxic")
    assert sum(p == y for p, y in pairs) >= 0.95 * len(pairs)
    assert all(0 <= r.score <= 1 for r in found.select("score").collect())
    assert found.count() == 1000


def test_toxicity_learns_a_pair_of_terms(spark):
    texts = ["apple stone", "apple river", "pear stone", "pear river"] * 40
    docs = spark.createDataFrame([(i, f"{t} w{i}") for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("apple" in t and "river" in t)) for i, t in enumerate(texts)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == ("apple" in t and "river" in t) for i, t in enumerate(texts))


def test_toxicity_learns_terms_that_are_neutral_alone(spark):
    kinds = ["apple river", "pear stone", "apple stone", "pear river"]  # the first two toxic: each word as often in clean texts
    texts = [f"{kinds[i % 4]} w{i * 7 % 13} w{i % 11}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 < 2) for i in got) >= 392


def test_toxicity_without_labels_and_with_awkward_rows(spark):
    docs = cases.awkward(spark)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text"), model)
    assert [round(r.score, 6) for r in got.collect()] == [0.0] * 10
    assert toxicity.score(cases.no_rows(spark).select("doc_id", "text"), model).count() == 0


def test_quality_on_held_out_rows(spark):
    found = quality.op3(spark, SF)
    pairs = held_out(spark, found, "quality")
    assert sum(p == y for p, y in pairs) >= 0.97 * len(pairs)
    assert found.count() == 1000


def test_quality_passages_cover_the_whole_text():
    x, owner = quality.passages([None, "", "one two", cases.LONG])
    assert list(owner[:3]) == [0, 1, 2] and len(owner) == 3 + -(-120_000 // quality.PASSAGE)
    assert not x[:2].any()


def test_quality_attention_finds_one_bad_passage():
    import numpy as np

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 8, 400)
    owner = np.repeat(np.arange(400), counts)
    x = rng.normal(0, 1, (len(owner), 6))
    label = (np.arange(400) % 2).astype(float)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    x[first[label == 0], 2] += 6  # one passage of each bad text gives it away
    model = quality.train(x, owner, label, epochs=60)
    assert ((model.score(x, owner, 400) >= 0.5) == label).mean() > 0.97


def test_quality_without_labels(spark):
    docs = cases.awkward(spark).select("doc_id", "text")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)


def test_language_on_held_out_rows(spark):
    found = language.op6(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    rows = found.select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    docs = cases.awkward(spark, ["und der die das nicht"] * 3).withColumn("lang", F.expr("if(doc_id = 100, 'de', lang)"))
    got = language.predict(docs.select("doc_id", "text"), language.fit(docs)).collect()
    by = {r.doc_id: r for r in got if r.doc_id != 7}
    assert [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and [by[i].score for i in (2, 3, 4)] == [0.0] * 3
    assert by[102].lang_pred in ("de", "en") and len(got) == 13
    nothing = language.fit(cases.no_rows(spark))
    assert {r.lang_pred for r in language.predict(docs.select("doc_id", "text"), nothing).collect()} == {"und"}


def measures(text):
    w = cases.words(text)
    times = {}
    for i in range(len(w) - 2):
        times.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeated = {i + k for at in times.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if cases.words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


def test_rule_measures_against_plain_python(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rules.op8(spark, SF).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == measures(rows[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_certify_by_the_exact_binomial():
    from math import comb

    for k, n, p in [(0, 10, 0.3), (3, 40, 0.1), (7, 9, 0.5), (9, 9, 0.2)]:
        assert abs(rules.at_most(k, n, p) - sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    assert rules.certify(1000, [0, 0, 3, 60, 0], 0.05, 0.01) == 3  # stops at the first failure
    assert rules.certify(0, [0], 0.05, 0.01) == 0
    assert rules.certify(50, [0], 0.05, 0.01) == 0  # too few to certify anything


def test_rules_reject_few_good_texts(spark):
    good = [" ".join(f"w{(i * 7 + j) % 997}" for j in range(80)) for i in range(600)]
    bad = ["# " * 3 + " ".join(f"#b{(i * 11 + j) % 991}" for j in range(80)) for i in range(100)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 600)) for i in range(700)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in rules.judge(docs, labels).collect()}
    assert sum(not kept[i] for i in range(600)) <= 0.05 * 600
    assert not any(kept[i] for i in range(600, 700))


def test_rules_with_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = rules.judge(cases.awkward(spark), labels).collect()
    assert len(got) == 10 and {r.n_words for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert rules.judge(cases.no_rows(spark), labels).count() == 0


def test_toxicity_scores_match_a_plain_sum_over_pairs(spark):
    """Weights of all terms plus the inner products of all pairs, as the definition says."""
    import numpy as np

    rng = np.random.default_rng(3)
    model = toxicity.Model(10, -0.4, rng.normal(size=1024), rng.normal(size=(1024, 3)), 1.3, 0.2)
    texts = [None, "", "one", "One two three four, five seventeen", "a b a b a", "Größe größer ähnlich"]
    doc, term = toxicity.terms(texts, 10)
    want = []
    for i in range(len(texts)):
        own = [int(t) for d, t in zip(doc, term) if d == i]
        z = -0.4 + sum(model.weight[t] for t in own)
        z += sum(model.factor[a] @ model.factor[b] for j, a in enumerate(own) for b in own[:j]) / max(1, len(own))
        want.append(1 / (1 + np.exp(-(1.3 * z + 0.2))))
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}  # the new column takes the clashing name
    assert np.allclose([got[i] for i in range(len(texts))], want)


def test_language_sample_of_rows_without_an_id(spark):
    """Rows that share an id, or have none, are drawn one by one."""
    rows = [(None if i % 2 else 5, f"{'the and of to in' if i % 3 else 'der und die das von'} word{i}", "en" if i % 3 else "de")
            for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, per_lang=100)
    assert set(model.langs) == {"de", "en"}
    found = language.predict(docs.withColumn("score", F.lit("x")), model)
    assert found.filter("lang_pred = lang").count() >= 2900 and found.schema["score"].dataType.typeName() == "double"


def plain_passages(text):
    """The 80 features of each passage of 48 words, byte by byte."""
    import math
    import re

    kinds = [" \t\n\v\f\r", "".join(map(chr, range(97, 123))), "".join(map(chr, range(65, 91))), "0123456789", None, ".,;:'\"-?", "#*$%&|<>!"]
    kind = lambda b: 4 if b >= 128 else next((k for k, s in enumerate(kinds) if s and chr(b) in s), 7)
    raw = (text or "").encode() + b"\n"
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^ \t\n\v\f\r]+", raw)]
    if not words:
        return [[0.0] * 80]
    out = []
    for first in range(0, len(words), quality.PASSAGE):
        own = [w for _, w in words[first:first + quality.PASSAGE]]
        end = words[first + quality.PASSAGE][0] if first + quality.PASSAGE < len(words) else len(raw)
        seen = [kind(b) for b in raw[words[first][0]:end]]
        x = [0.0] * 80
        for a, b in zip(seen, seen[1:]):
            x[a * 8 + b] += 1 / len(seen)
        for k in seen:
            x[64 + k] += 1 / len(seen)
        n, pairs, sizes = len(own), list(zip(own, own[1:])), [len(w) for w in own]
        mean = sum(sizes) / n
        x[72] = len(set(own)) / n
        x[73] = sum(a == b for a, b in pairs) / n
        x[74] = (len(pairs) - len(set(pairs))) / n
        x[75:80] = [math.log1p(mean), max(sum(s * s for s in sizes) / n - mean ** 2, 0) ** 0.5 / 10, math.log1p(max(sizes)),
                    sum(s == 1 for s in sizes) / n, math.log1p(n)]
        out.append(x)
    return out


def test_quality_scores_match_plain_attention(spark):
    """Features byte by byte, gated attention passage by passage, as the definition says."""
    import numpy as np

    rng = np.random.default_rng(9)
    p = {"W": rng.normal(0, 0.2, (80, 5)), "b": rng.normal(size=5), "V": rng.normal(size=(5, 3)), "U": rng.normal(size=(5, 3)),
         "w": rng.normal(size=3), "c": rng.normal(size=5), "d": np.array(0.3)}
    model = quality.Model(rng.normal(size=80), rng.uniform(0.5, 2, 80), p)
    texts = [None, "", "One two, two! 3% of $#", "Größe ÄÖ x\ty\nz " * 40, cases.LONG[:3000], "a b a b a b " * 30 + "tail"]
    want = []
    for text in texts:
        h = [np.tanh((np.array(x) - model.shift) / model.scale @ p["W"] + p["b"]) for x in plain_passages(text)]
        gate = np.exp([(np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"] for v in h])
        z = sum(g * v for g, v in zip(gate / gate.sum(), h))
        want.append(1 / (1 + np.exp(-(z @ p["c"] + p["d"]))))
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-9)


def test_language_matches_plain_centroids(spark):
    """Trigrams of a padded, letters-only text, TF-IDF by hand, cosine with every centroid."""
    import re

    import numpy as np

    rng = np.random.default_rng(4)
    centroids = rng.random((5, language.BUCKETS)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    model = language.Model(rng.random(language.BUCKETS), ["a", "a", "b", "c", "c"], centroids, np.full(5, 0.02))
    texts = ["The quick brown fox", "Größe, ähnlich! größe", "x", "ab 12 cd-ef", None, "123 !!"]
    for text, got in zip(texts, zip(*[iter(model.predict(texts)[k]) for k in ("lang", "score", "rejected")])):
        weights = {}
        padded = b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode()).strip(b" ") + b" "
        for i in range(len(padded) - 2):
            if padded[i + 1] != 32:
                code = padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]
                bucket = (code * 2654435761 % 2 ** 32) >> 20
                weights[bucket] = weights.get(bucket, 0) + 1
        v = np.zeros(language.BUCKETS)
        for bucket, n in weights.items():
            v[bucket] = np.log1p(n) * model.idf[bucket]
        cosine = centroids @ (v / max(np.linalg.norm(v), 1e-9))
        best = int(cosine.argmax())
        letters = any(c.isalpha() for c in text or "")
        assert got[0] == (model.langs[best] if letters else "und")
        assert abs(got[1] - (cosine[best] if letters else 0)) < 1e-5 and got[2] == (not letters or cosine[best] < 0.02)
