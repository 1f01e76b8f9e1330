"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose rate (symbols, repeated lines, repeated words, capitals, word length) is above a cutoff.
Cutoffs are chosen per stratum on labelled texts: going from the loosest to the tightest, a cutoff is certified while an
exact binomial test shows that it rejects at most a given share of good texts. The tests of one rule are done in this
fixed order, which needs no correction; the error level is divided by the number of rules and strata (Bonferroni), and
so is the risk by the number of rules. With probability 1 - ``error`` no stratum loses more than ``risk`` of its good texts.
All certified cutoffs hold at once, so any of them may be used: the loosest that rejects as many bad texts as the tightest,
counting those that no earlier rule rejects.

Null and empty texts have no words and fail the base. Whole texts are measured, however long. A text whose rate equals the
cutoff stays. Repeated rows and ids each give a row; an id labelled twice counts with its larger label. An empty table
gives an empty one, and strata with too few labelled texts certify no cutoff. Extra columns are not read.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import map_texts, query, table
from stratalens.llm.text import Words, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[65:91] = True
BLANKS = " \t\n\v\f\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]
#: Rate of each rule, its loosest and its tightest cutoff; ``STEPS`` cutoffs in geometric progression between them.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 1.0, 0.01),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", 0.9, 0.1),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.5, 0.1),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.9, 0.1),
    "length": ("word_chars / greatest(n_words, 1)", 50.0, 8.0),
}
STEPS = 24
MAX_STRATA = 10_000


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts of each whole text; a null text counts as an empty one."""
    words = Words(texts)

    def per_doc(flags):
        running = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(running[words.offsets])

    h = words.hashes()[0]
    w, at = windows(h, words.bounds, 3)
    doc = words.doc[at]
    order = np.lexsort((w, doc))
    same = (w[order][1:] == w[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = np.zeros(len(h), bool)
    for k in range(3):
        repeated[at[twice] + k] = True
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] if t else [] for t in texts]
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": per_doc(words.inside & ((words.buf & 0xC0) != 0x80)),
        "n_symbols": per_doc(SYMBOLS[words.buf]),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": np.bincount(words.doc[repeated], minlength=len(texts)),
        "n_capitals": per_doc(CAPITALS[words.buf]),
    }


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X, summed downwards from k until the terms vanish."""
    if k >= n:
        return 1.0
    term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))
    total, odds = term, (1 - p) / p
    while k > 0:
        term *= k / (n - k + 1) * odds
        k -= 1
        total += term
        if term < total * 1e-17 and k < n * p:
            break
    return min(total, 1.0)


def cutoffs(rule: str) -> list[float]:
    loose, tight = RULES[rule][1:]
    return [loose * (tight / loose) ** (i / (STEPS - 1)) for i in range(STEPS)]


def certify(n: int, rejected: list[int], risk: float, error: float) -> int:
    """How many of the cutoffs, loosest first, are certified to reject at most ``risk`` of good texts."""
    good = 0
    for k in rejected:
        if n == 0 or at_most(k, n, risk) > error:
            break
        good += 1
    return good


def calibrate(measured: DataFrame, labels: DataFrame, *, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """Per stratum the certified cutoff of each rule; null where none is, or where none rejects a text labelled bad.

    ``measured``: ``id``, ``stratum``, ``base_failed`` and the rates. Good texts that fail the base are left out, as the
    rules never see them. One row per stratum comes to the driver (up to ``MAX_STRATA``, else an error).
    """
    marked = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("quality"))
    names = [r.name for r in measured.groupBy(F.col("stratum").alias("name")).agg(F.count("*").alias("rows"))
             .limit(MAX_STRATA + 1).collect()]
    if len(names) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    held = runtime.materialise(measured.filter("not base_failed").join(marked, F.col("id") == F.col("of"))
                               .select("stratum", "quality", *RULES))

    def rejected(rows: DataFrame, rules: list[str]) -> dict:
        counted = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r in rules for i, c in enumerate(cutoffs(r))]
        return {r.stratum: r for r in rows.groupBy("stratum").agg(F.count("*").alias("n"), *counted).collect()}

    good = rejected(held.filter("quality = 1"), list(RULES))
    kind = "cut_stratum string, " + ", ".join(f"cut_{r} double" for r in RULES)
    cuts = {name: dict.fromkeys(RULES) for name in names}
    table = None
    for rule in RULES:  # bad texts that an earlier rule rejects need no second one
        rows = held.filter("quality = 0")
        if table is not None:
            rows = rows.join(table, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left").filter(_broken().isNull())
        bad = rejected(rows, [rule])
        for name, cut in cuts.items():
            steps = [good[name][f"{rule}_{i}"] for i in range(STEPS)] if name in good else []
            passed = certify(good[name].n if name in good else 0, steps, risk / len(RULES), error / len(RULES) / len(names))
            found = [bad[name][f"{rule}_{i}"] for i in range(passed)] if name in bad else []
            most = max(found, default=0)
            cut[rule] = cutoffs(rule)[found.index(most)] if most else None
        table = F.broadcast(measured.sparkSession.createDataFrame(
            [(name, *cut.values()) for name, cut in cuts.items()], kind))
    return table


def _broken():
    """The first rule whose cutoff a text is above."""
    return F.coalesce(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", stratum_col="lang",
          risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The measures of every row, ``base_failed``, ``kept`` and ``broken`` (the first rule it breaks, or null).

    A null stratum is a stratum. Without labels no cutoff is certified and only the base decides. Repeated rows are
    judged each for itself.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
                       F.col(text_col).alias("text"))
    found = map_texts(rows, "text", measure, ", ".join(f"{m} long" for m in MEASURES))
    found = found.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    measured = runtime.materialise(found).select("*", *[F.expr(RULES[r][0]).alias(r) for r in RULES])
    cuts = calibrate(measured, labels, risk=risk, error=error)
    return (measured.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
            .select(F.col("id").alias("doc_id"), *MEASURES, "base_failed", _broken().alias("broken"))
            .withColumn("kept", ~F.col("base_failed") & F.col("broken").isNull()))


@query("op8_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "broken")
