from pyspark.sql import functions as F

import pytest

from stratalens.functions import labels, recode
from stratalens.operators import columns
from stratalens.plans import analysis
from stratalens.sources.tables import normalise_names

# soft age, hard age -> flag; the published truth table and its NULL cases
BEFOR_CASES = [
    (20, 993, None), (20, 999, 1), (991, 993, 0), (991, 999, 0), (999, 993, 0), (20, 30, 1), (30, 20, 0),
    (20, 20, 0), (20, 991, 1), (991, 991, 0), (991, 30, 0), (None, 993, None), (None, 999, None),
    (None, 30, None), (20, None, None), (None, None, None), (993, 999, 0),
]


def test_befor_truth_table(spark):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(BEFOR_CASES)], "i int, s int, h int")
    got = {r["i"]: r["f"] for r in df.select("i", F.expr(recode.befor_flag("s", "h")).alias("f")).collect()}
    assert [got[i] for i in range(len(BEFOR_CASES))] == [c[2] for c in BEFOR_CASES]


def test_null_rules(spark):
    df = spark.createDataFrame([(None, 3, 9), (5, 3, 1), (993, None, None)], "a int, b int, c int")
    rows = df.select(
        F.expr(recode.rowwise_min(["a", "b"])).alias("low"),
        F.expr(recode.rowwise_min_skipna(["a", "b"])).alias("low_known"),
        F.expr(recode.imputation_recode("c")).alias("imp"),
        F.expr(recode.ever_flag_known_or_993("a")).alias("ever"),
        F.expr(recode.any_flag([recode.as_flag("a = 5"), recode.as_flag("b = 4")])).alias("either"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (None, 3, 0, None, None), (3, 3, 0, 1, 1), (None, 993, 1, 1, None)]


def test_smoking_order_is_never_violated_by_sorted_ages(spark):
    ages = [12, 30, 991, 999]
    rows = [(f, e, h) for f in ages for e in ages if e >= f for h in (20, 40, 991, 993, 999)]
    df = spark.createDataFrame(rows, "FSM int, ESM int, COC int")
    first, daily = recode.befor_flag("FSM", "COC"), recode.befor_flag("ESM", "COC")
    assert df.filter(F.expr(f"({daily}) > ({first})")).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("GENDER", 1), ("GENDER", 9), ("RLGINF", 4), ("X", None)], "v string, c int")
    table = {"GENDER": ["M", "F"], "RLGINF": ["a", "b", "c", "d"]}
    with_default = [r[0] for r in df.select(labels.label_lookup(F.col("v"), F.col("c"), table)).collect()]
    strict = [r[0] for r in df.select(labels.label_lookup(F.col("v"), F.col("c"), table, False)).collect()]
    assert with_default == ["M", "9", "d", None]
    assert strict == ["M", None, "d", None]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, B int")
    assert normalise_names(df).columns == ["A", "B"]
    with pytest.raises(ValueError):
        normalise_names(spark.createDataFrame([(1, 2)], "a int, b int").toDF("x", "X"))
    with pytest.raises(ValueError):
        columns.select_columns(df, ["a", "missing"])


def test_rowsum_filter_drops_unknown(spark):
    df = spark.createDataFrame([(1, None), (0, 0), (0, 1)], "a int, b int")
    assert columns.filter_rowsum_positive(df, ["a", "b"]).count() == 1
    assert columns.filter_any_nonzero(df, ["a", "b"]).count() == 2


def test_hdg_modes_differ_only_for_unknown_age(spark):
    names = ["COC", "HER", "CRK", "HAL", "MTH", "SED", "TRQ", "PNK", "STM"]
    rows = [(991, 991, 991, 991, 991, 993, 999, 999, 999), (20, 991, 991, 991, 991, 999, 999, 999, 999),
            (991, 991, 991, 991, 991, 999, 999, 999, 999)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    for s in ("ESM", "FSM", "VAP", "ALC", "MRJ"):
        df = df.withColumn(s, F.lit(15))
    wide = analysis.with_aggregates(df)
    got = [[r[0] for r in wide.select(F.expr(analysis.ever_columns(compat)["EVER_HDG"])).collect()] for compat in (False, True)]
    assert got == [[1, 1, 0], [0, 1, 0]]
