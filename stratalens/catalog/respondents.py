"""Survey-shaped view over the order tables: one respondent per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.schema import IMPUTED, NEVER_USED, NON_USER, RENAME, USER_AGE_UNKNOWN

SOFT_PRIORITY = {"ALC": "1-URGENT", "FSM": "2-HIGH", "VAP": "3-MEDIUM", "MRJ": "4-NOT SPECIFIED"}
HIGH_DISCOUNT = {"COC": "AF", "HER": "AO", "CRK": "NF", "HAL": "NO", "MTH": "RF", "SED": "RO"}
LOW_DISCOUNT = {"TRQ": "AF", "PNK": "NF", "STM": "RF"}
PRESCRIPTION_CUT = 80
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def event_age(day: str) -> str:
    return f"cast(12 + datediff({day}, date'1995-01-01') div 30 as int)"


def line_ages(lineitem: DataFrame) -> DataFrame:
    """Smallest age per order and item; only the two discount bands leave the scan."""
    rows = lineitem.filter("l_discount >= 0.095 or l_discount < 0.005").selectExpr(
        "l_orderkey", "l_returnflag || l_linestatus as flag", "l_discount as discount",
        event_age("l_shipdate") + " as age",
    )
    bands = [("discount >= 0.095", HIGH_DISCOUNT), ("discount < 0.005", LOW_DISCOUNT)]
    return rows.groupBy("l_orderkey").agg(*[
        F.expr(f"min(age) filter (where {band} and flag = '{flag}') as {item}")
        for band, items in bands for item, flag in items.items()
    ])


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, design columns, item ages with sentinels, demographics, imputation codes.

    Lines are reduced per order before they meet the orders, and both soft and
    hard ages are then reduced per customer in one aggregation.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", event_age("o_orderdate") + " as age")
    hard_items = [*HIGH_DISCOUNT, *LOW_DISCOUNT]
    per_order = orders.join(
        line_ages(read("lineitem")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ages = per_order.groupBy(F.col("o_custkey").alias("age_key")).agg(
        *[F.expr(f"min(age) filter (where o_orderpriority = '{p}') as {i}") for i, p in SOFT_PRIORITY.items()],
        *[F.min(i).alias(i) for i in hard_items],
    )
    second = (
        orders.filter(F.col("o_orderpriority") == SOFT_PRIORITY["FSM"])
        .withColumn("place", F.row_number().over(
            Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
        .filter("place <= 2").groupBy(F.col("o_custkey").alias("daily_key"))
        .agg(F.expr("max(age) filter (where place = 2) as ESM"))
    )
    base = (
        read("customer")
        .join(ages, F.col("c_custkey") == F.col("age_key"), "left")
        .join(second, F.col("c_custkey") == F.col("daily_key"), "left")
    )

    def age(item: str) -> str:
        prescription = item in ("SED", *LOW_DISCOUNT)
        absent = NEVER_USED if prescription or item == "ESM" else NON_USER
        value = f"if({item} >= {PRESCRIPTION_CUT}, {USER_AGE_UNKNOWN}, {item})" if prescription else item
        return f"cast(coalesce({value}, {absent}) as int) as {item}"

    def cycle(step: int, size: int, name: str) -> str:
        return f"cast(1 + (c_custkey div {step}) % {size} as int) as {name}"

    code = "case c_custkey % 10 when 7 then 9 when 8 then 3 when 9 then null else 1 end"
    segments = ", ".join(f"'{x}'" for x in SEGMENTS)
    return base.selectExpr(
        "c_custkey as rid",
        "c_nationkey % 5 as VESTR_C",
        "cast(1 + c_custkey % 2 as int) as VEREP",
        "cast(round((c_acctbal + 1000) * 100) as bigint) as w_cents",
        *[age(i) for i in ("ESM", *SOFT_PRIORITY, *hard_items)],
        cycle(2, 2, "GENDER"), cycle(1, 11, "AGEPRC"), cycle(11, 4, "CATAGE"), cycle(1, 7, "NEWRACE2"),
        cycle(5, 4, "TOTINC"), cycle(7, 5, "EDUCAT"), cycle(13, 3, "POPDEN"),
        f"cast(array_position(array({segments}), c_mktsegment) as int) as RLGIFA", cycle(3, 5, "RLGIFY"),
        *[f"{code} as {i}_IMP" for i in IMPUTED],
    )


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same respondents under the raw column names, in mixed case."""
    raw_name = {new: old for old, new in RENAME.items()}
    raw_name.update(CATAGE="CATAGE", NEWRACE2="NEWRACE2", w_cents="ANALWT2_C")
    df = respondents(spark, sf_dir)
    return df.toDF(*[raw_name.get(c, c).capitalize() for c in df.columns])
