"""The survey views as SQL common table expressions, for the oracle queries."""

from __future__ import annotations

from stratalens import schema as s
from stratalens.catalog import respondents as r

HARD_ITEMS = [*r.HIGH_DISCOUNT, *r.LOW_DISCOUNT]


def _age(day: str) -> str:
    return f"12 + CAST(date_diff('day', DATE '1995-01-01', CAST({day} AS DATE)) AS BIGINT) // 30"


def _item(name: str) -> str:
    prescription = name in ("SED", *r.LOW_DISCOUNT)
    absent = 999 if prescription or name == "ESM" else 991
    value = f"CASE WHEN a.{name} >= 80 THEN 993 ELSE a.{name} END" if prescription else name
    return f"CAST(COALESCE({value}, {absent}) AS INTEGER) AS {name}"


def _cycle(step: int, size: int, name: str) -> str:
    return f"CAST(1 + (c_custkey // {step}) % {size} AS INTEGER) AS {name}"


RESPONDENTS = f"""
ord AS MATERIALIZED (
  SELECT o_orderkey, o_custkey, o_orderpriority AS pri, o_orderdate, {_age('o_orderdate')} AS age FROM orders),
line AS MATERIALIZED (
  SELECT o_custkey, l_returnflag || l_linestatus AS flag, l_discount AS d, {_age('l_shipdate')} AS age
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount >= 0.095 OR l_discount < 0.005),
hard AS (SELECT o_custkey, {', '.join(f"MIN(age) FILTER (d >= 0.095 AND flag = '{f}') AS {i}" for i, f in r.HIGH_DISCOUNT.items())},
  {', '.join(f"MIN(age) FILTER (d < 0.005 AND flag = '{f}') AS {i}" for i, f in r.LOW_DISCOUNT.items())}
  FROM line GROUP BY o_custkey),
soft AS (SELECT o_custkey, {', '.join(f"MIN(age) FILTER (pri = '{p}') AS {i}" for i, p in r.SOFT_PRIORITY.items())}
  FROM ord GROUP BY o_custkey),
daily AS (SELECT o_custkey, age AS ESM FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n
  FROM ord WHERE pri = '2-HIGH') WHERE n = 2),
respondents AS MATERIALIZED (
  SELECT c_custkey AS rid, c_nationkey % 5 AS VESTR_C, CAST(1 + c_custkey % 2 AS INTEGER) AS VEREP,
    CAST(ROUND((c_acctbal + 1000) * 100) AS BIGINT) AS w_cents,
    {', '.join(_item(i) for i in ['ESM', *r.SOFT_PRIORITY])},
    {', '.join(_item(i).replace('a.', 'hard.') for i in HARD_ITEMS)},
    {_cycle(2, 2, 'GENDER')}, {_cycle(1, 11, 'AGEPRC')}, {_cycle(11, 4, 'CATAGE')}, {_cycle(1, 7, 'NEWRACE2')},
    {_cycle(5, 4, 'TOTINC')}, {_cycle(7, 5, 'EDUCAT')}, {_cycle(13, 3, 'POPDEN')},
    CAST(list_position([{', '.join(repr(x) for x in r.SEGMENTS)}], c_mktsegment) AS INTEGER) AS RLGIFA,
    {_cycle(3, 5, 'RLGIFY')},
    {', '.join(f"CAST(CASE c_custkey % 10 WHEN 7 THEN 9 WHEN 8 THEN 3 WHEN 9 THEN NULL ELSE 1 END AS INTEGER) AS {i}_IMP" for i in s.IMPUTED)}
  FROM customer LEFT JOIN soft ON c_custkey = soft.o_custkey
    LEFT JOIN hard ON c_custkey = hard.o_custkey LEFT JOIN daily ON c_custkey = daily.o_custkey)"""


def befor(soft: str, hard: str) -> str:
    return (f"CASE WHEN {hard} IN (993, 999) THEN CASE WHEN {soft} < 150 THEN CASE WHEN {hard} = 999 THEN 1 END "
            f"WHEN {soft} >= 150 THEN 0 END WHEN {soft} < {hard} THEN 1 WHEN {soft} >= {hard} THEN 0 END")


def row_min(columns: list[str]) -> str:
    some_null = " OR ".join(f"{c} IS NULL" for c in columns)
    return f"CASE WHEN {some_null} THEN NULL ELSE least({', '.join(columns)}) END"


def ever_basic(c: str) -> str:
    return f"CASE WHEN {c} < 100 THEN 1 WHEN {c} IS NOT NULL THEN 0 END"


def ever_known(c: str) -> str:
    return f"CASE WHEN {c} < 100 OR {c} = 993 THEN 1 WHEN {c} IS NOT NULL THEN 0 END"


ETHNIC = ("CASE WHEN NEWRACE2 IN (3, 4, 5, 6) THEN 4 WHEN NEWRACE2 = 1 THEN 1 WHEN NEWRACE2 = 2 THEN 2 "
          "WHEN NEWRACE2 = 7 THEN 3 END")
RLGINF = ("CASE WHEN CATAGE = 1 AND RLGIFY IN (1, 2, 3, 4) THEN RLGIFY "
          "WHEN CATAGE <> 1 AND RLGIFA IN (1, 2, 3, 4) THEN RLGIFA END")
AGGREGATE_COLUMNS = ", ".join(f"{row_min(m)} AS {n}" for n, m in s.AGGREGATES.items())


def _analysis(compat: bool) -> str:
    flags = [f"{befor(x, h)} AS {x}_befor_{h}" for x in ("ALC", "VAP", "MRJ") for h in s.HARD]
    flags += [f"({befor('FSM', h)}) + ({befor('ESM', h)}) AS SMK_befor_{h}" for h in s.HARD]
    ever = [f"{ever_basic(i)} AS EVER_{i}" for i in [*s.SOFT, "NMD", *s.NONMEDICAL]]
    ever += [f"{ever_known(i)} AS EVER_{i}" for i in ["MED", *s.PRESCRIPTION]]
    if compat:
        ever.append(f"{ever_known('HDG')} AS EVER_HDG")
    else:
        used = [f"({ever_basic(i)}) = 1" for i in s.NONMEDICAL] + [f"({ever_known(i)}) = 1" for i in s.PRESCRIPTION]
        ever.append(f"CASE WHEN {' OR '.join(used)} THEN 1 ELSE 0 END AS EVER_HDG")
    imp = [f"CASE WHEN {i}_IMP IN (1, 9) THEN 0 ELSE 1 END AS {i}_IMP" for i in s.IMPUTED]
    ages = ", ".join([*s.ITEMS, *s.AGGREGATES])
    return f"""
analysis AS MATERIALIZED (
  SELECT rid, VEREP, VESTR_C, w_cents AS ANALWT2_C, {ages}, {', '.join(flags)}, {', '.join(ever)}, {', '.join(imp)},
    GENDER, AGEPRC, TOTINC, {ETHNIC} AS ETHNIC, EDUCAT, POPDEN, {RLGINF} AS RLGINF
  FROM (SELECT *, {AGGREGATE_COLUMNS} FROM respondents))"""


ANALYSIS = _analysis(False)
ANALYSIS_COMPAT = _analysis(True)


def survey(select: str, *ctes: str, compat: bool = False) -> str:
    """A query over ``respondents`` and ``analysis`` with further CTEs."""
    view = ANALYSIS_COMPAT if compat else ANALYSIS
    return "WITH " + ",\n".join([RESPONDENTS, view, *ctes]) + "\n" + select


def respondents_sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([RESPONDENTS, *ctes]) + "\n" + select


def melt(table: str, columns: list[str], ids: str = "", name: str = "variable", value: str = "value") -> str:
    """NULL-keeping unpivot of columns of one type."""
    prefix = f"{ids}, " if ids else ""
    cells = ", ".join(f"{{'n': '{c}', 'v': {c}}}" for c in columns)
    return (f"(SELECT {prefix}u.n AS {name}, u.v AS {value} FROM (SELECT {prefix}unnest([{cells}]) AS u FROM {table}))")
