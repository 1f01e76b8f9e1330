"""Aggregations, sorts and the Guttman scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens import schema as s
from stratalens.catalog.base import Tables, query
from stratalens.catalog.recoding import RATES_SQL
from stratalens.catalog.shaping import AGES_LONG, EVER, IMP, RATE, WHOLE, ages_long
from stratalens.catalog.views import befor, melt, survey
from stratalens.functions import recode
from stratalens.operators import columns as c
from stratalens.operators import describe, guttman
from stratalens.plans import analysis

W = "CAST(sum(ANALWT2_C) AS BIGINT)"


@query("weighted_rate", survey(RATES_SQL))
def _(t: Tables):
    return describe.weighted_rate(t.analysis(), EVER, s.WEIGHT).orderBy("Proportion")


@query("unweighted_rate", survey(" UNION ALL ".join(
    f"SELECT '{x}' AS Drug, CAST(sum({x}) * 100 AS DOUBLE) / count({x}) AS Proportion FROM analysis" for x in EVER)))
def _(t: Tables):
    return describe.unweighted_rate(t.analysis(), EVER)


@query("imputation_share", survey(" UNION ALL ".join(
    f"SELECT '{x}' AS variable, CAST(sum({x}) * 100 AS DOUBLE) / count({x}) AS \"values\" FROM analysis" for x in IMP)))
def _(t: Tables):
    return describe.unweighted_rate(t.analysis(), IMP, name="variable", value="values").orderBy("values")


BEFOR = {s.ever(h): [s.befor(x, h) for x in s.PRIOR_USE] for h in s.HARD if h != "HDG"}


@query("crosstab_long", survey(" UNION ALL ".join(
    f"SELECT '{o}' AS outcome, ever, befor_var, befor_value, count(*) AS frequency FROM "
    + melt(f"(SELECT * FROM analysis WHERE {' AND '.join(f'{p} IS NOT NULL' for p in [o, *ps])})",
           ps, f"{o} AS ever", "befor_var", "befor_value").replace(f"SELECT {o} AS ever, u.n", "SELECT ever, u.n")
    + " GROUP BY ALL" for o, ps in BEFOR.items())))
def _(t: Tables):
    return describe.crosstab_long(t.analysis(), BEFOR)


@query("weighted_bar", survey(
    f"SELECT variable, category, {W} AS total FROM {melt('analysis', s.DEMOGRAPHIC, 'ANALWT2_C', 'variable', 'category')} "
    "GROUP BY ALL"))
def _(t: Tables):
    return describe.category_totals(t.analysis(), s.DEMOGRAPHIC, s.WEIGHT)


def share_sql(total: str) -> str:
    return (f"SELECT *, CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY variable) AS DOUBLE) AS share FROM "
            f"(SELECT variable, category, {total} AS total FROM "
            f"{melt('analysis', s.DEMOGRAPHIC, 'ANALWT2_C', 'variable', 'category')} GROUP BY ALL)")


@query("weighted_share_in_group", survey(share_sql(W)))
def _(t: Tables):
    return describe.share_in_group(describe.category_totals(t.analysis(), s.DEMOGRAPHIC, s.WEIGHT))


@query("unweighted_share_in_group", survey(share_sql("count(*)")))
def _(t: Tables):
    return describe.share_in_group(describe.category_totals(t.analysis(), s.DEMOGRAPHIC))


REAL = f"real AS MATERIALIZED (SELECT drugs, age, ANALWT2_C AS w FROM {AGES_LONG} WHERE age < 100)"


def real_ages(t: Tables):
    return ages_long(t).filter(F.col("age") < s.REAL_AGE_BELOW)


@query("weighted_quantiles", survey(
    "SELECT drugs, q1, q2, q3, CAST(min(age) FILTER (inside) AS INTEGER) AS whisker_low, "
    "CAST(max(age) FILTER (inside) AS INTEGER) AS whisker_high, "
    "CAST(coalesce(sum(w) FILTER (NOT inside), 0) AS BIGINT) AS outlier_weight "
    "FROM (SELECT r.*, q1, q2, q3, age >= q1 - 1.5 * (q3 - q1) AND age <= q3 + 1.5 * (q3 - q1) AS inside "
    "FROM real r JOIN box USING (drugs)) GROUP BY ALL", REAL,
    "cum AS (SELECT drugs, age, sum(sum(w)) OVER (PARTITION BY drugs ORDER BY age) AS c, "
    "sum(sum(w)) OVER (PARTITION BY drugs) AS total FROM real GROUP BY drugs, age)",
    "box AS (SELECT drugs, " + ", ".join(f"min(age) FILTER (c * 4 >= total * {q}) AS q{q}" for q in (1, 2, 3))
    + " FROM cum GROUP BY drugs)"))
def _(t: Tables):
    return describe.weighted_quantiles(real_ages(t), "drugs", "age", s.WEIGHT)


@query("weighted_density", survey(
    "SELECT drugs, slot, round(low + slot * (high - low) / 63.0, 6) AS at, round(sum(w * exp(-0.5 * "
    "((low + slot * ((high - low) / 63.0) - age) / bw) ** 2)) / (any_value(total) * any_value(bw) * sqrt(2 * pi())), 6) AS density "
    "FROM (SELECT drugs, age, sum(w) AS w FROM real GROUP BY ALL) JOIN stats USING (drugs), "
    "(SELECT CAST(unnest(range(64)) AS INTEGER) AS slot) GROUP BY drugs, slot, low, high", REAL,
    "stats AS (SELECT drugs, min(age) AS low, max(age) AS high, sum(w) AS total, 0.9 * least(stddev_samp(age), "
    "(quantile_cont(age, 0.75) - quantile_cont(age, 0.25)) / 1.34) * count(*) ** (-0.2) AS bw FROM real GROUP BY drugs)"))
def _(t: Tables):
    density = describe.weighted_density(real_ages(t), "drugs", "age", s.WEIGHT)
    return density.select("drugs", "slot", F.round("at", 6).alias("at"), F.round("density", 6).alias("density"))


#: The whole dataset: demographic columns and a text as factors, everything else as numbers.
PROFILE_FACTOR = [*s.DEMOGRAPHIC, "SEX"]
PROFILE_NUMERIC = [x for x in WHOLE if x not in PROFILE_FACTOR]
SEX = "CASE GENDER WHEN 1 THEN 'M' WHEN 2 THEN 'F' END"


def profile_sql() -> str:
    parts = []
    for x in [*PROFILE_NUMERIC, *PROFILE_FACTOR]:
        number = x in PROFILE_NUMERIC
        pick = lambda e: e if number else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{x}' AS variable, count(*) - count({x}) AS n_missing, CAST(count({x}) AS DOUBLE) / count(*) AS complete_rate, "
            f"{pick(f'round(avg({x}), 6)')} AS mean, {pick(f'round(stddev_samp({x}), 6)')} AS sd, "
            + ", ".join(f"{pick(f'CAST(quantile_cont({x}, {p / 100}) AS DOUBLE)')} AS p{p}" for p in (0, 25, 50, 75, 100))
            + (", CAST(NULL AS BIGINT) AS n_unique, CAST(NULL AS VARCHAR) AS top_value, CAST(NULL AS BIGINT) AS top_count"
               if number else
               f", count(DISTINCT {x}) AS n_unique, (SELECT CAST({x} AS VARCHAR) FROM profiled WHERE {x} IS NOT NULL "
               f"GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1) AS top_value, "
               f"(SELECT max(n) FROM (SELECT count(*) AS n FROM profiled WHERE {x} IS NOT NULL GROUP BY {x})) AS top_count")
            + " FROM profiled")
    return " UNION ALL ".join(parts)


@query("column_profile", survey(profile_sql(), f"profiled AS MATERIALIZED (SELECT *, {SEX} AS SEX FROM analysis)"))
def _(t: Tables):
    profile = describe.column_profile(t.analysis().withColumn("SEX", F.expr(SEX)), PROFILE_NUMERIC, PROFILE_FACTOR)
    return profile.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


ALL_COLUMNS = WHOLE


@query("missing_report", survey(
    "SELECT variable, N, printf('%.2f', round_even(CAST(N AS DOUBLE) / rows, 2)) AS \"Missing share\" FROM ("
    + " UNION ALL ".join(f"SELECT '{x}' AS variable, count(*) - count({x}) AS N, count(*) AS rows FROM analysis"
                         for x in ALL_COLUMNS) + ") WHERE N > 0"))
def _(t: Tables):
    return describe.missing_report(t.analysis(), ALL_COLUMNS)


@query("rows_with_any_null", survey(
    "SELECT count(*) FILTER (" + " OR ".join(f"{x} IS NULL" for x in ALL_COLUMNS) + ") AS rows_with_null FROM analysis"))
def _(t: Tables):
    return describe.rows_with_any_null(t.analysis())


@query("table_dims", survey("SELECT count(*) AS n_rows, CAST(109 AS INTEGER) AS n_columns FROM analysis"))
def _(t: Tables):
    return describe.table_dims(t.analysis())


@query("order_violation_check", survey(" UNION ALL ".join(
    f"SELECT '{h}' AS item, coalesce(bool_or(({befor('ESM', h)}) > ({befor('FSM', h)})), false) AS violated FROM analysis"
    for h in s.HARD)))
def _(t: Tables):
    flags = analysis.with_aggregates(t.selected())
    pairs = {h: (recode.befor_flag("ESM", h), recode.befor_flag("FSM", h)) for h in s.HARD}
    return describe.order_violation_check(flags, pairs)


@query("global_min_scalar", survey(
    "SELECT rid, (SELECT least(min(FSM), min(VAP)) FROM analysis) AS NIC FROM analysis"))
def _(t: Tables):
    return describe.global_min_scalar(t.analysis().select("rid", "FSM", "VAP"), ["FSM", "VAP"], "NIC").select("rid", "NIC")


GUTTMAN_COC = ["FSM", "ALC", "MRJ", "COC"]


@query("modal_frequency_column", survey(
    f"SELECT variable, max(n) AS modal_count FROM (SELECT variable, value, count(*) AS n FROM {melt('analysis', GUTTMAN_COC)} "
    "GROUP BY ALL) GROUP BY variable"))
def _(t: Tables):
    return describe.modal_frequency_column(t.analysis(), GUTTMAN_COC)


MODAL_ROW = "greatest(" + ", ".join(
    "(" + " + ".join(f"CAST({x} = {y} AS INTEGER)" for y in GUTTMAN_COC) + ")" for x in GUTTMAN_COC) + ")"


@query("modal_frequency_row", survey(f"SELECT rid, {MODAL_ROW} AS modal FROM analysis"))
def _(t: Tables):
    return t.analysis().select("rid", describe.modal_frequency_row([F.col(x) for x in GUTTMAN_COC]).alias("modal"))


@query("weighted_prevalence_cutoff", survey(" UNION ALL ".join(
    f"SELECT 'EVER_{h}' AS outcome, {RATE.format(x='EVER_' + h)} AS cutoff FROM analysis" for h in s.HARD)))
def _(t: Tables):
    long = c.apply_by_outcome(t.analysis(), [s.ever(h) for h in s.HARD], lambda o: {"y": o, "w": s.WEIGHT})
    return describe.weighted_prevalence_cutoff(long, ["outcome"], "y", "w")


def placed(df):
    """The place of each row as it leaves a sort, which a comparison of row sets would not see."""
    # a report has one row per column name, and its sorted partitions are read in order
    return df.coalesce(1).withColumn("position", (F.monotonically_increasing_id() + 1).cast("int"))


PLACE = "CAST(row_number() OVER (ORDER BY {}) AS INTEGER) AS position"


@query("sort_desc", survey(f"SELECT *, {PLACE.format('Proportion DESC, Drug')} FROM ({RATES_SQL})"))
def _(t: Tables):
    return placed(describe.weighted_rate(t.analysis(), EVER, s.WEIGHT).orderBy(F.desc("Proportion"), "Drug"))


@query("sort_asc", survey(f'SELECT *, {PLACE.format(chr(34) + "values" + chr(34) + ", variable")} FROM (' + " UNION ALL ".join(
    f"SELECT '{x}' AS variable, CAST(sum({x}) * 100 AS DOUBLE) / count({x}) AS \"values\" FROM analysis" for x in IMP) + ")"))
def _(t: Tables):
    return placed(describe.unweighted_rate(t.analysis(), IMP, name="variable", value="values").orderBy("values", "variable"))


@query("sort_by_custom_order", survey(
    f"SELECT drugs, n, CAST(list_position([{', '.join(repr(i) for i in s.ITEM_ORDER)}], drugs) AS INTEGER) AS place FROM "
    f"(SELECT drugs, count(*) FILTER (age < 100) AS n FROM {AGES_LONG} GROUP BY drugs) ORDER BY place"))
def _(t: Tables):
    from stratalens.functions.labels import level_position

    users = ages_long(t).groupBy("drugs").agg(F.count_if(F.col("age") < 100).alias("n"))
    return c.sort_by_custom_order(users, "drugs", s.ITEM_ORDER).withColumn(
        "place", level_position(F.col("drugs"), s.ITEM_ORDER))


@query("apply_by_outcome", survey(" UNION ALL ".join(
    f"SELECT 'EVER_{h}' AS outcome, count(*) AS n, CAST(sum(EVER_{h}) AS BIGINT) AS used, "
    f"CAST(sum(SMK_befor_{h}) AS BIGINT) AS smoking FROM analysis" for h in s.HARD)))
def _(t: Tables):
    long = c.apply_by_outcome(t.analysis(), [s.ever(h) for h in s.HARD], lambda o: {
        "y": o, "smk": s.befor("SMK", o.removeprefix("EVER_"))})
    return long.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("y").alias("used"), F.sum("smk").alias("smoking"))


# --- Guttman scale ----------------------------------------------------------------------

def guttman_sql(items, compat=False, classical=False):
    nic = "(SELECT least(min(FSM), min(VAP)) FROM analysis)" if compat else "least(FSM, VAP)"
    parts = []
    for item in items:
        for first, expr in (("FSM", "FSM"), ("NIC", nic)):
            used = " OR ".join(f"EVER_{i} <> 0" for i in ("ALC", "FSM", "VAP", "MRJ", item))
            parts.append(f"SELECT '{first}' AS first_item, '{item}' AS item, {expr} AS a, ALC AS b, MRJ AS c, {item} AS d "
                         f"FROM analysis WHERE {used}")
    cells = ["a", "b", "c", "d"]
    same = "greatest(" + ", ".join(
        "(" + " + ".join(f"CAST({x} = {y} AS INTEGER)" for y in cells) + ")" for x in cells) + ")"
    error = ("CAST(a > b AS INTEGER) + CAST(b > c AS INTEGER) + CAST(c > d AS INTEGER)" if classical
             else "CASE WHEN a <= b AND b <= c AND c <= d THEN 0 ELSE 1 END")
    ctes = [
        "g AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")",
        f"per_row AS (SELECT first_item, item, count(*) AS n, CAST(sum({error}) AS BIGINT) AS errors, "
        f"CAST(sum({same}) AS BIGINT) AS modal_rows FROM g GROUP BY ALL)",
        "per_item AS (SELECT first_item, item, CAST(sum(m) AS BIGINT) AS modal_items FROM (SELECT first_item, item, k, max(n) AS m FROM ("
        + " UNION ALL ".join(f"SELECT first_item, item, '{x}' AS k, {x} AS v, count(*) AS n FROM g GROUP BY first_item, item, {x}"
                             for x in cells) + ") GROUP BY ALL) GROUP BY ALL)",
        "scales AS (SELECT first_item, item, n, errors, 1 - CAST(errors AS DOUBLE) / (4 * n) AS CR, 1 - CAST(errors AS DOUBLE) / "
        "least(4 * n - modal_items, 4 * n - modal_rows) AS CS FROM per_row JOIN per_item USING (first_item, item))",
    ]
    return ctes


@query("guttman_order_check", survey(
    "SELECT rid, CASE WHEN f <= a AND a <= m AND m <= c THEN 0 ELSE 1 END AS error FROM (SELECT rid, coalesce(FSM, 999) AS f, "
    "coalesce(ALC, 999) AS a, coalesce(MRJ, 999) AS m, coalesce(COC, 999) AS c FROM analysis)"))
def _(t: Tables):
    return t.analysis().select("rid", guttman.guttman_order_check([F.col(x) for x in GUTTMAN_COC]).alias("error"))


def one_scale(t: Tables, classical=False):
    used = [s.ever(i) for i in ("ALC", "FSM", "VAP", "MRJ", "COC")]
    return guttman.guttman_scales(t.analysis(), {"COC": GUTTMAN_COC}, {"COC": used}, classical)


ONE = "WHERE first_item = 'FSM'"


@query("guttman_cr", survey(f"SELECT item AS scale, n AS rows, errors, CR FROM scales {ONE}", *guttman_sql(["COC"])))
def _(t: Tables):
    return one_scale(t).select("scale", "rows", "errors", "CR")


@query("guttman_cs", survey(f"SELECT item AS scale, errors, CS FROM scales {ONE}", *guttman_sql(["COC"])))
def _(t: Tables):
    return one_scale(t).select("scale", "errors", "CS")


@query("guttman_classical", survey(f"SELECT item AS scale, errors, CR, CS FROM scales {ONE}",
                                   *guttman_sql(["COC"], classical=True)))
def _(t: Tables):
    return one_scale(t, classical=True).select("scale", "errors", "CR", "CS")


@query("guttman_all", survey("SELECT first_item, item, round(CR, 3) AS CR, round(CS, 3) AS CS FROM scales",
                             *guttman_sql(s.SINGLE_HARD)))
def _(t: Tables):
    return guttman.guttman_all(t.analysis(), s.SINGLE_HARD)


@query("guttman_all_compat", survey("SELECT first_item, item, round(CR, 3) AS CR, round(CS, 3) AS CS FROM scales",
                                    *guttman_sql(s.SINGLE_HARD, compat=True)))
def _(t: Tables):
    return guttman.guttman_all(t.analysis(), s.SINGLE_HARD, compat=True)
