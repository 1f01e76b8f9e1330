"""Recoding and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens import schema as s
from stratalens.catalog.base import Tables, query
from stratalens.catalog.shaping import EVER, GROUP_RATE_CTE, IMP, PAIRS_CTE, RATE, group_rates
from stratalens.catalog.views import (
    AGGREGATE_COLUMNS, ETHNIC, RLGINF, befor, ever_basic, ever_known, melt, respondents_sql, survey,
)
from stratalens.functions import labels, recode
from stratalens.operators import columns as c
from stratalens.operators import describe
from stratalens.plans import analysis

E = F.expr
WITH_AGGREGATES = f"wide AS (SELECT *, {AGGREGATE_COLUMNS} FROM respondents)"


def picked(t: Tables, **columns: str):
    return analysis.with_aggregates(t.selected()).select("rid", *analysis.exprs(columns))


@query("befor_flag", respondents_sql(
    f"SELECT rid, {befor('ALC', 'COC')} AS ALC_befor_COC, {befor('MRJ', 'PNK')} AS MRJ_befor_PNK FROM respondents"))
def _(t: Tables):
    return picked(t, ALC_befor_COC=recode.befor_flag("ALC", "COC"), MRJ_befor_PNK=recode.befor_flag("MRJ", "PNK"))


@query("befor_matrix", respondents_sql("SELECT rid, " + ", ".join(
    f"{befor(x, h)} AS {x}_befor_{h}" for x in s.SOFT for h in s.HARD) + " FROM wide", WITH_AGGREGATES))
def _(t: Tables):
    return picked(t, **analysis.befor_columns())


@query("befor_sum", respondents_sql("SELECT rid, " + ", ".join(
    f"({befor('FSM', h)}) + ({befor('ESM', h)}) AS SMK_befor_{h}" for h in s.HARD) + " FROM wide", WITH_AGGREGATES))
def _(t: Tables):
    return picked(t, **analysis.smoking_columns())


@query("rowwise_min", respondents_sql("SELECT rid, MED, NMD, HDG FROM wide", WITH_AGGREGATES))
def _(t: Tables):
    return picked(t, MED="MED", NMD="NMD", HDG="HDG")


def real_ages(t: Tables):
    return c.across_map(t.selected(), s.ITEMS, recode.sentinel_to_null)


NULLED = "nulled AS (SELECT rid, AGEPRC, " + ", ".join(
    f"CASE WHEN {i} <= 100 THEN {i} END AS {i}" for i in s.ITEMS) + " FROM respondents)"


@query("sentinel_to_null", respondents_sql(f"SELECT rid, {', '.join(s.ITEMS)} FROM nulled", NULLED))
def _(t: Tables):
    return real_ages(t).select("rid", *s.ITEMS)


@query("null_to_sentinel", respondents_sql(
    "SELECT rid, " + ", ".join(f"COALESCE({i}, 999) AS {i}" for i in s.ITEMS) + " FROM nulled", NULLED))
def _(t: Tables):
    return c.across_map(real_ages(t), s.ITEMS, recode.null_to_sentinel).select("rid", *s.ITEMS)


@query("rowwise_min_skipna", respondents_sql(f"SELECT rid, least({', '.join(s.SOFT)}) AS MIN_INIT FROM nulled", NULLED))
def _(t: Tables):
    return real_ages(t).select("rid", E(recode.rowwise_min_skipna(s.SOFT)).alias("MIN_INIT"))


@query("rowwise_max_skipna", respondents_sql(
    f"SELECT rid, greatest({', '.join(s.ITEMS)}) AS MAX_INIT FROM nulled", NULLED))
def _(t: Tables):
    return real_ages(t).select("rid", E(recode.rowwise_max_skipna(s.ITEMS)).alias("MAX_INIT"))


@query("init_before_20", respondents_sql(
    f"SELECT rid, CASE WHEN m <= 20 THEN 1 WHEN m > 20 THEN 0 END AS INIT_BFR_20 FROM "
    f"(SELECT rid, least({', '.join(s.SOFT)}) AS m FROM nulled)", NULLED))
def _(t: Tables):
    first = real_ages(t).select("rid", E(recode.rowwise_min_skipna(s.SOFT)).alias("MIN_INIT"))
    return first.select("rid", E(recode.init_before("MIN_INIT")).alias("INIT_BFR_20"))


BANDS = "CASE AGEPRC " + " ".join(f"WHEN {k} THEN {v}" for k, v in s.AGE_BAND_LOWER.items()) + " END"


@query("age_band_lower", respondents_sql(
    f"SELECT rid, {BANDS} AS AGEPRC_LOWER, greatest({BANDS}, {', '.join(s.ITEMS)}) AS ESTAGE FROM nulled", NULLED))
def _(t: Tables):
    lower = recode.age_band_lower("AGEPRC")
    return real_ages(t).select("rid", E(lower).alias("AGEPRC_LOWER"),
                               E(recode.rowwise_max_skipna([lower, *s.ITEMS])).alias("ESTAGE"))


BASIC = [*s.SOFT, "NMD", *s.NONMEDICAL]
KNOWN = ["MED", *s.PRESCRIPTION, "HDG"]


@query("ever_flag_basic", respondents_sql(
    "SELECT rid, " + ", ".join(f"{ever_basic(i)} AS EVER_{i}" for i in BASIC) + " FROM wide", WITH_AGGREGATES))
def _(t: Tables):
    return picked(t, **{s.ever(i): recode.ever_flag_basic(i) for i in BASIC})


@query("ever_flag_known_or_993", respondents_sql(
    "SELECT rid, " + ", ".join(f"{ever_known(i)} AS EVER_{i}" for i in KNOWN) + " FROM wide", WITH_AGGREGATES))
def _(t: Tables):
    return picked(t, **{s.ever(i): recode.ever_flag_known_or_993(i) for i in KNOWN})


@query("ever_flag_hdg_or", survey("SELECT rid, EVER_HDG FROM analysis"))
def _(t: Tables):
    return t.analysis().select("rid", "EVER_HDG")


@query("ever_flag_hdg_compat", survey("SELECT rid, EVER_HDG FROM analysis", compat=True))
def _(t: Tables):
    return t.analysis(compat=True).select("rid", "EVER_HDG")


@query("imputation_recode", survey(f"SELECT rid, {', '.join(IMP)} FROM analysis"))
def _(t: Tables):
    return t.analysis().select("rid", *IMP)


@query("recode_collapse", respondents_sql(f"SELECT rid, {ETHNIC} AS ETHNIC FROM respondents"))
def _(t: Tables):
    return picked(t, ETHNIC=recode.ethnicity_groups("ETHNIC"))


@query("coalesce_by_group", respondents_sql(f"SELECT rid, {RLGINF} AS RLGINF FROM respondents"))
def _(t: Tables):
    return picked(t, RLGINF=recode.religion_influence("AGECAT", "RLGIFY", "RLGIFA"))


def label_rows(table: dict) -> str:
    return "(VALUES " + ", ".join(
        f"('{v}', {i}, '{text.replace(chr(39), chr(39) * 2)}')"
        for v, texts in table.items() for i, text in enumerate(texts, 1)) + ") AS l(v, i, label)"


DEMO_LONG = melt("analysis", s.DEMOGRAPHIC, "rid", "variable", "code")


def demo_long(t: Tables, columns=s.DEMOGRAPHIC):
    return t.analysis().select("rid", *columns).unpivot(["rid"], list(columns), "variable", "code")


@query("label_lookup", survey(
    f"SELECT rid, variable, COALESCE(label, CAST(code AS VARCHAR)) AS label FROM {DEMO_LONG} d "
    f"LEFT JOIN {label_rows(s.LABELS)} ON l.v = d.variable AND l.i = d.code"))
def _(t: Tables):
    label = labels.label_lookup(F.col("variable"), F.col("code"), s.LABELS)
    return demo_long(t).select("rid", "variable", label.alias("label"))


@query("label_lookup_strict", survey(
    f"SELECT Drug, variable, category, label FROM group_rates g LEFT JOIN {label_rows(s.SHORT_LABELS)} "
    "ON l.v = g.variable AND l.i = g.category WHERE variable IN ('ETHNIC', 'GENDER', 'RLGINF')",
    PAIRS_CTE, GROUP_RATE_CTE))
def _(t: Tables):
    label = labels.label_lookup(F.col("variable"), F.col("category"), s.SHORT_LABELS, default_code=False)
    rates = group_rates(t).filter(F.col("variable").isin("ETHNIC", "GENDER", "RLGINF"))
    return rates.select("Drug", "variable", "category", label.alias("label"))


@query("usage_label", survey(
    "SELECT Drug, variable, category, CASE WHEN category IS NULL THEN NULL WHEN category = 0 THEN ' never used' "
    "WHEN category = 1 THEN ' used' ELSE ' addiction' END AS label FROM group_rates "
    "WHERE variable IN ('ALC', 'SMK', 'MRJ', 'VAP')", PAIRS_CTE, GROUP_RATE_CTE))
def _(t: Tables):
    rates = group_rates(t).filter(F.col("variable").isin(*s.PRIOR_USE))
    return rates.select("Drug", "variable", "category", labels.usage_label(F.col("category")).alias("label"))


RATES_SQL = " UNION ALL ".join(f"SELECT '{x}' AS Drug, {RATE.format(x=x)} AS Proportion FROM analysis" for x in EVER)


@query("classify_by_regex", survey(
    "SELECT Drug, Proportion, CASE WHEN regexp_matches(Drug, 'EVER_(ALC|FSM|MRJ|VAP|ESM)') THEN '''Soft''' "
    "WHEN regexp_matches(Drug, 'EVER_(HDG|NMD|MED)') THEN '''Hard'' aggregated' ELSE '''Hard''' END AS category "
    f"FROM ({RATES_SQL})"))
def _(t: Tables):
    rates = describe.weighted_rate(t.analysis(), EVER, s.WEIGHT)
    kind = labels.classify_by_regex(F.col("Drug"), s.REGEX_RULES, s.GROUP_HARD)
    return rates.withColumn("category", kind)


@query("classify_by_set", survey(
    "SELECT rid, drugs, CASE WHEN drugs IN ('ALC', 'FSM', 'MRJ', 'VAP', 'ESM') THEN '''Soft''' "
    "WHEN drugs IN ('HDG', 'MED', 'NMD') THEN '''Hard'' aggregated' ELSE '''Hard''' END AS Category, "
    f"CAST(list_position([{', '.join(repr(i) for i in s.ITEM_ORDER)}], drugs) AS INTEGER) AS level "
    f"FROM {melt('analysis', s.ITEM_ORDER, 'rid', 'drugs', 'age')}"))
def _(t: Tables):
    long = t.analysis().select("rid", *s.ITEM_ORDER).unpivot(["rid"], s.ITEM_ORDER, "drugs", "age")
    return long.select("rid", "drugs", labels.classify_by_set(F.col("drugs"), s.SET_RULES).alias("Category"),
                       labels.level_position(F.col("drugs"), s.ITEM_ORDER).alias("level"))


@query("ordered_levels", survey(
    f"SELECT rid, variable, CASE WHEN code BETWEEN 1 AND 4 THEN code END AS level FROM {DEMO_LONG}"))
def _(t: Tables):
    return demo_long(t).select("rid", "variable", E(recode.bounded_level("code", range(1, 5))).alias("level"))


@query("order_levels_by_value", survey(
    f"SELECT *, CAST(row_number() OVER (ORDER BY Proportion, Drug) AS INTEGER) AS position FROM ({RATES_SQL})"))
def _(t: Tables):
    return describe.order_levels_by_value(describe.weighted_rate(t.analysis(), EVER, s.WEIGHT), "Drug", "Proportion")


BEFOR_COC = [s.befor(x, "COC") for x in s.PRIOR_USE]


@query("string_sub", survey(f"SELECT DISTINCT variable, right(variable, 3) AS Drug FROM {melt('analysis', BEFOR_COC)}"))
def _(t: Tables):
    long = t.analysis().select(*BEFOR_COC).unpivot([], BEFOR_COC, "variable", "value")
    return long.select("variable", F.right("variable", F.lit(3)).alias("Drug")).distinct()


@query("string_remove_prefix", survey(
    f"SELECT regexp_replace(Drug, 'EVER_', '') AS Drug, Proportion FROM ({RATES_SQL})"))
def _(t: Tables):
    rates = describe.weighted_rate(t.analysis(), EVER, s.WEIGHT)
    return rates.withColumn("Drug", F.regexp_replace("Drug", "EVER_", ""))


@query("string_remove_by_column", survey(
    "SELECT Drug, regexp_replace(variable || '_befor_' || Drug, '_befor_' || Drug, '') AS variable, count(*) AS n "
    "FROM pairs GROUP BY ALL", PAIRS_CTE))
def _(t: Tables):
    from stratalens.catalog.shaping import pairs_long

    named = pairs_long(t).withColumn("variable", F.concat_ws("_befor_", "variable", "Drug"))
    return named.select(
        "Drug", labels.remove_by_column(F.col("variable"), "_befor_", F.col("Drug")).alias("variable")
    ).groupBy("Drug", "variable").agg(F.count("*").alias("n"))


@query("format_number", survey(
    "SELECT Drug, printf('%.1f', Proportion * 100) AS text, round(Proportion, 3) AS rounded "
    f"FROM ({RATES_SQL})"))
def _(t: Tables):
    rates = describe.weighted_rate(t.analysis(), EVER, s.WEIGHT)
    return rates.select("Drug", labels.fixed_decimals(F.col("Proportion") * 100, 1).alias("text"),
                        F.round("Proportion", 3).alias("rounded"))


@query("interaction_key", survey(
    "SELECT category || '.' || variable AS key, count(*) AS n FROM pairs WHERE category IS NOT NULL GROUP BY ALL",
    PAIRS_CTE))
def _(t: Tables):
    from stratalens.catalog.shaping import pairs_long

    known = pairs_long(t).filter("category is not null")
    return known.groupBy(labels.interaction_key(F.col("category"), F.col("variable")).alias("key")).agg(
        F.count("*").alias("n"))
