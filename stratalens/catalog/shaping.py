"""Sources, sinks, projections, filters, reshaping, simple joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens import schema as s
from stratalens.catalog import pages
from stratalens.catalog.base import Tables, query
from stratalens.catalog.views import melt, respondents_sql, survey
from stratalens.functions import recode
from stratalens.operators import columns as c
from stratalens.operators import describe, html, reshape
from stratalens.plans import analysis
from stratalens.runtime import materialise, scratch_path
from stratalens.sources import tables as src

RAW_SQL = "SELECT rid, " + ", ".join(
    f"{ {'AGECAT': 'CATAGE', 'ETHNIC': 'NEWRACE2'}.get(new, new)} AS {old}" for old, new in s.RENAME.items()
) + ", VEREP, VESTR_C, w_cents AS ANALWT2_C FROM respondents"
SELECTED_SQL = "SELECT rid, " + ", ".join(
    f"{ {'AGECAT': 'CATAGE', 'ETHNIC': 'NEWRACE2'}.get(new, new)} AS {new}" for new in s.RENAME.values()
) + ", VEREP, VESTR_C, w_cents AS ANALWT2_C FROM respondents"
EVER = [s.ever(i) for i in [*s.SOFT, *s.HARD]]
IMP = [f"{i}_IMP" for i in s.IMPUTED]
WHOLE = ["rid", *s.RAW_DESIGN, *s.ITEMS, *s.AGGREGATES, *[s.befor(x, h) for x in s.PRIOR_USE for h in s.HARD], *EVER, *IMP,
         *s.DEMOGRAPHIC]


@query("scan_table", "SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem")
def _(t: Tables):
    path = f"{t.sf_dir}/lineitem.parquet"
    schema = t.spark.read.parquet(path).schema
    return src.scan_table(t.spark, path, schema).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query("normalise_names", respondents_sql(RAW_SQL.replace("rid,", "rid AS RID,", 1)))
def _(t: Tables):
    return src.normalise_names(t.raw())


@query("write_dataset", survey("SELECT * FROM analysis"))
def _(t: Tables):
    path = scratch_path(t.spark, "dataset")
    src.write_dataset(t.analysis(), path)
    return src.scan_table(t.spark, path)


#: Factors with their levels; nobody has the last one of EDUCAT.
FACTOR_LEVELS = {"ETHNIC": [4, 3, 2, 1], "GENDER": [1, 2], "AGEPRC": list(range(1, 12)), "EDUCAT": [1, 2, 3, 4, 5, 6]}


@query("factor_levels", survey(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, {i + 1} AS position, '{x}' AS level, count(*) FILTER ({c} = {x}) AS n FROM analysis"
    for c, levels in FACTOR_LEVELS.items() for i, x in enumerate(levels))))
def _(t: Tables):
    """The levels of factors after the dataset was written and read again."""
    path = scratch_path(t.spark, "factors")
    src.write_dataset(c.with_levels(t.analysis(), FACTOR_LEVELS), path)
    return c.level_counts(src.scan_table(t.spark, path))


@query("write_dataset_csv", survey("SELECT * FROM analysis"))
def _(t: Tables):
    path = scratch_path(t.spark, "csv")
    df = t.analysis()
    src.write_dataset(df, path, "csv")
    return src.scan_table(t.spark, path, df.schema, "csv")


GRID_SQL = """
SELECT page_id, t.no AS table_no, r.no AS row_no, c.no AS col_no,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(c.v, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS cell
FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g') AS h FROM pages) p,
  LATERAL (SELECT CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS no, unnest(x) AS v
    FROM (SELECT regexp_extract_all(h, '(?is)<ul\\b[^>]*>.*?</ul\\s*>') AS x)) t,
  LATERAL (SELECT CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS no, unnest(x) AS v
    FROM (SELECT regexp_extract_all(t.v, '(?is)<li\\b[^>]*>.*?</li\\s*>') AS x)) r,
  LATERAL (SELECT CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS no, unnest(x) AS v
    FROM (SELECT regexp_extract_all(r.v, '(?is)<a\\b[^>]*>.*?</a\\s*>') AS x)) c
"""


@query("html_tables", GRID_SQL)
def _(t: Tables):
    """The stored pages hold lists, not tables: a list is read as a grid of links."""
    lists = html.html_tables(t.table("pages"), table="ul", row="li", cell="a")
    return html.grid_cells(lists)


YEARLY_CTE = """WITH yearly AS (
  SELECT c_nationkey AS page_id, CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n,
    count(*) FILTER (o_orderpriority = '1-URGENT') AS u, count(*) FILTER (o_orderpriority = '2-HIGH') AS h
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
body AS (SELECT page_id, y, CAST(u AS VARCHAR) AS u, CAST(u * 1000 // n AS VARCHAR) AS ur, CAST(h AS VARCHAR) AS h,
  CAST(h * 1000 // n AS VARCHAR) AS hr FROM yearly
  UNION ALL SELECT DISTINCT page_id, 'Total', NULL, NULL, NULL, NULL FROM yearly)
"""


@query("nth_table", YEARLY_CTE + """
SELECT page_id, CAST(4 AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, CAST(u.i AS INTEGER) AS col_no, u.v AS cell
FROM (SELECT page_id, row_no, unnest([{'i': 1, 'v': a}, {'i': 2, 'v': b}, {'i': 3, 'v': c}, {'i': 4, 'v': d}, {'i': 5, 'v': e}]) AS u
FROM (SELECT page_id, 2 + row_number() OVER (PARTITION BY page_id ORDER BY y) AS row_no, y AS a, u AS b, ur AS c, h AS d, hr AS e FROM body
  UNION ALL SELECT DISTINCT page_id, 1, 'Year', 'Urgent', 'Urgent', 'High', 'High' FROM body
  UNION ALL SELECT DISTINCT page_id, 2, 'Year', 'Number', 'Rate', 'Number & share', 'Rate' FROM body))""")
def _(t: Tables):
    return html.grid_cells(html.nth_table(html.html_tables(pages.yearly_pages(t.spark, t.sf_dir)), 4))


@query("html_spans", YEARLY_CTE + """, whole AS (SELECT page_id, CAST(sum(n) AS VARCHAR) AS n, CAST(sum(u) AS VARCHAR) AS u, CAST(sum(h) AS VARCHAR) AS h
FROM yearly GROUP BY page_id)
SELECT page_id, CAST(c.t AS INTEGER) AS table_no, CAST(c.r AS INTEGER) AS row_no, CAST(c.c AS INTEGER) AS col_no, c.v AS cell FROM (
SELECT page_id, unnest([{'t': 5, 'r': 1, 'c': 1, 'v': 'All <years> & more'}, {'t': 5, 'r': 1, 'c': 2, 'v': n}, {'t': 5, 'r': 1, 'c': 3, 'v': n},
{'t': 5, 'r': 2, 'c': 1, 'v': 'All <years> & more'}, {'t': 5, 'r': 2, 'c': 2, 'v': u}, {'t': 5, 'r': 2, 'c': 3, 'v': 'high: ' || h},
{'t': 5, 'r': 3, 'c': 1, 'v': 'All <years> & more'}, {'t': 5, 'r': 3, 'c': 2, 'v': 'end'}, {'t': 5, 'r': 3, 'c': 3, 'v': NULL},
{'t': 6, 'r': 1, 'c': 1, 'v': h}]) AS c FROM whole)""")
def _(t: Tables):
    """Cells over several rows and columns, entities, and a table inside a cell."""
    tables = html.html_tables(pages.yearly_pages(t.spark, t.sf_dir))
    return html.grid_cells(tables.filter("table_no > 4"))


def yearly_table(t: Tables):
    tables = html.html_tables(pages.yearly_pages(t.spark, t.sf_dir))
    return html.header_column_filter(html.nth_table(tables, 4), pages.YEARLY)


@query("header_column_filter", YEARLY_CTE + "SELECT page_id, y AS Year, ur AS Urgent, hr AS High FROM body")
def _(t: Tables):
    return yearly_table(t)


YEARLY_LONG = """SELECT page_id, TRY_CAST(y AS DOUBLE) AS Year, b.n AS Category, TRY_CAST(b.v AS DOUBLE) AS Rate
FROM (SELECT page_id, y, unnest([{'n': 'Urgent', 'v': ur}, {'n': 'High', 'v': hr}]) AS b FROM body)"""


def yearly_long(t: Tables):
    long = yearly_table(t).unpivot(["page_id", "Year"], pages.YEARLY[1:], "Category", "Rate")
    return c.across_map(long, ["Year", "Rate"], lambda x: f"try_cast({x} as double)")


@query("cast_numeric", YEARLY_CTE + YEARLY_LONG)
def _(t: Tables):
    return yearly_long(t)


@query("min_max_range", YEARLY_CTE + f"SELECT min(Year) AS min, max(Year) AS max FROM ({YEARLY_LONG})")
def _(t: Tables):
    return describe.min_max_range(yearly_long(t), "Year")


@query("select_columns", respondents_sql("SELECT rid, VEREP, VESTR_C, w_cents AS ANALWT2_C, ALC, SED FROM respondents"))
def _(t: Tables):
    return c.select_columns(t.selected(), ["rid", *s.RAW_DESIGN, "ALC", "SED"])


@query("rename_dictionary", respondents_sql(SELECTED_SQL))
def _(t: Tables):
    return t.selected()


@query("select_by_regex", survey("SELECT " + ", ".join([*s.ITEMS, *s.AGGREGATES, *s.DEMOGRAPHIC]) + ", rid FROM analysis"))
def _(t: Tables):
    return c.select_by_regex(t.analysis(), r"^.{3}$", r"^.{6}$")


@query("drop_by_regex", survey("SELECT rid, ANALWT2_C, " + ", ".join(
    [f"{x}_befor_{h}" for x in s.PRIOR_USE for h in s.HARD] + EVER
    + [d for d in s.DEMOGRAPHIC]) + " FROM analysis"))
def _(t: Tables):
    kept = c.drop_by_regex(t.analysis(), r"^[A-Z]{3}$", "_IMP", any_of=["VEREP", "VESTR_C", "ESTAGE"])
    return kept


@query("across_map", survey("SELECT rid, " + ", ".join(
    f"CASE WHEN {i} < 100 THEN 1 WHEN {i} IS NOT NULL THEN 0 END AS USED_{i}" for i in s.ITEMS) + " FROM analysis"))
def _(t: Tables):
    df = c.across_map(t.analysis().select("rid", *s.ITEMS), s.ITEMS, recode.ever_flag_basic, "USED_{}")
    return df.drop(*s.ITEMS)


@query("strip_outcome_suffix", survey(
    "SELECT rid, EVER_COC, " + ", ".join(f"{x}_befor_COC AS {x}_befor" for x in s.PRIOR_USE) + " FROM analysis"))
def _(t: Tables):
    flags = [s.befor(x, "COC") for x in s.PRIOR_USE]
    return c.strip_outcome_suffix(t.analysis().select("rid", "EVER_COC", *flags), "COC")


@query("cast_factor", respondents_sql(
    "SELECT rid, CASE WHEN RLGIFA IN (1, 2, 3, 4) THEN RLGIFA END AS RLGIFA, "
    "CASE WHEN RLGIFY IN (1, 2, 3, 4) THEN RLGIFY END AS RLGIFY FROM respondents"))
def _(t: Tables):
    df = t.selected().select("rid", "RLGIFA", "RLGIFY")
    return c.across_map(df, ["RLGIFA", "RLGIFY"], lambda x: recode.bounded_level(x, [1, 2, 3, 4]))


AGES_LONG = melt("analysis", [*s.ITEMS, *s.AGGREGATES], "rid, ANALWT2_C", "drugs", "age")


def ages_long(t: Tables):
    items = [*s.ITEMS, *s.AGGREGATES]
    return reshape.unpivot_keep_ids(t.analysis(), ["rid", s.WEIGHT], items, "drugs", "age")


@query("filter_real_age", survey(f"SELECT * FROM {AGES_LONG} WHERE age < 100"))
def _(t: Tables):
    return ages_long(t).filter(F.col("age") < s.REAL_AGE_BELOW)


FLAGS_PNK = [s.befor(x, "PNK") for x in s.PRIOR_USE]


@query("filter_complete_cases", survey(
    f"SELECT rid, EVER_PNK, {', '.join(FLAGS_PNK)} FROM analysis WHERE "
    + " AND ".join(f"{x} IS NOT NULL" for x in [*FLAGS_PNK, "EVER_PNK"])))
def _(t: Tables):
    return c.filter_complete_cases(t.analysis().select("rid", "EVER_PNK", *FLAGS_PNK), ["EVER_PNK", *FLAGS_PNK])


@query("filter_any_nonzero", survey(
    f"SELECT rid, {', '.join(EVER)} FROM analysis WHERE {' OR '.join(f'{x} <> 0' for x in EVER)}"))
def _(t: Tables):
    return c.filter_any_nonzero(t.analysis().select("rid", *EVER), EVER)


@query("filter_rowsum_positive", survey(
    f"SELECT rid FROM analysis WHERE ({' + '.join(f'CAST({x} <> 0 AS INTEGER)' for x in EVER)}) > 0"))
def _(t: Tables):
    return c.filter_rowsum_positive(t.analysis().select("rid", *EVER), EVER).select("rid")


@query("filter_in_set", survey(f"SELECT * FROM {AGES_LONG} WHERE drugs IN ('COC', 'HER') AND age NOT IN (991, 999)"))
def _(t: Tables):
    return ages_long(t).filter(F.col("drugs").isin("COC", "HER") & ~F.col("age").isin(s.NON_USER, s.NEVER_USED))


PAIR_VARIABLES = [*[s.befor("ALC", h) for h in s.HARD], "GENDER", "TOTINC"]
PAIR_MELT = ("(SELECT rid, Drug, variable, categories FROM (SELECT rid, unnest([" + ", ".join(f"'{h}'" for h in s.HARD)
             + "]) AS Drug, variable, categories FROM ")


@query("filter_name_matches_row", survey(
    f"SELECT rid, Drug, variable, categories FROM {PAIR_MELT}{melt('analysis', PAIR_VARIABLES, 'rid', 'variable', 'categories')})) "
    "WHERE right(variable, 3) = Drug OR variable IN ('GENDER')"))
def _(t: Tables):
    long = t.analysis().select("rid", *PAIR_VARIABLES).unpivot(["rid"], PAIR_VARIABLES, "variable", "categories")
    both = long.select("rid", F.explode(F.array(*map(F.lit, s.HARD))).alias("Drug"), "variable", "categories")
    return c.filter_name_matches_row(both, "variable", "Drug", 3, ["GENDER"])


@query("filter_missing_positive", survey(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT count(*) AS rows, '{x}' AS variable, count(*) - count({x}) AS N FROM analysis"
        for x in WHOLE) + ") WHERE N > 0"))
def _(t: Tables):
    return describe.missing_counts(t.analysis(), WHOLE).filter("N > 0")


# --- reshaping and simple joins -----------------------------------------------------

@query("unpivot_all", survey(f"SELECT * FROM {melt('analysis', EVER)}"))
def _(t: Tables):
    return reshape.unpivot_all(t.analysis().select(*EVER))


@query("unpivot_keep_ids", survey(f"SELECT * FROM {melt('analysis', s.DEMOGRAPHIC, 'rid, ANALWT2_C')}"))
def _(t: Tables):
    return reshape.unpivot_keep_ids(t.analysis(), ["rid", s.WEIGHT], s.DEMOGRAPHIC)


def outcome_pairs(demographic=("ETHNIC", "GENDER", "RLGINF")):
    pairs = []
    for hard in s.HARD:
        pairs += [(hard, s.ever(hard), x, s.befor(x, hard)) for x in s.PRIOR_USE]
        pairs += [(hard, s.ever(hard), d, d) for d in demographic]
    return pairs


PAIRS_SQL = "(SELECT rid, ANALWT2_C, unnest([" + ", ".join(
    f"{{'d': '{d}', 'v': '{v}', 'i': {o}, 'c': {p}}}" for d, o, v, p in outcome_pairs()) + "]) AS u FROM analysis)"
PAIRS_CTE = (f"pairs AS MATERIALIZED (SELECT rid, ANALWT2_C, u.d AS Drug, u.v AS variable, u.i AS initiation, "
             f"u.c AS category FROM {PAIRS_SQL})")


def pairs_long(t: Tables):
    return reshape.unpivot_pairs(t.analysis(), ["rid", s.WEIGHT], outcome_pairs())


@query("unpivot_twice", survey("SELECT * FROM pairs", PAIRS_CTE))
def _(t: Tables):
    return pairs_long(t)


@query("transpose_small", survey(
    "SELECT 'n' AS measure, count(*) FILTER (GENDER = 1) AS \"1\", count(*) FILTER (GENDER = 2) AS \"2\" FROM analysis "
    "UNION ALL SELECT 'w', CAST(sum(ANALWT2_C) FILTER (GENDER = 1) AS BIGINT), "
    "CAST(sum(ANALWT2_C) FILTER (GENDER = 2) AS BIGINT) FROM analysis"))
def _(t: Tables):
    table = t.analysis().groupBy(F.col("GENDER").cast("string").alias("GENDER")).agg(
        F.count("*").alias("n"), F.sum(s.WEIGHT).alias("w"))
    return reshape.transpose_small(table, "GENDER", ["1", "2"])


RATE = "CAST(sum({x} * ANALWT2_C) AS DOUBLE) / CAST(sum(ANALWT2_C) AS DOUBLE)"
MEANS_CTE = "means AS (" + " UNION ALL ".join(
    f"SELECT '{h}' AS Drug, {RATE.format(x='EVER_' + h)} AS Overall FROM analysis" for h in [*s.SOFT, *s.HARD]) + ")"
GROUP_RATE_CTE = ("group_rates AS (SELECT Drug, variable, category, CAST(sum(initiation * ANALWT2_C) AS DOUBLE) / "
                  "CAST(sum(ANALWT2_C) AS DOUBLE) AS share FROM pairs GROUP BY ALL)")


def overall_means(t: Tables):
    items = [*s.SOFT, *s.HARD]
    rates = describe.weighted_rate(t.analysis(), [s.ever(i) for i in items], s.WEIGHT, "Drug", "Overall")
    return rates.withColumn("Drug", F.regexp_replace("Drug", "EVER_", ""))


def group_rates(t: Tables):
    return describe.weighted_group_rate(pairs_long(t), ["Drug", "variable", "category"], "initiation", s.WEIGHT)


@query("weighted_group_rate", survey("SELECT * FROM group_rates", PAIRS_CTE, GROUP_RATE_CTE))
def _(t: Tables):
    return group_rates(t)


@query("left_join_means", survey("SELECT g.*, Overall FROM group_rates g LEFT JOIN means USING (Drug)",
                                 PAIRS_CTE, GROUP_RATE_CTE, MEANS_CTE))
def _(t: Tables):
    # one row per EVER column, so its size is fixed by the schema
    return group_rates(t).join(F.broadcast(overall_means(t)), "Drug", "left")


@query("bind_columns", survey(
    "SELECT rid, " + ", ".join(f"ALC_befor_{h}, SMK_befor_{h}" for h in s.HARD) + " FROM analysis"))
def _(t: Tables):
    df = analysis.with_aggregates(t.selected())
    both = {**analysis.befor_columns(["ALC"]), **analysis.smoking_columns()}
    return df.select("rid", *analysis.exprs(both))


@query("bind_rows", survey(" UNION ALL ".join(
    f"SELECT rid, '{h}' AS outcome, EVER_{h} AS used FROM analysis" for h in s.HARD)))
def _(t: Tables):
    base = materialise(t.analysis().select("rid", *map(s.ever, s.HARD)))
    return reshape.bind_rows(*[
        base.select("rid", F.lit(h).alias("outcome"), F.col(s.ever(h)).alias("used")) for h in s.HARD])
