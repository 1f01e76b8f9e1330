"""The wrong answers of the review, with their inputs."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import describe, guttman, html, logit, neighbours
from stratalens.operators.logit import Formula

GROUP = ["g"]


def nearest(spark, rows, categories=("a",)):
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} string" for c in categories) + ", w long, rid long")
    return {r.rid: r.nn for r in neighbours.heom_nearest(df, df, GROUP, list(categories), "w", "rid").collect()}


@pytest.mark.parametrize("copies", [1, 30])  # patterns of a few rows and of many
def test_a_missing_number_is_as_far_as_the_whole_range(spark, copies):
    rows = [(0, "x", 1, 1), (0, "x", 2, 3), (0, "x", None, 9), (0, "x", 100, 4)]
    rows += [(0, "x", 500 + i, 100 + i) for i in range(copies - 1)]
    got = nearest(spark, rows)
    assert got[1] == 3 and got[3] == 1 and got[9] == 1


def test_separators_inside_categories_do_not_join_patterns(spark):
    rows = [(0, "p|q", "r", 1, 1), (0, "p", "q|r", 1, 2), (0, "p|q", "z", 5, 3), (0, None, "~", 1, 4), (0, "~", None, 1, 5),
            (0, "*", "r", 1, 6)]
    got = nearest(spark, rows, ("a", "b"))
    assert got[1] == 6 and got[3] == 1 and got[6] == 1


def test_an_unknown_level_is_an_error(spark):
    cells = spark.createDataFrame([("o", 0, 4.0, 1.0, 4), ("o", 1, 4.0, 3.0, 4), ("o", 7, 6.0, 6.0, 6)],
                                  "outcome string, f int, w double, wy double, n long")
    formula = Formula({"f": [0, 1]})
    with pytest.raises(Exception, match="unknown level of f: 7"):
        logit.svy_logistic(cells, ["outcome"], formula).collect()
    fits = logit.svy_logistic(cells.filter("f < 2"), ["outcome"], formula)
    with pytest.raises(Exception, match="unknown level of f: 7"):
        logit.predict_prob(cells, fits, ["outcome"], formula).collect()
    assert len(logit.predict_prob(cells.filter("f < 2"), fits, ["outcome"], formula).collect()) == 2


def test_a_missing_age_counts_as_never_used(spark):
    df = spark.createDataFrame([(1, 10, 12, None, 1), (2, 10, None, 14, 1), (3, 10, 12, 14, 1), (4, 1, 2, 3, 0)],
                               "rid int, a int, b int, c int, EVER_a int")
    row = guttman.guttman_scales(df, {"s": ["a", "b", "c"]}, {"s": ["EVER_a"]}).first()
    assert (row.rows, row.errors) == (3, 1)
    row = guttman.guttman_scales(df.withColumn("EVER_b", F.expr("if(rid = 3, null, 1)")), {"s": ["a", "b", "c"]},
                                 {"s": ["EVER_a"]}, known=["EVER_a", "EVER_b"]).first()
    assert (row.rows, row.errors) == (2, 1)


def test_density_of_a_constant_item(spark):
    df = spark.createDataFrame([("a", 5, 1.0)] * 3 + [("b", 0, 2.0)] + [("c", i, 1.0) for i in range(9)],
                               "item string, v int, w double")
    got = describe.weighted_density(df, "item", "v", "w", grid_points=4).collect()
    assert {r["item"] for r in got} == {"a", "b", "c"} and all(r.density > 0 for r in got)


def test_more_columns_than_names_are_an_error(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a<th>b<th>c</tr><tr><td>x<td>Number<td>z</tr><tr><td>1<td>2<td>3</tr></table>")],
                                  "page_id int, html string")
    grid = html.html_tables(pages)
    assert [tuple(r) for r in html.header_column_filter(grid, ["p", "q"]).collect()] == [(1, "1", "3")]
    with pytest.raises(Exception, match="2 columns to keep, 1 names"):
        html.header_column_filter(grid, ["p"]).collect()


def grids(spark, page):
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    return [r.grid for r in html.html_tables(pages).orderBy("table_no").collect()]


def test_cells_that_span_rows_and_columns(spark):
    page = ("<table><tr><td rowspan=2>g<td>1</tr><tr><td>2</tr><tr><td colspan='2'>w<td>x</tr>"
            "<tr><td rowspan=9>d<td colspan=2 rowspan=2>e</tr><tr></tr><tr><td>f</table>")
    assert grids(spark, page) == [[["g", "1", None], ["g", "2", None], ["w", "w", "x"], ["d", "e", "e"], ["d", "e", "e"],
                                   ["d", "f", None]]]
    assert len(grids(spark, "<table><tr><td colspan=99999999>a</table>")[0][0]) == 1000


def test_a_table_inside_a_cell(spark):
    page = "<p><table><tr><td>a<table><tr><td>in</td><td>ner</td></tr></table>z</td><td>tail</td></tr></table><table><tr><td>b</table>"
    assert grids(spark, page) == [[["a in ner z", "tail"]], [["in", "ner"]], [["b"]]]
    assert grids(spark, "</table><table><tr><td>open") == []


def test_entities(spark):
    page = "<table><tr><td>caf&eacute; &#233;&#xE9; &amp;lt; &lt;b&gt; a&nbsp;b &bogus; &#0; & c &#128512;</table>"
    assert grids(spark, page) == [[["café éé &lt; <b> a b &bogus; &#0; & c \U0001F600"]]]
