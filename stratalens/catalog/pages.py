"""Web pages with yearly tables, built from the orders of each nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEARLY = ["Year", "Urgent", "High"]
HEADER = (
    "<tr><th>Year</th><th colspan=\"2\">Urgent</th><th colspan=\"2\">High</th></tr>"
    "<tr><th>Year</th><th>Number</th><th>Rate</th><th>Number &amp; share</th><th>Rate</th></tr>"
)

SPANS = (
    "<TABLE class='t'><!-- <tr><td>no</td></tr> --><tr><td rowspan=3>All &lt;years&gt; &#38; more<td colspan='2'> <b>%d</b>\n</tr>"
    "<tr><td>%d<td>high: <table><tr><th>%d</table></tr><tr><td>end</table>"
)


def yearly_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per nation; its fourth table counts urgent and high orders per year.

    Rates are per thousand orders, in whole numbers. The last row is short. The fifth table has cells over several rows
    and columns, and the sixth inside a cell.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    per_year = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .groupBy("c_nationkey", F.year("o_orderdate").alias("year"))
        .agg(F.count("*").alias("n"),
             F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
             F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("high"))
    )
    cells = [F.col("year"), F.col("urgent"), F.expr("urgent * 1000 div n"),
             F.col("high"), F.expr("high * 1000 div n")]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>")) for c in cells],
                   F.lit("</tr>"))
    body = F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("year", row.alias("row")))), lambda r: r["row"]), "")
    small = "<table><tr><td>{}</td></tr></table>"
    return per_year.groupBy(F.col("c_nationkey").alias("page_id")).agg(F.concat(
        F.lit("<html><body>" + "".join(small.format(i) for i in range(3)) + "<table>" + HEADER), body,
        F.lit("<tr><td>Total</td></tr></table>"),
        F.format_string(SPANS, F.sum("n"), F.sum("urgent"), F.sum("high")), F.lit("</body></html>")).alias("html"))
