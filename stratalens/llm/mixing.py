"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed place in its source's hash order (the md5 of its id), so a larger budget takes all that a
smaller one takes. The words of each source are summed by hash bucket; the bucket in which the budget ends is found on
those sums and only its rows are summed again by the next digits, until one hash value holds the border. Documents are
then kept by comparing hashes: nothing is sorted.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import query, table

DIGITS = 3
LEVELS = 5
MAX_SOURCES = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), most: int = 3) -> dict[str | None, Fraction]:
    """Target words of each source: weights in code point order of the names, null last, excess reshared.

    A source stops at ``most`` times its size; what it leaves goes to the others by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] > most * sizes[s] * total}
        if not full:
            return out | {s: Fraction(left * weight[s], total) for s in open_}
        out |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Size of a document and its place in the hash order."""
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return word_count(F.col(text_col)), F.substring(md5, 1, DIGITS * LEVELS)


def plan(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1),
         most: int = 3) -> DataFrame:
    """One row per source: its size, target, whole repeats, and the hash at which the rest of its budget ends.

    One row per source comes to the driver (up to a million sources, else an error); documents never do.
    """
    size, place = _keys(id_col, text_col)
    rows = runtime.materialise(docs.select(F.col(source_col).alias("source"), size.alias("size"), place.alias("hash")))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r.source: r.words for r in per_source}
    goal = targets(sizes, weights, most)
    repeats = {s: int(goal[s] // sizes[s]) if sizes[s] else 0 for s in goal}
    borders = _borders(rows, {s: (int(goal[s]) - repeats[s] * sizes[s]) for s in goal})
    kind = "plan_source string, source_size long, target double, repeats long, border string, rest long, held long"
    found = rows.sparkSession.createDataFrame(
        [(s, sizes[s], float(goal[s]), repeats[s], *borders[s]) for s in goal], kind)
    return F.broadcast(found) if len(goal) <= 10_000 else found


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1),
        most: int = 3) -> DataFrame:
    """``row`` (all columns of the input), ``size``, ``source_size``, ``target`` and ``taken`` of every row.

    ``size``: words of the text, 0 for null. ``taken``: words of the document in the mix, repeats counted. With a
    target of r times its source's size each document is taken floor(r) times, and those first in the hash order once
    more, up to the target. Rows that share the border's hash (one document, or repeats of one id) share its last words
    in proportion to their sizes, rounded down. A null id hashes as the text 'null'; an empty table gives no rows.
    """
    size, place = _keys(id_col, text_col)
    found = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, most=most)
    more = (F.when(F.col("hash") < F.col("border"), F.col("size"))
            .when((F.col("hash") == F.col("border")) & (F.col("held") > 0),
                  F.expr("size * cast(rest as decimal(38,0)) div held")).otherwise(F.lit(0)))
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("mix_source"), size.alias("size"),
                       place.alias("hash"))
    return (rows.join(found, F.col("mix_source").eqNullSafe(F.col("plan_source")))
            .select("row", "size", "source_size", "target",
                    (F.col("repeats") * F.col("size") + more.cast("long")).alias("taken")))


def _borders(rows: DataFrame, budget: dict[str | None, int]) -> dict[str | None, tuple[str, int, int]]:
    """Of each source the hash at which its budget ends, the words left for it and the words it holds.

    One histogram job per level over the rows of the buckets still open; 16^3 buckets a level.
    """
    spark = rows.sparkSession
    done = {s: ("", 0, 0) for s, b in budget.items() if b <= 0}
    open_ = {s: ("", b) for s, b in budget.items() if b > 0}
    for level in range(1, LEVELS + 1):
        if not open_:
            break
        at = spark.createDataFrame([(s, p, b) for s, (p, b) in open_.items()],
                                   "at_source string, prefix string, budget long")
        width = DIGITS * level
        bucket = (rows.join(F.broadcast(at) if len(open_) <= 10_000 else at,
                            F.col("source").eqNullSafe(F.col("at_source"))
                            & (F.substring("hash", 1, width - DIGITS) == F.col("prefix")))
                  .groupBy("source", F.substring("hash", 1, width).alias("bucket"))
                  .agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"),
                       F.first("budget").alias("budget")))
        running = bucket.withColumn("upto", F.expr("sum(words) over (partition by source order by bucket)"))
        border = running.filter("upto >= budget and upto - words < budget").select(
            "source", "bucket", "low", "high", "words", F.expr("budget - (upto - words)").alias("rest")).collect()
        open_ = {}
        for r in border:
            if r.low == r.high:
                done[r.source] = (r.low, r.rest, r.words)
            else:
                open_[r.source] = (r.bucket, r.rest)
    return done


SQL = r"""
with recursive docs as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15) as hash
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as words,
         cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as bigint) as w
  from docs group by source),
level(n, source, words, w, full_, leftover, total) as (
  select 0, source, words, w, false, cast(sum(words) over () as bigint), cast(sum(w) over () as bigint) from sources
  union all
  select n + 1, source, words, w, hit,
         cast(leftover - sum(case when hit and not full_ then 3 * words else 0 end) over () as bigint),
         cast(total - sum(case when hit and not full_ then w else 0 end) over () as bigint)
  from (select *, full_ or leftover * w > 3 * words * total as hit, bool_or(not full_ and leftover * w > 3 * words * total) over () as again
        from level) where again),
last as (select * from level where n = (select max(n) from level)),
goal as (
  select source, words, case when full_ then cast(3 * words as double) else leftover * w / total end as target,
         case when full_ then 3 * words else leftover * w // total end as whole from last),
plan as (select *, case when words > 0 then whole // words else 0 end as repeats from goal),
run as (
  select d.*, p.words, p.target, p.repeats, p.whole - p.repeats * p.words as budget,
         sum(size) over (partition by d.source order by hash) as upto, sum(size) over (partition by d.source, hash) as held
  from docs d join plan p on d.source is not distinct from p.source)
select doc_id, size, words as source_size, target,
       cast(repeats * size + case when upto <= budget then size
                                  when upto - held < budget then size * (budget - (upto - held)) // held
                                  else 0 end as bigint) as taken
from run
"""


@query("op7_mixing", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken")


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, rounded to whole documents.

    Rows without words stay once: they weigh nothing in any source. All columns are kept.
    """
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    return (mix(docs).withColumn("copies", copies).filter("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))
