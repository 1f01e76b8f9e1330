"""Filter interaction audit: what each of five filters removes at each place of each order of the filters.

Each document becomes a mask of the filters it fails. Documents are counted into cells, one per part and mask; from then
on only cells matter, at most 32 per part. A recursive query extends filter prefixes with the letters they do not hold
yet, over the masks that occur, and carries the bits applied so far; each level says for every mask whether the step
keeps it, removes it, or finds it removed before. Joined to the cells these levels give the counts of every prefix, and
each of the 120 orders takes those of its five prefixes.

A: fewer than 200 words. B: less than half of the words distinct. C: more than 2 % of the code points are A-Z.
D: holds one of ``#$%&*|``. E: the text equals that of a document with a smaller id, anywhere in the table.

Null texts are empty, and equal to empty ones; a text without words fails A only, and D never. A null part is the empty
string. Rows that share an id and a text are equal to no smaller one by that alone. A row without an id is smaller than
none and never fails E. A document labelled more than once counts as good or toxic if one label says so. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import query, table

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The filters that need the text alone."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, part_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, mask, good, toxic`` of each document: bit i of the mask says that filter i fails."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = sum((F.when(fails, 1 << LETTERS.index(c)).otherwise(0) for c, fails in failures(F.col("text")).items()), F.lit(0))
    rows = (docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                        text.alias("text"))
            .select("doc", "part", own.alias("own"), *[F.xxhash64(F.lit(i), F.col("text")).alias(f"t{i}") for i in (0, 1)]))
    spark = docs.sparkSession
    path = runtime.scratch_path(spark, "filter-masks")
    rows.write.parquet(path)  # the texts are read once
    rows = spark.read.parquet(path)
    first = (rows.groupBy("t0", "t1").agg(F.min("doc").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
             .select(F.col("t0").alias("f0"), F.col("t1").alias("f1"), "first"))
    first_path = runtime.scratch_path(spark, "filter-firsts")
    first.write.parquet(first_path)
    marks = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_doc"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .filter("good = 1 or toxic = 1"))
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    return (rows.join(marks, F.col("doc") == F.col("l_doc"), "left")
            .join(spark.read.parquet(first_path), (F.col("t0") == F.col("f0")) & (F.col("t1") == F.col("f1")), "left")
            .select("part", (F.col("own") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)).alias("mask"),
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


#: A level per filter; ``bits`` are the filters of the prefix, ``applied`` those before its last letter.
WALK = """
with recursive walk(mask, prefix, step, letter, applied, bits) as (
  select mask, '', 0, '', 0, 0 from {masks}
  union all
  select mask, concat(prefix, next), step + 1, next, bits, bits | shiftleft(1, instr('{letters}', next) - 1)
  from walk lateral view explode(split('{letters}', '')) as next
  where instr(prefix, next) = 0)
select mask, prefix, step, letter,
       int(mask & bits = 0) as kept,
       int(mask & applied = 0 and mask & bits <> 0) as removed,
       int(mask & applied <> 0 and mask & (bits ^ applied) <> 0) as redundant,
       int(mask = bits ^ applied) as unique_fails
from walk where step > 0
"""


def audit(cells: DataFrame) -> DataFrame:
    """From cells ``part, mask, n, good, toxic``: a row per part, order of all filters and step.

    The walk has at most 32 masks times 325 prefixes, whatever the input, and the orders 600 rows; both are broadcast.
    """
    spark = cells.sparkSession
    seen = cells.select("mask").distinct()
    walk = spark.sql(WALK.format(masks="{seen}", letters=LETTERS), seen=seen)
    counts = ["kept", "removed", "redundant", "unique_fails"]
    steps = (cells.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "step", "letter")
             .agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in counts],
                  F.sum(F.col("good") * F.col("removed")).alias("good_lost"),
                  F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost")))
    orders = (walk.filter(F.col("step") == len(LETTERS)).select(F.col("prefix").alias("filter_order")).distinct()
              .select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("at"))
              .select("filter_order", F.expr("left(filter_order, at)").alias("of")))
    every = steps.join(F.broadcast(orders), F.col("prefix") == F.col("of"))
    return every.select("part", "filter_order", F.col("step").cast("int").alias("step"), *counts, "good_lost", "toxic_lost",
                        F.expr("sum(removed) over (partition by part, letter)").alias("shapley"))


def filter_interactions(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    found = masks(docs, labels, part_col)
    cells = found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return audit(runtime.materialise(cells))


SQL = r"""
with recursive docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         min(doc_id) over (partition by coalesce(text, '')) as first_id from documents),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
          from labels group by doc_id),
flags as (select d.part, coalesce(m.good, 0) as good, coalesce(m.toxic, 0) as toxic,
    case when len(words) < 200 then 1 else 0 end
  + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
  + case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
  + case when d.doc_id > first_id then 16 else 0 end as mask
  from docs d left join marks m on d.doc_id = m.doc_id),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(prefix, step, letter, bit, applied) as (
  select letter, 1, letter, bit, 0 from letters
  union all
  select w.prefix || l.letter, w.step + 1, l.letter, l.bit, w.applied | w.bit
  from walk w join letters l on (w.applied | w.bit) & l.bit = 0),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from flags group by part, mask),
steps as (select c.part, w.prefix, w.step, w.letter,
    sum(case when c.mask & (w.applied | w.bit) = 0 then n else 0 end) as kept,
    sum(case when c.mask & w.applied = 0 and c.mask & w.bit <> 0 then n else 0 end) as removed,
    sum(case when c.mask & w.applied <> 0 and c.mask & w.bit <> 0 then n else 0 end) as redundant,
    sum(case when c.mask = w.bit then n else 0 end) as unique_fails,
    sum(case when c.mask & w.applied = 0 and c.mask & w.bit <> 0 then good else 0 end) as good_lost,
    sum(case when c.mask & w.applied = 0 and c.mask & w.bit <> 0 then toxic else 0 end) as toxic_lost
  from cells c cross join walk w group by all),
every as (select s.*, o.prefix as filter_order from steps s join walk o on o.step = 5 and s.prefix = left(o.prefix, s.step))
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from every
"""


@query("op13_filter_audit", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return filter_interactions(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
