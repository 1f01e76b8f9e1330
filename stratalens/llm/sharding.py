"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows go from each partition to each shard is drawn exactly, as if all rows had been dealt from one shuffled
deck. Every partition then permutes its own rows, sends as many to each shard as drawn, and each shard permutes what it
received. The matrix is never built whole: a task draws only the row of its partition, by halving the range of
partitions; each halving has its own seed, so all tasks draw the same matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import query, table

BLOCK_ROWS = 200_000


def draw(good: int, bad: int, taken: int, rng: np.random.Generator) -> int:
    """One hypergeometric draw for counts of any size: inverse of the distribution function around its mode."""
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (taken + 1) * (good + 1) // (total + 2)))
    spread = (taken * (good / total) * (bad / total) * max(total - taken, 1) / max(total - 1, 1)) ** 0.5
    first, last = max(low, mode - int(12 * spread) - 30), min(high, mode + int(12 * spread) + 30)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((taken - k) / (bad - taken + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return first + int(min(np.searchsorted(chance, rng.random() * chance[-1], side="right"), last - first))


def split(rows: list[int], left: int, rng: np.random.Generator) -> list[int]:
    """Of ``rows[s]`` rows of each shard, how many are among the ``left`` rows dealt to the left half."""
    out, rest = [], sum(rows)
    for size in rows:
        rest -= size
        got = draw(size, rest, left, rng)
        out.append(got)
        left -= got
    return out


def matrix_row(part: int, upto: np.ndarray, sizes: list[int], seed: int) -> list[int]:
    """Rows of partition ``part`` for each shard. ``upto``: running row counts of the partitions, from 0."""
    low, high, row = 0, len(upto) - 1, list(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(row, int(upto[middle] - upto[low]), np.random.default_rng([seed, low, high]))
        if part < middle:
            row, high = left, middle
        else:
            row, low = [r - x for r, x in zip(row, left)], middle
    return row


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_shards(docs: DataFrame, *, id_col="doc_id", text_col="text", shards: int = 40, seed: int = 17) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row: a uniform shuffle, shard sizes at most one apart.

    ``size``: UTF-8 bytes of the text (null: none) plus 16; ``text_crc32``: of the text's bytes, of none for null.
    Repeated rows are dealt each for itself; an empty table gives no rows. A shard's last permutation is an order by
    random numbers drawn with the rows, ranked in blocks of about ``BLOCK_ROWS`` rows, so no shard is one task.
    """
    spark = docs.sparkSession
    runtime.ship_package(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    lean = runtime.materialise(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.spark_partition_id().alias("part")))
    counts = {r.part: r.n for r in lean.groupBy("part").agg(F.count("*").alias("n")).collect()}
    upto = np.cumsum([0] + [counts.get(p, 0) for p in range(max(counts, default=0) + 1)])
    total = int(upto[-1])
    sizes = shard_sizes(total, shards)
    blocks = max(1, -(-max(sizes) // BLOCK_ROWS))
    known = spark.sparkContext.broadcast(upto)

    def deal(batches):
        part, rng, places, done = None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column("part")[0].as_py()
                rng = np.random.default_rng([seed, 1, part])
                row = matrix_row(part, known.value, sizes, seed)
                places = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), row))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"),
                 pa.array(places[done:done + n]), pa.array(rng.integers(0, 1 << 62, n))],
                ["doc_id", "size", "text_crc32", "shard", "key"])
            done += n

    kind = lean.schema["doc_id"].dataType.simpleString()
    dealt = lean.mapInArrow(deal, f"doc_id {kind}, size long, text_crc32 long, shard int, key long")
    dealt = dealt.withColumn("block", F.expr(f"cast((key >> 31) * {blocks} >> 31 as int)"))
    before = (dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
              .withColumn("before", F.expr("sum(n) over (partition by shard order by block) - n"))
              .select(F.col("shard").alias("at_shard"), F.col("block").alias("at_block"), "before"))
    ranked = dealt.withColumn(
        "rank", F.expr("row_number() over (partition by shard, block order by key, doc_id, text_crc32)"))
    return (ranked.join(before, (F.col("shard") == F.col("at_shard")) & (F.col("block") == F.col("at_block")))
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot")))


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shuffle_shards(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
