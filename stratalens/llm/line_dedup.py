"""Line dedup: lines that many documents share stay in one document only.

A text is split at newlines. The key of a line is the line without white space at its ends, A-Z in lower case. Keys of
``least_length`` code points or more that at least ``least_docs`` documents hold lose their lines everywhere but in the
document with the largest id that holds them, where all of them stay. What is left is joined again by position.

The lines are exploded as 128-bit hashes of their keys, so no text is shuffled while they are counted; distinct
documents are counted with partial sums before each exchange, so a line that a third of the documents share is a row
per task. The hashes over the threshold are stored and joined back to the exploded lines, one row per hash on their
side, and each text receives the sorted positions of its dropped lines.

Null and empty texts are one empty line. Rows that share an id are one document in the counts, and each row gives a row.
A row without an id counts as no document and is never the one that keeps a line. Ties cannot occur, as equal ids are
one document. An empty table gives an empty one. Extra columns come along whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import query, table, text_slices

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    plain = F.length(bare) == F.octet_length(bare)  # of ASCII alone, where lower() changes A-Z only and is much faster
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def halves(value: Column, *names: str) -> list[Column]:
    """Two independent 64-bit hashes: a key of 128 bits."""
    return [F.xxhash64(F.lit(seed), value).alias(name) for seed, name in enumerate(names)]


def exploded(docs: DataFrame, least_length: int) -> DataFrame:
    """``doc``, two hashes of the text, ``pos`` and two hashes of the key for each line whose key is long enough."""
    lines = docs.select("doc", *halves(F.col("text"), "t1", "t2"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= least_length).select("doc", "t1", "t2", "pos", *halves(F.col("key"), "k1", "k2"))


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """The hashes that at least ``least_docs`` documents hold, with the largest id among them."""
    once = lines.filter("doc is not null").groupBy("k1", "k2", "doc").agg(F.lit(1).alias("one"))
    return (once.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
            .filter(F.col("docs") >= least_docs).select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "keeper"))


def drop_shared_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 20,
                      least_docs: int = 3) -> DataFrame:
    """``row`` (the other columns as a struct), the ``text`` that is left, ``n_lines`` before, ``n_dropped`` and ``sha256``."""
    spark = docs.sparkSession
    runtime.ship_package(spark)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(others.alias("row"), F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    lines = exploded(rows, least_length)
    path = runtime.scratch_path(spark, "shared-lines")
    shared_lines(lines, least_docs).write.parquet(path)
    hit = lines.join(spark.read.parquet(path), (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
    drops = (hit.filter("doc is null or doc <> keeper").groupBy("doc", "t1", "t2")
             .agg(F.array_sort(F.collect_set("pos")).alias("drops"))
             .select(F.col("doc").alias("d_doc"), F.col("t1").alias("d1"), F.col("t2").alias("d2"), "drops"))
    marked = (rows.select("row", "doc", "text", *halves(F.col("text"), "t1", "t2"))
              .join(drops, (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2"))
                    & F.col("doc").eqNullSafe(F.col("d_doc")), "left").select("row", "text", "drops"))

    def reassemble(batches):
        for part in text_slices(batches, "text"):
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("drops")):
                lines = text.split("\n")
                n_lines.append(len(lines))
                n_dropped.append(len(gone.values) if gone.is_valid else 0)
                if gone.is_valid:
                    stays = np.ones(len(lines), bool)
                    stays[gone.values.to_numpy()] = False
                    lines = [lines[i] for i in np.flatnonzero(stays)]
                texts.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())],
                ["row", "text", "n_lines", "n_dropped", "sha256"])

    row = marked.schema["row"].dataType.simpleString()
    return marked.mapInArrow(reassemble, f"row {row}, text string, n_lines long, n_dropped long, sha256 string")


SQL = r"""
with docs as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select rid, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from docs),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.*, s.key is not null and k.doc_id is distinct from s.keeper as dropped from keyed k left join shared s on k.key = s.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where dropped) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by rid, doc_id
"""


@query("op11_line_dedup", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_shared_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.col("sha256").alias("kept_sha256"))
