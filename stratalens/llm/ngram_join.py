"""Near-duplicate texts: a Jaccard self-join on word shingles with prefix filters under several global orders.

In a global order of all shingles, two sets with a Jaccard similarity of at least t share one of their first
``n - ceil(t n) + 1`` shingles. The orders used here put rarer shingles first and differ in how they order shingles of
equal frequency; a pair must share a prefix shingle under every one of them before its sets are compared.

1. Shingles held by about a thousandth of the texts or more are found first, by counts over all texts of a task in bounded
   memory. There are at most a thousand times the mean set size of them, whatever the number of texts, so every task
   can know them and none of them is shuffled by value. One that is missed (see ``Counts``) only makes a larger bucket.
2. All other shingles meet by value, packed in binary blocks, to learn their frequencies. Those of one text only, nearly
   all, go no further: they fill the prefix and can match nothing.
3. Sets whose prefix holds more than such shingles are grouped into clusters of sets that are connected by shared prefix
   shingles of the first order. Clusters are compared in tiles of bounded size, inside which the prefixes of every order
   must meet and the sets are then intersected exactly. A tile gives links as a spanning forest, never its pairs.

Equal sets are one class throughout, known by a 64-bit hash of the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import packed, query, table, text_slices
from stratalens.llm.components import components
from stratalens.llm.text import mix, shingles

ORDERS = 3
TILE = 512
CHUNK_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 20
HOT_SHARE = 1000
HOT_LEAST = 64
KEEP_TEXTS = 4 * HOT_SHARE
KEEP_TOKENS = 1 << 19
STRIP = 8192


def classes_of(doc: np.ndarray, token: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and size of each text's set; the hash does not depend on the order of the set."""
    size = np.bincount(doc, minlength=docs)
    out = np.zeros(docs, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        total = np.add.reduceat(mix(token ^ np.uint64(0xA5A5A5A55A5A5A5A)), (np.cumsum(size) - size)[some])
        out[some] = mix(total + size[some].astype(np.uint64))
    return out.view(np.int64), size


def _first_of_class(kind: np.ndarray, size: np.ndarray) -> np.ndarray:
    first = np.zeros(len(kind), bool)
    first[np.unique(kind, return_index=True)[1]] = True
    return first & (size > 0)


class Counts:
    """Counts of the frequent shingles of a task in bounded memory (lossy counting).

    Shingles are kept over all slices; whenever ``KEEP_TEXTS`` texts or ``KEEP_TOKENS`` shingles have come in, those are
    dropped that cannot have been in more texts than there were such rounds. A count is short by at most the rounds,
    so a shingle in a thousandth of the texts of a task is found where texts are of usual length, and one in a tenth
    of them wherever ``KEEP_TOKENS`` shingles hold twenty texts.
    """

    def __init__(self):
        self.value, self.times, self.short = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting, self.texts, self.tokens, self.round = [], 0, 0, 1

    def add(self, token: np.ndarray, texts: int) -> None:
        self.waiting.append(token)
        self.texts, self.tokens = self.texts + texts, self.tokens + len(token)
        if self.texts >= KEEP_TEXTS or self.tokens >= KEEP_TOKENS:
            self._merge()
            keep = self.times + self.short > self.round
            self.value, self.times, self.short = self.value[keep], self.times[keep], self.short[keep]
            self.texts = self.tokens = 0
            self.round += 1

    def _merge(self) -> None:
        new, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        value, back = np.unique(np.concatenate([self.value, new]), return_inverse=True)
        times, short = np.zeros(len(value), np.int64), np.full(len(value), self.round - 1)
        np.add.at(times, back[:len(self.value)], self.times)
        np.add.at(times, back[len(self.value):], count)
        short[back[:len(self.value)]] = self.short
        self.value, self.times, self.short, self.waiting = value, times, short, []

    def often(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles held twice or more, with their counts."""
        self._merge()
        often = self.times > 1
        return self.value[often], self.times[often]


def _hot(rows: DataFrame, n: int) -> tuple[np.ndarray, int, int]:
    """Frequent shingles in ascending order of (count, value), the number of texts, the number of shingles."""

    def count(batches):
        held = Counts()
        texts_seen = total = 0
        for part in text_slices(batches, "text", 1 << 20):
            doc, token = shingles(part.column("text").to_pylist(), n)
            kind, size = classes_of(doc, token, part.num_rows)
            texts_seen += part.num_rows
            total += len(token)
            held.add(token[_first_of_class(kind, size)[doc]], part.num_rows)
        value, times = held.often()
        for first in range(0, len(value), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(value[first:first + (1 << 16)].view(np.int64)),
                                              pa.array(times[first:first + (1 << 16)])], ["token", "times"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(2, pa.int64()), pa.array([-texts_seen, total], pa.int64())], ["token", "times"])

    counted = rows.select("text").mapInArrow(count, "token long, times long")
    counted = runtime.materialise(
        counted.groupBy("token", F.expr("token is null and times < 0").alias("texts")).agg(F.sum("times").alias("times")))
    sums = {r.texts: r.times for r in counted.filter("token is null").collect()}
    texts, total = -(sums.get(True) or 0), sums.get(False) or 0
    least = max(HOT_LEAST, texts // HOT_SHARE)
    found = counted.filter(F.col("token").isNotNull() & (F.col("times") >= least)).select("token", "times").toArrow()
    value, times = found.column("token").to_numpy(), found.column("times").to_numpy()
    return value[np.lexsort((value, times))], texts, total


def _frequencies(rows: DataFrame, hot: np.ndarray, buckets: int, n: int) -> DataFrame:
    """Rows of two kinds. A shingle shared by several classes: ``class, token, freq``, one row for each of them.

    A text: ``class, doc_id, n`` and, at the first text of a class in its block, ``hot``: positions of its frequent
    shingles in their list.
    """
    by_value = np.argsort(hot)
    known = rows.sparkSession.sparkContext.broadcast((hot[by_value], by_value))
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    def blocks(batches):
        held, tokens, seen = [], 0, 0
        values, places = known.value
        for part in text_slices(batches, "text", 1 << 20):
            doc, token = shingles(part.column("text").to_pylist(), n)
            kind, size = classes_of(doc, token, part.num_rows)
            keep = _first_of_class(kind, size)
            doc, token = doc[keep[doc]], token[keep[doc]]
            at = np.minimum(np.searchsorted(values, token.view(np.int64)), max(len(values) - 1, 0))
            is_hot = values[at] == token.view(np.int64) if len(values) else np.zeros(len(token), bool)
            cut = np.concatenate([[0], np.cumsum(np.bincount(doc[is_hot], minlength=part.num_rows))])
            place = mix(np.arange(seen, seen + len(kind), dtype=np.uint64) ^ kind.view(np.uint64))  # copies of a text go apart
            seen += len(kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets + (place % np.uint64(buckets)).astype(np.int64)), pa.nulls(len(kind), pa.binary()),
                 pa.nulls(len(kind), pa.binary()), pa.nulls(len(kind), pa.binary()), part.column("doc_id"),
                 pa.array(kind), pa.array(size.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(places[at[is_hot]].astype(np.int32)))],
                ["bucket", "tokens", "owners", "classes", "doc_id", "class", "n", "hot"])
            held.append((kind[doc[~is_hot]], token[~is_hot]))
            tokens += len(held[-1][1])
            if tokens >= CHUNK_TOKENS:
                yield from emit(held)
                held, tokens = [], 0
        if tokens:
            yield from emit(held)

    def emit(held):
        kind, token = (np.concatenate(x) for x in zip(*held))
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        kind, rest = kind[order], (token // np.uint64(buckets))[order] & np.uint64((1 << 48) - 1)
        for b in np.flatnonzero(np.diff(cut)):
            which, owner = np.unique(kind[cut[b]:cut[b + 1]], return_inverse=True)
            planes = np.ascontiguousarray(rest[cut[b]:cut[b + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b]), pa.array([planes.tobytes()], pa.binary()),
                 pa.array([owner.astype("<u2" if len(which) < 1 << 16 else "<u4").tobytes()], pa.binary()),
                 pa.array([which.tobytes()], pa.binary()), pa.nulls(1, rows_kind), pa.nulls(1, pa.int64()),
                 pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32()))],
                ["bucket", "tokens", "owners", "classes", "doc_id", "class", "n", "hot"])

    def count(group):
        bucket = group.column("bucket")[0].as_py()
        names = ["class", "token", "freq", "doc_id", "n", "hot"]
        if bucket >= buckets:
            empty = pa.nulls(group.num_rows, pa.int64())
            return pa.table([group.column("class"), empty, empty, group.column("doc_id"), group.column("n"),
                             group.column("hot")], names=names)
        kinds, tokens = [], []
        for planes, owners, which in zip(*(group.column(c) for c in ("tokens", "owners", "classes"))):
            six = np.frombuffer(planes.as_py(), np.uint8).reshape(6, -1)
            wide = np.zeros((six.shape[1], 8), np.uint8)
            wide[:, :6] = six.T
            tokens.append(wide.view("<u8").ravel())
            which = np.frombuffer(which.as_py(), np.int64)
            owner = np.frombuffer(owners.as_py(), "<u2" if len(which) < 1 << 16 else "<u4")
            kinds.append(which[owner])
        kind, token = np.concatenate(kinds), np.concatenate(tokens)
        order = np.argsort(token)
        kind, token = kind[order], token[order]
        near = token[1:] == token[:-1]
        some = np.concatenate([near, [False]]) | np.concatenate([[False], near])
        kind, token = kind[some], token[some]  # shingles that occur once leave here
        order = np.lexsort((kind, token))
        kind, token = kind[order], token[order]
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (token[1:] != token[:-1])
        kind, token = kind[new], token[new]
        _, back, freq = np.unique(token, return_inverse=True, return_counts=True)
        shared = freq[back] > 1
        value = token[shared] * np.uint64(buckets) + np.uint64(bucket)
        m = len(value)
        return pa.table([pa.array(kind[shared]), pa.array(value.view(np.int64)), pa.array(freq[back][shared]),
                         pa.nulls(m, rows_kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32()))],
                        names=names)

    rows_kind = pa.int64() if id_kind == "bigint" else pa.int32() if id_kind == "int" else pa.string()
    sent = rows.mapInArrow(blocks, f"bucket long, tokens binary, owners binary, classes binary, doc_id {id_kind}, "
                                   "class long, n long, hot array<int>")
    path = runtime.scratch_path(rows.sparkSession, "shingles")
    sent.groupBy("bucket").applyInArrow(
        count, f"class long, token long, freq long, doc_id {id_kind}, n long, hot array<int>").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _prefixes(sets: DataFrame, hot: np.ndarray, share: tuple[int, int]) -> DataFrame:
    """``node, size, n, tokens, prefix0..``: the shared shingles of each set and, per order, those in its prefix."""
    known = sets.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in batches:
            out = {"tokens": []} | {f"prefix{k}": [] for k in range(ORDERS)}
            for n, shared, common in zip(batch.column("n"), batch.column("shared"), batch.column("hot")):
                n = n.as_py()
                pairs = shared.values
                token = pairs.field("token").to_numpy() if len(pairs) else np.zeros(0, np.int64)
                freq = pairs.field("freq").to_numpy() if len(pairs) else np.zeros(0, np.int64)
                place = common.values.to_numpy() if common.is_valid else np.zeros(0, np.int32)
                every = np.concatenate([token, known.value[place]])
                # frequent shingles come after all others, by their place in the list of frequent ones
                rank = np.concatenate([freq, place.astype(np.int64) + (1 << 60)])
                left = n - -(-share[0] * n // share[1]) + 1 - (n - len(every))
                out["tokens"].append(np.sort(every))
                for k in range(ORDERS):
                    tie = mix(every.view(np.uint64) + np.uint64(k + 1))
                    out[f"prefix{k}"].append(every[np.lexsort((tie, rank))[:max(left, 0)]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("node", "size", "n")]
                + [pa.array(v, pa.list_(pa.int64())) for v in out.values()], ["node", "size", "n", *out])

    lists = ", ".join(f"{c} array<long>" for c in ["tokens"] + [f"prefix{k}" for k in range(ORDERS)])
    return sets.mapInArrow(run, f"node {sets.schema['node'].dataType.simpleString()}, size long, n long, {lists}")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of shared values of every pair of arrays, by products of strips of their incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = left + right
    values = np.concatenate(both)
    if not len(values):
        return out
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    twice = times[column] > 1
    row, column = row[twice], (np.cumsum(times > 1) - 1)[column[twice]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, total, STRIP):
        low, high = np.searchsorted(column, [first, first + STRIP])
        m = np.zeros((len(both), min(STRIP, total - first)), np.float32)
        m[row[low:high], column[low:high] - first] = 1
        out += m[:len(left)] @ m[len(left):].T
    return out


def _links(clusters: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``node, root, near``: per tile a forest of the linked sets, and how many texts each is linked with."""
    kind = clusters.schema["node"].dataType.simpleString()

    def compare(group):
        first, second = group.column("row_tile")[0].as_py(), group.column("column_tile")[0].as_py()
        tile = group.column("tile").to_numpy()
        node, size, n = (group.column(c).to_numpy() for c in ("node", "size", "n"))
        a, b = np.flatnonzero(tile == first), np.flatnonzero(tile == second)

        def lists(column, at):
            flat = group.column(column).combine_chunks()
            ends = flat.offsets.to_numpy()
            values = flat.values.to_numpy()
            return [values[ends[i]:ends[i + 1]] for i in at]

        linked = np.ones((len(a), len(b)), bool)
        for k in range(ORDERS):
            linked &= _common(lists(f"prefix{k}", a), lists(f"prefix{k}", b)) > 0
        if first == second:
            linked &= np.triu(np.ones(linked.shape, bool), 1)
        if linked.any():
            rows, columns = linked.any(1), linked.any(0)
            c = np.zeros(linked.shape)
            c[np.ix_(rows, columns)] = _common(lists("tokens", a[rows]), lists("tokens", b[columns]))
            linked &= share[1] * c >= share[0] * (n[a][:, None] + n[b][None, :] - c)
        near = np.zeros(len(node), np.int64)
        i, j = np.nonzero(linked)
        np.add.at(near, a[i], size[b[j]])
        np.add.at(near, b[j], size[a[i]])
        root = np.arange(len(node))
        while True:  # smallest position reached, over links and then over roots of roots
            before = root.copy()
            np.minimum.at(root, a[i], root[b[j]])
            np.minimum.at(root, b[j], root[a[i]])
            root = root[root]
            if (root == before).all():
                break
        some = near > 0
        return pa.table({"node": group.column("node").filter(pa.array(some)),
                         "root": group.column("node").take(pa.array(root[some])), "near": pa.array(near[some])})

    return clusters.groupBy("cluster", "row_tile", "column_tile").applyInArrow(
        compare, f"node {kind}, root {kind}, near long")


def join_texts(docs: DataFrame, *, id_col="doc_id", text_col="text", words: int = 5,
               share: tuple[int, int] = (75, 100)) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row.

    Two texts link when their sets of ``words``-word shingles have a Jaccard similarity of at least ``share``.
    ``component_id``: the smallest id reached by links; ``n_links``: other rows linked directly, copies included. A text
    without words, or null, has an empty set and links with nothing. Rows that share an id are one node; a null id
    links others only through equal texts, and its component is null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    runtime.ship_package(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hot, texts, total = _hot(rows, words)
    buckets = max(-(-total // BUCKET_TOKENS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = _frequencies(rows, hot, buckets, words)
    members = found.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("node"), F.count("*").alias("size"))
    sets = (found.filter("n is null or n > 0").groupBy("class")
            .agg(F.min("doc_id").alias("node"), F.count("n").alias("size"), F.max("n").alias("n"),
                 F.max_by("hot", F.size("hot")).alias("hot"),
                 F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", "freq"))).alias("shared")))
    alone = F.col("n") - F.size("shared") - F.coalesce(F.size("hot"), F.lit(0))
    prefix = F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + 1
    sets = runtime.materialise(_prefixes(sets.filter(F.col("node").isNotNull() & (alone < prefix)), hot, share))
    first = sets.select("node", F.explode("prefix0").alias("token"))
    meet = first.groupBy("token").agg(F.min("node").alias("low"), F.count("*").alias("held")).filter("held > 1")
    edges = (first.join(meet, "token").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    cluster = components(edges)
    roots = cluster.select("root").distinct().select(F.col("root").alias("node"), "root")
    placed = runtime.materialise(sets.join(cluster.union(roots).withColumnRenamed("root", "cluster"), "node"))
    tiles = placed.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    spread = (placed.join(tiles, "cluster")
              .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles").cast("long")).cast("int"))
              .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
              .withColumn("row_tile", F.least("tile", "other")).withColumn("column_tile", F.greatest("tile", "other")))
    links = runtime.materialise(_links(spread, share))
    reached = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    near = links.groupBy("node").agg(F.sum("near").alias("near"))
    result = (members.join(near, "node", "left").join(reached, "node", "left")
              .select(F.col("class").alias("of"), F.coalesce("root", "node").alias("component_id"),
                      (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    every = found.filter("n is not null").select("doc_id", F.when(F.col("n") > 0, F.col("class")).alias("class"), "n")
    return (every.join(result, F.col("class") == F.col("of"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                      else list_distinct([array_to_string(w[i:i + 4], ' ') for i in generate_series(1, len(w) - 4)]) end as s
  from words),
sizes as (select doc_id, cast(len(s) as bigint) as n from sets),
tokens as (select doc_id, unnest(s) as t from sets),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id group by all),
link as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach(id, root) as (
  select doc_id, doc_id from documents
  union
  select l.b, r.root from reach r join link l on l.a = r.id where r.root < l.b),
root as (select id, min(root) as root from reach group by id),
degree as (select a, count(*) as n from link group by a)
select s.doc_id, s.n as n_shingles, r.root as component_id, coalesce(d.n, 0) as n_links
from sizes s join root r on r.id = s.doc_id left join degree d on d.a = s.doc_id
"""


@query("op4_ngram_join", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_texts(table(spark, sf_dir, "documents"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the row with the smallest id, all columns kept.

    Rows that share an id stay or go together; rows with a null id stay.
    """
    found = join_texts(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("copy")).distinct()
    rows = packed(docs, "doc_id").withColumnRenamed("text", "id")
    return rows.join(found, F.col("id") == F.col("copy"), "left_anti").select("row.*")
