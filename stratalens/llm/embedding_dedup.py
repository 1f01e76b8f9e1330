"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors of a label are put in the lexicographic order of 48 random hyperplane signs; each is compared
with its next ``window`` neighbours, and the pairs of all passes at or above the cosine are united. The number of passes
follows from the number of vectors, so that a pair at the threshold is missed by all passes in one case of a thousand
where the vectors are spread evenly. Near copies are not, so every component of the found links is then compared whole:
link counts are those of all pairs of a component, large or small. Small components share a block of cosines, large
ones are compared tile against tile.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import query, table
from stratalens.llm.components import components

BITS = 48
BLOCK = 1024
#: Vectors of a tile: at least, and at most in a component of more than 32 tiles.
TILE = (1024, 8192)


def passes_for(vectors: int, window: int, least: float, missed: float = 1e-3) -> int:
    """Passes after which a pair at the threshold has stayed outside every window with probability ``missed``."""
    bits = max(1.0, log2(max(2, vectors) / window))
    agree = (1 - acos(least) / pi) ** bits
    return max(4, ceil(log(missed) / log(1 - agree)))


def signs(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """Of each row one integer per pass: the signs of ``BITS`` random projections as binary digits."""
    planes = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], passes * BITS))
    bits = (x @ planes > 0).reshape(len(x), passes, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _matrix(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector length, with the vectors as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(size)])
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out.append((at, flat[first[at][:, None] + np.arange(d)]))
    return out


def linked_pairs(classes: DataFrame, *, least: float, window: int, passes: int, seed: int) -> DataFrame:
    """Distinct pairs ``a < b`` of ``node`` found with a cosine of at least ``least``; label and length must be equal.

    ``classes``: ``node, label, vector``. All passes are one sort of small rows (pass, label, signs, node); ranks in that
    order cut it into blocks of ``BLOCK`` rows, each with the ``window`` rows after it, whatever the partitioning.
    """
    def keys(batches):
        for batch in batches:
            for at, x in _matrix(batch.column("vector")):
                rows = np.repeat(at, passes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(rows)), batch.column("label").take(pa.array(rows)),
                     pa.array(np.full(len(rows), x.shape[1], np.int64)),
                     pa.array(np.tile(np.arange(passes, dtype=np.int64), len(at))),
                     pa.array(signs(x, passes, seed).ravel())],
                    ["node", "label", "dim", "turn", "key"])

    types = {f.name: f.dataType.simpleString() for f in classes.schema}
    lean = classes.mapInArrow(keys, f"node {types['node']}, label {types['label']}, dim long, turn long, key long")
    order = ["turn", "label", "dim", "key", "node"]
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lined = runtime.materialise(
        lean.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = {r.part: r.n for r in lined.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = np.cumsum([0] + [counts.get(p, 0) for p in range(max(counts, default=0) + 1)])
    starts = F.broadcast(classes.sparkSession.createDataFrame(
        [(p, int(before[p])) for p in counts], "at_part int, before long"))
    ranked = (lined.join(starts, F.col("part") == F.col("at_part"))
              .withColumn("rank", F.col("before") + F.col("place"))
              .select("node", "label", "dim", "turn", "rank"))
    rank = F.col("rank")
    blocks = ranked.withColumn("block", F.explode(F.when(
        (rank % BLOCK < window) & (rank >= BLOCK), F.array(F.floor(rank / BLOCK), F.floor(rank / BLOCK) - 1))
        .otherwise(F.array(F.floor(rank / BLOCK)))))

    def compare(group):
        group = group.sort_by([("rank", "ascending")])
        rank, block = group.column("rank").to_numpy(), group.column("block")[0].as_py()
        kind = np.stack([group.column(c).to_numpy() for c in ("turn", "label", "dim")], 1)
        cuts = np.concatenate([[0], np.flatnonzero((kind[1:] != kind[:-1]).any(1)) + 1, [len(rank)]])
        left, right = [], []
        for low, high in zip(cuts[:-1], cuts[1:]):
            part = group.slice(low, high - low)
            (_, x), = _matrix(part.column("vector"))
            x /= np.sqrt((x * x).sum(1))[:, None]
            near = x @ x.T >= least
            i, j = np.nonzero(np.triu(near, 1) & ~np.triu(near, window + 1))
            own = rank[low + i] // BLOCK == block
            left.append(low + i[own]), right.append(low + j[own])
        node = group.column("node").to_numpy()
        a, b = node[np.concatenate(left)], node[np.concatenate(right)]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    whole = blocks.join(classes.select(F.col("node").alias("of"), "vector"), F.col("node") == F.col("of")).drop("of")
    return whole.groupBy("block").applyInArrow(compare, f"a {types['node']}, b {types['node']}").distinct()


def whole_counts(members: DataFrame, least: float) -> DataFrame:
    """``node, near``: over all pairs of a root, the summed ``size`` of the vectors that link with each.

    ``members``: ``node, root, size, vector``, the vectors of a root of one length. Tiles are dealt by the hash of the node;
    a pair of tiles is one group, in which only blocks of ``BLOCK`` by ``BLOCK`` cosines exist at a time. Roots of fewer
    than ``BLOCK`` vectors are dealt whole into bundles of about that many, in which only vectors of one root meet.
    """
    type_of = next(f.dataType.simpleString() for f in members.schema if f.name == "node")
    count = runtime.materialise(members.groupBy(F.col("root").alias("of"), F.size("vector").alias("dim")).agg(F.count("*").alias("n")))
    small = F.col("n") < BLOCK
    few = count.filter(small).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bundles = max(1, -(-few // BLOCK))
    height = F.least(F.lit(TILE[1]), F.greatest(F.lit(TILE[0]), F.ceil(F.col("n") / 32)))
    tiles = (members.join(runtime.broadcast_if_small(count), F.col("root") == F.col("of"))
             .withColumn("tiles", F.when(small, 1).otherwise(F.ceil(F.col("n") / height)).cast("int"))
             .withColumn("unit", F.when(small, F.pmod(F.xxhash64("root", F.lit(7)), F.lit(bundles))).otherwise(F.xxhash64("root", F.lit(9))))
             .withColumn("tile", F.pmod(F.xxhash64("node", F.lit(5)), F.col("tiles")).cast("int"))
             .groupBy("unit", "dim", "tiles", "tile").agg(F.collect_list(F.struct("node", "root", "size", "vector")).alias("held")))
    jobs = tiles.select("unit", "dim", "tile", "held", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        "unit", "dim", "tile", "held", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    def compare(group):
        sides = []
        for held in group.sort_by([("tile", "ascending")]).column("held").combine_chunks():
            (_, x), = _matrix(held.values.field("vector"))
            x /= np.sqrt((x * x).sum(1))[:, None]
            sides.append((held.values.field("node"), held.values.field("size").to_numpy().astype(np.float64), x,
                          np.unique(held.values.field("root").to_numpy(), return_inverse=True)))
        out, same = [np.zeros(len(x)) for _, _, x, _ in sides], group.column("low")[0].as_py() == group.column("high")[0].as_py()
        if same or len(sides) == 2:  # else the other tile is empty
            (_, left, x, (names, mine)), (_, right, y, (others, theirs)) = sides[0], sides[-1]
            theirs = np.searchsorted(names, others)[theirs] if len(names) > 1 or not same else theirs
            for i in range(0, len(x), BLOCK):
                for j in range(0, len(y), BLOCK):
                    near = x[i:i + BLOCK] @ y[j:j + BLOCK].T >= least
                    near &= mine[i:i + BLOCK][:, None] == theirs[j:j + BLOCK][None, :]
                    if same and i == j:
                        np.fill_diagonal(near, False)
                    out[0][i:i + BLOCK] += near @ right[j:j + BLOCK]
                    if not same:
                        out[1][j:j + BLOCK] += left[i:i + BLOCK] @ near
        return pa.table({"node": pa.concat_arrays([n for n, _, _, _ in sides]),
                         "near": pa.array(np.concatenate(out).astype(np.int64))})

    return (jobs.groupBy("unit", "dim", "low", "high").applyInArrow(compare, f"node {type_of}, near long")
            .groupBy("node").agg(F.sum("near").alias("near")))


def near_duplicates(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label",
                    least: float = 0.98, window: int = 256, seed: int = 13) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Equal vectors of a label are one class and link with one another without being compared. Vectors that are null,
    empty, zero, or hold null or non-finite components, and rows with a null label or id, link with nothing: n_links 0,
    the row its own component, kept. Rows that share an id count as one vector.
    """
    runtime.ship_package(vectors.sparkSession)
    x = F.col("vector")
    fine = (F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists(x, lambda v: v != 0))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.transform(F.col(vector_col), lambda v: v + F.lit(0.0).cast("float")
                                      if "float" in vectors.schema[vector_col].dataType.simpleString() else v + F.lit(0.0))
                          .alias("vector"))
    usable = F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(usable, x).alias("vector"),
                       *[F.when(usable, F.xxhash64(F.lit(s), "label", x)).alias(f"h{s}") for s in (1, 2)])
    classes = runtime.materialise(
        rows.filter("vector is not null").groupBy("h1", "h2", "label")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("vector").alias("vector")))
    n = classes.count()
    pairs = runtime.materialise(linked_pairs(
        classes.select("node", "label", "vector"), least=least, window=window, passes=passes_for(n, window, least), seed=seed))
    roots = components(pairs)
    member = roots.union(roots.select("root", "root").distinct()).toDF("member", "root")
    members = runtime.materialise(
        member.join(classes, F.col("member") == F.col("node")).select("node", "root", "size", "vector"))
    links = whole_counts(members, least).withColumnRenamed("node", "a")
    found = (classes.select("h1", "h2", "node", "size").join(links, F.col("node") == F.col("a"), "left").drop("a")
             .join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
             .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("root", "node").alias("root"),
                     (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links")))
    keys = rows.select("vec_id", "h1", "h2")
    return (keys.join(found, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("root", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


SQL = """
with recursive good as (
  select vec_id, label, cast(embedding as double[]) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and list_bool_and([x is not null and isfinite(x) for x in embedding])
    and list_bool_or([x <> 0 for x in embedding])),
unit as (select vec_id, label, v, sqrt(list_inner_product(v, v)) as norm from good),
link as (
  select a.vec_id as a, b.vec_id as b from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id
  where list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach(id, root) as (
  select vec_id, vec_id from embeddings
  union
  select l.b, r.root from reach r join link l on l.a = r.id where r.root < l.b),
root as (select id, min(root) as root from reach group by id),
degree as (select a, count(*) as n from link group by a)
select e.vec_id, coalesce(d.n, 0) as n_links, r.root as component_id, e.vec_id = r.root as kept
from embeddings e join root r on r.id = e.vec_id left join degree d on d.a = e.vec_id
"""


@query("op2_embedding_dedup", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
