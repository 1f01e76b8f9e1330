"""Class cleaning and rebalancing inside strata: Tomek links and SMOTE."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stratalens.functions.digests import replicate_digests
from stratalens.operators.logit import Formula
from stratalens.operators.neighbours import HeomSpace, heom_search, hvdm_knn
from stratalens.runtime import BROADCAST_ROWS, broadcast_if_small, materialise, ship_package, spread_in_order

DIGITS = 2          # hex digits of a rank that one histogram resolves
FEW_AT_CUT = 4096   # rows of one digit that are ordered by themselves
BAND = 3.0          # standard deviations on either side of where a cut is looked for first
MOST_PATTERNS = 1 << 20  # covariate patterns of a formula that are numbered one by one
MOST_SUMS = 1 << 22      # sums of one outcome that a task holds
GROWTH = 0.5      # synthetic rows per minority row
NEIGHBOURS = 5


def tomek_links(rows: DataFrame, group: Sequence[str], categories: Sequence[str], number: str, row_id: str,
                y: str = "y", slices: int | None = None) -> DataFrame:
    """Mutual nearest neighbours of different class: (group, ``minority``, ``majority``).

    The nearest row is looked up for minority rows, then only for the majority
    rows that were found.
    """
    group = list(group)
    space = HeomSpace.of(rows, group, categories, number, row_id, slices)
    first = heom_search(rows.filter(F.col(y) == 1), space)
    met = first.select(*group, F.col("nn").alias(row_id)).distinct()
    candidates = rows.filter(F.col(y) == 0).join(met, [*group, row_id], "left_semi")
    second = heom_search(candidates, space)
    out = first.select(*group, F.col(row_id).alias("minority"), F.col("nn").alias("majority"))
    back = second.select(*group, F.col(row_id).alias("majority"), F.col("nn").alias("minority"))
    return out.join(back, [*group, "majority", "minority"])


def drop_tomek_majority(rows: DataFrame, links: DataFrame, group: Sequence[str], row_id: str) -> DataFrame:
    return rows.join(links.select(*group, F.col("majority").alias(row_id)), [*group, row_id], "left_anti")


def smote_parents(rows: DataFrame, group: Sequence[str], categories: Sequence[str], number: str, row_id: str,
                  y: str = "y", k: int = NEIGHBOURS, slices: int | None = None) -> DataFrame:
    """Minority rows with their neighbours' values, ready to draw from any number of times."""
    return materialise(parents_of(rows, group, categories, number, row_id, y, k, slices))


def parents_of(rows: DataFrame, group: Sequence[str], categories: Sequence[str], number: str, row_id: str,
               y: str = "y", k: int = NEIGHBOURS, slices: int | None = None) -> DataFrame:
    """The rows of :func:`smote_parents`, for the caller to keep."""
    group = list(group)
    knn = hvdm_knn(rows, group, categories, number, row_id, y, k, slices)
    minority = rows.filter(F.col(y) == 1).select(*group, row_id, number, *categories)
    wanted = knn.select(*group, row_id, F.posexplode("neighbours").alias("slot", "hit")).select(
        *group, F.col(row_id).alias("parent"), "slot", F.col("hit.id").alias(row_id))
    partner = F.struct("slot", F.col(row_id).alias("nn"), F.col(number).alias("nn_number"),
                       *[F.col(c).alias(f"nn_{c}") for c in categories])
    partners = (
        wanted.join(minority, [*group, row_id]).groupBy(*group, F.col("parent").alias("parent"))
        .agg(F.sort_array(F.collect_list(partner)).alias("partners"))
        .withColumnRenamed("parent", row_id)
    )
    sizes = minority.groupBy(*group).agg(F.floor(F.count("*") * GROWTH).cast("int").alias("need"))
    return spread_in_order(minority.join(partners, [*group, row_id]).join(broadcast_if_small(sizes), group), *group, row_id)


def _drawn(parents: DataFrame, group: Sequence[str], row_id: str, first: int, last: int, seed: int) -> DataFrame:
    """Every parent in every replicate, with the md5 digits of (seed, outcome, replicate, row) and its rank among them."""
    key = f"md5(concat_ws('|', '{seed}', {group[0]}, replicate, {row_id}))"
    every = parents.selectExpr("*", f"explode(sequence({first}, {last})) as replicate").selectExpr("*", f"{key} as digits")
    return every.withColumn("pick", F.expr("cast(conv(substr(digits, 1, 8), 16, 10) as bigint)"))


def replicate_cuts(parents: DataFrame, group: Sequence[str], row_id: str, first: int, last: int, seed: int) -> DataFrame:
    """(group, replicate, ``cut``): the rank and id of the last row that each replicate takes.

    Ranks are spread evenly, so the cut of a group is nearly always within a narrow band around its share of the rows.
    Rows below the band are counted where they are drawn, those inside leave the task and are ordered; replicates whose
    cut is elsewhere are looked at again in a band twice as wide, the last time in all rows. Ids that are no whole
    numbers take the way of :func:`_cuts_by_digits`.
    """
    group = list(group)
    keys = [*group, "replicate"]
    if not isinstance(parents.schema[row_id].dataType, T.IntegralType):
        return _cuts_by_digits(parents, group, row_id, first, last, seed)
    sizes = parents.groupBy(*group).agg(F.count("*").alias("size"), F.first("need").cast("bigint").alias("need"))
    sizes = broadcast_if_small(materialise(sizes.filter("need between 1 and size")))
    slim = parents.select(*group, F.col(row_id).cast("bigint").alias("id"), *_texts(group, row_id, seed)).join(sizes, group)
    asked, width, found = slim.withColumn("numbers", F.lit(None).cast("array<int>")), BAND, []
    kind = parents.schema[row_id].dataType.simpleString()
    while True:
        ordered = _near_the_cut(asked, group, first, last, width).groupBy(*keys).agg(
            F.first("need").alias("need"), F.sum("below").alias("below"), F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
        ordered = materialise(ordered.selectExpr(
            *keys, "if(need > below and need <= below + size(near), near[cast(need - below - 1 as int)], null) as cut"))
        found.append(ordered.filter("cut is not null").selectExpr(
            *keys, f"named_struct('pick', cut.pick, 'id', cast(cut.id as {kind})) as cut"))
        missed = ordered.filter("cut is null").groupBy(*group).agg(F.collect_list("replicate").alias("numbers"))
        if missed.isEmpty():
            break
        asked, width = slim.join(broadcast_if_small(materialise(missed)), group), 2 * width
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _texts(group: Sequence[str], row_id: str, seed: int) -> list:
    """What the digits of a row are taken from, beside the number of the replicate."""
    return [F.concat_ws("|", F.lit(str(seed)), F.col(group[0])).alias("head"), F.col(row_id).cast("string").alias("tail")]


def _runs(batch: pa.RecordBatch, group: Sequence[str], lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the rows of each group whose ids have the same length."""
    code = lengths.astype(np.int64)
    for g in group:
        own = batch.column(g).dictionary_encode()
        code = np.unique(code * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False),
                         return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []


def _tails(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids, where each begins and how long it is."""
    tail = batch.column("tail").cast(pa.large_string())
    starts = np.frombuffer(tail.buffers()[1], np.int64)[tail.offset:tail.offset + len(tail) + 1]
    return np.frombuffer(tail.buffers()[2], np.uint8), starts[:-1], np.diff(starts)


def _near_the_cut(asked: DataFrame, group: Sequence[str], first: int, last: int, width: float) -> DataFrame:
    """Per batch, group and replicate: the rows below the band and the ranks and ids inside it."""
    ship_package(asked.sparkSession)
    group = list(group)
    point = T.StructType([T.StructField("pick", T.LongType()), T.StructField("id", T.LongType())])
    schema = T.StructType([*[asked.schema[g] for g in group], T.StructField("replicate", T.IntegerType()), T.StructField("need", T.LongType()),
                           T.StructField("below", T.LongType()), T.StructField("near", T.ArrayType(point))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, lengths = _tails(batch)
            ids = batch.column("id").to_numpy()
            for rows in _runs(batch, group, lengths):
                at = int(rows[0])
                need, size, numbers = (batch.column(c)[at].as_py() for c in ("need", "size", "numbers"))
                numbers = np.arange(first, last + 1) if numbers is None else np.array(numbers)
                share, slack = need / size, width * math.sqrt(need * (size - need) / size) / size + 1 / size
                low = max(0, int((share - slack) * 2 ** 32))
                high = min(2 ** 32 - 1, int((share + slack) * 2 ** 32))
                tails = data[starts[rows][:, None] + np.arange(lengths[at])]
                below, found = np.zeros(len(numbers), np.int64), []
                for which, part, (pick, *_) in replicate_digests(batch.column("head")[at].as_py(), numbers, tails):
                    below[which] += (pick < low).sum(1)
                    r, i = np.nonzero((pick >= low) & (pick <= high))
                    found.append((which[r], pick[r, i].astype(np.int64), ids[rows[part]][i]))
                which, pick, near = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(which, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(numbers)))])
                points = pa.StructArray.from_arrays([pa.array(pick[order]), pa.array(near[order])], ["pick", "id"])
                same = pa.array(np.full(len(numbers), at))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(g).take(same) for g in group], pa.array(numbers, pa.int32()), pa.array(np.full(len(numbers), need)),
                     pa.array(below), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points)], schema.fieldNames())

    columns = [*group, "id", "head", "tail", "need", "size", "numbers"]
    return asked.select(*columns).mapInArrow(look, schema)


def _cuts_by_digits(parents: DataFrame, group: list[str], row_id: str, first: int, last: int, seed: int) -> DataFrame:
    """Counts per leading digits, combined before the shuffle, show which digits the cut falls on; only rows with these
    digits are looked at again, in finer digits while they are many, then by themselves.
    """
    keys = [*group, "replicate"]
    slim = _drawn(parents.select(*group, row_id, "need").filter("need > 0"), group, row_id, first, last, seed).drop("digits")
    open_ = slim.withColumn("rest", F.col("need").cast("bigint"))
    for level in range(1, 5):
        bits = 4 * DIGITS * (4 - level)
        counts = open_.groupBy(*keys, F.expr(f"shiftright(pick, {bits})").alias("head")).agg(
            F.count("*").alias("size"), F.first("rest").alias("rest"))
        upto = F.sum("size").over(Window.partitionBy(*keys).orderBy("head"))
        border = counts.withColumn("upto", upto).filter("upto >= rest and upto - size < rest").selectExpr(
            *keys, "head", "size", "rest - (upto - size) as rest")
        border = materialise(border)
        most = border.agg(F.max("size")).first()[0] or 0
        open_ = slim.withColumn("head", F.expr(f"shiftright(pick, {bits})")).join(
            broadcast_if_small(border), [*keys, "head"]).drop("head", "size")
        if most <= FEW_AT_CUT:
            break
    ordered = F.sort_array(F.collect_list(F.struct("pick", F.col(row_id).alias("id"))))
    last = open_.groupBy(*keys).agg(ordered.alias("ranked"), F.first("rest").alias("rest"))
    return last.select(*keys, F.expr("ranked[cast(rest - 1 as int)]").alias("cut"))


def smote(parents: DataFrame, group: Sequence[str], categories: Sequence[str], number: str, row_id: str,
          replicates: int, seed: int, first: int = 1) -> DataFrame:
    """Synthetic minority rows of every replicate from ``first`` to ``replicates``, from hash-seeded draws.

    The digits of one md5 per (seed, outcome, replicate, row) give the rank, the
    partner, the gap and, per category, which parent is copied. The draw of a row
    depends on nothing else, so a lost task repeats it exactly. A row is taken
    when its rank is not beyond the cut of its group and replicate: cuts are one
    small row each and broadcast, for as many replicates at a time as keep them
    so, and drawn rows leave the scan of their parents without a shuffle.
    """
    group = list(group)
    last = int(replicates)
    cuts = materialise(replicate_cuts(parents, group, row_id, first, last, seed))
    groups = max(1, cuts.select(*group).distinct().count())
    at_once = max(1, BROADCAST_ROWS // groups)
    number_at = lambda start, length: f"cast(conv(substr(digits, {start}, {length}), 16, 10) as bigint)"
    copied = [f"if({number_at(21 + i, 1)} % 2 = 1, mate.nn_{c}, {c}) as {c}" for i, c in enumerate(categories)]
    out = None
    for start in range(first, last + 1, at_once):
        end = min(start + at_once - 1, last)
        drawn = _drawn(parents, group, row_id, start, end, seed).drop("pick").join(
            broadcast_if_small(cuts.filter(F.col("replicate").between(start, end))), [*group, "replicate"])
        taken = drawn.filter(f"struct({number_at(1, 8)} as pick, {row_id} as id) <= cut")
        mate = taken.selectExpr("* except (partners)", f"partners[cast({number_at(9, 4)} % size(partners) as int)] as mate",
                                f"{number_at(13, 8)} / 4294967296D as gap")
        part = mate.selectExpr(
            *group, "replicate", row_id, "mate.nn",
            f"{number} + gap * (mate.nn_number - {number}) as {number}", *copied, "1 as y")
        out = part if out is None else out.unionByName(part)
    return out


def sums_in_tasks(parents: DataFrame, group: Sequence[str], categories: Sequence[str], row_id: str, formula: Formula) -> bool:
    """Whether :func:`smote_cells` can number the patterns of a formula: whole numbers as ids and as levels of categories."""
    whole = lambda c: isinstance(parents.schema[c].dataType, T.IntegralType)
    patterns = math.prod(len(levels) + 1 for levels in formula.factors.values())
    return (not formula.numbers and patterns <= MOST_PATTERNS and set(formula.factors) <= set(categories)
            and all(map(whole, [row_id, *formula.factors])))


def smote_cells(parents: DataFrame, group: Sequence[str], categories: Sequence[str], number: str, row_id: str,
                replicates: int, seed: int, formula: Formula, first: int = 1) -> DataFrame:
    """The rows of :func:`smote` as covariate cells: ``n``, ``w`` and ``wy`` per (outcome, replicate, pattern).

    The same draws from the same digits, made for many rows and replicates at a time; the task that draws the rows adds
    them up, so a pattern comes once per task and stretch of an outcome. Sums of several are left to the caller.
    """
    group, categories, last = list(group), list(categories), int(replicates)
    spark = parents.sparkSession
    ship_package(spark)
    cuts = materialise(replicate_cuts(parents, group, row_id, first, last, seed))
    groups = max(1, cuts.select(*group).distinct().count())
    at_once = max(1, BROADCAST_ROWS // groups)
    outcome, factors = group[0], dict(formula.factors)
    schema = T.StructType([parents.schema[outcome], T.StructField("replicate", T.IntegerType()), *[parents.schema[v] for v in factors],
                           T.StructField("n", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("wy", T.DoubleType())])
    mates = {"nn_number": F.col("partners.nn_number").cast("array<double>")} | {f"nn_{v}": F.col(f"partners.nn_{v}") for v in factors}
    slim = parents.select(*group, F.col(row_id).cast("bigint").alias("id"), *_texts(group, row_id, seed), F.col(number).cast("double").alias("number"),
                          *factors, *[x.alias(name) for name, x in mates.items()])
    out = None
    for start in range(first, last + 1, at_once):
        end = min(start + at_once - 1, last)
        now = cuts.filter(F.col("replicate").between(start, end)).select(*group, "replicate", "cut.pick", "cut.id").toArrow()
        known = spark.sparkContext.broadcast(_cut_table(now, group, start, end))
        part = slim.mapInArrow(_summed(known, group, categories, factors, schema, start, end), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _cut_table(cuts: pa.Table, group: Sequence[str], start: int, end: int) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Per group the ranks and ids of its cuts by replicate; a rank below 0 where a replicate takes nothing."""
    out: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for *key, r, pick, cut_id in zip(*[cuts.column(c).to_pylist() for c in (*group, "replicate", "pick", "id")]):
        ranks, ids = out.setdefault(tuple(key), (np.full(end - start + 1, -1), np.zeros(end - start + 1, np.int64)))
        ranks[r - start], ids[r - start] = pick, cut_id
    return out


def _valid(values: pa.Array) -> np.ndarray:
    return values.is_valid().to_numpy(zero_copy_only=False)


def _plain(values: pa.Array) -> np.ndarray:
    return values.fill_null(0).to_numpy(zero_copy_only=False)


def _summed(known, group: list[str], categories: list[str], factors: dict, schema: T.StructType, start: int, end: int):
    """The function of a task that draws its parents' rows and adds them up."""
    numbers = np.arange(start, end + 1)
    strides, size = {}, 1
    for v, levels in factors.items():
        strides[v], size = size, size * (len(levels) + 1)
    # the hex digit of a category, counted from the 21st, is a place in the third or fourth word; beyond 32 the own value stays
    bits = {v: (2 + (i >= 4), 12 - 4 * i if i < 4 else 28 - 4 * (i - 4)) for v in factors if (i := categories.index(v)) < 12}

    def codes(values: pa.Array, v: str) -> np.ndarray:
        """Which level a value is; the place after the last is for nulls."""
        levels = factors[v]
        got = np.full(len(values), len(levels), np.int64)
        mask, plain = _valid(values), _plain(values)
        unknown = mask.copy()
        for k, level in enumerate(levels):
            hit = mask & (plain == level)
            got[hit] = k
            unknown &= ~hit
        if unknown.any():
            raise ValueError(f"unknown level of {v}: {plain[unknown][0]}")
        return got * strides[v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, now, sums = known.value, None, None
        for batch in batches:
            data, starts, lengths = _tails(batch)
            ids = batch.column("id").to_numpy()
            weight, weighs = (f(batch.column("number")) for f in (_plain, _valid))
            near = batch.column("nn_number")
            offsets = near.offsets.to_numpy()
            mate_weight, mate_weighs = (f(near.values) for f in (_plain, _valid))
            own = {v: codes(batch.column(v), v) for v in factors}
            mate = {v: codes(batch.column(f"nn_{v}").values, v) for v in factors}
            fixed = sum((own[v] for v in factors if v not in bits), np.zeros(len(batch), np.int64))
            keys = list(zip(*[batch.column(g).to_pylist() for g in group]))
            for rows in _runs(batch, group, lengths):
                key = keys[rows[0]]
                if key not in cuts:
                    continue
                if now != key[0] or sums.full():
                    if sums is not None:
                        yield from sums.batches(now, start)
                    now, sums = key[0], _Sums(size, len(numbers), factors, strides, schema)
                ranks, cut_ids = (x[:, None] for x in cuts[key])
                tails = data[starts[rows][:, None] + np.arange(lengths[rows[0]])]
                for which, part, words in replicate_digests(batch.column("head")[int(rows[0])].as_py(), numbers, tails):
                    here = rows[part]
                    rank = words[0].astype(np.int64)
                    taken = rank < ranks[which]
                    tied = rank == ranks[which]
                    if tied.any():
                        taken |= tied & (ids[here] <= cut_ids[which])
                    r, i = np.nonzero(taken)
                    i = here[i]
                    words = [x[taken] for x in words]
                    at = offsets[i] + (words[1] >> 16) % (offsets[i + 1] - offsets[i])
                    gap = (((words[1] & 0xFFFF) << 16) | (words[2] >> 16)) / 4294967296.0
                    code = fixed[i]
                    for v, (word, shift) in bits.items():
                        code += np.where(words[word] >> shift & 1, mate[v][at], own[v][i])
                    sums.add(code, which[r], weight[i] + gap * (mate_weight[at] - weight[i]), weighs[i] & mate_weighs[at])
        if sums is not None:
            yield from sums.batches(now, start)

    return run


class _Sums:
    """Counts and weights of the patterns met so far, by replicate."""

    def __init__(self, size: int, replicates: int, factors: dict, strides: dict, schema: T.StructType):
        self.slot, self.codes, self.width = np.full(size, -1), np.zeros(0, np.int64), replicates
        self.n, self.known, self.w = (np.zeros(0, kind) for kind in (np.int64, np.int64, float))
        self.factors, self.strides, self.schema = factors, strides, schema

    def full(self) -> bool:
        return len(self.n) > MOST_SUMS

    def add(self, code: np.ndarray, replicate: np.ndarray, w: np.ndarray, weighs: np.ndarray) -> None:
        seen = np.zeros(len(self.slot), bool)
        seen[code] = True
        new = np.flatnonzero(seen & (self.slot < 0))
        if len(new):
            self.slot[new] = len(self.codes) + np.arange(len(new))
            self.codes = np.concatenate([self.codes, new])
            self.n, self.known, self.w = (np.concatenate([x, np.zeros(len(new) * self.width, x.dtype)]) for x in (self.n, self.known, self.w))
        at = self.slot[code] * self.width + replicate
        np.add.at(self.n, at, 1)
        np.add.at(self.known, at[weighs], 1)
        np.add.at(self.w, at[weighs], w[weighs])

    def batches(self, outcome, first: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """One row per pattern and replicate with rows; the weight is null where no row has one."""
        found = np.flatnonzero(self.n)
        for low in range(0, len(found), rows):
            at = found[low:low + rows]
            code, columns = self.codes[at // self.width], []
            for v, levels in self.factors.items():
                place = code // self.strides[v] % (len(levels) + 1)
                columns.append(pa.array(np.array([*levels, 0])[place], mask=place == len(levels)))
            w = pa.array(self.w[at], mask=self.known[at] == 0)
            columns = [pa.array([outcome] * len(at)), pa.array(at % self.width + first), *columns, pa.array(self.n[at]), w, w]
            kinds = to_arrow_schema(self.schema)
            yield pa.RecordBatch.from_arrays([c.cast(kind.type) for c, kind in zip(columns, kinds)], schema=kinds)
