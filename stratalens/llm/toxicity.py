"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their 4- and 5-byte stems, all hashed into a fixed number of slots; none is
left out. In pairs a text's terms count one over the root of their number each, so that long texts do not drown in them. Beside a weight per term the model
learns a vector per term; the inner product of two vectors is the weight of that pair occurring in one text, so that an
insult together with a mention of a group can score high where neither does alone.

Null, empty and wordless texts have no terms and score by the bias alone. Whole texts are scored, however long. Equal texts
score alike; repeated rows and ids each give a row. An empty table gives an empty one. A column of the input named
``score`` is replaced by the new one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import free_name, in_fold, map_texts, query, sample_ids, table
from stratalens.llm.text import LETTERS, Words

STEMS = (4, 5)
ROUNDS = 7
BLOCK = 1 << 12  # slots a task sends at once


@dataclass
class Model:
    """A weight and a vector for each of 2 ** ``bits`` slots; zero for those that no text of the sample holds."""

    bits: int
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, doc: np.ndarray, term: np.ndarray, docs: int) -> np.ndarray:
        """Log odds from distinct (doc, term) pairs, before calibration."""
        if not len(self.weight):
            return np.full(docs, self.bias)
        n = np.maximum(np.bincount(doc, minlength=docs), 1)
        linear = np.bincount(doc, self.weight[term], docs)
        pairs = np.zeros(docs)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            pairs += np.bincount(doc, v, docs) ** 2 - np.bincount(doc, v * v, docs)
        return np.clip(self.bias + linear + pairs / 2 / n, -30, 30)

    def score(self, doc: np.ndarray, term: np.ndarray, docs: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(doc, term, docs) + self.shift, -30, 30)))


def terms(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs."""
    words = Words(texts, LETTERS, lower=True)
    buckets = [(h >> np.uint64(64 - bits)).astype(np.int64) for h in words.hashes(*STEMS)]
    keep = [np.ones(len(words.doc), bool)] + [words.length > k for k in STEMS]
    key = np.unique(np.concatenate([(words.doc << bits | b)[k] for b, k in zip(buckets, keep)]))
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class State:
    """What training carries from round to round; ``table`` has per slot the weight, its squared gradients, the mean squared
    gradient of the vector's parts, and the vector."""

    table: np.ndarray
    bias: float
    bias_squares: float

    @classmethod
    def first(cls, bits: int, rank: int, odds: float, seed: int) -> State:
        rng = np.random.default_rng(seed)
        table = np.full((1 << bits, 3 + rank), 1e-2, np.float32)
        table[:, 0] = 0
        table[:, 3:] = rng.normal(0, 0.05, (1 << bits, rank))
        return cls(table, float(np.log(odds)), 1e-6)


def train(state: State, bounds: np.ndarray, term: np.ndarray, label: np.ndarray, epochs: int, vectors: bool, seed: int,
          sparse: float, rate: float = 0.1, decay: float = 1e-4, batch: int = 64) -> State:
    """Adagrad on the log loss; changes ``state`` in place. ``bounds`` says where each text's distinct terms begin and end.

    ``sparse`` is a penalty on the size of each weight, the same in every pass however often the term occurs (proximal
    steps, each time a term is met), so that a word of very few texts gets no weight. Vectors have no such penalty.
    ``vectors`` says whether they are trained beside the weights.
    """
    rng = np.random.default_rng(seed)
    docs, rank = len(label), state.table.shape[1] - 3
    steps = max(1, docs // batch)
    each = sparse / np.clip(np.bincount(term, minlength=len(state.table)), 1, steps)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(docs), steps):
            counts = bounds[part + 1] - bounds[part]
            row = np.repeat(np.arange(len(part)), counts)
            at = np.repeat(bounds[part], counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            u, t = np.unique(term[at], return_inverse=True)  # only the slots of these texts are touched
            x = 1 / np.sqrt(np.maximum(counts, 1))
            mine = state.table[u].astype(float)
            w, gw, gv, v = mine[:, 0], mine[:, 1], mine[:, 2], mine[:, 3:]
            s = np.stack([np.bincount(row, v[t, f], len(part)) for f in range(rank)], 1) * x[:, None]
            sq = np.bincount(row, (v ** 2).sum(1)[t], len(part)) * x ** 2
            z = state.bias + np.bincount(row, w[t], len(part)) + 0.5 * ((s ** 2).sum(1) - sq)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part) * 16
            grad = np.bincount(t, err[row], len(u)) + decay * w
            gw += grad ** 2
            step = rate / np.sqrt(gw)
            w -= step * grad
            w[:] = np.sign(w) * np.maximum(np.abs(w) - each[u] * step, 0)
            state.bias_squares += err.sum() ** 2
            state.bias -= rate * err.sum() / np.sqrt(state.bias_squares)
            if vectors:
                own = np.bincount(t, (err * x ** 2)[row], len(u))
                pull = (err * x)[:, None] * s
                grad = (np.stack([np.bincount(t, pull[row, f], len(u)) for f in range(rank)], 1)
                        - own[:, None] * v + decay * v)
                gv += (grad ** 2).mean(1)
                v -= rate * 0.3 * grad / np.sqrt(gv)[:, None]
            state.table[u] = mine
    return state


def _train_round(sample: DataFrame, state: State, epochs: int, vectors: bool, seed: int, sparse: float) -> State:
    """Every part of the sample trains its own copy; changes are averaged, weighted by the texts of a part that hold the slot.

    Tasks send blocks of slots, which are added up before they reach the driver: it receives one table, whatever the
    number of parts.
    """
    spark = sample.sparkSession
    known = spark.sparkContext.broadcast(state)
    width = state.table.shape[1]

    def run(key, part):
        part = part.sort_by("id")
        label = part.column("label").to_numpy().astype(float)
        slots = part.column("slots").combine_chunks()
        bounds, term = slots.offsets.to_numpy(), slots.values.to_numpy()
        old = known.value
        seen = np.zeros(len(old.table), bool)
        seen[term[bounds[0]:bounds[-1]]] = True
        own = np.flatnonzero(seen).astype(np.int32)  # the slots of this part, a table of their own
        term = (np.cumsum(seen, dtype=np.int32) - 1)[term]
        before = old.table[own]
        new = train(State(before.copy(), old.bias, old.bias_squares), bounds, term, label, epochs, vectors,
                    seed + key[0].as_py(), sparse)
        held = np.bincount(term, minlength=len(own)).astype(np.float32)[:, None]
        change = np.concatenate([held, (new.table - before) * held], 1)
        cuts = np.searchsorted(own, np.arange(0, len(seen) + 1, BLOCK))
        some = [b for b in range(len(cuts) - 1) if cuts[b] < cuts[b + 1]]
        at = [own[cuts[b]:cuts[b + 1]].tobytes() for b in some]
        data = [change[cuts[b]:cuts[b + 1]].tobytes() for b in some]
        bias = np.array([1, new.bias - old.bias, new.bias_squares - old.bias_squares], np.float32) * np.float32(len(label))
        return pa.table({"block": pa.array([*some, -1], pa.int32()), "at": pa.array([*at, b""], pa.binary()),
                         "data": pa.array([*data, bias.tobytes()], pa.binary())})

    def add(key, group):
        block = key[0].as_py()
        total = np.zeros((BLOCK, width + 1) if block >= 0 else 3)
        for at, data in sorted(zip(group.column("at").to_pylist(), group.column("data").to_pylist())):
            values = np.frombuffer(data, np.float32)
            if block < 0:
                total += values
            else:
                total[np.frombuffer(at, np.int32) - block * BLOCK] += values.reshape(-1, width + 1)
        return pa.table({"block": pa.array([block], pa.int32()), "at": pa.array([b""], pa.binary()),
                         "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "block int, at binary, data binary"
    made = sample.groupBy("part").applyInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect()
    known.destroy()
    for r in made:
        total = np.frombuffer(r.data, np.float32)
        if r.block < 0:
            state.bias += float(total[1] / total[0])
            state.bias_squares += float(total[2] / total[0])
        else:
            total = total.reshape(-1, width + 1)
            first = r.block * BLOCK
            state.table[first:first + len(total)] += total[:, 1:] / np.maximum(total[:, :1], 1)
    return state


def calibrate(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift by Newton steps, on smoothed labels and drawn a little towards no change."""
    ones = label.sum()
    goal = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack([logit, np.ones(len(logit))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * (at - [1, 0]))
        at -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic",
        max_rows: int = 20_000, bits: int = 18, rank: int = 8, visits: int = 60_000, part_terms: int = 2_500_000,
        sparse: float = 0.05, seed: int = 7) -> Model:
    """Fit on at most ``max_rows`` labelled rows (a documented bound), chosen by hash of the id; one text per id.

    Every term of those texts is used, whatever its own share of toxic texts. The sample is stored; parts of about
    ``part_terms`` terms train side by side, round by round, weights first, then the vectors beside them. There are as
    many passes as make ``visits`` visits of texts, at least 7 and at most 28; the
    penalty of :func:`train` is ``sparse`` times the root of the number of texts with label 1, as chance counts grow so. Where there are a hundred texts of each
    label, a fifth of the sample only calibrates the scores; with fewer all train and calibrate. Without labels of both kinds the model has no terms and
    scores every text with the share of toxic labels (0 when there are none).
    """
    spark = docs.sparkSession
    ids = sample_ids(labels, id_col, label_col, max_rows, seed)
    runtime.ship_package(spark)
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
            .select("id", "text", "label"))

    def slots_of(texts):
        doc, term = terms(texts, bits)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        return {"slots": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term, pa.int32()))}

    path = runtime.scratch_path(spark, "toxicity-sample")
    (map_texts(rows, "text", slots_of, "slots array<int>").groupBy("id").agg(F.min("label").alias("label"), F.min("slots").alias("slots"))
     .withColumn("later", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5)) == 0).write.parquet(path))
    sample = spark.read.parquet(path)
    n_all, n_pos, n_terms = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)),
                                       F.coalesce(F.sum(F.size("slots")), F.lit(0))).first()
    if not n_pos or n_pos == n_all:
        odds = n_pos / (n_all + 1)
        bias = -30.0 if not n_pos else float(np.log(odds / (1 - odds)))
        return Model(bits, bias, np.zeros(0), np.zeros((0, rank)))
    calibrated = min(n_pos, n_all - n_pos) >= 100
    parts = max(1, -(-n_terms // part_terms))
    learn = (sample.filter(~F.col("later")) if calibrated else sample).withColumn(
        "part", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int"))
    epochs = max(1, min(4, visits // (ROUNDS * n_all)))
    state = State.first(bits, rank, (n_pos + 1) / (n_all - n_pos + 1), seed)
    for turn in range(ROUNDS):
        state = _train_round(learn, state, epochs, turn >= ROUNDS // 2, seed + 1000 * turn, sparse * n_pos ** 0.5 / parts)
    model = Model(bits, state.bias, state.table[:, 0].copy(), state.table[:, 3:].copy())
    known = spark.sparkContext.broadcast(model)

    def logits(batches):
        for batch in batches:
            slots = batch.column("slots")
            doc = np.repeat(np.arange(len(slots)), pc.list_value_length(slots).to_numpy())
            z = known.value.logit(doc, slots.flatten().to_numpy(), len(slots))
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column("label")], ["z", "label"])

    unseen = sample.filter("later") if calibrated else sample
    found = unseen.select("slots", "label").mapInArrow(logits, "z double, label int").toArrow()
    z, label = found.column("z").to_numpy(), found.column("label").to_numpy()
    order = np.lexsort((label, z))  # sums in the same order in every run
    if 0 < label.sum() < len(label):
        model.slope, model.shift = calibrate(z[order], label[order].astype(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """All columns of ``docs``, the text only if asked for, with ``score``: whole texts, null and empty texts included."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        m = known.value
        doc, term = terms(texts, m.bits)
        return {name: m.score(doc, term, len(texts))}

    return map_texts(docs, text_col, run, f"`{name}` double", keep_text)


def learned(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model of the query: learned from labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(~in_fold(F.col("doc_id"), 5, 0))
    return fit(docs, labels)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learned(spark, sf_dir, docs))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, limit: float = 0.5) -> DataFrame:
    """Pipeline stage: documents scored below ``limit``, all columns kept."""
    name = free_name(docs, "score")
    scored = score(docs, learned(spark, sf_dir, docs), name=name, keep_text=True)
    return scored.filter(F.col(name) < limit).select(*[F.col(f"`{c}`") for c in docs.columns])
