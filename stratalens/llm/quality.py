"""Quality: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of 48 words. Each passage becomes a vector of surface features (letter case, symbols,
word lengths, repetition, transitions between character classes) and is encoded by a learned layer; gated attention,
learned from labels of whole texts, weighs the passages, and the weighted mean is scored.

Null, empty and wordless texts are one passage of zeros and get its score. Whole texts are scored, however long. Equal texts
score alike, whatever stands beside them; repeated rows and ids each give a row. An empty table gives an empty one. A
column of the input named ``score`` is replaced by the new one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.base import in_fold, map_texts, query, sample_ids, table
from stratalens.llm.text import Words

PASSAGE = 48
#: Classes of bytes: white space, lower case, upper case, digit, above ASCII, sentence marks, symbols, the rest.
CLASSES = np.full(256, 7, np.uint8)
CLASSES[128:] = 4
for marks, kind in ((b" \t\n\v\f\r", 0), (bytes(range(97, 123)), 1), (bytes(range(65, 91)), 2), (b"0123456789", 3),
                    (b".,;:'\"-?", 5), (b"#*$%&|<>!", 6)):
    CLASSES[list(marks)] = kind
FEATURES = 64 + 8 + 8


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and the text each belongs to; a text without words is one passage of zeros."""
    words = Words(texts)
    counts = np.diff(words.bounds)
    per_doc = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    n, owner = int(first[-1]), np.repeat(np.arange(len(texts)), per_doc)
    x = np.zeros((n, FEATURES))
    if not len(words.start):
        return x, owner
    at = np.arange(len(words.doc)) - words.bounds[words.doc]
    of = first[words.doc] + at // PASSAGE
    size = np.bincount(of, minlength=n).astype(float)
    least = np.maximum(size, 1)
    # bytes from each word's first up to the next word of the text belong to the word's passage
    nexts = np.append(words.start[1:], len(words.buf))
    nexts = np.minimum(nexts, words.offsets[words.doc + 1])
    spans = nexts - words.start
    byte_of = np.repeat(of, spans)
    place = np.repeat(words.start - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(len(byte_of))
    kind = CLASSES[words.buf[place]].astype(np.int64)
    total = np.maximum(np.bincount(byte_of, minlength=n), 1)[:, None]
    same = byte_of[1:] == byte_of[:-1]
    moves = (byte_of[1:] * 64 + kind[:-1] * 8 + kind[1:])[same]
    x[:, :64] = np.bincount(moves, minlength=n * 64).reshape(n, 64) / total
    x[:, 64:72] = np.bincount(byte_of * 8 + kind, minlength=n * 8).reshape(n, 8) / total
    h = words.hashes()[0]
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    inside = of[1:] == of[:-1]  # a pair of words belongs to a passage that holds both
    pairs, pair_of = (h[1:] ^ (h[:-1] * np.uint64(3)))[inside], of[1:][inside]
    order2 = np.lexsort((pairs, pair_of))
    twice = np.zeros(len(pairs), bool)
    twice[1:] = (pairs[order2][1:] == pairs[order2][:-1]) & (pair_of[order2][1:] == pair_of[order2][:-1])
    mean = np.bincount(of, words.length, n) / least
    x[:, 72] = np.bincount(of[order][new], minlength=n) / least
    x[:, 73] = np.bincount(of[1:][again], minlength=n) / least
    x[:, 74] = np.bincount(pair_of[order2][twice], minlength=n) / least
    x[:, 75] = np.log1p(mean)
    x[:, 76] = np.sqrt(np.maximum(np.bincount(of, words.length.astype(float) ** 2, n) / least - mean ** 2, 0)) / 10
    longest = np.zeros(n)
    np.maximum.at(longest, of, words.length)
    x[:, 77] = np.log1p(longest)
    x[:, 78] = np.bincount(of[words.length == 1], minlength=n) / least
    x[:, 79] = np.log1p(size)
    return x, owner


@dataclass
class Model:
    shift: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, x: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
        return _sigmoid(_forward((x - self.shift) / self.scale, owner, docs, self.p)["s"])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sum(owner, values, docs):
    """Column sums by owner; owners ascend and each has a row."""
    return np.add.reduceat(values, np.searchsorted(owner, np.arange(docs)), axis=0)


def _forward(x, owner, docs, p):
    h = np.tanh(x @ p["W"] + p["b"])
    t, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    logit = (t * u) @ p["w"]
    weight = np.exp(np.clip(logit, -30, 30))
    weight /= _sum(owner, weight, docs)[owner]
    z = _sum(owner, weight[:, None] * h, docs)
    return {"h": h, "t": t, "u": u, "a": weight, "z": z, "s": z @ p["c"] + p["d"]}


def _gradient(x, owner, label, p):
    docs = len(label)
    f = _forward(x, owner, docs, p)
    h, t, u, a = f["h"], f["t"], f["u"], f["a"]
    ds = (_sigmoid(f["s"]) - label) / docs
    dz = ds[:, None] * p["c"]
    da = (h * dz[owner]).sum(1)
    dl = a * (da - _sum(owner, a * da, docs)[owner])
    de = dl[:, None] * p["w"]
    dt, du = de * u * (1 - t ** 2), de * t * u * (1 - u)
    dh = a[:, None] * dz[owner] + dt @ p["V"].T + du @ p["U"].T
    dpre = dh * (1 - h ** 2)
    return {"W": x.T @ dpre, "b": dpre.sum(0), "V": h.T @ dt, "U": h.T @ du, "w": (t * u).T @ dl,
            "c": f["z"].T @ ds, "d": ds.sum()}


def train(x, owner, label, *, hidden=24, gate=12, epochs=40, rate=0.01, decay=1e-4, seed=5) -> Model:
    """Adam on the log loss of whole texts, in batches of 128 texts."""
    rng = np.random.default_rng(seed)
    shift, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - shift) / scale
    p = {"W": rng.normal(0, 0.15, (x.shape[1], hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)),
         "U": rng.normal(0, 0.3, (hidden, gate)), "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden),
         "d": np.array(0.0)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    docs, step = len(label), 0
    bounds = np.searchsorted(owner, np.arange(docs + 1))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(docs), max(1, docs // 128)):
            counts = bounds[part + 1] - bounds[part]
            of = np.repeat(np.arange(len(part)), counts)
            rows = np.repeat(bounds[part], counts) + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            step += 1
            for k, g in _gradient(x[rows], of, label[part], p).items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(shift, scale, p)


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality",
        max_rows: int = 6_000, max_passages: int = 64, seed: int = 3) -> Model | float:
    """Fit on at most ``max_rows`` labelled rows and, of each, ``max_passages`` passages spread evenly over the text.

    Both bounds hold for training only. Without labels of both kinds the result is a plain share, (ones + 1) / (n + 2).
    """
    ids = sample_ids(labels, id_col, label_col, max_rows, seed)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")

    def encode(texts):
        x, owner = passages(texts)
        counts = np.bincount(owner, minlength=len(texts))
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        every = -(-counts // max_passages)[owner]
        keep = at % every == 0
        cut = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))]) * FEATURES
        return {"x": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[keep].astype(np.float32).ravel()))}

    sample = map_texts(rows, "text", encode, "x array<float>").toArrow().sort_by([("id", "ascending")])
    label = sample.column("label").to_numpy().astype(float)
    if not 0 < label.sum() < len(label):
        return float((label.sum() + 1) / (len(label) + 2))
    flat = sample.column("x").combine_chunks()
    owner = np.repeat(np.arange(len(label)), pc.list_value_length(flat).to_numpy() // FEATURES)
    return train(flat.flatten().to_numpy().reshape(-1, FEATURES).astype(float), owner, label)


def score(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``score`` from every passage of the whole text."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        if isinstance(known.value, float):
            return {"score": np.full(len(texts), known.value)}
        x, owner = passages(texts)
        return {"score": known.value.score(x, owner, len(texts))}

    return map_texts(docs, text_col, run, "score double")


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~in_fold(F.col("doc_id"), 5, 0))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
