"""Language identification: nearest centroid of TF-IDF character trigrams.

A text becomes a unit vector of trigram weights over 4096 hash buckets. Each language has several centroids, found by
spherical k-means over a bounded sample; the language of the nearest centroid by cosine is the answer. A text that is
farther from its centroid than nearly all training texts of that centroid is marked as rejected.

A null text or one without a letter is ``und`` with score 0 and rejected. Whole texts are read, however long. Equal texts
get equal results; repeated rows and ids each give a row; of centroids as near as each other the first in the order of
languages decides. An empty table gives an empty one, and one to learn from a model that knows no language. Columns of
the input with the names of new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import in_fold, map_texts, query, table, text_slices

BUCKETS = 4096
ROWS = 512
UNKNOWN = "und"
MAX_LANGS = 10_000
LETTER = np.zeros(256, bool)
LETTER[128:] = True
LETTER[97:123] = True


def trigrams(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed byte trigrams of each lower-cased text, runs of non-letters read as one space."""
    raw = [("" if t is None else t.lower()).encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" " + b"\x00".join(raw) + b"\x00", np.uint8)
    doc = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])
    doc = np.concatenate([[0], doc])
    letter = LETTER[buf]
    clean = np.where(letter, buf, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    clean, doc, letter = clean[keep], doc[keep], letter[keep]
    code = clean[:-2] << 16 | clean[1:-1] << 8 | clean[2:]
    same = (doc[2:] == doc[1:-1]) & letter[1:-1]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(20)
    return np.bincount(doc[1:-1][same] * BUCKETS + bucket[same], minlength=len(raw) * BUCKETS).reshape(-1, BUCKETS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts; centroids and the cosine of each row to its own."""
    starts = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    centroids = x[starts]
    for _ in range(rounds):
        of = np.argmax(x @ centroids.T, 1)
        sums = np.stack([x[of == j].sum(0) if (of == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centroids, np.argmax(x @ centroids.T, 1)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> dict:
        counts = trigrams(texts)
        some = np.array([t is not None and any(c.isalpha() for c in t) for t in texts], bool)
        if not len(self.langs):
            return {"lang": [UNKNOWN] * len(texts), "score": np.zeros(len(texts)), "rejected": np.ones(len(texts), bool)}
        cosine = vectors(counts, self.idf) @ self.centroids.T
        best = np.argmax(cosine, 1)
        top = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        return {"lang": [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)], "score": np.where(some, top, 0.0),
                "rejected": ~some | (top < self.least[best])}


def fit(docs: DataFrame, *, text_col="text", lang_col="lang", id_col="doc_id", per_lang: int = 600, k: int = 4,
        reject: float = 0.005, seed: int = 11) -> Model:
    """Fit from ``docs`` with a language and a text.

    Document frequencies of the trigrams cover all these rows. Centroids come from about ``per_lang`` rows of each
    language (a documented bound), those under a hash threshold of id and text, so that rows without an id, or with the
    same one, are drawn one by one. ``least`` of a centroid is the cosine that
    the share ``reject`` of its training texts falls short of. More than ``MAX_LANGS`` languages are an error.
    """
    runtime.ship_package(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def document_counts(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for part in text_slices(batches, "text", rows=ROWS):
            df += (trigrams(part.column("text").to_pylist()) > 0).sum(0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], df]))], ["bucket", "n"])

    found = rows.select("text").mapInArrow(document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = {r.bucket: r.n for r in found.collect()}
    n = df.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(b, 0) for b in range(BUCKETS)], float))) + 0.05
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    sizes = F.broadcast(rows.sparkSession.createDataFrame([(r.lang, r.n) for r in sizes], "of string, in_lang long"))
    mark = F.shiftrightunsigned(F.xxhash64(F.coalesce("id", F.lit("")), "text", F.lit(seed)), 1) / F.lit(float(1 << 63))
    sample = (rows.join(sizes, F.col("lang") == F.col("of")).filter(mark < F.lit(float(per_lang)) / F.col("in_lang")).select("id", "lang", "text"))

    def centroids(group):
        group = group.sort_by([("id", "ascending")])
        texts = group.column("text").to_pylist()
        x = np.concatenate([vectors(trigrams(texts[i:i + ROWS]), idf) for i in range(0, len(texts), ROWS)])
        c, of = cluster(x, k)
        own = (x * c[of]).sum(1)
        least = [float(np.quantile(own[of == j], reject)) if (of == j).any() else 0.0 for j in range(len(c))]
        lang = group.column("lang")[0].as_py()
        return pa.table({"lang": [lang] * len(c), "centroid": list(c.astype(np.float32)),
                         "least": pa.array(least, pa.float64())})

    made = sample.groupBy("lang").applyInArrow(centroids, "lang string, centroid array<float>, least double").collect()
    made.sort(key=lambda r: (r.lang, r.centroid))
    return Model(idf, [r.lang for r in made], np.array([r.centroid for r in made], np.float32).reshape(-1, BUCKETS),
                 np.array([r.least for r in made]))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``lang_pred``, ``score`` (cosine) and ``rejected``.

    A null text or one without a letter is ``und`` with score 0; with nothing learned every text is.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        made = [known.value.predict(texts[i:i + ROWS]) for i in range(0, len(texts), ROWS)]
        return {"lang_pred": pa.array([x for m in made for x in m["lang"]], pa.string()),
                "score": np.concatenate([m["score"] for m in made]),
                "rejected": np.concatenate([m["rejected"] for m in made])}

    return map_texts(docs, text_col, run, "lang_pred string, score double, rejected boolean")


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~in_fold(F.col("doc_id"), 3, 1)))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
