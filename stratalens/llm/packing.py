"""Packing token ids into sequences of bounded length: bounded-space online best fit, leftovers merged.

Each partition keeps a fixed number of open windows. A piece goes to the window it fills best; when it fits in none the
fullest window is closed and a new one opened. Windows still open at the end of a partition are merged over groups of
partitions by the same rule, group by group until one group is left.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stratalens import runtime
from stratalens.llm.base import query, table, text_slices

LENGTH = 2048
OPEN = 64
FAN = 64
END_ID = 1
CACHED_WORDS = 400_000
_TOKENS: dict[str, WordTokens] = {}


#: Blanks, tabs and line ends separate words; A to Z are lower-cased, as the tokenizer does.
BLANK = bytes.maketrans(b"\t\n\r", b"   ")
PLAIN = bytes.maketrans(b"\t\n\r" + bytes(range(65, 91)), b"   " + bytes(range(97, 123)))
MARKS = b".,!?;:|"


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes, each word encoded once while it stays cached.

    The tokenizer drops white space and never joins over it, so the ids of a text are those of its words in a row; and
    it parts a letter or digit from the marks after it, so those of a word are of its front and of its last marks. Other
    white space than blanks, tabs and line ends is left to the tokenizer. Two generations of words are kept, so memory
    is bounded and words in use stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.new: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 2000):
            part = [w.decode("utf-8", "replace") for w in words[i:i + 2000]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            at = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            cut = np.searchsorted(at, starts)
            for j, word in enumerate(words[i:i + 2000]):
                self.new[word] = ids[cut[j]:cut[j + 1]].tobytes()

    def _known(self, word: bytes) -> bool:
        if word in self.new:
            return True
        ids = self.old.get(word)
        if ids is not None:
            self.new[word] = ids
        return ids is not None

    def _learn(self, words: set[bytes]) -> None:
        split, fresh = [], set()
        for word in words:
            if self._known(word):
                continue
            front = word.rstrip(MARKS)
            if 0 < len(front) < len(word) and front[-1:].isalnum():
                split.append((word, front, word[len(front):]))
                fresh.update(x for x in split[-1][1:] if not self._known(x))
            else:
                fresh.add(word)
        rest = []
        for word in fresh:
            if word.isalpha() and word.islower():  # ASCII letters only: nothing to normalise or to split
                self.new[word] = np.array([t.id for t in self.model.tokenize(word.decode())], "<u4").tobytes()
            else:
                rest.append(word)
        self._encode(rest)
        for word, front, marks in split:
            self.new[word] = self.new[front] + self.new[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        split = [r.translate(BLANK if b"<|" in r else PLAIN).split(b" ") for r in raw]  # names of special tokens stay
        if len(self.new) > CACHED_WORDS:
            self.old, self.new = self.new, {b"": b""}
        self._learn(set().union(*split))
        look = self.new.__getitem__
        return [b"".join(map(look, words)) for words in split]


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this worker process, kept over its tasks."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


class Windows:
    """Open windows of one task, best fit; ``place`` returns the window and the offset of a piece.

    ``closed`` collects the windows that nothing more goes into, until the caller takes them.
    """

    def __init__(self, length: int, most: int):
        self.length, self.most, self.count, self.open, self.closed = length, most, 0, [], []

    def place(self, size: int) -> tuple[int, int]:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) == self.most and size < self.length:
                self.closed.append(self.open.pop(0)[1])
            room, window = self.length, self.count
            self.count += 1
        if room > size:
            insort(self.open, (room - size, window))
        else:
            self.closed.append(window)
        return window, self.length - room


def pack(docs: DataFrame, *, tokenizer: str, id_col="doc_id", text_col="text", length: int = LENGTH,
         open_windows: int = OPEN) -> DataFrame:
    """Pieces of every document: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids``: the piece's token ids as little-endian unsigned 32-bit binary. A document is its text's ids and the id 1 at
    the end; a null or empty text is that id alone. Documents longer than a sequence are cut into whole sequences and a
    rest. Repeated rows are packed each for itself; a null id stays null; an empty table gives no pieces.

    A piece leaves its task when its window is closed; those of the few windows left open at the end are marked, and
    only they meet the merged sequences in a join.
    """
    spark = docs.sparkSession
    runtime.ship_package(spark)
    end = np.array([END_ID], "<u4").tobytes()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("part", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()),
                        ("open", pa.bool_())])

    def run(batches):
        part, tokens, windows = TaskContext.get().partitionId(), word_tokens(tokenizer), Windows(length, open_windows)
        held: dict[int, list[tuple]] = {}

        def pieces(of, still_open):
            found = [(*piece, part, w, *place, still_open) for w in of for *piece, place in held.pop(w)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

        for batch in text_slices(batches, "text"):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), tokens.encode(batch.column("text").to_pylist())):
                raw += end
                n = len(raw) // 4
                for first in range(0, n, length):
                    piece = raw[4 * first:4 * (first + length)]
                    w, offset = windows.place(len(piece) // 4)
                    held.setdefault(w, []).append((doc, first, len(piece) // 4, piece, n, (offset,)))
            if windows.closed:
                yield pieces(windows.closed, False)
                windows.closed = []
        if held:
            yield pieces(sorted(held), True)

    path = runtime.scratch_path(spark, "pieces")
    rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, "
                         "doc_tokens long, part long, window long, offset long, open boolean").write.parquet(path)
    made = spark.read.parquet(path)
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]
    done = made.filter("not open").select(
        *columns, F.expr("part << 32 | window").alias("sequence_id"), "offset")
    left = made.filter("open")
    moved = _merge(left.groupBy("part", "window").agg(F.sum("length").alias("fill")), length, open_windows)
    return done.union(left.join(moved, ["part", "window"]).select(
        *columns, F.col("merged").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset")))


def _merge(left: DataFrame, length: int, most: int) -> DataFrame:
    """``part, window, merged, base``: the sequence of each open window and where in it the window begins.

    A group of ``FAN`` partitions merges at most ``FAN * most`` windows in a task and hands at most ``most`` on.
    """
    schema = pa.schema([
        ("members", pa.list_(pa.struct([("part", pa.int64()), ("window", pa.int64()), ("base", pa.int64())]))),
        ("fill", pa.int64()), ("number", pa.int64()), ("closed", pa.bool_()), ("part", pa.int64())])
    kind = "members array<struct<part:bigint,window:bigint,base:bigint>>, fill long, number long, closed boolean, part long"

    def merger(level: int, scale: int):
        def run(group):
            rows = group.select(["part", "fill", "members"]).to_pylist()
            rows.sort(key=lambda r: (-r["fill"], [(m["part"], m["window"]) for m in r["members"]]))
            windows, held, fills = Windows(length, most), {}, {}
            for row in rows:
                w, offset = windows.place(row["fill"])
                held.setdefault(w, []).extend(m | {"base": m["base"] + offset} for m in row["members"])
                fills[w] = offset + row["fill"]
            still = {w for _, w in windows.open}
            first = rows[0]["part"]
            return pa.Table.from_pylist(
                [{"members": m, "fill": fills[w], "number": (level << 56) | (first // scale << 32) | w,
                  "closed": w not in still, "part": first} for w, m in held.items()], schema)

        return run

    items = left.select("part", "fill", F.expr("array(struct(part, window, 0L as base))").alias("members"))
    top = left.agg(F.max("part")).first()[0] or 0
    level, ready = 0, []
    while not level or top > 0:
        level, top, scale = level + 1, top // FAN, FAN ** (level + 1)
        merged = runtime.materialise(items.groupBy(F.floor(F.col("part") / scale).alias("shared"))
                                     .applyInArrow(merger(level, scale), kind))
        ready.append(merged.filter("closed") if top else merged)
        items = merged.filter("not closed").select("part", "fill", "members")
    done = ready[0]
    for more in ready[1:]:
        done = done.unionByName(more)
    return (done.select("number", F.explode("members").alias("m"))
            .select("m.part", "m.window", F.col("number").alias("merged"), F.col("m.base").alias("base")))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer=default_tokenizer()))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces with their ids."""
    return pack(docs, tokenizer=default_tokenizer())
