"""Words, word hashes and n-gram hashes of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xFF51AFD7ED558CCD)
MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)

NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
LETTERS = np.zeros(256, bool)
LETTERS[128:] = True
for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
    LETTERS[ord(first):ord(last) + 1] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> SHIFT)) * MIX1
    h = (h ^ (h >> SHIFT)) * MIX2
    return h ^ (h >> SHIFT)


class Words:
    """The words of a list of texts: runs of bytes that ``member`` marks.

    ``buf``: all bytes, a newline after each text; ``start``, ``length``, ``doc``: of each word; ``bounds``: where
    the words of each text begin, with the total at the end. A null text has no words.
    """

    def __init__(self, texts: list[str | None], member: np.ndarray = NON_SPACE, lower: bool = False,
                 lower_ascii: bool = False):
        raw = [("" if t is None else t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in texts]
        if lower_ascii:
            raw = [r.lower() for r in raw]
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
        self.sizes = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        inside = member[self.buf]
        self.inside = inside
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.start, end = edges[0::2], edges[1::2]
        self.length = end - self.start
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.bounds))

    def _spread(self):
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        at = np.arange(int(self.length.sum())) - np.repeat(first, self.length)
        power = np.multiply.accumulate(np.full(int(self.length.max()), BASE, np.uint64))
        return first, at, (self.buf[self.inside].astype(np.uint64) + np.uint64(1)) * power[at]

    def hashes(self, *prefixes: int) -> list[np.ndarray]:
        """64-bit hash of each word, then of its first k bytes for each k (0 where the word is no longer than k)."""
        first, at, part = self._spread()
        if not len(first):
            return [np.zeros(0, np.uint64)] * (1 + len(prefixes))
        out = [mix(np.add.reduceat(part, first))]
        for k in prefixes:
            h = mix(np.add.reduceat(np.where(at < k, part, np.uint64(0)), first) + np.uint64(k))
            out.append(np.where(self.length > k, h, np.uint64(0)))
        return out


def windows(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n consecutive words of one text, and the first word of each."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = total * MIX1 + h[k:len(h) - n + 1 + k]
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts)[:len(total)] - np.arange(len(total))
    at = np.flatnonzero(left >= n)
    return mix(total[at] + np.uint64(n)), at


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-word shingles of each text, as (text, hash) sorted by both; words with A-Z lower-cased.

    A text of fewer words is one shingle of all of them; one without words has none.
    """
    words = Words(texts, lower_ascii=True)
    h = words.hashes()[0]
    found, at = windows(h, words.bounds, n)
    doc, parts = words.doc[at], [found]
    counts = np.diff(words.bounds)
    docs = [doc]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        total = np.zeros(len(short), np.uint64)
        for j in range(k):
            total = total * MIX1 + h[words.bounds[short] + j]
        parts.append(mix(total + np.uint64(k)))
        docs.append(short)
    doc, found = np.concatenate(docs), np.concatenate(parts)
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new]
