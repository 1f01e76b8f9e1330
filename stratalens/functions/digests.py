"""MD5 of many short texts at once: the draws of Spark's ``md5`` over ``head | id``, in columns of 32-bit words."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

AT_ONCE = 1 << 16  # texts of one step, few enough for the cache of a core
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _compress(state: Sequence[np.ndarray], words: Sequence) -> list[np.ndarray]:
    """State after one block of 16 words; a word is an array, or a number where all texts have the same."""
    a, b, c, d = (x.copy() for x in state)
    t = np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        np.add(a, t, out=a)
        word = words[WORD[i]]
        if isinstance(word, np.ndarray):
            np.add(a, word, out=a)
            np.add(a, np.uint32(SINES[i]), out=a)
        else:
            np.add(a, np.uint32((SINES[i] + word) & 0xFFFFFFFF), out=a)
        shift = SHIFTS[i // 16][i % 4]
        np.left_shift(a, np.uint32(shift), out=t), np.right_shift(a, np.uint32(32 - shift), out=a), np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [np.add(x, y, out=y) for x, y in zip(state, (a, b, c, d))]


def md5_words(heads: np.ndarray, tails: np.ndarray) -> list[np.ndarray]:
    """Four arrays (heads, tails) with the digests' words, in the order of their hex digits.

    ``heads`` and ``tails`` hold bytes, one text per row, all of one length; every head is followed by every tail.
    """
    (h, p), (n, q) = heads.shape, tails.shape
    blocks = (p + q + 8) // 64 + 1
    front, back = np.zeros((h, 64 * blocks), np.uint8), np.zeros((n, 64 * blocks), np.uint8)
    front[:, :p], back[:, p:p + q] = heads, tails
    front[:, p + q] = 0x80
    front[:, -8:] = np.frombuffer((8 * (p + q)).to_bytes(8, "little"), np.uint8)
    front, back = front.view("<u4"), back.view("<u4")
    state = [np.full(h * n, x, np.uint32) for x in START]
    for k in range(blocks):
        words = []
        for j in range(16 * k, 16 * k + 16):
            if 4 * j < p + q and 4 * j + 4 > p:
                words.append((front[:, j, None] | back[None, :, j]).ravel())
            elif (front[:, j] == front[0, j]).all():
                words.append(int(front[0, j]))
            else:
                words.append(np.repeat(front[:, j], n))
        state = _compress(state, words)
    return [x.byteswap().reshape(h, n) for x in state]


def replicate_digests(head: str, numbers: np.ndarray, tails: np.ndarray) -> Iterator[tuple[np.ndarray, slice, list[np.ndarray]]]:
    """Digests of ``head|number|tail`` in pieces: positions among the numbers, a slice of the tails, the words (numbers, tails)."""
    texts = [f"{head}|{x}|".encode() for x in numbers.tolist()]
    sizes = np.array([len(x) for x in texts])
    for size in np.unique(sizes):
        same = np.flatnonzero(sizes == size)
        heads = np.frombuffer(b"".join(texts[i] for i in same), np.uint8).reshape(len(same), size)
        for low in range(0, len(tails), AT_ONCE):
            part = slice(low, min(low + AT_ONCE, len(tails)))
            step = max(1, AT_ONCE // (part.stop - part.start))
            for start in range(0, len(same), step):
                yield same[start:start + step], part, md5_words(heads[start:start + step], tails[part])
