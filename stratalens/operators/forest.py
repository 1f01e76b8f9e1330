"""Decision trees over binned columns, grown level by level from counts.

Every column is a small code per row (at most ``MOST_BINS`` of them, a gap being a code of its own), so a split is a set
of codes that go left, the same for ordered and for unordered columns. All open nodes of a level are counted and split
together; depth has no limit, only the number of leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MOST_BINS = 64
LEAST_GAIN = 1e-9


@dataclass
class Tree:
    """Flat nodes, the root first. ``feature`` is -1 at a leaf; the right child follows the left one."""

    feature: np.ndarray
    left_codes: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def predict(self, codes: np.ndarray) -> np.ndarray:
        """Value of the leaf of each row: the class, or the mean."""
        at = np.zeros(len(codes), np.int64)
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            node = at[going]
            code = codes[going, self.feature[node]].astype(np.uint64)
            left = (self.left_codes[node] >> code) & np.uint64(1)
            at[going] = self.child[node] + 1 - left.astype(np.int64)
            going = going[self.feature[at[going]] >= 0]
        return self.value[at]


def _counts(key: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, classes: int) -> np.ndarray:
    """Per key the weight of each class, or the weight and the weighted sum of a number."""
    if classes:
        return np.bincount(key * classes + y, weight, size * classes).reshape(size, classes)
    return np.stack([np.bincount(key, weight, size), np.bincount(key, weight * y, size)], 1)


def _purity(counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each side and its part of the criterion (sum of squares over weight, larger is purer)."""
    if classes:
        n = counts.sum(1)
        return n, (counts ** 2).sum(1) / np.maximum(n, 1e-12)
    return counts[:, 0], counts[:, 1] ** 2 / np.maximum(counts[:, 0], 1e-12)


def _best_splits(hist: np.ndarray, width: np.ndarray, ordered: np.ndarray, node: np.ndarray, classes: int):
    """Best cut of every candidate column of every node.

    ``hist`` has the codes of one (node, column) after another, ``width`` how many each has, ``node`` whose it is.
    Codes of an unordered column are lined up by the share of the node's commonest class (or by their mean).
    Returns per node the criterion, the (node, column) chosen and a bit set of the codes that go left.
    """
    segment = np.repeat(np.arange(len(width)), width)
    start = np.concatenate([[0], np.cumsum(width)[:-1]])
    code = np.arange(len(hist)) - start[segment]
    n, _ = _purity(hist, classes)
    if classes:
        # every column of a node counts the same rows; the first segment of each is enough
        first = np.searchsorted(node, np.arange(node[-1] + 1))
        ends = start[first] + width[first]
        total = np.concatenate([np.zeros((1, classes)), np.cumsum(hist, 0)])
        own = total[ends] - total[start[first]]
        share = hist[np.arange(len(hist)), own.argmax(1)[node[segment]]] / np.maximum(n, 1e-12)
    else:
        share = hist[:, 1] / np.maximum(n, 1e-12)
    place = np.where(ordered[segment], code.astype(float), share)
    order = np.lexsort((place, n == 0, segment)) if not ordered.all() else np.arange(len(hist))
    lined = hist[order]
    upto = np.cumsum(lined, 0)
    before = (upto - lined)[start]
    left = upto - before[segment]
    right = (upto[start + width - 1] - before)[segment] - left
    n_left, good_left = _purity(left, classes)
    n_right, good_right = _purity(right, classes)
    gain = np.where((n_left > 1e-9) & (n_right > 1e-9), good_left + good_right, -np.inf)
    of = node[segment]
    first_of = np.searchsorted(of, np.arange(of[-1] + 1))
    best = np.maximum.reduceat(gain, first_of)
    hit = np.flatnonzero(gain == best[of])
    at = hit[np.unique(of[hit], return_index=True)[1]]
    chosen = segment[at]
    goes = (segment == chosen[of]) & np.where(
        n[order] > 0, np.arange(len(hist)) <= at[of], (n_left >= n_right)[at][of])  # a code never seen joins the larger side
    masks = np.zeros(len(best), np.uint64)
    np.bitwise_or.at(masks, of[goes], np.uint64(1) << code[order][goes].astype(np.uint64))
    return best, chosen, masks


def grow(codes: np.ndarray, bins: np.ndarray, ordered: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int,
         rng: np.random.Generator, tried: int, least_rows: int = 1, most_leaves: int = 1024) -> Tree:
    """One tree over the rows of positive weight.

    ``bins`` is the number of codes of each column, ``y`` a class from 0 or (``classes`` = 0) a number. Every node tries
    ``tried`` random columns; nodes of ``least_rows`` rows or fewer, pure nodes and nodes without a useful split are
    leaves. Where leaves run out, the splits of a level with the largest gain are made.
    """
    rows = np.flatnonzero(weight > 0)
    at = np.zeros(len(rows), np.int64)
    y = y.astype(np.int64) if classes else y.astype(float)
    feature, masks, child, value = [], [], [], []
    done, opened, made = 0, 1, 0  # leaves so far, nodes of this level, nodes of earlier levels
    while opened:
        stats = _counts(at, y[rows], weight[rows], opened, classes)
        n, good = _purity(stats, classes)
        level_feature, level_mask = np.full(opened, -1, np.int32), np.zeros(opened, np.uint64)
        level_child = np.zeros(opened, np.int64)
        value.append(stats.argmax(1).astype(float) if classes else stats[:, 1] / np.maximum(n, 1e-12))
        size = np.bincount(at, minlength=opened)
        pure = stats.max(1) >= n if classes else size <= 1
        trying = np.flatnonzero((size > least_rows) & ~pure)
        split = trying[:0]
        if len(trying):
            place = np.full(opened, -1)
            place[trying] = np.arange(len(trying))
            picked = np.argsort(rng.random((len(trying), len(bins))), 1, kind="stable")[:, :tried]
            width = bins[picked]
            first = (np.cumsum(width) - width.ravel()).reshape(width.shape)
            inside = np.flatnonzero(place[at] >= 0)
            who = place[at[inside]]
            key = first[who] + codes[rows[inside]][np.arange(len(inside))[:, None], picked[who]]
            k = picked.shape[1]
            hist = _counts(key.ravel(), np.repeat(y[rows[inside]], k), np.repeat(weight[rows[inside]], k),
                           int(width.sum()), classes)
            best, chosen, mask = _best_splits(hist, width.ravel(), ordered[picked].ravel(),
                                              np.repeat(np.arange(len(trying)), k), classes)
            gain = best - good[trying]
            useful = np.flatnonzero(gain > LEAST_GAIN * np.maximum(n[trying], 1))
            room = most_leaves - done - opened
            if len(useful) > room:
                useful = np.sort(useful[np.argsort(-gain[useful], kind="stable")[:max(room, 0)]])
            split = trying[useful]
            level_feature[split] = picked.ravel()[chosen[useful]]
            level_mask[split] = mask[useful]
            level_child[split] = made + opened + 2 * np.arange(len(split))
        feature.append(level_feature)
        masks.append(level_mask)
        child.append(level_child)
        done += opened - len(split)
        stay = level_feature[at] >= 0
        rows, at = rows[stay], at[stay]
        code = codes[rows, level_feature[at]].astype(np.uint64)
        left = ((level_mask[at] >> code) & np.uint64(1)).astype(np.int64)
        made += opened
        at = level_child[at] + 1 - left - made
        opened = 2 * len(split)
    return Tree(np.concatenate(feature), np.concatenate(masks), np.concatenate(child), np.concatenate(value))
