"""Join sets by Jaccard similarity with a signature tree.

Sets lie in the leaves by size. A node holds the OR of its sets' token bitmaps and the range of
their sizes. Two trees (or one with itself) are walked together from the top; a pair of nodes
is left as soon as the bits they share, with what bits may hide, cannot make the overlap that
its sizes ask for, or when all their sets are connected by then. Pairs of sets that get through are
compared exactly.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LEAF = 64
_FAN = 8
#: So few sets are compared without trees.
_FEW = 4


class Tree:
    """Levels from the leaves' sets (level 0) to one root, as arrays over nodes."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], bits: int):
        self.order = np.argsort(sizes, kind="stable")
        held = np.array([len(tokens[at]) for at in self.order], np.int64)
        set_bits = np.zeros((len(sizes), bits), np.uint8)
        bit = np.concatenate([tokens[at] for at in self.order]) & np.uint64(bits - 1)
        set_bits[np.repeat(np.arange(len(sizes)), held), bit.astype(np.int64)] = 1
        signatures = np.packbits(set_bits, axis=1).view(np.uint64)
        # Tokens of a set beyond its bits: by so many a count of common bits may fall short.
        hidden = held - np.bitwise_count(signatures).sum(axis=1, dtype=np.int64)
        ordered = sizes[self.order].astype(np.int64)
        self.levels = [(signatures, ordered, ordered, hidden)]
        width = _LEAF
        while len(self.levels[-1][1]) > 1:
            above = [np.arange(0, len(self.levels[-1][1]), width)] * 4
            ways = (np.bitwise_or, np.minimum, np.maximum, np.maximum)
            self.levels.append(
                tuple(way.reduceat(x, at, axis=0) for way, x, at in zip(ways, self.levels[-1], above))
            )
            width = _FAN

    def marked(self, marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of every level's nodes the least and the most of their sets' marks, which lie by leaf."""
        found, width = [(marks, marks)], _LEAF
        while len(found[-1][0]) > 1:
            at = np.arange(0, len(found[-1][0]), width)
            found.append((np.minimum.reduceat(found[-1][0], at), np.maximum.reduceat(found[-1][1], at)))
            width = _FAN
        return found

    def children(self, level: int, node: int) -> np.ndarray:
        width = _LEAF if level == 1 else _FAN
        return np.arange(node * width, min((node + 1) * width, len(self.levels[level - 1][1])))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i of a, j of b) of nodes, or of sets, may hold a link."""
    (bits_a, min_a, max_a, hid_a), (bits_b, min_b, max_b, hid_b) = a, b
    min_a, max_a, min_b, max_b = min_a[i][:, None], max_a[i][:, None], min_b[j], max_b[j]
    fits = (100 * max_a >= percent * min_b) & (100 * max_b >= percent * min_a)
    common = np.bitwise_count(bits_a[i][:, None, :] & bits_b[j]).sum(axis=2, dtype=np.int64)
    most = common + np.minimum(hid_a[i][:, None], hid_b[j])
    return fits & ((100 + percent) * most >= percent * (min_a + min_b))


def _one(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i of a, j of b) of nodes, or of sets, hold sets of one component only."""
    (least_a, most_a), (least_b, most_b) = a, b
    of_a = np.where(least_a[i] == most_a[i], least_a[i], -1)
    of_b = np.where(least_b[j] == most_b[j], least_b[j], -2)
    return of_a[:, None] == of_b


def _bits(sizes: np.ndarray) -> int:
    """Bits for a signature: four for each token of the largest set, as a power of two."""
    return 1 << min(max(int(sizes.max() * 4).bit_length(), 9), 14)


def _counter(tokens: list[np.ndarray]):
    """A function that counts what two of the sets have in common."""
    if len(tokens) <= 16:

        def few(p: int, q: int) -> int:
            both = np.concatenate([tokens[p], tokens[q]])
            both.sort()
            return int(np.count_nonzero(both[1:] == both[:-1]))

        return few
    vocabulary, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    ends = np.cumsum([0, *map(len, tokens)])
    own = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
    marked = np.zeros(len(vocabulary), bool)

    def many(p: int, q: int) -> int:
        marked[own[p]] = True
        both = int(np.count_nonzero(marked[own[q]]))
        marked[own[p]] = False
        return both

    return many


def links(sizes: np.ndarray, tokens: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all sets which similar pairs connect: 100 * common >= percent * union.

    `tokens` holds of each set the distinct tokens that may be common, `sizes` its full size.
    `side` is 0 for all sets, to join them with each other, or tells the sides 0 and 1 of a
    join apart. Pairs already connected are not compared.
    """
    two = bool(side.any())
    common = _counter(tokens)
    if len(sizes) <= _FEW and not two:
        found, label = [], list(range(len(sizes)))
        for q in range(1, len(sizes)):
            for p in range(q):
                n, m = int(sizes[p]), int(sizes[q])
                if label[p] == label[q] or 100 * min(n, m) < percent * max(n, m):
                    continue
                if (both := common(p, q)) and (100 + percent) * both >= percent * (n + m):
                    label = [label[p] if name == label[q] else name for name in label]
                    found.append((p, q))
        return found
    bits = _bits(sizes)
    rows = [np.flatnonzero(side == s) for s in ((0, 1) if two else (0,))]
    trees = [Tree(sizes[r], [tokens[k] for k in r], bits) for r in rows if len(r)]
    if len(trees) < len(rows):
        return []
    left, right = trees[0], trees[-1]
    at_left, at_right = rows[0][left.order], rows[-1][right.order]
    parent = np.arange(len(sizes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def marks() -> list[list[tuple[np.ndarray, np.ndarray]]]:
        # The component of every set, as known now: it holds for all that follows.
        nonlocal parent
        while not np.array_equal(above := parent[parent], parent):
            parent = above
        return [tree.marked(parent[at]) for tree, at in ((left, at_left), (right, at_right))]

    found, marked_at = [], 0
    known_left, known_right = marks()
    top_left, top_right = len(left.levels) - 1, len(right.levels) - 1
    stack = [(top_left, 0, top_right, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        if len(found) - marked_at >= max(16, (len(sizes) - len(found)) // 8):
            known_left, known_right = marks()
            marked_at = len(found)
        # Sets that are in one component by now need no comparison.
        if (la or lb) and _one(known_left[la], known_right[lb], np.array([a]), np.array([b])).all():
            continue
        i = left.children(la, a) if la else np.array([a])
        j = right.children(lb, b) if lb else np.array([b])
        # The higher of the two is opened, both if they are level.
        if la > lb:
            j = np.array([b])
        elif lb > la:
            i = np.array([a])
        na, nb = (la - 1 if la >= lb and la else la), (lb - 1 if lb >= la and lb else lb)
        open_ = ~_one(known_left[na], known_right[nb], i, j)
        if not open_.any():
            continue
        fits = open_ & _possible(left.levels[na], right.levels[nb], i, j, percent)
        for x, y in zip(*(axis.tolist() for axis in np.nonzero(fits))):
            x, y = int(i[x]), int(j[y])
            if not two and na == nb and y < x:
                continue
            if na or nb:
                stack.append((na, x, nb, y))
                continue
            p, q = int(at_left[x]), int(at_right[y])
            if p == q or root(p) == root(q):
                continue
            both = common(p, q)
            if both and (100 + percent) * both >= percent * int(sizes[p] + sizes[q]):
                parent[max(root(p), root(q))] = min(root(p), root(q))
                found.append((p, q))
    return found
