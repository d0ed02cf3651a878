"""BK-trees over 64-bit fingerprints, many at once, in numpy: children are keyed by their Hamming distance to the parent,
and a query follows only edges that differ from its own distance by at most the radius."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Groups up to this size are searched together; larger ones each by pivots.
SMALL = 64
PIVOTS = 64


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """A tree for each group; items are numbered as given, a group's items stand together, its first is the root."""

    def __init__(self, prints: np.ndarray, starts: np.ndarray):
        self.prints = prints
        sizes = np.diff(np.append(starts, len(prints)))
        self.root = np.repeat(starts, sizes)
        items = np.arange(len(prints))
        items, anchor = items[items != self.root], self.root[items != self.root]
        keys, nodes = [], []
        while len(items):
            key = anchor * 65 + distance(prints[items], prints[anchor])
            order = np.argsort(key, kind="stable")
            items, key = items[order], key[order]
            first = np.append(True, key[1:] != key[:-1])
            heads = items[first]
            keys.append(key[first])
            nodes.append(heads)
            anchor = np.repeat(heads, np.diff(np.append(np.flatnonzero(first), len(items))))
            items, anchor = items[~first], anchor[~first]
        key, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
        order = np.argsort(key)
        self.key, self.child = key[order], node[order]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) for all items of the query's group within the radius, itself left out."""
        q, node, found = queries, self.root[queries], []
        while len(q):
            d = distance(self.prints[q], self.prints[node])
            hit = (d <= radius) & (q != node)
            found.append((q[hit], node[hit]))
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            q, node = np.repeat(q, n), self.child[at]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (queries[:0], queries[:0])


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives linked items one label: the smallest item that they reach."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def components(prints: np.ndarray, starts: np.ndarray, radius: int, alike: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For each item the smallest item of its component; links are within a group, within the radius, and alike.

    A large group is not searched pair by pair: only items outside its largest component are queried, until none is left
    unqueried. Any link between two components would have an end outside the largest, so no link is lost.
    """
    label = np.arange(len(prints))
    if not len(prints):
        return label
    sizes = np.diff(np.append(starts, len(prints)))
    forest = Forest(prints, starts)

    def link(q: np.ndarray) -> None:
        a, b = forest.search(q, radius)
        if alike is None:
            union(label, a, b)
            return
        # some pairs at a time: most are connected by those before and need no look
        low, step = 0, 500
        while low < len(a):
            x, y = a[low : low + step], b[low : low + step]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            if len(x):
                ok = alike(x, y)
                union(label, x[ok], y[ok])
            low, step = low + step, min(20_000, 2 * step)

    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for i in range(0, len(small), 20_000):
        link(small[i : i + 20_000])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        done = np.zeros(n, bool)
        while True:
            own = label[s : s + n]
            names, count = np.unique(own, return_counts=True)
            todo = np.flatnonzero((own != names[count.argmax()]) & ~done)[:PIVOTS]
            if not len(todo):
                break
            done[todo] = True
            link(todo + s)
    return label
