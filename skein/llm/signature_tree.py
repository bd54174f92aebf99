"""Signature trees over the members of one block, joined with themselves by a dual traversal.

A leaf is a set's token bitmap, its size and how many of its tokens share a bit with an earlier one.  An inner node has
the OR of its children's bitmaps, the range of their sizes and the largest such surplus.  Two sets with bitmaps a and b
share at most popcount(a AND b) + min(surplus) tokens; for two nodes this bounds every pair of leaves below them.  A
pair of nodes is dropped when that bound, or the sizes alone, cannot give the wanted Jaccard similarity, or when all
leaves below both are in one component already.

A bitmap is as wide as its set is large, so that it prunes long texts as it does short ones.  Widths are powers of two:
a wider bitmap is folded to a narrower one by OR, and sets of different widths meet at the narrower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 16


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The fewest common tokens of sets of these sizes with 100 * common >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


class Tree:
    """Levels of nodes, leaves first.  Leaves are ordered by size, then bitmap, so that like sets stand together."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        words = np.ascontiguousarray(bitmaps).view("u8")
        self.order = np.lexsort((*words.T[:2], sizes))  # a bitmap has 64 bits at least
        words, sizes = words[self.order], sizes[self.order].astype("i8")
        self.label = component[self.order].copy()
        surplus = sizes - np.bitwise_count(words).sum(1, dtype="i8")
        self.levels = [(words, sizes, sizes, surplus)]
        while len(self.levels[-1][0]) > 1:
            words, low, high, surplus = self.levels[-1]
            at = np.arange(0, len(words), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(words, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(surplus, at)))
        self._spread_labels()

    def _spread_labels(self) -> None:
        """The least and largest component below each node."""
        self.spans = [(self.label, self.label)]
        for _ in self.levels[1:]:
            low, high = self.spans[-1]
            at = np.arange(0, len(low), FANOUT)
            self.spans.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def merge(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins the components of leaf pairs; returns the pairs that joined two."""
        out = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.label[i], self.label[j]
            if x != y:
                self.label[self.label == max(x, y)] = min(x, y)
                out.append((int(self.order[i]), int(self.order[j])))
        if out:
            self._spread_labels()
        return out

    def survivors(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which of the node pairs (a, b) of a level may hold a link between components."""
        words, low, high, surplus = self.levels[level]
        c_low, c_high = self.spans[level]
        fits = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        fits &= ~((c_low[a] == c_high[a]) & (c_low[b] == c_high[b]) & (c_low[a] == c_low[b]))
        at = np.flatnonzero(fits)
        for first in range(0, len(at), 1 << 14):
            part = at[first : first + (1 << 14)]
            x, y = a[part], b[part]
            most = np.bitwise_count(words[x] & words[y]).sum(1, dtype="i8") + np.minimum(surplus[x], surplus[y])
            fits[part] = most >= least_overlap(low[x], low[y], percent)
        return fits

    def pairs(self, percent: int):
        """Yields arrays (i, j) of leaf pairs that the bounds leave; depth first, in bounded batches.  Components that
        the caller merges in between are left out from then on."""
        stack = [(len(self.levels) - 1, np.zeros(1, "i8"), np.zeros(1, "i8"))]
        below = np.arange(FANOUT)
        while stack:
            level, a, b = stack.pop()
            keep = self.survivors(level, a, b, percent)
            if not level:
                keep &= (a < b) & (self.label[a] != self.label[b])
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if not level:
                yield a, b
                continue
            n = len(self.levels[level - 1][0])
            for first in range(0, len(a), 16):
                x, y = a[first : first + 16], b[first : first + 16]
                i = (x[:, None, None] * FANOUT + below[None, :, None] + np.zeros((1, 1, FANOUT), "i8")).ravel()
                j = (y[:, None, None] * FANOUT + below[None, None, :] + np.zeros((1, FANOUT, 1), "i8")).ravel()
                real = (i < n) & (j < n) & (i <= j)
                stack.append((level - 1, i[real], j[real]))


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """(len(maps), width) bytes: wider bitmaps have their halves OR-combined until they are ``width`` bytes."""
    out = np.zeros((len(maps), width), "u1")
    for n, m in enumerate(maps):
        out[n] = np.bitwise_or.reduce(np.frombuffer(m, "u1").reshape(-1, width), axis=0)
    return out


def by_width(maps: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width of bitmap: which sets have it or one so much wider that their sizes may still link, and their
    bitmaps of that width.  Widths double as sizes do, so that every pair that may link meets in one of them."""
    widths = np.array([len(m) for m in maps])
    steps = 0
    while (100 << steps) * percent < 10_000:
        steps += 1
    for width in np.unique(widths).tolist():
        chosen = np.flatnonzero((widths >= width) & (widths <= width << max(steps, 1)))
        if len(chosen) > 1:
            yield chosen, folded([maps[k] for k in chosen.tolist()], width)


#: Up to so many sets are compared without a tree: it would have one inner node.
FEW = 8


def few(maps: list[bytes], sizes: list[int], component: list[int], percent: int, forest: bool) -> list[tuple[int, int]]:
    """``spanning`` or ``candidates`` of a few sets, by the same bounds on pairs of leaves."""
    bits, label, out = [int.from_bytes(m) for m in maps], list(component), []
    for i in range(len(maps)):
        for j in range(i):
            a, b = sizes[i], sizes[j]
            if label[i] == label[j] or 100 * a < percent * b or 100 * b < percent * a:
                continue
            x, y, narrow = bits[i], bits[j], min(len(maps[i]), len(maps[j]))
            x, y = _narrowed(x, len(maps[i]), narrow), _narrowed(y, len(maps[j]), narrow)
            most = (x & y).bit_count() + min(a - x.bit_count(), b - y.bit_count())
            if (100 + percent) * most >= percent * (a + b):
                out.append((i, j))
                if forest:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
    return out


def _narrowed(x: int, width: int, narrow: int) -> int:
    while width > narrow:
        width //= 2
        x = (x >> 8 * width) | (x & (1 << 8 * width) - 1)
    return x


def spanning(maps: list[bytes], sizes: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of pairs that may link: it touches every set that has a possible partner in another component."""
    if len(maps) <= FEW:
        return few(maps, sizes.tolist(), component.tolist(), percent, True)
    label, out = component.copy(), []
    for chosen, bitmaps in by_width(maps, percent):
        tree = Tree(bitmaps, sizes[chosen], label[chosen])
        for a, b in tree.pairs(percent):
            for i, j in tree.merge(a, b):
                i, j = int(chosen[i]), int(chosen[j])
                x, y = label[i], label[j]
                label[label == max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def candidates(maps: list[bytes], sizes: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """All pairs of different components that the bounds leave."""
    if len(maps) <= FEW:
        return few(maps, sizes.tolist(), component.tolist(), percent, False)
    out = set()
    for chosen, bitmaps in by_width(maps, percent):
        tree = Tree(bitmaps, sizes[chosen], component[chosen])
        for a, b in tree.pairs(percent):
            out.update(zip(chosen[tree.order[a]].tolist(), chosen[tree.order[b]].tolist(), strict=True))
    return list(out)
