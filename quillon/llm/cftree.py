"""Cluster-feature trees over unit vectors, and Ward agglomeration of their leaves.

A cluster feature is (n, sum of the unit vectors, smallest and largest id). Two features can be added
up, and the mean cosine between the members of two is ``sum_a . sum_b / (n_a n_b)``; both follow from
the features alone, which makes trees mergeable.
"""

from __future__ import annotations

import heapq

import numpy as np

CAPACITY = 48


class _Node:
    __slots__ = ("sums", "n", "low", "high", "children", "count")

    def __init__(self, dim: int, leaf: bool):
        self.sums = np.zeros((CAPACITY + 1, dim), np.float32)
        self.n = np.zeros(CAPACITY + 1, np.float32)
        self.low = np.zeros(CAPACITY + 1, np.int64)
        self.high = np.zeros(CAPACITY + 1, np.int64)
        self.children: list | None = None if leaf else []
        self.count = 0

    def put(self, s: np.ndarray, n: float, low: int, high: int, child=None) -> None:
        i = self.count
        self.sums[i], self.n[i], self.low[i], self.high[i] = s, n, low, high
        if self.children is not None:
            self.children.append(child)
        self.count += 1

    def add(self, i: int, s: np.ndarray, n: float, low: int, high: int) -> None:
        self.sums[i] += s
        self.n[i] += n
        if low < self.low[i]:
            self.low[i] = low
        if high > self.high[i]:
            self.high[i] = high


class CFTree:
    """A tree whose leaf entries hold vectors with a mean cosine of at least ``threshold`` to the rest."""

    def __init__(self, dim: int, threshold: float):
        self.dim, self.threshold = dim, np.float32(threshold)
        self.root = _Node(dim, True)
        self.entries = 0

    def insert(self, s: np.ndarray, n: float, low: int, high: int) -> None:
        node, path = self.root, []
        while node.children is not None:
            k = node.count
            # The nearest centroid: |c|^2 - 2 c.v, with c = sum / n and v = s / n_v.
            sums, counts = node.sums[:k], node.n[:k]
            d = np.einsum("ij,ij->i", sums, sums) / (counts * counts) - (sums @ s) * (2.0 / n) / counts
            i = int(d.argmin())
            path.append((node, i))
            node = node.children[i]
        k = node.count
        if k:
            near = (node.sums[:k] @ s) / node.n[:k]
            i = int(near.argmax())
            if near[i] >= self.threshold * n:
                node.add(i, s, n, low, high)
                for parent, j in path:
                    parent.add(j, s, n, low, high)
                return
        self.entries += 1
        node.put(s, n, low, high)
        for parent, j in path:
            parent.add(j, s, n, low, high)
        while node.count > CAPACITY:
            left, right = self._split(node)
            if path:
                parent, j = path.pop()
                self._place(parent, j, left)
                parent.put(*self._total(right), right)
                node = parent
            else:
                self.root = _Node(self.dim, False)
                for half in (left, right):
                    self.root.put(*self._total(half), half)
                return

    @staticmethod
    def _total(node: _Node) -> tuple[np.ndarray, float, int, int]:
        k = node.count
        return node.sums[:k].sum(axis=0), float(node.n[:k].sum()), int(node.low[:k].min()), int(node.high[:k].max())

    def _place(self, parent: _Node, j: int, child: _Node) -> None:
        parent.sums[j], parent.n[j], parent.low[j], parent.high[j] = self._total(child)
        parent.children[j] = child

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        k = node.count
        c = node.sums[:k] / node.n[:k, None]
        # The entry farthest from the first, and the one farthest from that, are the seeds.
        sq = np.einsum("ij,ij->i", c, c)
        a = int((sq - 2 * (c @ c[0])).argmax())
        da = sq - 2 * (c @ c[a])
        b = int(da.argmax())
        to_b = da + sq[a] > sq - 2 * (c @ c[b]) + sq[b]
        to_b[a], to_b[b] = False, True
        if a == b:
            to_b = np.arange(k) % 2 == 1
        halves = []
        for side in (False, True):
            half = _Node(self.dim, node.children is None)
            for i in np.flatnonzero(to_b == side):
                half.put(node.sums[i], node.n[i], node.low[i], node.high[i], node.children[i] if node.children is not None else None)
            halves.append(half)
        return halves[0], halves[1]

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sums, n, low, high of all leaf entries."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.children is None:
                k = node.count
                out.append((node.sums[:k], node.n[:k], node.low[:k], node.high[:k]))
            else:
                todo += node.children
        return tuple(np.concatenate(x) for x in zip(*out))


def ward(sums: np.ndarray, n: np.ndarray, threshold: float, block: int = 256) -> np.ndarray:
    """A label for each leaf: leaves agglomerated in order of Ward's cost n_a n_b / (n_a + n_b) |c_a - c_b|^2.

    Only leaves whose members have a mean cosine of at least ``threshold`` are joined, and a merged
    cluster is held against its neighbours by its own sum. Pairs that qualify are found in blocks.
    """
    k = len(n)
    sums = sums.astype(np.float64)
    c = sums / n[:, None]
    near: list[dict[int, float]] = [{} for _ in range(k)]
    for lo in range(0, k, block):
        s = c[lo : lo + block] @ c.T
        for i, j in zip(*np.nonzero(s >= threshold)):
            i = int(i) + lo
            if i < j:
                near[i][int(j)] = near[int(j)][i] = float(s[i - lo, j])
    size, vec = {i: float(n[i]) for i in range(k)}, {i: sums[i] for i in range(k)}
    square = {i: float(c[i] @ c[i]) for i in range(k)}
    cost = lambda a, b, cos: size[a] * size[b] / (size[a] + size[b]) * (square[a] + square[b] - 2 * cos)
    heap = [(cost(i, j, s), i, j) for i in range(k) for j, s in near[i].items() if i < j]
    heapq.heapify(heap)
    parent = list(range(k))
    links = {i: near[i] for i in range(k) if near[i]}
    while heap:
        _, a, b = heapq.heappop(heap)
        if a not in size or b not in size or b not in links.get(a, ()):
            continue
        new = len(parent)
        parent.append(new)
        parent[a] = parent[b] = new
        vec[new], size[new] = vec.pop(a) + vec.pop(b), size[a] + size[b]
        m = vec[new] / size[new]
        square[new] = float(m @ m)
        others = (links.pop(a).keys() | links.pop(b).keys()) - {a, b}
        del size[a], size[b]
        links[new] = {}
        for o in others:
            links[o].pop(a, None)
            links[o].pop(b, None)
            cos = float(m @ vec[o]) / size[o]
            if cos >= threshold:
                links[new][o] = links[o][new] = cos
                heapq.heappush(heap, (cost(min(new, o), max(new, o), cos), min(new, o), max(new, o)))
    for i in range(len(parent) - 1, -1, -1):
        parent[i] = parent[parent[i]]
    return np.array(parent[:k], dtype=np.int64)
