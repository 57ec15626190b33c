"""A forest of random-projection trees as plain numpy, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class Margins:
    """Signed distances of rows to planes: all at once for few planes, else only those asked for."""

    DENSE = 2048

    def __init__(self, x: np.ndarray, normals: np.ndarray, offsets: np.ndarray):
        self.x, self.normals, self.offsets = x, normals, offsets
        self.dense = x @ normals.T - offsets if len(normals) <= self.DENSE else None

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, at: tuple) -> np.ndarray:
        rows, planes = at
        if self.dense is not None:
            return self.dense[rows, planes]
        return (self.x[rows] * self.normals[planes]).sum(axis=-1) - self.offsets[planes]


class Forest:
    """Complete binary trees of equal depth; node i has children 2i+1 and 2i+2.

    Every node cuts along a random direction between two sampled points, refined by a few
    two-means steps, at the median of its sample, so all leaves hold about equal shares.
    """

    def __init__(self, normals: np.ndarray, offsets: np.ndarray):
        self.normals, self.offsets = normals, offsets
        self.trees, self.inner = offsets.shape
        self.leaves = self.inner + 1
        self.depth = self.leaves.bit_length() - 1

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
        d = sample.shape[1] if sample.ndim == 2 else 0
        self = cls(np.zeros((trees, 2**depth - 1, d), dtype=np.float32), np.zeros((trees, 2**depth - 1), dtype=np.float32))
        rng = np.random.default_rng(seed)
        for t in range(trees):
            stack = [(0, np.arange(len(sample)))]
            while stack:
                node, rows = stack.pop()
                if node >= self.inner:
                    continue
                w = self._direction(sample[rows], rng, d)
                at = sample[rows] @ w
                cut = float(np.median(at)) if len(rows) else 0.0
                self.normals[t, node], self.offsets[t, node] = w, cut
                low = at <= cut
                stack += [(2 * node + 1, rows[low]), (2 * node + 2, rows[~low])]
        return self

    @staticmethod
    def _direction(points: np.ndarray, rng: np.random.Generator, d: int) -> np.ndarray:
        if len(points) < 2:
            w = rng.normal(size=d)
        else:
            a, b = points[rng.choice(len(points), 2, replace=False)].astype(np.float64)
            some = points[rng.choice(len(points), min(len(points), 256), replace=False)]
            for _ in range(3):
                near = some @ (a - b) > (a - b) @ (a + b) / 2
                if near.all() or not near.any():
                    break
                a, b = some[near].mean(axis=0, dtype=np.float64), some[~near].mean(axis=0, dtype=np.float64)
            w = a - b
            if not np.linalg.norm(w) > 1e-9:
                w = rng.normal(size=d)
        return (w / max(np.linalg.norm(w), 1e-12)).astype(np.float32)

    def margins(self, x: np.ndarray) -> Margins:
        """The signed distance of every row of x to any cutting plane, plane number tree * inner + node."""
        return Margins(x, self.normals.reshape(-1, self.normals.shape[2]), self.offsets.reshape(-1))

    def own(self, m: Margins) -> np.ndarray:
        """(rows, trees): the leaf, numbered over the whole forest, that holds each row."""
        rows = np.arange(len(m))
        out = np.zeros((len(m), self.trees), dtype=np.int64)
        for t in range(self.trees):
            node = np.zeros(len(m), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (m[rows, t * self.inner + node] > 0)
            out[:, t] = t * self.leaves + node - self.inner
        return out

    def search(self, m: Margins, probes: int) -> np.ndarray:
        """(rows, probes): the leaves that one priority queue over all trees pops first.

        The queue of every row starts with all roots.  The node of the greatest priority is
        taken; a leaf is reported, an inner node puts both children back, each with the lesser
        of its parent's priority and the row's distance on that child's side of the plane.  All
        rows of the batch take their step together.
        """
        n, total = len(m), self.trees * self.leaves
        probes = min(probes, total)
        if not self.depth:
            return np.tile(np.arange(probes), (n, 1))
        most = self.trees + probes * self.depth + self.trees * self.depth + 2
        priority = np.full((n, most), -np.inf, dtype=np.float32)
        node = np.zeros((n, most), dtype=np.int64)
        tree = np.zeros((n, most), dtype=np.int64)
        priority[:, : self.trees] = 1e30
        tree[:, : self.trees] = np.arange(self.trees)
        out = np.full((n, probes), -1, dtype=np.int64)
        got = np.zeros(n, dtype=np.int64)
        used = np.full(n, self.trees, dtype=np.int64)
        live = np.arange(n)
        while len(live):
            width = int(used[live].max())
            at = priority[live, :width].argmax(axis=1)
            p, i, t = priority[live, at], node[live, at], tree[live, at]
            leaf = i >= self.inner
            done = live[leaf]
            out[done, got[done]] = t[leaf] * self.leaves + i[leaf] - self.inner
            got[done] += 1
            priority[done, at[leaf]] = -np.inf
            go, at, p, i, t = live[~leaf], at[~leaf], p[~leaf], i[~leaf], t[~leaf]
            if len(go):
                side = m[go, t * self.inner + i]
                right = side > 0
                node[go, at] = 2 * i + 1 + right
                priority[go, at] = np.minimum(p, np.abs(side))
                slot = used[go]
                node[go, slot] = 2 * i + 2 - right
                tree[go, slot] = t
                priority[go, slot] = np.minimum(p, -np.abs(side))
                used[go] += 1
            live = live[got[live] < probes]
        return out
