"""Trees of boxes for the tasks that look for neighbours: many points ask at once, level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a leaf at most, (point, box) pairs looked at together, and points that ask together.
LEAF, PAIRS, ASKING = 16, 1 << 20, 1 << 13


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from each point to its box; never above that to a point in the box, rounding included."""
    gap = np.maximum(np.maximum(low - points, points - high), 0.0)
    return squared(gap)


def squared(gap: np.ndarray) -> np.ndarray:
    return gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1] + gap[..., 2] * gap[..., 2]


class Boxes:
    """A full binary tree over boxes that lie near each other in their order. lows and highs: the boxes of each level, the root's first."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.count, self.depth = len(low), max(0, int(len(low) - 1).bit_length())
        missing = (1 << self.depth) - len(low)
        self.lows, self.highs = [np.concatenate([low, np.full((missing, 3), np.inf)])], [np.concatenate([high, np.full((missing, 3), -np.inf)])]
        for _ in range(self.depth):
            self.lows.insert(0, np.minimum(self.lows[0][::2], self.lows[0][1::2]))
            self.highs.insert(0, np.maximum(self.highs[0][::2], self.highs[0][1::2]))

    def descend(self, points: np.ndarray) -> np.ndarray:
        """A leaf near each point: that of the nearer box at each fork."""
        node = np.zeros(len(points), np.int64)
        for low, high in zip(self.lows[1:], self.highs[1:], strict=True):
            left = 2 * node
            node = left + (box_distance(points, low[left + 1], high[left + 1]) < box_distance(points, low[left], high[left]))
        return node

    def within(self, points: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (row of points, leaf) whose box is at most the row's bound (a squared distance) away, some at a time, rows ascending."""
        yield from self._open(points, bound, np.arange(len(points)), np.zeros(len(points), np.int64), 0)

    def _open(self, points: np.ndarray, bound: np.ndarray, rows: np.ndarray, nodes: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while len(rows):
            near = box_distance(points[rows], self.lows[level][nodes], self.highs[level][nodes]) <= bound[rows]
            rows, nodes = rows[near], nodes[near]
            if level == self.depth:
                yield rows[nodes < self.count], nodes[nodes < self.count]
                return
            if len(rows) > PAIRS // 2:
                for part in range(0, len(rows), PAIRS // 4):
                    cut = slice(part, part + PAIRS // 4)
                    yield from self._open(points, bound, np.repeat(rows[cut], 2), np.stack([2 * nodes[cut], 2 * nodes[cut] + 1], axis=1).ravel(), level + 1)
                return
            rows, nodes, level = np.repeat(rows, 2), np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), level + 1


class Tree:
    """Points split at medians of their widest axes down to LEAF, for finding nearest ones. Of points at one place only the first counts."""

    def __init__(self, points: np.ndarray) -> None:
        order = np.lexsort((np.arange(len(points)), points[:, 2], points[:, 1], points[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (points[order[1:]] != points[order[:-1]]).any(axis=1)
        order = order[new]
        n = len(order)
        leaves = 1 << max(0, int(-(-n // LEAF) - 1).bit_length())
        parts = 1
        while parts < leaves:
            starts = np.arange(parts) * n // parts
            node = np.repeat(np.arange(parts), np.diff(np.append(starts, n)))
            p = points[order]
            low, high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
            axis = (high - low).argmax(axis=1)
            width = np.maximum((high - low).max(axis=1), 1e-300)
            share = (p[np.arange(n), axis[node]] - low[np.arange(parts), axis][node]) / width[node]
            order = order[np.argsort(node + np.minimum(share, 1.0) * 0.999999)]  # rounding may misplace a point; boxes are those of the points that came
            parts *= 2
        self.starts = np.append(np.arange(leaves) * n // leaves, n)
        self.rows, self.points = order, points[order]
        self.boxes = Boxes(np.minimum.reduceat(self.points, self.starts[:-1]), np.maximum.reduceat(self.points, self.starts[:-1]))
        self.size = int(np.diff(self.starts).max())

    def nearest(self, asked: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row of the nearest point of each that asks, ties to the least row, and its squared distance; -1 where none is within the bound (squared)."""
        row, best = np.full(len(asked), -1, np.int64), np.full(len(asked), np.inf) if bound is None else bound.astype(float)
        for k in range(0, len(asked), ASKING):
            part = slice(k, k + ASKING)
            self._search(asked[part], row[part], best[part])
        return row, best

    def _search(self, asked: np.ndarray, row: np.ndarray, best: np.ndarray) -> None:
        first = self.boxes.descend(asked)
        self._meet(asked, np.arange(len(asked)), first, row, best)
        for rows, leaves in self.boxes.within(asked, best.copy()):
            other = leaves != first[rows]
            rows, leaves = rows[other], leaves[other]
            for k in range(0, len(rows), PAIRS // self.size + 1):
                cut = slice(k, k + PAIRS // self.size + 1)
                self._meet(asked, rows[cut], leaves[cut], row, best)

    def _meet(self, asked: np.ndarray, rows: np.ndarray, leaves: np.ndarray, row: np.ndarray, best: np.ndarray) -> None:
        """Let each of `rows` (ascending) look at all points of its leaf."""
        if not len(rows):
            return
        at = self.starts[leaves][:, None] + np.arange(self.size)
        there = at < self.starts[leaves + 1][:, None]
        at = np.minimum(at, len(self.rows) - 1)
        square = np.where(there, squared(asked[rows][:, None, :] - self.points[at]), np.inf)
        begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        low = np.minimum.reduceat(square.min(axis=1), begin)
        alike = square == np.repeat(low, np.diff(np.append(begin, len(rows))))[:, None]
        found = np.minimum.reduceat(np.where(alike, self.rows[at], np.iinfo(np.int64).max).min(axis=1), begin)
        asks = rows[begin]
        better = np.isfinite(low) & ((low < best[asks]) | ((low == best[asks]) & ((row[asks] < 0) | (found < row[asks]))))
        row[asks[better]], best[asks[better]] = found[better], low[better]
