"""KD-trees over a shard's vectors: median splits, tight boxes, best-first order."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np


class KdTree:
    """points stand in leaf order; node k has box low[k]..high[k] and rows start[k]..stop[k]; children 0: a leaf."""

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, stop: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.order, self.points, self.low, self.high = order, points, low, high
        self.start, self.stop, self.left, self.right = start, stop, left, right

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> KdTree:
        order = np.arange(len(points))
        boxes, spans, children = [], [], []

        def node(a: int, b: int) -> int:
            k = len(spans)
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            boxes.append((low, high))
            spans.append((a, b))
            children.append([0, 0])
            return k

        todo = [node(0, len(points))] if len(points) else []
        while todo:
            k = todo.pop()
            a, b = spans[k]
            wide = boxes[k][1] - boxes[k][0]
            if b - a <= leaf or not wide.any():
                continue  # equal points can't be split
            middle = (a + b) // 2
            part = order[a:b]
            order[a:b] = part[np.argpartition(points[part, int(np.argmax(wide))], middle - a)]
            children[k] = [node(a, middle), node(middle, b)]
            todo += children[k]
        d = points.shape[1] if points.ndim == 2 else 0
        pick = lambda i: np.array([x[i] for x in boxes]) if boxes else np.zeros((0, d))
        spans_, kids = np.array(spans, np.int64).reshape(-1, 2), np.array(children, np.int64).reshape(-1, 2)
        return cls(order, points[order], pick(0), pick(1), spans_[:, 0], spans_[:, 1], kids[:, 0], kids[:, 1])

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, order=self.order, points=self.points, low=self.low, high=self.high, start=self.start, stop=self.stop, left=self.left, right=self.right, **more)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[KdTree, dict[str, np.ndarray]]:
        data = dict(np.load(io.BytesIO(raw), allow_pickle=False))
        tree = cls(*(data.pop(k) for k in ("order", "points", "low", "high", "start", "stop", "left", "right")))
        return tree, data

    def best_first(self, reach: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Leaves by falling reach (of their boxes, one number a node): reach, and the rows of the leaf."""
        if not len(self.start):
            return
        queue = [(-reach[0], 0)]
        while queue:
            bound, k = heapq.heappop(queue)
            if self.left[k]:
                for child in (self.left[k], self.right[k]):
                    heapq.heappush(queue, (-reach[child], child))
            else:
                yield -bound, self.start[k], self.stop[k]

    def inner_bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node: the largest inner product that a point of the box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def distance_bounds(self, query: np.ndarray) -> np.ndarray:
        """For each node: the least squared distance from the query to its box."""
        gap = np.maximum(0, np.maximum(self.low - query, query - self.high))
        return (gap * gap).sum(axis=1)
