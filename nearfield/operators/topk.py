"""Best-k bookkeeping for one task: a block of queries against a stream of point blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PAIR_BUDGET = 4_000_000  # rough scores held at a time
GATHER_BUDGET = 8_000_000  # vector values gathered at a time for exact scores
WAITING_ROWS = 200_000  # exact scores held before they are ranked
ERROR_32 = 2.4e-7  # four times the unit roundoff of single precision
ERROR_64 = 4.5e-16  # ... and of double precision


class BestK:
    """Keeps, for every query, the k best points seen, exactly.

    A block product, in single precision where the values allow, finds the
    pairs that may still enter: its error bound is part of the comparison.
    Those are scored again in double precision, pair by pair, so equal vectors
    get equal scores wherever they stand, and ties fall to the smaller id.
    Internally larger is better (a Euclidean distance counts negative).
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, threshold: float | None = None):
        self.queries = queries
        self.k = k
        self.metric = metric
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        if metric == "cosine":
            self.factors = _unit(queries, self.norms)
        else:  # distances do not change when both sides move; near the origin they round less
            self.shift = queries.mean(axis=0) if metric == "euclid" and len(queries) else 0.0
            self.factors = queries - self.shift
        self.sizes = np.sqrt((self.factors * self.factors).sum(axis=1))
        self.factors_32 = self.factors.astype(np.float32)
        worst = -np.inf if threshold is None else (-threshold if metric == "euclid" else threshold)
        self.threshold = worst
        self.floor = np.full(len(queries), worst)  # what a new pair has to reach
        self.q = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.ids: np.ndarray | None = None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, ids: np.ndarray, points: np.ndarray, only: np.ndarray | None = None) -> None:
        """Take in a block of points, for all queries or those at positions ``only``."""
        ids, points = self._thin(ids, points)
        which = np.arange(len(self.queries)) if only is None else only
        for q_at in range(0, len(which), 4096):
            qs = which[q_at : q_at + 4096]
            rows = max(256, PAIR_BUDGET // len(qs))
            for at in range(0, len(points), rows):
                self._offer(ids[at : at + rows], points[at : at + rows], qs)
                if sum(len(q) for q, _, _ in self.waiting) > WAITING_ROWS:
                    self._rank()
        self._rank()

    def _thin(self, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drop copies of a vector beyond the ``k`` with the smallest ids: those tie ahead for every query."""
        if len(ids) <= self.k:
            return ids, points
        mark = (points * np.cos(np.arange(points.shape[1]))).sum(axis=1)  # equal for equal rows
        order = np.argsort(mark, kind="stable")
        starts = np.concatenate([[0], np.nonzero(np.diff(mark[order]))[0] + 1, [len(order)]])
        drop = np.zeros(len(ids), dtype=bool)
        for at in np.nonzero(np.diff(starts) > self.k)[0]:
            rows = order[starts[at] : starts[at + 1]]
            rows = rows[np.argsort(_ranks(ids[rows]), kind="stable")]
            same = rows[(points[rows] == points[rows[0]]).all(axis=1)]
            drop[same[self.k :]] = True
        return (ids[~drop], points[~drop]) if drop.any() else (ids, points)

    def _offer(self, ids: np.ndarray, points: np.ndarray, qs: np.ndarray) -> None:
        rough, limit = self._rough(points, qs)
        if len(points) > self.k and np.isneginf(limit).any():
            kth = len(points) - self.k
            own = np.partition(rough, kth, axis=0)[kth].astype(np.float64)
            limit = np.maximum(limit, own - 2 * self.slack)
        limit = np.nextafter(limit.astype(rough.dtype), rough.dtype.type(-np.inf))
        found = np.flatnonzero(rough >= limit)
        row, col = np.divmod(found, len(qs))
        step = max(1, GATHER_BUDGET // max(1, points.shape[1]))
        for at in range(0, len(row), step):
            r, q = row[at : at + step], qs[col[at : at + step]]
            score = self._exact(points[r], q)
            enters = score >= self.floor[q]
            self.waiting.append((q[enters], score[enters], ids[r[enters]]))

    def _rough(self, points: np.ndarray, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Approximate scores (points x queries) and what they must reach; sets ``slack``, their error bound."""
        if self.metric == "cosine":
            moved = _unit(points, np.sqrt((points * points).sum(axis=1)))
            longest = 1.0
        else:
            moved = points - self.shift
            longest = float(np.sqrt((moved * moved).sum(axis=1).max(initial=0.0)))
        sizes = self.sizes[qs]
        scale = longest * sizes if self.metric != "euclid" else longest**2 + sizes**2
        single = self.metric == "cosine" or (len(qs) > 0 and 1e-12 < scale.min() and scale.max() < 1e12)
        self.slack = (ERROR_32 if single else ERROR_64) * (points.shape[1] + 8) * scale
        factors = (self.factors_32 if single else self.factors)[qs]
        rough = (moved.astype(np.float32) if single else moved) @ factors.T
        limit = self.floor[qs]
        if self.metric == "euclid":  # order by -distance^2
            rough *= 2
            rough -= (moved * moved).sum(axis=1)[:, None].astype(rough.dtype)
            rough -= (sizes**2)[None, :].astype(rough.dtype)
            limit = -np.square(limit)
        return rough, limit - self.slack

    def _exact(self, points: np.ndarray, q: np.ndarray) -> np.ndarray:
        queries = self.queries[q]
        if self.metric == "euclid":
            gap = points - queries
            return -np.sqrt((gap * gap).sum(axis=1))
        dots = (points * queries).sum(axis=1)
        if self.metric == "dot":
            return dots
        norms = np.sqrt((points * points).sum(axis=1)) * self.norms[q]
        return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)

    def _rank(self) -> None:
        """Merge waiting pairs into the best, and raise the floors."""
        waiting = [w for w in self.waiting if len(w[0])]
        self.waiting = []
        if not waiting:
            return
        if self.ids is not None:
            waiting.append((self.q, self.score, self.ids))
        q, score, ids = (np.concatenate(parts) for parts in zip(*waiting))
        order = np.lexsort((_ranks(ids), -score, q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        self.q, self.score, self.ids = q[best], score[best], ids[best]
        last = place[best] == self.k - 1
        self.floor[self.q[last]] = np.maximum(self.threshold, self.score[last])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, ids and scores (a Euclidean distance positive again)."""
        ids = self.ids if self.ids is not None else np.empty(0, dtype=object)
        return self.q, ids, -self.score if self.metric == "euclid" else self.score


def _unit(rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.divide(rows, norms[:, None], out=np.zeros_like(rows), where=norms[:, None] > 0)


def _ranks(ids: np.ndarray) -> np.ndarray:
    if ids.dtype.kind in "iu":
        return ids
    return np.unique(ids, return_inverse=True)[1]


def partial_rows(best: BestK, query_ids: pa.Array, id_type: pa.DataType, part: int) -> pa.RecordBatch:
    """What a task found, as rows (query_id, id, score, part)."""
    q, ids, score = best.result()
    return pa.RecordBatch.from_arrays(
        [
            query_ids.take(pa.array(q)),
            pa.array(ids, id_type),
            pa.array(score),
            pa.array(np.full(len(q), part, dtype=np.int32)),
        ],
        ["query_id", "id", "score", "part"],
    )
