"""The best rows of every query, kept per task while its batches go by."""

from __future__ import annotations

import numpy as np

#: Candidates held before they are cut down to the best of each query.
HELD = 1_000_000


class Best:
    """Keeps the ``k`` best (score, then smaller id) of each of ``queries`` numbered queries.

    What a task sends is ``k`` rows a query at most, however many rows it has seen.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> None:
        """``scores``: queries x rows; only entries of ``wanted`` (same shape) count. ``ids``: of the rows."""
        if not np.isfinite(scores).all():
            raise ValueError("a score isn't finite")
        passing = wanted & (scores >= self.floor[:, None])
        if scores.shape[1] > self.k:
            # The k-th best of these rows bounds what can come out; ties with it stay, as ids decide.
            shown = np.where(passing, scores, -np.inf)
            passing &= shown >= np.partition(shown, shown.shape[1] - self.k, axis=1)[:, shown.shape[1] - self.k][:, None]
        query, row = np.nonzero(passing)
        if len(query):
            self.parts.append((query, scores[query, row], ids[row]))
            self.held += len(query)
            if self.held > HELD:
                self._cut()

    def _cut(self) -> None:
        query, score, ids = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = score[last]
        keep = place < self.k
        self.parts = [(query[keep], score[keep], ids[keep])]
        self.held = int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(query numbers, scores, ids), best first within a query."""
        if not self.parts:
            return None
        self._cut()
        return self.parts[0]
