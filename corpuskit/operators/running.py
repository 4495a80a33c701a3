"""Best rows of many queries, kept while a task runs through its batches."""

from __future__ import annotations

import numpy as np

# Scores are compared after rounding, so that summation order decides no tie.
TIE_DIGITS = 9


class Running:
    """The k best rows seen so far for each of some queries, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), None, dtype=object)

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """Merge a block of scores (queries from ``first`` on x rows).

        Only scores that can still be among the best are rounded and ordered.
        """
        worst = self.scores[first:first + len(scores)].min(axis=1)
        lots = 4 * self.k
        if scores.shape[1] >= 2 * lots and np.isneginf(worst).any():
            # The best of each lot of columns: k of them reach the k-th of these.
            tops = scores[:, :scores.shape[1] // lots * lots].reshape(len(scores), lots, -1).max(axis=2)
            tops = np.where(np.isnan(tops), -np.inf, tops)
            worst = np.maximum(worst, -np.partition(-tops, self.k - 1, axis=1)[:, self.k - 1])
        # Rounding may move two scores by half a digit each; an empty place is -inf, and -inf or NaN fills none.
        least = np.maximum(worst - (2 * 10.0 ** -TIE_DIGITS + 1e-15 * np.abs(worst)), np.finfo(np.float64).min)
        row, column = np.nonzero(scores >= least[:, None])
        if not len(row):
            return
        # The candidates of a query side by side.
        times = np.bincount(row, minlength=len(scores))
        rows = np.flatnonzero(times)
        at = (np.cumsum(times > 0) - 1)[row]
        place = np.arange(len(row)) - (np.cumsum(times) - times)[row]
        fresh = np.full((len(rows), times.max()), -np.inf)
        fresh[at, place] = np.round(scores[row, column], TIE_DIGITS)
        origin = np.zeros(fresh.shape, np.int64)
        origin[at, place] = column
        both = np.concatenate([self.scores[first + rows], fresh], axis=1)
        limit = -np.partition(-both, self.k - 1, axis=1)[:, self.k - 1]
        # Equal scores can still win by id.
        keep = (both >= limit[:, None]) & (both > -np.inf)
        exact = keep.sum(axis=1) == self.k
        columns = np.nonzero(keep[exact])[1]
        if len(columns):
            queries = first + rows[exact]
            names = self._names(np.repeat(queries, self.k), origin, np.repeat(np.flatnonzero(exact), self.k), columns, ids)
            self.scores[queries] = np.take_along_axis(both[exact], columns.reshape(-1, self.k), axis=1)
            self.ids[queries] = names.reshape(-1, self.k)
        for at in np.flatnonzero(~exact):  # ties at the limit, or fewer than k rows so far
            columns, query = np.flatnonzero(keep[at]), first + rows[at]
            names = self._names(np.full(len(columns), query), origin, np.full(len(columns), at), columns, ids)
            order = sorted(range(len(columns)), key=lambda j: (-both[at, columns[j]], names[j]))[:self.k]
            self.scores[query] = -np.inf
            self.scores[query, :len(order)] = both[at, columns[order]]
            self.ids[query, :len(order)] = names[order]

    def _names(self, queries: np.ndarray, origin: np.ndarray, at: np.ndarray, columns: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Ids behind columns: the first k are those kept, the others candidates from the block."""
        out = np.empty(len(columns), dtype=object)
        old = columns < self.k
        out[old] = self.ids[queries[old], columns[old]]
        out[~old] = ids[origin[at[~old], columns[~old] - self.k]]
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of all kept rows."""
        query, place = np.nonzero(self.scores > -np.inf)
        return query, self.ids[query, place], self.scores[query, place]
