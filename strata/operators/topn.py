"""The best rows of every query inside one task, kept while the rows stream by."""

from __future__ import annotations

import numpy as np
import pandas as pd


class TopN:
    """Keeps the n best (score, key) of each query; scores equal to nine places rank by key. What a task emits doesn't grow with its rows."""

    def __init__(self, queries: int, n: int):
        self.n = n
        self.keys = [np.zeros(0, dtype=np.int64)] * queries
        self.scores = [np.zeros(0)] * queries

    def add(self, keys: np.ndarray, scores: np.ndarray, allowed: list[np.ndarray | None], above: float = -np.inf) -> None:
        """scores: rows x queries; allowed: rows that a query may see (None: all)."""
        for q, ok in enumerate(allowed):
            column = scores[:, q]
            full = len(self.keys[q]) == self.n
            least = max(above, self.scores[q][-1] - 1e-8) if full else above
            keep = column > least if ok is None else ok & (column > least)
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            if len(at) > 4 * self.n:  # all that can be among the best, ties included
                edge = np.partition(column[at], len(at) - self.n)[len(at) - self.n] - 1e-8
                at = at[column[at] >= edge]
            all_keys, all_scores = np.concatenate([self.keys[q], keys[at]]), np.concatenate([self.scores[q], column[at]])
            order = np.lexsort((all_keys, -np.round(all_scores, 9)))[: self.n]
            self.keys[q], self.scores[q] = all_keys[order], all_scores[order]

    def frame(self, ids: list) -> pd.DataFrame:
        sizes = [len(k) for k in self.keys]
        of = pd.Series([i for i, n in zip(ids, sizes) for _ in range(n)], dtype=object)
        return pd.DataFrame({"query_id": of, "key": np.concatenate([*self.keys, np.zeros(0, dtype=np.int64)]).astype(np.int64), "score": np.concatenate([*self.scores, np.zeros(0)])})


def scope_masks(columns: dict[str, np.ndarray], scopes: list[tuple]) -> list[np.ndarray | None]:
    """Rows that each query's own ticker, year and section admit; None where it sets no condition. Equal scopes share a mask."""
    made: dict[tuple, np.ndarray | None] = {}
    for wanted in scopes:
        if wanted in made:
            continue
        mask = None
        for column, value in zip(("ticker", "year", "section"), wanted):
            if value is not None:
                same = np.asarray(columns[column] == value, dtype=bool)
                mask = same if mask is None else mask & same
        made[wanted] = mask
    return [made[w] for w in scopes]
