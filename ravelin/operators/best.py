"""The k best rows of each query, kept inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class Best:
    """The k best (id, score) of each of n queries among all that were offered: higher scores first, then smaller
    ids. floor holds the k-th best score known of a query: whatever lies below it need not be offered.
    At most some 3 * n * k rows (or SLACK) are held."""

    SLACK = 1 << 18

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.full = 0, 2 * n * k + self.SLACK

    def offer(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Rows of queries, given by their places."""
        if len(query):
            self.parts.append((query, ids, score))
            self.held += len(query)
            if self.held > self.full:
                self.settle()

    def offer_block(self, first: int, score: np.ndarray, ids: np.ndarray) -> None:
        """A matrix of scores: a row for each query from the place first on, a column for each id; -inf is no hit."""
        floor = self.floor[first : first + len(score)]
        good = (score >= floor[:, None]) & (score > -np.inf)
        if good.sum() > 4 * self.k * len(score):
            # No floor yet: the block's own k-th best is one. Ties at it are all offered.
            at = min(self.k, score.shape[1]) - 1
            good &= score >= -np.partition(-score, at, axis=1)[:, at][:, None]
        row, column = np.nonzero(good)
        self.offer(row + first, ids[column], score[row, column])

    def settle(self) -> None:
        if not self.parts:
            return
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = score[last]
        kept = place < self.k
        self.parts, self.held = [(query[kept], ids[kept], score[kept])], int(kept.sum())

    def batches(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        """query_id, id, score of all that is kept; names are the queries' own ids by place."""
        self.settle()
        for query, ids, score in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])
