"""Packing by the histogram of lengths.

Lengths are whole numbers up to the capacity, so any number of pieces has a histogram of at
most that many counts, and bins that hold the same lengths can be kept as one pattern with a
multiplicity. The plans below are made from the histogram alone, in time and memory that do
not depend on the number of pieces; the pieces then look up their places by rank.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # (length, copies) in order of their place


class CapacityTree:
    """Segment tree over residual capacities: the smallest one from a length on that some bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, residual: int, n: int) -> None:
        i = residual + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def at_least(self, length: int) -> int | None:
        i = length + self.size
        if self.count[i]:
            return length
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass
class Bins:
    """Bins as patterns with multiplicities, found by residual capacity."""

    capacity: int
    by_residual: dict[int, list[tuple[Pattern, int]]] = field(default_factory=dict)

    def __post_init__(self):
        self.tree = CapacityTree(self.capacity)

    def put(self, pattern: Pattern, n: int) -> None:
        if n:
            left = self.capacity - sum(length * copies for length, copies in pattern)
            self.by_residual.setdefault(left, []).append((pattern, n))
            self.tree.add(left, n)

    def best_fit(self, length: int, count: int) -> None:
        """Place count pieces of one length, each in the fullest bin that takes it. A bin that
        took one piece is fuller than its peers, so it takes as many as it can before the next."""
        while count:
            left = self.tree.at_least(length)
            if left is None:
                pattern, bins, left = (), -(-count // (self.capacity // length)), self.capacity
            else:
                pattern, bins = self.by_residual[left].pop()
                self.tree.add(left, -bins)
            each = left // length
            full = min(bins, count // each)
            self.put((*pattern, (length, each)), full)
            count -= full * each
            bins -= full
            if bins and 0 < count < each:
                self.put((*pattern, (length, count)), 1)
                bins, count = bins - 1, 0
            self.put(pattern, bins) if pattern else None

    def patterns(self) -> list[tuple[Pattern, int]]:
        return [x for left in sorted(self.by_residual) for x in self.by_residual[left]]


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """counts[l] pieces of length l, longest first, by best fit."""
    bins = Bins(capacity)
    for length in range(capacity, 0, -1):
        bins.best_fit(length, int(counts[length]))
    return bins.patterns()


# ---------------------------------------------------------------- linear grouping


def linear_groups(counts: np.ndarray, above: int, capacity: int, groups: int) -> list[list[tuple[int, int]]]:
    """Lengths from capacity - 1 down to above + 1 in groups of equal cardinality, as (length, count) runs."""
    total = int(counts[above + 1 : capacity].sum())
    if not total:
        return []
    groups = max(1, min(groups, total))
    edges = [total * (g + 1) // groups for g in range(groups)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(groups)]
    g = seen = 0
    for length in range(capacity - 1, above, -1):
        n = int(counts[length])
        while n:
            take = min(n, edges[g] - seen)
            if take:
                out[g].append((length, take))
                seen, n = seen + take, n - take
            if seen == edges[g] and g + 1 < groups:
                g += 1
    return [x for x in out if x]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """The configuration programme, min sum x with sum a x = demand, by column generation: the
    dual prices go to a bounded knapsack, whose best filling enters the basis."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    most = int(capacity // sizes.min())
    for turn in range(rounds):
        price = inverse.sum(axis=0)
        # best[c]: the most that pieces of total size c or less are worth, one more piece in each pass
        best, picks = np.zeros(capacity + 1), []
        for _ in range(most):
            after, pick = best.copy(), np.full(capacity + 1, -1, np.int32)
            for i in np.flatnonzero(price > 1e-12):
                s = sizes[i]
                value = best[:-s] + price[i]
                better = value > after[s:] + 1e-12
                after[s:][better] = value[better]
                pick[s:][better] = i
            picks.append(pick)
            if not (pick >= 0).any():
                break
            best = after
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            i = pick[room]
            if i >= 0:
                column[i] += 1
                room -= sizes[i]
        if price @ column <= 1 + 1e-7:
            break
        way = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, x / way, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leave] / way[leave]
            inverse -= np.outer(way, row)
            inverse[leave] = row
        x = np.maximum(inverse @ demand, 0)
    return [(basis[:, j], x[j]) for j in range(k)]


#: Shares of the optimised bins that are tried, from all to few.
SHARES = (1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)


def grouped_packing(counts: np.ndarray, capacity: int, small: int, groups: int) -> list[tuple[Pattern, int]]:
    """Linear grouping: lengths above small are rounded up to the longest of their group, the
    configurations of these few sizes are optimised, actual lengths take the rounded places,
    and everything else goes in by best fit, longest first.

    Rounding leaves gaps that only small pieces fill. Where there are too few of them, part of
    the optimised bins is left out and their pieces join the best fit; of the SHARES tried the
    largest with the fewest bins is taken."""
    large = linear_groups(counts, small, capacity, groups)
    by_size: dict[int, list[tuple[int, int]]] = {}
    for runs in large:  # groups with the same longest length are one size
        by_size.setdefault(runs[0][0], []).extend(runs)
    queues = list(by_size.values())
    solution: list[tuple[np.ndarray, float]] = []
    if queues:
        demand = np.array([sum(n for _, n in runs) for runs in queues], float)
        solution = configurations(np.array(list(by_size)), demand, capacity)
    least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    chosen, fewest = [], None
    for share in SHARES:
        patterns = _substituted(counts, capacity, solution, queues, share)
        n = sum(m for _, m in patterns)
        if fewest is None or n < fewest:
            chosen, fewest = patterns, n
        if n == least:
            break
    return chosen


def _substituted(counts: np.ndarray, capacity: int, solution, groups, share: float) -> list[tuple[Pattern, int]]:
    """Bins for that share of the solution, with actual lengths in the rounded places, and the rest by best fit."""
    rest = counts.copy()
    bins = Bins(capacity)
    bins.put(((capacity, 1),), int(rest[capacity]))
    rest[capacity] = 0
    queues = [list(runs[::-1]) for runs in groups]
    stock = [sum(n for _, n in runs) for runs in groups]
    for column, x in solution:
        left = int(x * share + 1e-7)
        places = [i for i in np.flatnonzero(column) for _ in range(int(column[i]))]
        need = {i: places.count(i) for i in places}
        left = min(left, *(stock[i] // c for i, c in need.items())) if need else 0
        for i, c in need.items():
            stock[i] -= left * c
        while left:
            # The longest stretch of bins over which every place keeps its length.
            n = min(left, *(queues[i][-1][1] // c for i, c in need.items()))
            lengths = []
            if n:
                lengths = [queues[i][-1][0] for i in places]
                for i, c in need.items():
                    length, count = queues[i].pop()
                    if count > n * c:
                        queues[i].append((length, count - n * c))
            else:  # a run is too short for one bin: that bin mixes lengths
                n = 1
                for i in places:
                    length, count = queues[i].pop()
                    lengths.append(length)
                    if count > 1:
                        queues[i].append((length, count - 1))
            runs: dict[int, int] = {}
            for length in lengths:
                runs[length] = runs.get(length, 0) + 1
                rest[length] -= n
            bins.put(tuple(runs.items()), n)
            left -= n
    for length in range(capacity, 0, -1):
        bins.best_fit(length, int(rest[length]))
    return bins.patterns()


# ---------------------------------------------------------------- from ranks to places


class Places:
    """Where the piece with a given rank among those of its length goes."""

    def __init__(self, patterns: list[tuple[Pattern, int]], capacity: int):
        base, used, rows = 0, [0] * (capacity + 1), []
        for pattern, n in patterns:
            at = 0
            for length, copies in pattern:
                rows.append((length << 44 | used[length], base, copies, at))
                used[length] += n * copies
                at += length * copies
            base += n
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.key, self.base, self.copies, self.at = (np.ascontiguousarray(table[:, i]) for i in range(4))
        self.bins = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin numbers and offsets."""
        row = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        nth = rank - (self.key[row] & ((1 << 44) - 1))
        return self.base[row] + nth // self.copies[row], self.at[row] + nth % self.copies[row] * length
