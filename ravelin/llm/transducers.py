"""Weighted finite-state transducers over token classes, composed lazily.

A machine maps (state, input symbol) to arcs (output symbol, weight, next state). Composition
runs two machines in step, the second on the first's output; weights add along a path, and
the best path of a clause is found by dynamic programming over the composed states.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

State = Hashable
Arc = tuple[object, float, State]


class Transducer:
    """start, arcs(state, symbol), and the weight of ending in a state."""

    def __init__(self, start: State, arcs: Callable[[State, object], Iterable[Arc]], final: Callable[[State], float] = lambda _: 0.0):
        self.start, self.arcs, self.final = start, arcs, final

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes."""

        def arcs(state, symbol):
            for middle, w, left in self.arcs(state[0], symbol):
                for out, v, right in other.arcs(state[1], middle):
                    yield out, w + v, (left, right)

        return Transducer((self.start, other.start), arcs, lambda s: self.final(s[0]) + other.final(s[1]))

    def best_path(self, symbols: Iterable[object]) -> tuple[float, list[object]]:
        """Weight and output of the heaviest path that reads all symbols."""
        front: dict[State, tuple[float, tuple]] = {self.start: (0.0, ())}
        for symbol in symbols:
            after: dict[State, tuple[float, tuple]] = {}
            for state, (weight, trail) in front.items():
                for out, w, to in self.arcs(state, symbol):
                    if to not in after or weight + w > after[to][0]:
                        after[to] = (weight + w, (trail, out))
            front = after
        if not front:
            return float("-inf"), []
        weight, trail = max(((w + self.final(s), t) for s, (w, t) in front.items()), key=lambda x: x[0])
        out = []
        while trail:
            trail, last = trail
            out.append(last)
        return weight, out[::-1]
