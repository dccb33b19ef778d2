"""Weighted letter transducers: tables of arcs, their composition, and best accepted paths.

Every arc reads one symbol and writes one, so composing two transducers is a product of their states. Weights add along a
path, and of several paths the heaviest counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Transducer:
    """``arcs[state][read]`` lists (written, next state, weight); a path counts where it ends in one of ``finals``."""

    start: object = 0
    finals: set = field(default_factory=set)
    arcs: dict = field(default_factory=dict)

    def add(self, state, read: str, written: str, to, weight: float = 0.0) -> None:
        self.arcs.setdefault(state, {}).setdefault(read, []).append((written, to, weight))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what ``first`` reads and writes what ``second`` makes of its output; only states that can be reached."""
    out = Transducer((first.start, second.start))
    ahead, seen = [out.start], {out.start}
    while ahead:
        state = a, b = ahead.pop()
        if a in first.finals and b in second.finals:
            out.finals.add(state)
        for read, arcs in first.arcs.get(a, {}).items():
            for middle, to_a, weight in arcs:
                for written, to_b, more in second.arcs.get(b, {}).get(middle, ()):
                    out.add(state, read, written, (to_a, to_b), weight + more)
                    if (to_a, to_b) not in seen:
                        seen.add((to_a, to_b))
                        ahead.append((to_a, to_b))
    return out


class Paths:
    """A transducer compiled to numbered states, for best paths over many sequences."""

    def __init__(self, found: Transducer):
        states = {found.start: 0}
        for state, by_symbol in found.arcs.items():
            for arcs in by_symbol.values():
                for _, to, _ in arcs:
                    states.setdefault(to, len(states))
            states.setdefault(state, len(states))
        self.finals = frozenset(states[s] for s in found.finals)
        # Of the arcs between two states on one symbol only the heaviest can be on a best path.
        self.arcs: list[dict[str, tuple]] = [{} for _ in states]
        for state, by_symbol in found.arcs.items():
            for read, arcs in by_symbol.items():
                best: dict[int, float] = {}
                for _, to, weight in arcs:
                    best[states[to]] = max(best.get(states[to], weight), weight)
                self.arcs[states[state]][read] = tuple(best.items())

    def heaviest(self, symbols: list[str]) -> tuple[float, int]:
        """Weight of the best accepted path and the number of its arcs that weigh something; (0, 0) without a path."""
        front = {0: (0.0, 0)}
        for symbol in symbols:
            after: dict[int, tuple[float, int]] = {}
            for state, (total, n) in front.items():
                for to, weight in self.arcs[state].get(symbol, ()):
                    there = total + weight, n + (weight > 0)
                    if to not in after or there > after[to]:
                        after[to] = there
            front = after
        return max((got for state, got in front.items() if state in self.finals), default=(0.0, 0))
