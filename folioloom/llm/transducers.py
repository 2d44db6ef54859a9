"""Small weighted finite-state transducers over word classes, and their composition."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Transducer:
    """Deterministic: (state, input) -> (state, output, weight). An input without an arc keeps the state's `other` arc."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, str, float]]
    #: Where symbols without an arc of their own lead from a state; they come out as they are.
    other: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        got = self.arcs.get((state, symbol))
        return got if got is not None else (self.other.get(state, state), symbol, 1.0)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for s in symbols:
            state, o, w = self.step(state, s)
            out.append((o, w))
        return out


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """One transducer that does what `second` does to the output of `first`; weights multiply."""
    numbers: dict[tuple[int, int], int] = {(first.start, second.start): 0}
    todo, arcs = [(first.start, second.start)], {}
    while todo:
        pair = todo.pop()
        for s in alphabet:
            a, o, w = first.step(pair[0], s)
            b, o2, w2 = second.step(pair[1], o)
            if (a, b) not in numbers:
                numbers[(a, b)] = len(numbers)
                todo.append((a, b))
            arcs[(numbers[pair], s)] = (numbers[(a, b)], o2, w * w2)
    return Transducer(0, arcs)
