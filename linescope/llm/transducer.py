"""Minimal acyclic transducers that map the terms of a sorted list to their ordinals.

Terms in ascending byte order are added one by one. What the next term cannot share any more is frozen: a frozen state
that accepts the same endings as an earlier one is that state, so the automaton is minimal at every moment. A state
knows how many terms it accepts; the numbers accepted by the arcs before an arc, summed along a path, are the ordinal.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Transducer:
    """Arcs sorted by (state, byte); ``add`` is what an arc adds to the ordinal."""

    root: int
    final: np.ndarray
    keys: np.ndarray  # state * 256 + byte
    target: np.ndarray
    add: np.ndarray

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in (self.final, self.keys, self.target, self.add))

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinal of every byte span, -1 for those that are no term. All spans take a step at once."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        at = np.arange(len(starts))
        place, state = starts.astype(np.int64), np.full(len(starts), self.root, np.int64)
        total = np.zeros(len(starts), np.int64)
        while len(at):
            over = place == ends[at]
            if over.any():
                ended = over & self.final[state]
                out[at[ended]] = total[ended]
                at, place, state, total = at[~over], place[~over], state[~over], total[~over]
            wanted = state * 256 + data[place]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            held = self.keys[arc] == wanted
            arc = arc[held]
            at, place = at[held], place[held] + 1
            state, total = self.target[arc].astype(np.int64), total[held] + self.add[arc]
        return out


def build(terms: Iterable[bytes]) -> Transducer:
    """Transducer of distinct, not empty terms in ascending byte order."""
    register: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}
    accepted: list[int] = []
    #: States of the last term's path: final or not, and the arcs that are frozen.
    path: list[list] = [[False, []]]
    last = b""

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        known = register.get(key)
        if known is None:
            known = register[key] = len(register)
            accepted.append(state[0] + sum(accepted[t] for _, t in state[1]))
        return known

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))

    for term in terms:
        if term <= last:
            raise ValueError("terms must be distinct and ascend")
        shared, most = 0, min(len(term), len(last))
        while shared < most and term[shared] == last[shared]:
            shared += 1
        close(shared)
        path.extend([False, []] for _ in range(len(term) - shared))
        path[-1][0] = True
        last = term
    close(0)
    root = freeze(path[0])
    final = np.zeros(len(register), bool)
    keys, target, add = [], [], []
    for (ends, arcs), state in register.items():
        final[state] = ends
        before = int(ends)
        for byte, to in arcs:
            keys.append(state * 256 + byte)
            target.append(to)
            add.append(before)
            before += accepted[to]
    return Transducer(root, final, np.array(keys, np.int64), np.array(target, np.int32), np.array(add, np.int32))
