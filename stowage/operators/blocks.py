"""Matching blocks of two token sequences, longest first, by a suffix automaton.

The blocks are those of the longest-first matcher: the longest run that both have, the first in the one, then the first in
the other, and so on to its left and right. A run is found by streaming one side through an automaton of all runs of the
other, in steps linear in both, whatever repeats; comparing places by token is quadratic where a line repeats.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class Runs:
    """All runs of a sequence: each state stands for runs that end at the same places, and knows the first of these."""

    def __init__(self, tokens: Sequence[Hashable]):
        self.step: list[dict] = [{}]
        self.back, self.size, self.first = [-1], [0], [-1]
        last = 0
        for at, token in enumerate(tokens):
            last = self._grow(last, token, at)

    def _state(self, step: dict, back: int, size: int, first: int) -> int:
        self.step.append(step)
        self.back.append(back)
        self.size.append(size)
        self.first.append(first)
        return len(self.step) - 1

    def _grow(self, last: int, token: Hashable, at: int) -> int:
        step, back, size = self.step, self.back, self.size
        new = self._state({}, 0, size[last] + 1, at)
        p = last
        while p >= 0 and token not in step[p]:
            step[p][token] = new
            p = back[p]
        if p >= 0:
            q = step[p][token]
            if size[q] != size[p] + 1:  # the shorter runs of q now end here too: they become a state of their own
                split = self._state(dict(step[q]), back[q], size[p] + 1, self.first[q])
                while p >= 0 and step[p].get(token) == q:
                    step[p][token] = split
                    p = back[p]
                back[q] = split
                q = split
            back[new] = q
        return new

    def longest_in(self, tokens: Sequence[Hashable]) -> tuple[int, int, int]:
        """(place in ``tokens``, place in the sequence, length) of the longest common run, the first of its length in
        either; length 0 if there is none."""
        state = n = 0
        best = (0, 0, 0)
        step, back, size, first = self.step, self.back, self.size, self.first
        for at, token in enumerate(tokens):
            while state and token not in step[state]:
                state = back[state]
                n = size[state]
            if token in step[state]:
                state = step[state][token]
                n += 1
            if n > best[2]:
                best = (at - n + 1, first[state] - n + 1, n)
        return best


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of each block, in order."""
    found, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        i, j, n = Runs(b[b0:b1]).longest_in(a[a0:a1])
        if n:
            i, j = a0 + i, b0 + j
            found.append((i, j, n))
            waiting += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return sorted(found)
