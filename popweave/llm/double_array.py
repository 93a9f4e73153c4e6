"""A double-array trie over dense symbol ids, built level by level in numpy."""

from __future__ import annotations

import numpy as np

#: Places tried for a node's children before they go to the end of the arrays.
TRIES = 64


class DoubleArray:
    """States are places: child = BASE[state] + symbol, and CHECK[child] = state.

    State 0 is the top.  BASE may be negative; CHECK alone tells whether a child exists.
    """

    def __init__(self):
        self.base = np.zeros(1024, dtype=np.int64)
        self.check = np.full(1024, -1, dtype=np.int64)
        self.check[0] = 0
        self.end = 1  # no state at or beyond
        self.hint = 1  # no free place before

    def _room(self, end: int) -> None:
        if end > len(self.base):
            more = max(end, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """Up to n free places before the end."""
        gaps = np.flatnonzero(self.check[self.hint:self.end] < 0)[:n] + self.hint
        if len(gaps) < n:
            self.hint = self.end
        elif n:
            self.hint = int(gaps[0])
        return gaps

    def _family(self, parent: int, symbols: np.ndarray) -> None:
        """Places several children of one state."""
        hint = self.hint
        for place in self._free(TRIES):
            base = int(place - symbols[0])
            last = int(base + symbols[-1])
            if last < self.end and (self.check[base + symbols] < 0).all():
                break
        else:
            base = int(self.end - symbols[0])
            self.end = int(base + symbols[-1]) + 1
            self._room(self.end)
        self.hint = min(hint, self.hint)
        self.base[parent] = base
        self.check[base + symbols] = parent

    def add(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Adds all children of the given states at once; a state gets its children in one call only."""
        pairs = np.unique(np.stack([parents, symbols], axis=1), axis=0)
        owner, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        for k in np.flatnonzero(count > 1):
            self._family(int(owner[k]), pairs[first[k]:first[k] + count[k], 1])
        single = first[count == 1]
        at = self._free(len(single))
        if len(at) < len(single):
            new = np.arange(self.end, self.end + len(single) - len(at))
            self.end += len(new)
            self._room(self.end)
            at = np.concatenate([at, new])
        self.base[pairs[single, 0]] = at - pairs[single, 1]
        self.check[at] = pairs[single, 0]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of states by symbols; -1 where there is none."""
        at = self.base[states] + symbols
        known = (at > 0) & (at < self.end)
        known[known] = self.check[at[known]] == states[known]
        return np.where(known, at, -1)
