"""Generalised suffix automaton over word sequences, and matching statistics against it.

The automaton accepts every run of words that stands in one of its sequences.  A text is streamed
through it: after each word the state and the length of the longest run of words that ends there and
stands in some sequence are known.  Before streaming, numpy drops the words that cannot matter: a run
of matching words needs each of its words and each of its neighbouring pairs to occur in a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from popweave.llm.text import Words, words_of


class Automaton:
    """States by number, 0 the start: ``next`` transitions, ``link`` suffix link, ``length`` longest run."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for sequence in sequences:
            last = 0
            for token in sequence:
                last = self._extend(last, token)

    def _new(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """The state for the runs of ``q`` that end an arc from ``p``; made by copying if need be."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, self.next[last][token], token)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.next[p][token], token)
        return state

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """State and matched length after one more word."""
        arcs = self.next
        while state and token not in arcs[state]:
            state = self.link[state]
            length = self.length[state]
        target = arcs[state].get(token)
        return (0, 0) if target is None else (target, length + 1)

    def walk(self, tokens: Sequence[int]) -> Iterator[tuple[int, int]]:
        state = length = 0
        for token in tokens:
            state, length = self.step(state, length, token)
            yield state, length

    def ancestor(self, state: int, length: int) -> int:
        """The state that holds the last ``length`` words of a run at ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Lexicon:
    """Numbers for the words of a few texts, and a filter for the words of many."""

    def __init__(self, texts: Sequence[str], table: np.ndarray):
        w = words_of(list(texts), table)
        self.table = table
        self.hashes = np.unique(w.hash)
        ids = np.searchsorted(self.hashes, w.hash)
        self.sequences = [ids[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
        pairs = [np.asarray(s[:-1], np.int64) * len(self.hashes) + np.asarray(s[1:], np.int64) for s in self.sequences if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def ids(self, words: Words) -> np.ndarray:
        """The number of each word, or -1."""
        out = np.full(len(words.hash), -1, dtype=np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.seen[(words.hash & np.uint64(0xFFFF)).astype(np.int64)])
            h = words.hash[maybe]
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[k] == h
            out[maybe[same]] = k[same]
        return out

    def runs(self, words: Words, ids: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Maximal ranges of at least ``least`` words inside one text that could all match together."""
        known = ids >= 0
        n = len(ids)
        if not n or not known.any():
            return []
        joined = np.zeros(n + 1, dtype=bool)  # word i goes on the run of word i - 1
        both = np.flatnonzero(known[1:] & known[:-1])
        pair = ids[both] * len(self.hashes) + ids[both + 1]
        if len(self.pairs):
            k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[k] == pair] + 1] = True
        joined[words.first] = False
        start = np.flatnonzero(known & ~joined[:n])
        end = np.flatnonzero(known & ~joined[1:]) + 1
        long = end - start >= least
        return list(zip(start[long].tolist(), end[long].tolist()))
