"""Word and byte helpers that work on a whole Arrow batch of texts at once.

Texts reach the Python side as Arrow string arrays, whose buffers already hold all bytes of a batch
in a row.  Everything here works on those buffers, in slices of bounded size, so that memory follows
the slice and the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20
#: Texts handled at once.
SLICE_ROWS = 1 << 16
#: Bytes whose word hashes are computed at once.
HASH_BYTES = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (a bijection)."""
    x = np.array(x, dtype=_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _outside(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for a, b in ranges:
        t[a:b + 1] = False
    return t


LOWER = _lower_table()
#: Bytes of words that end at space, tab and line ends (after lower-casing).
SPACED = _outside((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of letters, digits and everything beyond ASCII (capitals are lower-cased first).
ALNUM = _outside((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_CODES = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))[LOWER]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, HASH_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            t = np.full(size, base, dtype=_U)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and the null mask of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    nulls = np.asarray(column.is_null())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), nulls
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets, nulls


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``SLICE_ROWS`` rows each; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j), i + SLICE_ROWS)
        yield i, j
        i = j


class Words:
    """The words of a slice of texts.

    ``hash``: 64-bit hash of each lower-cased word; ``start``, ``end``: its bytes in ``data``;
    ``first``: for each text the index of its first word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        base = int(offsets[0])
        data = data[base:int(offsets[-1])]
        offsets = offsets - base
        n = len(data)
        inside = table[data]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside
        after = np.zeros(n + 1, dtype=bool)
        after[:n] = inside
        cut = before.copy()
        cut[offsets] = False
        start = np.flatnonzero(after & ~cut)
        cut = after.copy()
        cut[offsets] = False
        end = np.flatnonzero(before & ~cut)
        self.data, self.start, self.end = data, start, end
        self.first = np.searchsorted(start, offsets)
        self.hash = self._hash(data, start, end)

    @staticmethod
    def _hash(data, start, end):
        out = np.empty(len(start), dtype=_U)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + HASH_BYTES, side="right")))
            lo, hi = int(start[i]), int(end[j - 1])
            power, inverse = _power_tables(hi - lo)
            sums = np.empty(hi - lo + 1, dtype=_U)
            sums[0] = 0
            np.cumsum(_CODES[data[lo:hi]] * power[:hi - lo], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U))
            i = j
        return out

    def text(self, k: int) -> str:
        """The k-th word, lower-cased."""
        return LOWER[self.data[self.start[k]:self.end[k]]].tobytes().decode("utf-8", "replace")


def words_of(texts: list[str], table: np.ndarray) -> Words:
    """The words of a few texts."""
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, table)


def lower_ascii(text: str | None) -> str:
    """``text`` with A-Z lower-cased and nothing else changed."""
    return (text or "").translate(_ASCII_CAPITALS)


_ASCII_CAPITALS = {c: c + 32 for c in range(65, 91)}
