"""Arrow/numpy helpers for whole-text kernels that run inside Spark tasks.

Words are the runs matching ``[^\\x20\\x09-\\x0D]+`` (UTF-8 never uses those
bytes inside a character, so splitting the raw bytes is exact). Every word
gets a 64-bit hash computed from the column's own buffer; nothing is done
per word in Python. Work is cut into pieces of about ``PIECE`` bytes of text,
so a task holds one Arrow batch and one piece of temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64 finaliser over a uint64 array; ``seed`` selects the function."""
    x = x + U((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each (a longer text is a range of its own)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (n_rows + 1 entries)."""
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word; ``lower`` folds A-Z only."""
    table, out, at = (_BYTE_LOWER if lower else _BYTE), np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + PIECE, side="right")), at + 1)
        lo, hi = int(starts[at]), int(ends[to - 1])
        powers, inverse = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(table[raw[lo:hi]] * powers[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * U(0xA24BAED4963EE407))
        at = to
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` consecutive words from each position (len(words) - width + 1 values)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = mix(words[:n], 1)
    for k in range(1, width):
        acc = acc * U(0x2545F4914F6CDD1D) + mix(words[k : n + k], 1)
    return mix(acc, width + 100)


def binary(arrays: list[np.ndarray]) -> pa.Array:
    """A binary column from numpy arrays."""
    return pa.array([a.tobytes() for a in arrays], pa.binary())
