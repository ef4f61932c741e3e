"""Hashes of words and word runs, computed over whole buffers of texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD6E8FEB86659FD93)


@cache
def _powers(base: int, log_size: int) -> np.ndarray:
    out = np.full(1 << log_size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return (h ^ (h >> np.uint64(29))) * _Q


@cache
def _classes() -> np.ndarray:
    """Every byte as words use it: A-Z lower-cased, ASCII that is no letter or digit as 0, other bytes as they are."""
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 0
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word: a longest run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    folded = _classes()[data]
    inside = np.concatenate([[False], folded != 0, [False]])
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    start[edge] |= inside[1:-1][edge]  # a word does not run on into the next text
    end[edge - 1] |= inside[1:-1][edge - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    size = max(1, len(data)).bit_length()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(folded.astype(np.uint64) * _powers(_P, size)[: len(data)], out=sums[1:])
    hashed = (sums[end] - sums[start]) * _powers(_P_INVERSE, size)[start]
    return row, start, end, _mix(hashed + (end - start).astype(np.uint64))


def runs(row: np.ndarray, hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``n`` words of one text."""
    if len(row) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(len(row) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_P) + hashed[k : len(row) - n + 1 + k]
    first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    return first, _mix(total[first])
