"""Ragged lookups for tokenizers: distinct pieces of text are encoded once per worker, and remembered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Pieces that a worker remembers before it starts afresh.
REMEMBERED = 500_000


class PieceCache:
    """What ``encode`` made of each distinct piece seen lately; ``encode`` takes a list and returns a list."""

    def __init__(self, encode: Callable[[list], list], limit: int = REMEMBERED):
        self._encode, self._limit, self._seen = encode, limit, {}

    def __call__(self, pieces: list) -> list:
        seen = self._seen
        missing = [p for p in pieces if p not in seen]
        if missing:
            if len(seen) + len(missing) > self._limit:
                seen.clear()
                missing = pieces
            made = dict(zip(missing, self._encode(missing)))
            if len(made) <= self._limit:
                seen.update(made)
            else:
                return [made[p] for p in pieces]
        return [seen[p] for p in pieces]


def ragged(rows: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows of packed numbers end to end, and their n + 1 offsets."""
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)), out=offsets[1:])
    return np.frombuffer(b"".join(rows), dtype), offsets // np.dtype(dtype).itemsize


def gather(values: np.ndarray, offsets: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked rows of a ragged array end to end, and the offsets of each."""
    lengths = (offsets[1:] - offsets[:-1])[picked]
    out = np.zeros(len(picked) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1][picked], lengths)
    return values[at], out
