"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of bytes other than space and the five ASCII controls 0x09-0x0D,
with A-Z lower-cased; these bytes never occur inside a longer UTF-8 sequence, so
working on bytes is exact. A word's hash is a polynomial in its bytes, taken
from running sums over the buffer, so there is no Python step per word.
"""

from __future__ import annotations

import numpy as np

from loomframe.llm.common import mix, odd_constants, remembered

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Modulo 2^64; an odd number has an inverse.
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PIECE = 1 << 19
_STEP = odd_constants(64, 5)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _powers_of_piece() -> tuple[np.ndarray, np.ndarray]:
    return remembered("powers", lambda: (_powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE)))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end; no word crosses from one text into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per word, computed piece by piece so that memory stays bounded on long texts."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(int(np.searchsorted(ends, base + _PIECE, side="right")), at + 1)
        size = int(ends[upto - 1] - base)
        power, down = _powers_of_piece() if size <= _PIECE else (_powers(_BASE, size), _powers(_INVERSE, size))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data[base : base + size]]] * power[:size], out=sums[1:])
        a, b = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        at = upto
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the n + 1 offsets into them.

    A text with fewer than ``words`` words has its whole sequence as its one
    shingle; a text without words has none.
    """
    starts, ends = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    of = np.searchsorted(starts, offsets)
    full = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(full, np.uint64)
    for j in range(words):
        rolled += hashes[j : j + full] * _STEP[j]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= words:
            x = np.sort(rolled[a : b - words + 1])
            sets.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            short = np.uint64(0xA5A5 + b - a) + (hashes[a:b] * _STEP[words + 1 : words + 1 + b - a]).sum(dtype=np.uint64)
            sets.append(mix(np.array([short])))
        else:
            sets.append(hashes[:0])
    ends_of = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=ends_of[1:])
    return (np.concatenate(sets) if sets else rolled[:0]), ends_of


def set_keys(members: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set, equal for equal sets, as two unsigned longs."""
    sizes = np.diff(offsets)
    keys = []
    for salt in (0x51ED27, 0xB7E151):
        sums = np.zeros(len(members) + 1, np.uint64)
        np.cumsum(mix(members ^ np.uint64(salt)), out=sums[1:])
        keys.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype(np.uint64)))
    return keys[0], keys[1]
