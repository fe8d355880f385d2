"""Randomness as a pure function of (seed, key).

``rand(seed)`` depends on how rows are laid out in partitions; a keyed hash
does not, so every random operator gives the same rows on any cluster and after
any task retry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, functions as F

HASH_BITS = 52  # 13 hex digits: exact in a double


def _as_column(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def keyed_hash(seed, *keys) -> Column:
    """A bigint in [0, 2^52) from md5('seed:key1:key2...')."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_as_column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def digest_numbers(texts: Iterable[bytes]) -> np.ndarray:
    """What ``keyed_hash`` makes of ``seed:key1:key2...``, for texts inside a task."""
    digests = b"".join([hashlib.md5(text, usedforsecurity=False).digest() for text in texts])
    return (np.frombuffer(digests, dtype=">u8")[::2] >> (64 - HASH_BITS)).astype(np.int64)


def keyed_uniform(seed, *keys) -> Column:
    """A double in [0, 1)."""
    return keyed_hash(seed, *keys) / F.lit(float(2**HASH_BITS))


def keyed_normal(seed, *keys) -> Column:
    """A standard normal draw (Box-Muller over two keyed uniforms)."""
    u1 = (keyed_hash(f"{seed}/a", *keys) + F.lit(1.0)) / F.lit(float(2**HASH_BITS))
    u2 = keyed_uniform(f"{seed}/b", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def keyed_integer(seed, low: int, high: int, *keys) -> Column:
    """A bigint in [low, high)."""
    return F.lit(low) + F.floor(keyed_uniform(seed, *keys) * F.lit(high - low))
