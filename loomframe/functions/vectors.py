"""Expressions on one ``array`` column: the axis-1 side of the array operators.

Positions are 0-based as in n-d array libraries, ties go to the lowest index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from loomframe.functions.activations import array_sum


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def doubles(v) -> Column:
    """Vectors are stored as float and computed in double."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return array_sum(v)


def product(v: Column) -> Column:
    return F.aggregate(v, F.lit(1.0), lambda acc, x: acc * x)


def mean(v: Column) -> Column:
    return array_sum(v) / F.size(v)


def norm(v: Column, order: float = 2.0) -> Column:
    if order == 2.0:
        return F.sqrt(array_sum(F.transform(v, lambda x: x * x)))
    if order == 1.0:
        return array_sum(F.transform(v, lambda x: F.abs(x)))
    if order == float("inf"):
        return F.array_max(F.transform(v, lambda x: F.abs(x)))
    powered = F.transform(v, lambda x: F.pow(F.abs(x), F.lit(order)))
    return F.pow(array_sum(powered), F.lit(1.0 / order))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def argmin(v: Column) -> Column:
    return F.array_position(v, F.array_min(v)) - 1


def percentile(v: Column, p: float) -> Column:
    """Linear interpolation between the two nearest ranks."""
    ordered = F.array_sort(v)
    at = (F.size(v) - 1) * F.lit(float(p))
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    lo, hi = F.get(ordered, low), F.get(ordered, high)
    return lo + (hi - lo) * (at - low)


def median(v: Column) -> Column:
    return percentile(v, 0.5)


def all_true(v: Column) -> Column:
    return F.forall(v, lambda x: x != 0)


def any_true(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def none_true(v: Column) -> Column:
    return ~any_true(v)


def count_nonzero(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x != 0)).cast("bigint")


def cumsum(v: Column) -> Column:
    """Running sum in one pass over the array."""
    seed = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(
        v,
        seed,
        lambda acc, x: F.struct(
            (acc["s"] + x).alias("s"), F.array_append(acc["out"], acc["s"] + x).alias("out")
        ),
        lambda acc: acc["out"],
    )


def argsort(v: Column, ascending: bool = True) -> Column:
    """Positions in sorted order, int64, lowest position first among equals."""
    sign = 1 if ascending else -1
    pairs = F.transform(v, lambda x, i: F.struct((x * sign).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"].cast("bigint"))


def mask(v: Column, keep) -> Column:
    """Elements for which ``keep(value, position)`` is true."""
    return F.filter(v, keep)


def slice_range(v: Column, start: int, stop: int | None = None, step: int = 1) -> Column:
    """Python slice semantics, negative bounds included."""
    n = F.size(v)

    def bound(b, default):
        if b is None:
            return default
        return F.lit(b) if b >= 0 else F.greatest(n + F.lit(b), F.lit(0))

    lo, hi = bound(start, F.lit(0)), bound(stop, n)
    if step > 0:
        return F.filter(v, lambda x, i: (i >= lo) & (i < hi) & (F.pmod(i - lo, F.lit(step)) == 0))
    if start is None and stop is None:
        reversed_v = F.reverse(v)
        return F.filter(reversed_v, lambda x, i: F.pmod(i, F.lit(-step)) == 0)
    raise ValueError("a negative step needs open bounds")


def pick(v: Column, position: Column) -> Column:
    """The element at a per-row position."""
    return F.get(v, position.cast("int"))


def one_hot(index: Column, depth: int, on: float = 1.0, off: float = 0.0) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(depth - 1)),
        lambda i: F.when(i == index, F.lit(on)).otherwise(F.lit(off)),
    )


def sequence_mask(v: Column, valid: Column, value: float = 0.0) -> Column:
    return F.transform(v, lambda x, i: F.when(i < valid, x).otherwise(F.lit(value)))


def pad_to(v: Column, width: Column, value) -> Column:
    missing = F.greatest(width - F.size(v), F.lit(0)).cast("int")
    return F.concat(v, F.array_repeat(value if isinstance(value, Column) else F.lit(value), missing))


def repeat_each(v: Column, times: int) -> Column:
    return F.flatten(F.transform(v, lambda x: F.array_repeat(x, times)))


def tile(v: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(v, times))


def fingerprint(v: Column) -> Column:
    """Position-weighted sum: one number that changes when values or order do."""
    weighted = F.transform(v, lambda x, i: x.cast("double") * (i + 1))
    return array_sum(weighted)


def distinct_keep_last(v: Column) -> Column:
    """One struct(key, value) per key, the last one wins."""
    return F.filter(
        v,
        lambda p, i: ~F.exists(F.slice(v, i + 2, F.greatest(F.size(v) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]),
    )
