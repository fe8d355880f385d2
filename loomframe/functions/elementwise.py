"""Element-wise math as native column expressions.

Every function takes and returns a scalar ``Column``. ``over_array`` and
``over_arrays`` lift it to ``array`` columns, so one definition serves a column
(one element per row) and a vector (one array per row). Division and logarithms
follow IEEE arithmetic (infinities and NaN) and not Spark's ANSI errors or NULLs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

INF = float("inf")
NAN = float("nan")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def over_array(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    # one-argument lambda: transform would pass the position to a second parameter
    return lambda v: F.transform(v, lambda x: fn(x))


def over_arrays(fn: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.zip_with(a, b, lambda x, y: fn(x, y))


# arithmetic -----------------------------------------------------------------
def add(a, b, *more) -> Column:
    total = _c(a) + _c(b)
    for x in more:
        total = total + _c(x)
    return total


def sub(a, b) -> Column:
    return _c(a) - _c(b)


def mul(a, b, *more) -> Column:
    total = _c(a) * _c(b)
    for x in more:
        total = total * _c(x)
    return total


def div(a, b) -> Column:
    a, b = _c(a).cast("double"), _c(b).cast("double")
    # comparisons do not see the sign of a zero, its text does
    same = (a > 0) == (b.cast("string") != "-0.0")
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(same, F.lit(INF)).when(~same, F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def mod(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b))


def power(a, b) -> Column:
    return F.pow(_c(a), _c(b))


def maximum(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def minimum(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def neg(x) -> Column:
    return -_c(x)


def absolute(x) -> Column:
    return F.abs(x)


def sign(x) -> Column:
    return F.signum(x)


def square(x) -> Column:
    return _c(x) * _c(x)


def sqrt(x) -> Column:
    return F.sqrt(x)


def cbrt(x) -> Column:
    return F.cbrt(x)


# rounding -------------------------------------------------------------------
def _whole(x, rounded: Column) -> Column:
    """Doubles of 2^53 and more, infinities and NaN are whole already and would not fit a bigint."""
    x = _c(x).cast("double")
    return F.when(F.abs(x) < float(2**53), rounded.cast("double")).otherwise(x)


def floor(x) -> Column:
    return _whole(x, F.floor(x))


def ceil(x) -> Column:
    return _whole(x, F.ceil(x))


def round_half_even(x) -> Column:
    return F.rint(x)


def trunc(x) -> Column:
    return _whole(x, F.when(_c(x) < 0, F.ceil(x)).otherwise(F.floor(x)))


# exponentials ---------------------------------------------------------------
def exp(x) -> Column:
    return F.exp(x)


def _guarded_log(log: Callable[[Column], Column], x) -> Column:
    x = _c(x)
    return (
        F.when(x > 0, log(x))
        .when(x == 0, F.lit(-INF))
        .when(x.isNull(), F.lit(None).cast("double"))
        .otherwise(F.lit(NAN))
    )


def ln(x) -> Column:
    return _guarded_log(F.log, x)


def log10(x) -> Column:
    return _guarded_log(F.log10, x)


def log2(x) -> Column:
    return _guarded_log(F.log2, x)


# trigonometry ---------------------------------------------------------------
sin, cos, tan = F.sin, F.cos, F.tan
asin, acos, atan = F.asin, F.acos, F.atan
sinh, cosh, tanh = F.sinh, F.cosh, F.tanh
asinh, acosh, atanh = F.asinh, F.acosh, F.atanh
degrees, radians = F.degrees, F.radians


def clip(x, low, high) -> Column:
    return minimum(maximum(x, low), high)


def is_nan(x) -> Column:
    return F.isnan(x)


def is_inf(x) -> Column:
    return F.abs(_c(x)) == F.lit(INF)


# comparison and logic -------------------------------------------------------
def eq(a, b) -> Column:
    return _c(a) == _c(b)


def neq(a, b) -> Column:
    return _c(a) != _c(b)


def gt(a, b) -> Column:
    return _c(a) > _c(b)


def gte(a, b) -> Column:
    return _c(a) >= _c(b)


def lt(a, b) -> Column:
    return _c(a) < _c(b)


def lte(a, b) -> Column:
    return _c(a) <= _c(b)


def truthy(x) -> Column:
    """Non-zero is true."""
    return _c(x) != 0


def logical_and(a, b) -> Column:
    return truthy(a) & truthy(b)


def logical_or(a, b) -> Column:
    return truthy(a) | truthy(b)


def logical_xor(a, b) -> Column:
    return truthy(a) != truthy(b)


def logical_not(a) -> Column:
    return ~truthy(a)


def where_select(condition, a, b) -> Column:
    return F.when(truthy(condition), _c(a)).otherwise(_c(b))


# inverse error function -----------------------------------------------------
def erfinv(x: Column) -> Column:
    """Inverse error function, in Arrow batches (Spark has neither it nor erf).

    A logarithmic first guess (Winitzki 2008), then Newton steps.
    """

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        v = column.to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.full(v.shape, np.nan)
        inside = np.abs(v) < 1.0
        z = v[inside]
        a = 0.147
        log = np.log1p(-z * z)
        t = 2.0 / (np.pi * a) + log / 2.0
        y = np.sign(z) * np.sqrt(np.sqrt(t * t - log / a) - t)
        erf = np.frompyfunc(math.erf, 1, 1)
        for _ in range(3):
            y = y - (erf(y).astype(np.float64) - z) * (np.sqrt(np.pi) / 2.0) * np.exp(y * y)
        out[inside] = y
        out[v == 1.0], out[v == -1.0] = INF, -INF
        return pa.array(out, mask=np.asarray(column.is_null()))

    return run(_c(x).cast("double"))
