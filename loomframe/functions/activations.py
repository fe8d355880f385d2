"""Activation functions, softmax and row-wise neural expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# fixed values: self-normalising activation constants
SELU_ALPHA = 1.6732632423543772
SELU_SCALE = 1.0507009873554805


def relu(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return relu(x) + F.log1p(F.exp(-F.abs(x)))


def softsign(x: Column) -> Column:
    return x / (F.lit(1.0) + F.abs(x))


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * F.lit(alpha))


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x) * F.lit(alpha))


def selu(x: Column) -> Column:
    return F.lit(SELU_SCALE) * F.when(x > 0, x).otherwise(F.expm1(x) * F.lit(SELU_ALPHA))


def gelu(x: Column) -> Column:
    """The tanh form of x * Phi(x)."""
    inner = F.lit(0.7978845608028654) * (x + F.lit(0.044715) * x * x * x)
    return F.lit(0.5) * x * (F.lit(1.0) + F.tanh(inner))


def swish(x: Column, beta: float = 1.0) -> Column:
    return x * sigmoid(x * F.lit(beta))


def mish(x: Column) -> Column:
    """x * tanh(log(1 + e^x)), natural logarithm."""
    return x * F.tanh(softplus(x))


def prelu(x: Column, alpha: Column) -> Column:
    """Leaky form with a learned slope, one per channel."""
    return F.when(x > 0, x).otherwise(x * alpha)


# over a vector column -------------------------------------------------------
def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def _shifted(v: Column) -> Column:
    # array_max evaluated once per row, not once per element
    return F.transform(F.array(F.array_max(v)), lambda m: F.transform(v, lambda x: x - m))[0]


def softmax(v: Column) -> Column:
    e = F.transform(_shifted(v), lambda x: F.exp(x))
    return F.transform(
        F.array(e), lambda w: F.transform(F.array(array_sum(w)), lambda s: F.transform(w, lambda x: x / s))[0]
    )[0]


def log_softmax(v: Column) -> Column:
    return F.transform(
        F.array(_shifted(v)),
        lambda w: F.transform(
            F.array(F.log(array_sum(F.transform(w, lambda x: F.exp(x))))),
            lambda s: F.transform(w, lambda x: x - s),
        )[0],
    )[0]


def linear(v: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """v . W^T + b for a small literal weight matrix (one row per output)."""
    outputs = []
    for i, row in enumerate(weights):
        w = F.array(*[F.lit(float(x)) for x in row])
        dot = F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        outputs.append(dot + F.lit(float(bias[i])) if bias is not None else dot)
    return F.array(*outputs)
