"""Learning-rate schedules: the value at update number n.

One formula per schedule serves a table column and a driver-side number: the
arithmetic goes through a small namespace, ``COLUMN`` or ``SCALAR``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

COLUMN = SimpleNamespace(
    minimum=lambda a, b: F.least(a, F.lit(b)),
    maximum=lambda a, b: F.greatest(a, F.lit(b)),
    power=lambda a, b: F.pow(F.lit(a) if isinstance(a, (int, float)) else a, F.lit(b) if isinstance(b, (int, float)) else b),
    cos=F.cos,
    sqrt=F.sqrt,
    where=lambda c, a, b: F.when(c, a).otherwise(b),
)
SCALAR = SimpleNamespace(
    minimum=np.minimum,
    maximum=np.maximum,
    power=np.power,
    cos=np.cos,
    sqrt=np.sqrt,
    where=np.where,
)

Schedule = Callable[..., object]


def fixed(value: float) -> Schedule:
    return lambda n, m=COLUMN: n * 0.0 + value


def factor(base: float, ratio: float, max_updates: int) -> Schedule:
    return lambda n, m=COLUMN: base * m.power(float(ratio), m.minimum(n, max_updates))


def linear(base: float, slope: float, max_updates: int) -> Schedule:
    return lambda n, m=COLUMN: base + m.minimum(n, max_updates) * slope


def cosine(base: float, final: float, max_updates: int) -> Schedule:
    def at(n, m=COLUMN):
        wave = final + (m.cos(n * (math.pi / max_updates)) + 1.0) * ((base - final) / 2.0)
        return m.where(n > max_updates, n * 0.0 + final, wave)

    return at


def polynomial(base: float, end: float, steps: int, power: float) -> Schedule:
    def at(n, m=COLUMN):
        done = m.maximum(m.minimum(n, steps), 0)
        return m.power(1.0 - done / float(steps), power) * (base - end) + end

    return at


def multifactor(base: float, ratio: float, steps: Sequence[int]) -> Schedule:
    """The ratio is applied once per step that n has passed."""

    def at(n, m=COLUMN):
        value = n * 0.0 + base
        for step in steps:
            value = value * m.where(n > step, n * 0.0 + ratio, n * 0.0 + 1.0)
        return value

    return at


def warmup(main: Schedule, steps: int, begin: float, final: float) -> Schedule:
    """A linear ramp, then the main schedule counted from its end."""

    def at(n, m=COLUMN):
        ramp = n * ((final - begin) / steps) + begin
        return m.where(n < steps, ramp, main(m.maximum(n - steps, 0), m))

    return at
