"""Optimizer update rules over a parameter table or driver-side weights.

``update_table`` applies a rule as column expressions to rows
(parameter, position, w, g, state…), which scales to any number of parameters;
``fit`` applies the same rule to the small weight vector it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomframe.operators.schedules import COLUMN, SCALAR


@dataclass(frozen=True)
class Optimizer:
    """A rule with its constants; ``states`` are zero before the first update."""

    name: str
    states: tuple[str, ...] = ()
    weight_decay: float = 0.0
    rescale: float = 1.0
    clip: float = 0.0
    momentum: float = 0.0
    beta1: float = 0.9
    beta2: float = 0.999
    rho: float = 0.9
    epsilon: float = 1e-8
    centered: bool = False

    def _gradient(self, w, g, m):
        g = g * self.rescale
        if self.clip > 0:
            g = m.maximum(m.minimum(g, self.clip), -self.clip)
        return g + w * self.weight_decay

    def step(self, w, g, state: dict, t, lr, m=SCALAR):
        """(new weight, new state) for the t-th update (from 1) at rate ``lr``."""
        g = self._gradient(w, g, m)
        if self.name == "sgd":
            return w - g * lr, {}
        if self.name == "momentum":
            v = state["v"] * self.momentum - g * lr
            return w + v, {"v": v}
        if self.name == "nag":
            v = state["v"] * self.momentum + g
            return w - (g + v * self.momentum) * lr, {"v": v}
        if self.name == "adam":
            mean = state["m"] * self.beta1 + g * (1.0 - self.beta1)
            var = state["v"] * self.beta2 + g * g * (1.0 - self.beta2)
            rate = lr * m.sqrt(1.0 - m.power(float(self.beta2), t)) / (1.0 - m.power(float(self.beta1), t))
            return w - rate * mean / (m.sqrt(var) + self.epsilon), {"m": mean, "v": var}
        if self.name == "adagrad":
            h = state["h"] + g * g
            return w - g * lr / m.sqrt(h + self.epsilon), {"h": h}
        if self.name == "rmsprop":
            n = state["n"] * self.rho + g * g * (1.0 - self.rho)
            if not self.centered:
                return w - g * lr / m.sqrt(n + self.epsilon), {"n": n}
            a = state["a"] * self.rho + g * (1.0 - self.rho)
            d = state["d"] * self.momentum - g * lr / m.sqrt(n - a * a + self.epsilon)
            return w + d, {"n": n, "a": a, "d": d}
        if self.name == "adadelta":
            s = state["s"] * self.rho + g * g * (1.0 - self.rho)
            move = m.sqrt(state["d"] + self.epsilon) / m.sqrt(s + self.epsilon) * g
            d = state["d"] * self.rho + move * move * (1.0 - self.rho)
            return w - move, {"s": s, "d": d}
        raise ValueError(f"unknown optimizer {self.name!r}")


def sgd(**kw) -> Optimizer:
    return Optimizer("sgd", **kw)


def momentum(momentum: float = 0.9, **kw) -> Optimizer:
    return Optimizer("momentum", ("v",), momentum=momentum, **kw)


def nag(momentum: float = 0.9, **kw) -> Optimizer:
    return Optimizer("nag", ("v",), momentum=momentum, **kw)


def adam(**kw) -> Optimizer:
    return Optimizer("adam", ("m", "v"), **kw)


def adagrad(**kw) -> Optimizer:
    return Optimizer("adagrad", ("h",), **kw)


def rmsprop(centered: bool = True, momentum: float = 0.9, **kw) -> Optimizer:
    states = ("n", "a", "d") if centered else ("n",)
    return Optimizer("rmsprop", states, centered=centered, momentum=momentum, **kw)


def adadelta(**kw) -> Optimizer:
    return Optimizer("adadelta", ("s", "d"), **kw)


def update_table(df: DataFrame, optimizer: Optimizer, lr: float, t: int = 1, w: str = "w", g: str = "g") -> DataFrame:
    """One update of every row; the state columns are named as in ``states``."""
    state = {s: F.col(s) for s in optimizer.states}
    new_w, new_state = optimizer.step(F.col(w), F.col(g), state, F.lit(t), F.lit(float(lr)), COLUMN)
    return df.withColumns({w: new_w, **new_state})


def average_parameters(df: DataFrame, keys: list[str], value: str = "w") -> DataFrame:
    """One model from the models of all workers."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def check_gradients(df: DataFrame, parameter: str, g: str = "g") -> DataFrame:
    """(parameter, total, all_zero): a parameter whose gradients sum to zero did not train."""
    return df.groupBy(parameter).agg(F.sum(F.abs(g)).alias("total")).withColumn("all_zero", F.col("total") == 0)
