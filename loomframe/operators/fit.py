"""Distributed fit of linear and logistic models, one Spark aggregation per step.

Any number of configurations train together: a step computes the gradients of
all of them in the same pass over the batch, so a hyperparameter search reads
the data no more often than a single fit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.core.arrow import matrix
from loomframe.core.keyed import keyed_hash, keyed_integer, keyed_uniform
from loomframe.core.session import new_path, spread
from loomframe.operators.optimizers import Optimizer, sgd
from loomframe.operators.schedules import SCALAR, Schedule, fixed


@dataclass
class Config:
    """What one model trains with."""

    optimizer: Optimizer = field(default_factory=sgd)
    schedule: Schedule = field(default_factory=lambda: fixed(0.1))
    l2: float = 0.0


@dataclass
class Fit:
    """Weights (models x features) and the loss of every step and model."""

    weights: np.ndarray
    history: list[dict]
    loss: str

    def predict(self, df: DataFrame, features: str, model: int = 0, out: str = "prediction") -> DataFrame:
        w = self.weights[model]
        logistic = self.loss == "logistic"

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            z = matrix(x).reshape(len(x), len(w)) @ w
            return pa.array(1.0 / (1.0 + np.exp(-z)) if logistic else z)

        return df.withColumn(out, score(F.col(features)))


class Listener:
    """Training callbacks; override what is needed."""

    def on_begin(self, configs: Sequence[Config]) -> None: ...

    def on_batch(self, epoch: int, batch: int, losses: np.ndarray) -> None: ...

    def on_epoch(self, epoch: int, losses: np.ndarray) -> None: ...

    def on_end(self, fit: Fit) -> None: ...


def _losses_and_gradients(frame: DataFrame, weights: np.ndarray, loss: str):
    """(rows, loss sum per model, gradient sum per model and feature)."""
    models, width = weights.shape
    shipped = frame.sparkSession.sparkContext.broadcast(weights)

    def partial(batches):
        w = shipped.value
        n, losses, grads = 0, np.zeros(len(w)), np.zeros_like(w)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["_x"])
            y = batch["_y"].to_numpy(zero_copy_only=False)[:, None]
            z = x @ w.T
            if loss == "logistic":
                error = 1.0 / (1.0 + np.exp(-z)) - y
                losses += (np.maximum(z, 0.0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum(axis=0)
            else:
                error = z - y
                losses += 0.5 * (error * error).sum(axis=0)
            grads += error.T @ x
            n += batch.num_rows
        m, k = np.indices((len(w), w.shape[1] + 1))
        v = np.concatenate([losses[:, None], grads], axis=1)
        cells = [m.ravel().astype(np.int32), k.ravel().astype(np.int32), v.ravel(), np.full(v.size, n, dtype=np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["m", "k", "v", "n"])

    parts = frame.mapInArrow(partial, "m int, k int, v double, n bigint")
    total = np.zeros((models, width + 1))
    rows = 0
    # models x (features + 1) sums reach the driver
    for r in parts.groupBy("m", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
        total[r.m, r.k] = r.v
        rows = r.n
    return rows, total[:, 0], total[:, 1:]


def fit(
    df: DataFrame,
    features: Column,
    label: Column,
    width: int,
    configs: Sequence[Config] | None = None,
    loss: str = "squared",
    epochs: int = 10,
    batches: int = 1,
    seed=0,
    key: Sequence[str] = (),
    listeners: Sequence[Listener] = (),
) -> Fit:
    """Mini-batch training; a keyed hash deals the rows to ``batches``.

    The prepared rows are written once, one directory per batch, so a step reads
    only its own batch and no lineage grows over the steps.
    """
    configs = list(configs or [Config()])
    if batches > 1 and not key:
        raise ValueError("several batches need a key that deals the rows")
    batch = keyed_integer(seed, 0, batches, *key).cast("int") if batches > 1 else F.lit(0)
    path = new_path(df.sparkSession, "fit")
    prepared = df.select(features.cast("array<double>").alias("_x"), label.cast("double").alias("_y"), batch.alias("_batch"))
    spread(prepared).write.partitionBy("_batch").parquet(path)
    data = df.sparkSession.read.parquet(path)
    weights = np.zeros((len(configs), width))
    states = [{s: np.zeros(width) for s in c.optimizer.states} for c in configs]
    history: list[dict] = []
    for listener in listeners:
        listener.on_begin(configs)
    t = 0
    for epoch in range(epochs):
        epoch_losses = []
        for b in range(batches):
            t += 1
            rows, losses, grads = _losses_and_gradients(data.filter(F.col("_batch") == b).select("_x", "_y"), weights, loss)
            if not rows:
                continue
            mean = losses / rows
            epoch_losses.append(mean)
            for i, c in enumerate(configs):
                rate = float(c.schedule(np.float64(t - 1), SCALAR))
                g = grads[i] / rows + 2.0 * c.l2 * weights[i]
                weights[i], states[i] = c.optimizer.step(weights[i], g, states[i], t, rate)
                history.append({"model": i, "epoch": epoch, "step": t, "loss": float(mean[i])})
            for listener in listeners:
                listener.on_batch(epoch, b, mean)
        for listener in listeners:
            listener.on_epoch(epoch, np.mean(epoch_losses, axis=0))
    result = Fit(weights, history, loss)
    for listener in listeners:
        listener.on_end(result)
    return result


def validation_losses(df: DataFrame, features: Column, label: Column, model: Fit) -> np.ndarray:
    """Mean loss of every model over a table, in one pass."""
    frame = df.select(features.cast("array<double>").alias("_x"), label.cast("double").alias("_y"))
    rows, losses, _ = _losses_and_gradients(frame, model.weights, model.loss)
    return losses / rows


# hyperparameter search ---------------------------------------------------------------
def hp_bool(seed, *key) -> Column:
    return keyed_uniform(seed, *key) < 0.5


def hp_categorical(seed, values: Sequence, *key) -> Column:
    table = F.array(*[F.lit(v) for v in values])
    return F.get(table, F.pmod(keyed_hash(seed, *key), F.lit(len(values))).cast("int"))


def hp_int(seed, low: int, high: int, *key) -> Column:
    return keyed_integer(seed, low, high, *key).cast("bigint")


def hp_float(seed, low: float, high: float, *key, log: bool = False) -> Column:
    u = keyed_uniform(seed, *key)
    if not log:
        return F.lit(low) + u * (high - low)
    a, b = float(np.log(low)), float(np.log(high))
    return F.exp(F.lit(a) + u * (b - a))


def hpo_sample(df: DataFrame, space: dict, seed, key: Sequence[str]) -> DataFrame:
    """One random configuration per row of ``df``; nested dicts become structs.

    A leaf is ('bool',), ('categorical', values), ('int', low, high),
    ('float', low, high) or ('log_float', low, high).
    """

    def build(node, path: str) -> Column:
        if isinstance(node, dict):
            return F.struct(*[build(v, f"{path}/{k}").alias(k) for k, v in node.items()])
        kind, *args = node
        if kind == "bool":
            return hp_bool(path, *key)
        if kind == "categorical":
            return hp_categorical(path, args[0], *key)
        if kind == "int":
            return hp_int(path, args[0], args[1], *key)
        return hp_float(path, args[0], args[1], *key, log=kind == "log_float")

    return df.select(*key, *[build(v, f"{seed}/{k}").alias(k) for k, v in space.items()])


def best_config(results: DataFrame, config: Sequence[str], loss: str) -> DataFrame:
    """The worst loss of the repeats per configuration, then the lowest of those."""
    worst = results.groupBy(*config).agg(F.max(loss).alias("worst"))
    pick = F.min(F.struct("worst", *config)).alias("b")
    return worst.agg(pick).select(*[F.col(f"b.{c}").alias(c) for c in config], F.col("b.worst").alias("worst"))


def hpo_search(
    train: DataFrame,
    validate: DataFrame,
    features: Column,
    label: Column,
    width: int,
    configs: Sequence[Config],
    repeats: int = 1,
    make: Callable[..., Fit] = fit,
    **kw,
) -> tuple[DataFrame, Fit]:
    """Train all configurations (x repeats with other seeds), pick the best, retrain it."""
    rows = []
    for repeat in range(repeats):
        trained = make(train, features, label, width, configs, seed=f"{kw.get('seed', 0)}/{repeat}", **{k: v for k, v in kw.items() if k != "seed"})
        losses = validation_losses(validate, features, label, trained)
        rows += [(i, repeat, float(x)) for i, x in enumerate(losses)]
    results = train.sparkSession.createDataFrame(rows, "config int, repeat int, loss double")
    winner = best_config(results, ["config"], "loss").first().config
    return results, make(train, features, label, width, [configs[winner]], **kw)
