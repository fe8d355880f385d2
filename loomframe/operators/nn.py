"""Row-wise neural operators: normalisation, dropout, scoring, attention."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.core.arrow import matrix, vectors
from loomframe.core.keyed import keyed_uniform
from loomframe.core.order import group_rank
from loomframe.core.session import materialize


def softmax_rows(df: DataFrame, value: str, out: str) -> DataFrame:
    """Softmax down the rows (axis 0): two one-row aggregates, no join."""
    top = df.agg(F.max(value)).scalar()
    total = df.agg(F.sum(F.exp(F.col(value) - top))).scalar()
    return df.withColumn(out, F.exp(F.col(value) - top) / total)


def batch_norm(
    df: DataFrame,
    cols: Sequence[str],
    gamma: Sequence[float] | None = None,
    beta: Sequence[float] | None = None,
    eps: float = 1e-5,
    running: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """(x - mean) / sqrt(var + eps) * gamma + beta with batch or running statistics."""
    gamma = gamma or [1.0] * len(cols)
    beta = beta or [0.0] * len(cols)
    if running is None:
        stats = df.agg(
            F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.var_pop(c).alias(f"v_{c}") for c in cols])
        ).scalar()
        mean = {c: stats.getField(f"m_{c}") for c in cols}
        var = {c: stats.getField(f"v_{c}") for c in cols}
    else:
        mean = {c: F.lit(float(running[c][0])) for c in cols}
        var = {c: F.lit(float(running[c][1])) for c in cols}
    scaled = {
        c: (F.col(c) - mean[c]) / F.sqrt(var[c] + eps) * F.lit(float(g)) + F.lit(float(b))
        for c, g, b in zip(cols, gamma, beta)
    }
    return df.withColumns(scaled)


def dropout(v: Column, rate: float, seed, *keys, training: bool = True) -> Column:
    """Zero each element with probability ``rate`` and scale the rest."""
    if not training or rate == 0:
        return v
    keep = F.lit(1.0 / (1.0 - rate))
    return F.transform(
        v, lambda x, i: F.when(keyed_uniform(seed, *keys, i) < rate, F.lit(0.0)).otherwise(x * keep)
    )


def mlp_score(
    df: DataFrame, vector: str, layers: Sequence[tuple[np.ndarray, np.ndarray]], out: str, activation: str = "relu"
) -> DataFrame:
    """(linear, activation)* -> linear over a vector column, one product per batch and layer."""
    shipped = df.sparkSession.sparkContext.broadcast(
        [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64)) for w, b in layers]
    )
    squash = {"relu": lambda z: np.maximum(z, 0.0), "tanh": np.tanh, "sigmoid": lambda z: 1.0 / (1.0 + np.exp(-z))}[
        activation
    ]

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        weights = shipped.value
        h = matrix(x).reshape(len(x), weights[0][0].shape[1])
        for i, (w, b) in enumerate(weights):
            h = h @ w.T + b
            if i < len(weights) - 1:
                h = squash(h)
        return vectors(h)

    # a generator over the result would let the optimizer score once more in a filter
    return df.withColumn(out, score.asNondeterministic()(F.col(vector)))


# attention -----------------------------------------------------------------------------
#: Positions of a sequence that meet as one block.
ATTENTION_BLOCK = 128


def _block_state(q, k, v, ok, heads: int, first_q: int, first_k: int, causal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What one block of keys adds to one block of queries: greatest score, sum of weights, weighted sum, by head.

    Scores are relative to the greatest one; a query that sees no key has -inf and zeros.
    """
    n, m = len(q), len(k)
    qh, kh, vh = (x.reshape(len(x), heads, -1).transpose(1, 0, 2) for x in (q, k, v))
    scores = qh @ kh.transpose(0, 2, 1) / np.sqrt(qh.shape[2])
    seen = np.broadcast_to(ok, (n, m))
    if causal:
        seen = seen & (first_k + np.arange(m) <= (first_q + np.arange(n))[:, None])
    scores = np.where(seen, scores, -np.inf)
    top = scores.max(axis=2, initial=-np.inf)
    weights = np.where(seen, np.exp(scores - np.where(np.isfinite(top), top, 0.0)[..., None]), 0.0)
    return top, weights.sum(axis=2), weights @ vh


def _merge_states(a, b):
    """Two states of the same queries as one: both are rescaled to the greater of their greatest scores."""
    top = np.maximum(a[0], b[0])
    base = np.where(np.isfinite(top), top, 0.0)
    x, y = np.exp(a[0] - base), np.exp(b[0] - base)
    return top, a[1] * x + b[1] * y, a[2] * x[..., None] + b[2] * y[..., None]


_STATE = "_key string, sequence long, _b long, top array<double>, weight array<double>, total array<double>"


def _flushed(key, state) -> pa.RecordBatch:
    lists = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in state]
    cells = [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64())]
    return pa.RecordBatch.from_arrays([*cells, *lists], ["_key", "sequence", "_b", "top", "weight", "total"])


def _running(states: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Merge states of equal keys that follow each other; one state is held at a time."""
    key, held = None, None
    for at, state in states:
        if held is not None and at == key:
            held = _merge_states(held, state)
            continue
        if held is not None:
            yield _flushed(key, held)
        key, held = at, state
    if held is not None:
        yield _flushed(key, held)


def attention(
    df: DataFrame,
    group: Sequence[str],
    order_by: str,
    vector: str,
    length: int | None = None,
    causal: bool = False,
    heads: int = 1,
    valid: str | None = None,
    keys: str | None = None,
    values: str | None = None,
    block: int = ATTENTION_BLOCK,
) -> DataFrame:
    """softmax(Q K^T / sqrt(d)) V, head by head, over the sequence of each group.

    ``vector`` gives the queries, and the keys and values too unless ``keys`` and
    ``values`` name other columns; with several heads each takes its equal part of
    the components. With ``length`` the rows of a group are cut, in order, into
    sequences of so many. Keys whose ``valid`` is false or null are masked, and
    with ``causal`` those after the query; a query that sees no key gets zeros.

    Sequences are blocks of positions. Each pair of blocks gives a partial state
    (running maximum, rescaled sums), states merge in any order, and so a sequence
    of any length is never one row, array or task. Returns
    ``(group, sequence, order_by, attended)``.
    """
    group = list(group)
    wanted = {"q": vector, "k": keys or vector, "v": values or vector}
    rows = df.select(
        *group,
        order_by,
        *[F.col(c).cast("array<double>").alias(f"_{n}") for n, c in wanted.items()],
        (F.coalesce(F.col(valid).cast("boolean"), F.lit(False)) if valid else F.lit(True)).alias("_ok"),
    )
    ranked = group_rank(rows, group, order_by, "_p")
    sequence = F.floor(F.col("_p") / length) if length else F.lit(0)
    place = F.col("_p") % length if length else F.col("_p")
    packed = (
        ranked.withColumn("sequence", sequence.cast("long"))
        .withColumn("_at", place)
        .withColumn("_b", F.floor(F.col("_at") / block).cast("long"))
        .groupBy(*group, "sequence", "_b")
        .agg(F.array_sort(F.collect_list(F.struct("_at", F.col(order_by).alias("id"), "_q", "_k", "_v", "_ok"))).alias("_rows"))
    )
    # null groups are groups too: the key names them all
    blocks = materialize(packed.withColumn("_key", F.to_json(F.struct(*group)) if group else F.lit("")), "blocks")
    part = lambda name: F.transform("_rows", lambda r: r[name]).alias(name)
    last = blocks.groupBy("_key", "sequence").agg(F.max("_b").alias("_last"))
    upto = F.col("_b") if causal else F.col("_last")
    queries = blocks.select("_key", "sequence", "_b", part("_q")).join(last, ["_key", "sequence"])
    queries = queries.withColumn("_kb", F.explode(F.sequence(F.lit(0).cast("long"), upto))).drop("_last")
    pairs = queries.join(blocks.select("_key", "sequence", F.col("_b").alias("_kb"), part("_k"), part("_v"), part("_ok")), ["_key", "sequence", "_kb"])

    def cells(column, i) -> np.ndarray:
        nested = column[i].values
        return nested.flatten().to_numpy(zero_copy_only=False).reshape(len(nested), -1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states():
            for batch in batches:
                at = list(zip(*[batch.column(c).to_pylist() for c in ("_key", "sequence", "_b")]))
                other = batch.column("_kb").to_pylist()
                for i, key in enumerate(at):
                    q, k, v = (cells(batch.column(c), i) for c in ("_q", "_k", "_v"))
                    ok = batch.column("_ok")[i].values.to_numpy(zero_copy_only=False)
                    yield key, _block_state(q, k, v, ok, heads, key[2] * block, other[i] * block, causal)

        yield from _running(states())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states():
            for batch in batches:
                at = list(zip(*[batch.column(c).to_pylist() for c in ("_key", "sequence", "_b")]))
                for i, key in enumerate(at):
                    top, weight, total = (batch.column(c)[i].values.to_numpy() for c in ("top", "weight", "total"))
                    yield key, (top.reshape(heads, -1), weight.reshape(heads, -1), total.reshape(heads, len(top) // heads, -1))

        yield from _running(states())

    order = ["_key", "sequence", "_b"]
    states = pairs.mapInArrow(partial, _STATE).repartition(*order).sortWithinPartitions(*order).mapInArrow(merged, _STATE)
    # position i, head h, component c lies at (h * positions + i) * width + c of the weighted sums
    whole = blocks.select(*group, *order, "_rows").join(states, order)
    size, width = F.size("_rows"), F.size("total") / F.size("top")

    def attended(i):
        head = lambda h: F.transform(
            F.slice("total", ((h * size + i) * width + 1).cast("int"), width.cast("int")),
            lambda x: F.when(F.get("weight", (h * size + i).cast("int")) > 0, x / F.get("weight", (h * size + i).cast("int"))).otherwise(0.0),
        )
        return F.flatten(F.array(*[head(h) for h in range(heads)]))

    zipped = F.transform("_rows", lambda r, i: F.struct(r["id"].alias(order_by), attended(i).alias("attended")))
    return whole.select(*group, "sequence", F.inline(zipped))
