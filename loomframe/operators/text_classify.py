"""Supervised text classification: a linear model over hashed word and character n-grams.

Features are counted by Spark expressions and hashed into a fixed number of
buckets, so the model's size is a parameter: buckets x outputs numbers. Training
writes the featurized rows once, a folder per mini-batch. A step is one
aggregation: tasks turn their rows' errors into sparse gradient cells, Spark
sums the cells of a step, and only cells that a row touched reach the driver.

Losses: ``softmax``; ``ova``, one logistic unit per label; ``hs``, hierarchical
softmax, a logistic unit per inner node of the labels' Huffman tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomframe.core.keyed import keyed_integer
from loomframe.core.session import new_path, spread
from loomframe.functions.vectors import let
from loomframe.operators.optimizers import Optimizer, sgd
from loomframe.operators.topk import topk

#: A model is broadcast at each step; a larger one needs fewer buckets.
MAX_MODEL_BYTES = 256 << 20
#: Features that a task spreads into arrays of their own at a time; a longer single row is one slice.
SLICE_FEATURES = 1 << 18
LOSSES = ("softmax", "ova", "hs")


@dataclass(frozen=True)
class Options:
    """Words of fewer than ``min_count`` occurrences and labels of fewer than ``min_label_count`` rows are left out.

    A feature below ``min_count`` is dropped by its bucket. ``word_ngrams`` is the
    longest word n-gram; characters ``min_char`` to ``max_char`` long (0: none) come from
    each word between the marks < and >. The rate falls linearly to zero over the
    steps and is set anew after every ``rate_update`` of them.
    """

    epochs: int = 5
    batches: int = 1
    learning_rate: float = 0.1
    rate_update: int = 1
    min_count: int = 1
    min_label_count: int = 0
    word_ngrams: int = 1
    min_char: int = 0
    max_char: int = 0
    buckets: int = 1 << 18
    label_prefix: str = "__label__"
    loss: str = "softmax"
    optimizer: Optimizer = field(default_factory=sgd)
    seed: int = 0

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"loss must be one of {LOSSES}")


def bucket_of(gram: Column, buckets: int) -> Column:
    """A feature's bucket: the first eight digits of its MD5, modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _word_grams(tokens: Column, n: int) -> Column:
    joined = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))


def _char_grams(word: Column, n: int) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))
    return F.when(F.length(word) >= n, cut).otherwise(F.array().cast("array<string>"))


def grams(tokens: Column, options: Options) -> Column:
    """All features of a token list, with repeats: words, word n-grams, character n-grams."""

    def collected(t: Column) -> Column:
        parts = [t, *[_word_grams(t, n) for n in range(2, options.word_ngrams + 1)]]
        if options.max_char:
            lengths = range(max(options.min_char, 1), options.max_char + 1)
            marked = F.transform(t, lambda w: F.concat(F.lit("<"), w, F.lit(">")))
            parts.append(F.flatten(F.transform(marked, lambda w: F.flatten(F.array(*[_char_grams(w, n) for n in lengths])))))
        return F.flatten(F.array(*parts)) if len(parts) > 1 else t

    return let(tokens, collected)


def features(tokens: Column, options: Options) -> Column:
    """``array<int>``: the bucket of every feature; empty for a null token list."""
    hashed = F.transform(grams(tokens, options), lambda g: bucket_of(g, options.buckets))
    return F.coalesce(hashed, F.array().cast("array<int>"))


@dataclass(frozen=True)
class LabelTree:
    """A Huffman tree over labels: the inner nodes and turns on each label's way from the root."""

    nodes: list[list[int]]
    turns: list[list[int]]  # 1: to the second child

    @classmethod
    def huffman(cls, counts: Sequence[int]) -> LabelTree:
        """Rare labels lie deep; of equal counts the lower number is merged first."""
        k = len(counts)
        heap = [(c, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        made = k
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[made] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], made, made))
            made += 1
        nodes: list[list[int]] = [[] for _ in range(k)]
        turns: list[list[int]] = [[] for _ in range(k)]
        open_ = [(made - 1, [], [])] if k else []
        while open_:
            at, way, turned = open_.pop()
            if at < k:
                nodes[at], turns[at] = way, turned
                continue
            for turn, child in enumerate(children[at]):
                # inner nodes are numbered from 0 for the root
                open_.append((child, [*way, made - 1 - at], [*turned, turn]))
        return cls(nodes, turns)

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """(inner nodes x labels): whether a label's way turns to the first, or to the second child there."""
        k = len(self.nodes)
        first, second = np.zeros((max(k - 1, 0), k)), np.zeros((max(k - 1, 0), k))
        for label, (way, turned) in enumerate(zip(self.nodes, self.turns)):
            for node, turn in zip(way, turned):
                (second if turn else first)[node, label] = 1.0
        return first, second


def _log_sigmoid(z: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0.0, -z)


def log_probabilities(scores: np.ndarray, loss: str, tree: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Log probability of each label (rows x labels) from the outputs' scores."""
    if loss != "hs" and not scores.shape[1]:
        return scores
    if loss == "softmax":
        top = scores.max(axis=1, keepdims=True)
        return scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
    if loss == "ova":
        return _log_sigmoid(scores)
    first, second = tree
    return _log_sigmoid(-scores) @ first + _log_sigmoid(scores) @ second


def losses_and_errors(scores: np.ndarray, y: np.ndarray, loss: str, tree) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each row and its derivative by each output's score."""
    rows = np.arange(len(y))
    if loss == "softmax":
        log_p = log_probabilities(scores, loss, tree)
        error = np.exp(log_p)
        error[rows, y] -= 1.0
        return -log_p[rows, y], error
    if loss == "ova":
        sign = np.ones_like(scores)
        sign[rows, y] = -1.0
        hit = np.zeros_like(scores)
        hit[rows, y] = 1.0
        return np.logaddexp(0.0, sign * scores).sum(axis=1), np.exp(_log_sigmoid(scores)) - hit
    first, second = tree
    on_way = (first + second).T[y]
    turned = second.T[y]
    each = np.logaddexp(0.0, np.where(turned > 0, -scores, scores)) * on_way
    return each.sum(axis=1), (np.exp(_log_sigmoid(scores)) - turned) * on_way


def _sparse(column: pa.Array, kept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value (one over the row's features) of all features of a batch."""
    lengths = np.diff(column.offsets.to_numpy())
    row, bucket = np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)
    if kept is not None:
        use = kept[bucket]
        row, bucket = row[use], bucket[use]
    size = np.bincount(row, minlength=len(column))
    return row, bucket, 1.0 / np.maximum(size, 1)[row]


def _slices(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of a list column that hold about ``limit`` features; at least one row each."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    start, limit = 0, limit or SLICE_FEATURES
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


def _scores(sparse, weights: np.ndarray, n: int) -> np.ndarray:
    row, bucket, value = sparse
    return np.stack([np.bincount(row, weights[bucket, k] * value, n) for k in range(weights.shape[1])], axis=1) if weights.shape[1] else np.zeros((n, 0))


@dataclass
class TextModel:
    """Labels, weights (buckets x outputs) and what they were trained with."""

    labels: list[str]
    weights: np.ndarray
    options: Options
    kept: np.ndarray | None = None  # buckets that reach the minimum count
    tree: LabelTree | None = None
    history: list[dict] = field(default_factory=list)

    def probabilities(self, df: DataFrame, tokens: Column, out: str = "probabilities") -> DataFrame:
        """``df`` with the probability of every label, in the order of ``labels``. A row without features scores 0 everywhere."""
        matrices = self.tree.matrices() if self.tree else None
        held = df.sparkSession.sparkContext.broadcast((self.weights, self.kept, self.options.loss, matrices))

        frame = df.withColumn("_x", features(tokens, self.options))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, kept, loss, tree = held.value
            for batch in batches:
                n, x = batch.num_rows, batch.column("_x")
                scores = [_scores(_sparse(x.slice(a, b - a), kept), weights, b - a) for a, b in _slices(x)]
                p = np.exp(log_probabilities(np.concatenate([np.zeros((0, weights.shape[1])), *scores]), loss, tree))
                made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                rest = [c for c in batch.schema.names if c != "_x"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], made], [*rest, out])

        return frame.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))

    def predict(self, df: DataFrame, tokens: Column, k: int = 1, out: str = "classes") -> DataFrame:
        """``df`` with the ``k`` most probable labels (prefixed) and their probabilities; ties by label order."""
        if not self.labels:
            return df.withColumn(out, F.array().cast("array<struct<class:string,prob:double>>"))
        scored = self.probabilities(df, tokens, "_p")
        names = [f"{self.options.label_prefix}{x}" for x in self.labels]
        return scored.withColumn(out, topk(F.col("_p"), names, k)).drop("_p")

    def to_table(self, spark: SparkSession) -> DataFrame:
        """``(bucket, output, weight)`` of all weights that are not zero."""
        bucket, output = np.nonzero(self.weights)
        table = pa.table({"bucket": pa.array(bucket, pa.int32()), "output": pa.array(output, pa.int32()), "weight": self.weights[bucket, output]})
        return spark.createDataFrame(table)

    @classmethod
    def from_table(cls, table: DataFrame, labels: Sequence[str], options: Options, counts: Sequence[int] | None = None) -> TextModel:
        """A model from ``(bucket, output, weight)``; ``hs`` also takes the label counts its tree was made from."""
        tree = LabelTree.huffman(counts) if options.loss == "hs" else None
        weights = np.zeros((options.buckets, _outputs(len(labels), options)))
        cells = table.select("bucket", "output", F.col("weight").cast("double")).toArrow()
        weights[cells.column(0).to_numpy(), cells.column(1).to_numpy()] = cells.column(2).to_numpy()
        return cls(list(labels), weights, options, None, tree)


def _outputs(labels: int, options: Options) -> int:
    outputs = max(labels - 1, 0) if options.loss == "hs" else labels
    if options.buckets * outputs * 8 > MAX_MODEL_BYTES:
        raise ValueError(f"{options.buckets} buckets x {outputs} outputs exceed {MAX_MODEL_BYTES} bytes: take fewer buckets")
    return outputs


def _gradient(rows: DataFrame, weights: np.ndarray, kept, loss: str, tree) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(rows, loss sum, touched cells, their gradient sums) of one step."""
    held = rows.sparkSession.sparkContext.broadcast((weights, kept, loss, tree))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, kept, loss, tree = held.value
        n, total = 0, 0.0
        for batch in batches:
            whole, labels = batch.column("x"), batch.column("y").to_numpy(zero_copy_only=False)
            for a, b in _slices(whole):
                y = labels[a:b]
                sparse = _sparse(whole.slice(a, b - a), kept)
                each, error = losses_and_errors(_scores(sparse, w, len(y)), y, loss, tree)
                n, total = n + len(y), total + float(each.sum())
                if not w.shape[1]:
                    continue
                row, bucket, value = sparse
                used, at = np.unique(bucket, return_inverse=True)
                sums = np.stack([np.bincount(at, error[row, k] * value, len(used)) for k in range(w.shape[1])], axis=1)
                i, k = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(used[i].astype(np.int64) * w.shape[1] + k), pa.array(sums[i, k])], ["cell", "v"])
        # the number of rows and their loss, as two more cells
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1], pa.int64()), pa.array([float(n), total])], ["cell", "v"])

    cells = rows.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    at, v = cells.column("cell").to_numpy(), cells.column("v").to_numpy()
    return int(v[at == -2].sum()), float(v[at == -1].sum()), at[at >= 0], v[at >= 0]


def fit(df: DataFrame, tokens: Column, label: Column, options: Options = Options(), key: Sequence[str] = ()) -> TextModel:
    """Train on the rows whose label is not null; labels are ordered by name.

    Several batches need a ``key``, a hash of which deals the rows. ``history``
    holds, for each epoch, the rows, their mean loss before each step's update,
    and the sum of the weights' magnitudes after the epoch. A table without labels
    gives a model without labels, which predicts nothing.
    """
    if options.batches > 1 and not key:
        raise ValueError("several batches need a key that deals the rows")
    spark = df.sparkSession
    batch = keyed_integer(options.seed, 0, options.batches, *key).cast("int") if options.batches > 1 else F.lit(0)
    rows = spread(df).select(label.cast("string").alias("label"), features(tokens, options).alias("x"), batch.alias("batch")).filter("label is not null")
    path = new_path(spark, "texts")
    counted = df.select(label.cast("string").alias("label")).filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    # one row per label, as many as the model has outputs
    classes = sorted((r.label, r.n) for r in counted.filter(F.col("n") >= options.min_label_count).collect())
    labels, counts = [c for c, _ in classes], [n for _, n in classes]
    outputs = _outputs(len(labels), options)
    tree = LabelTree.huffman(counts) if options.loss == "hs" else None
    matrices = tree.matrices() if tree else None
    model = TextModel(labels, np.zeros((options.buckets, outputs)), options, None, tree)
    if not labels:
        return model
    numbers = spark.createDataFrame([(c, i) for i, c in enumerate(labels)], "label string, y int")
    rows.join(numbers, "label").select("y", "x", "batch").write.partitionBy("batch").parquet(path)
    data = spark.read.parquet(path)
    if options.min_count > 1:
        seen = data.select(F.explode("x").alias("b")).groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") >= options.min_count)
        model.kept = np.zeros(options.buckets, bool)
        model.kept[seen.select("b").toArrow().column(0).to_numpy()] = True
    state = {s: np.zeros(model.weights.size) for s in options.optimizer.states}
    steps, step, rate = options.epochs * options.batches, 0, options.learning_rate
    for epoch in range(options.epochs):
        seen_rows, total = 0, 0.0
        for b in range(options.batches):
            if step % options.rate_update == 0:
                rate = options.learning_rate * (1.0 - step / steps)
            step += 1
            n, loss, cells, sums = _gradient(data.filter(F.col("batch") == b).select("x", "y"), model.weights, model.kept, options.loss, matrices)
            if not n:
                continue
            seen_rows, total = seen_rows + n, total + loss
            flat = model.weights.ravel()
            # cells that no row touched have no gradient: the rule runs on the touched ones
            flat[cells], moved = options.optimizer.step(flat[cells], sums / n, {s: v[cells] for s, v in state.items()}, step, rate)
            for s, v in moved.items():
                state[s][cells] = v
        model.history.append({"epoch": epoch, "rows": seen_rows, "loss": total / max(seen_rows, 1), "weight": float(np.abs(model.weights).sum())})
    return model
