"""Scoring of feature vectors by tree ensembles and linear models given as tables.

An ensemble is a table with a row per node: ``(tree, node, feature, threshold,
left, right, missing_left, value)``. A leaf has a null ``feature`` and a ``value``.
Tasks walk all trees for a whole Arrow batch at once: each step moves every row
of the batch one node down in every tree, so the number of steps is the depth of
the deepest tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, missing_left boolean, value double"
#: What a model's nodes may take when they are sent to all tasks.
MAX_MODEL_BYTES = 256 << 20
#: Row x tree positions that are held at once.
CELLS = 1 << 20
OBJECTIVES = ("regression", "logistic", "softmax", "mean")


@dataclass(frozen=True)
class TreeEnsemble:
    """All nodes of all trees as flat arrays; a child is a position in them and a leaf its own child.

    ``regression``: base score plus the leaves' sum. ``logistic``: its sigmoid.
    ``softmax``: tree t adds to class ``t mod classes``, then softmax over classes.
    ``mean``: the leaves' mean over trees (a forest).
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    objective: str = "regression"
    classes: int = 1
    base: float = 0.0

    @classmethod
    def from_table(cls, nodes: DataFrame, objective: str = "regression", classes: int = 1, base: float = 0.0) -> TreeEnsemble:
        """Read and check a node table: every tree has a node 0, its root, every child exists and no walk returns to a node."""
        if objective not in OBJECTIVES:
            raise ValueError(f"objective must be one of {OBJECTIVES}")
        if nodes.count() * 45 > MAX_MODEL_BYTES:
            raise ValueError(f"the nodes exceed {MAX_MODEL_BYTES} bytes")
        names = NODE_SCHEMA.replace(",", "").split()[0::2]
        t = nodes.select(*names).orderBy("tree", "node").toArrow().combine_chunks()
        column = lambda c, null, kind: np.asarray(t.column(c).fill_null(null).to_numpy(zero_copy_only=False)).astype(kind)
        tree, node = column("tree", -1, np.int64), column("node", -1, np.int64)
        leaf = t.column("feature").is_null().to_numpy(zero_copy_only=False)
        place = {key: i for i, key in enumerate(zip(tree.tolist(), node.tolist()))}
        if len(place) != len(tree):
            raise ValueError("a node is given twice")
        own = np.arange(len(tree))
        children = []
        for side in ("left", "right"):
            to = column(side, -1, np.int64)
            at = np.array([i if is_leaf else place.get(key, -1) for i, is_leaf, key in zip(own.tolist(), leaf.tolist(), zip(tree.tolist(), to.tolist()))], np.int64).reshape(-1)
            if (at < 0).any():
                raise ValueError(f"node {node[at < 0][0]} of tree {tree[at < 0][0]} has no {side} child")
            children.append(at)
        roots = np.array([place.get((k, 0), -1) for k in np.unique(tree).tolist()], np.int64)
        if (roots < 0).any():
            raise ValueError("a tree has no node 0")
        depth, front = 0, roots
        while len(inner := front[~leaf[front]]):
            depth += 1
            if depth > len(tree):
                raise ValueError("the nodes of a tree form a ring")
            front = np.unique(np.concatenate((children[0][inner], children[1][inner])))
        return cls(
            column("feature", 0, np.int64), column("threshold", 0.0, float), *children, column("missing_left", True, bool),
            column("value", 0.0, float), roots, depth, objective, classes, base,
        )

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches in each tree (rows x trees). A row goes left below the threshold; NaN as the node says."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            v = x[rows, self.feature[at]]
            left = np.where(np.isnan(v), self.missing_left[at], v < self.threshold[at])
            at = np.where(left, self.left[at], self.right[at])
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """(rows x outputs) scores of an (n, width) matrix."""
        parts = []
        step = max(CELLS // max(len(self.roots), 1), 1)
        for i in range(0, len(x), step):
            values = self.value[self.leaves(x[i : i + step])]
            if self.objective == "softmax":
                z = np.stack([values[:, k :: self.classes].sum(axis=1) for k in range(self.classes)], axis=1) + self.base
                p = np.exp(z - z.max(axis=1, keepdims=True))
                parts.append(p / p.sum(axis=1, keepdims=True))
                continue
            total = values.mean(axis=1) if self.objective == "mean" and values.shape[1] else values.sum(axis=1)
            z = self.base + total
            parts.append((1.0 / (1.0 + np.exp(-z)) if self.objective == "logistic" else z)[:, None])
        return np.concatenate(parts) if parts else np.zeros((0, self.classes if self.objective == "softmax" else 1))

    def arrays(self) -> tuple:
        return tuple(getattr(self, f) for f in self.__dataclass_fields__)


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An (n, width) matrix with NaN for nulls and missing ends, and which rows have a vector."""
    has = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(has, column.value_lengths().fill_null(0).to_numpy(), 0)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(column), width), np.nan)
    use = at < width
    out[row[use], at[use]] = flat[use]
    return out, has


def predict(df: DataFrame, vector_col: str, model: TreeEnsemble, out: str = "scores") -> DataFrame:
    """``df`` with an array of scores: one, or a probability per class.

    A null component and one past a short vector's end count as missing and go
    where the node sends them; a null vector has null scores.
    """
    # the size was checked when the model was read; plain arrays need no package on the executors
    held = df.sparkSession.sparkContext.broadcast(model.arrays())
    width = int(model.feature.max(initial=0)) + 1
    position = df.columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = TreeEnsemble(*held.value)
        for batch in batches:
            x, has = _vectors(batch.column(position), width)
            y = trees.score(x)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * y.shape[1]
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def softmax_regression(v: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Class probabilities of a linear model, as an expression: a null vector gives null."""
    row = lambda w: F.aggregate(
        F.zip_with(v.cast("array<double>"), F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
    )
    scores = F.array(*[row(w) + F.lit(float(b)) for w, b in zip(weights, bias)])
    raised = lambda z: F.transform(z, lambda s: F.exp(s - F.array_max(z)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    normed = lambda e: F.transform(e, lambda x: x / total(e))
    bound = F.get(F.transform(F.array(scores), lambda z: F.get(F.transform(F.array(raised(z)), normed), 0)), 0)
    return F.when(v.isNotNull(), bound)
