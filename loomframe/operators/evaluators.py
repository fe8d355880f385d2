"""Evaluators: accuracies over a predictions table, averaged by instance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions.vectors import argmax, argsort


def _share(flag: Column) -> Column:
    """Share of true rows; NaN without rows."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(float("nan")))


def accuracy(label: Column, pred: Column) -> Column:
    return _share(argmax(pred) == label)


def binary_accuracy(label: Column, pred: Column, threshold: float = 0.0) -> Column:
    return _share((pred >= threshold).cast("int") == label)


def topk_accuracy(label: Column, pred: Column, k: int) -> Column:
    if k < 2:
        raise ValueError("top-k accuracy needs k of at least 2")
    return _share(F.array_contains(F.slice(argsort(pred, ascending=False), 1, k), label.cast("bigint")))


def box_error(box_label: Column, box_pred: Column, box_mask: Column) -> Column:
    """Mean absolute masked offset error over all cells."""
    cells = F.zip_with(F.zip_with(box_label, box_pred, lambda a, b: F.abs(a - b)), box_mask, lambda d, m: d * m)
    total = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
    return F.sum(total) / F.sum(F.size(box_label))


def evaluate(df: DataFrame, evaluators: dict[str, Column], score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Score once, run all evaluators in one aggregation: rows (evaluator, value)."""
    scored = score(df) if score else df
    row = scored.agg(*[c.alias(n) for n, c in evaluators.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("evaluator"), F.col(n).cast("double").alias("value")) for n in evaluators])
    return row.select(F.inline(pairs))


def by_group(df: DataFrame, group: Sequence[str], evaluators: dict[str, Column]) -> DataFrame:
    return df.groupBy(*group).agg(*[c.alias(n) for n, c in evaluators.items()])
