"""Losses and penalties.

A loss is a per-sample column; ``mean_loss`` turns it into the number a trainer
reports: the mean over a batch, and the mean of the batch means over batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions.activations import array_sum, log_softmax, relu, softplus
from loomframe.functions.vectors import argmax, pick

EPS = 1e-5


def mean_loss(df: DataFrame, loss: str | Column, batch: str | None = None, out: str = "loss") -> DataFrame:
    col = F.col(loss) if isinstance(loss, str) else loss
    if batch is None:
        return df.agg(F.avg(col).alias(out))
    return df.groupBy(batch).agg(F.avg(col).alias("_m")).agg(F.avg("_m").alias(out))


def l1(label: Column, pred: Column, weight: float = 1.0) -> Column:
    return F.abs(label - pred) * weight


def l2(label: Column, pred: Column, weight: float = 0.5) -> Column:
    return (label - pred) * (label - pred) * weight


def hinge(label: Column, pred: Column, margin: float = 1.0, weight: float = 1.0) -> Column:
    return relu(F.lit(margin) - label * pred) * weight


def sigmoid_bce(label: Column, pred: Column, weight: float = 1.0, from_logits: bool = True) -> Column:
    if from_logits:
        loss = relu(pred) - pred * label + softplus(-F.abs(pred))
    else:
        loss = -(label * F.log(pred + EPS) + (1.0 - label) * F.log(1.0 - pred + EPS))
    return loss * weight


def softmax_ce(label: Column, pred: Column, sparse: bool = True, from_logits: bool = True, weight: float = 1.0) -> Column:
    """Cross entropy of a class vector with a class index or a distribution."""
    logp = log_softmax(pred) if from_logits else pred
    if sparse:
        return -pick(logp, label) * weight
    return -array_sum(F.zip_with(logp, label, lambda p, y: p * y)) * weight


def masked_softmax_ce(labels: Column, preds: Column, valid: Column, sparse: bool = True, from_logits: bool = True) -> Column:
    """Per sample: the step losses, zero beyond the valid length, over the full length."""
    steps = F.zip_with(labels, preds, lambda y, p: softmax_ce(y, p, sparse, from_logits))
    kept = F.transform(steps, lambda x, i: F.when(i < valid, x).otherwise(F.lit(0.0)))
    return array_sum(kept) / F.size(labels)


def ssd(class_label: Column, class_pred: Column, box_label: Column, box_pred: Column, box_mask: Column) -> Column:
    """Class cross entropy plus masked L1 of the box offsets, per anchor."""
    diff = F.zip_with(F.zip_with(box_label, box_pred, lambda a, b: F.abs(a - b)), box_mask, lambda d, m: d * m)
    return softmax_ce(class_label, class_pred) + array_sum(diff) / F.size(box_label)


def composite(*losses: Column) -> Column:
    total = losses[0]
    for x in losses[1:]:
        total = total + x
    return total


def masked_lm(df: DataFrame, logp: str, target: str, mask: str) -> DataFrame:
    """One row per table of masked positions: loss and accuracy, weighted by the mask."""
    m = F.col(mask).cast("double")
    weight = F.sum(m)
    hit = (argmax(F.col(logp)) == F.col(target)).cast("double")
    return df.agg(
        (F.sum(-pick(F.col(logp), F.col(target)) * m) / (weight + EPS)).alias("loss"),
        (F.sum(hit * m) / weight).alias("accuracy"),
    )


def next_sentence(df: DataFrame, logp: str, label: str) -> DataFrame:
    hit = (argmax(F.col(logp)) == F.col(label)).cast("double")
    return df.agg(F.avg(-pick(F.col(logp), F.col(label))).alias("loss"), F.avg(hit).alias("accuracy"))


def penalty_l1(w: Column, lam: float) -> Column:
    return F.sum(F.abs(w)) * lam


def penalty_l2(w: Column, lam: float) -> Column:
    return F.sum(w * w) * lam


def penalty_elastic(w: Column, lam1: float, lam2: float) -> Column:
    return penalty_l1(w, lam1) + penalty_l2(w, lam2)


def divergence(df: DataFrame, group: Sequence[str], loss: str) -> DataFrame:
    """The groups whose loss is not a number."""
    return df.groupBy(*group).agg(F.bool_or(F.isnan(loss)).alias("diverged")).filter("diverged")
