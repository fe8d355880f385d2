"""Metric tables (name, value, unit, ts): means, percentiles, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.core.quantile import select_ranks


def mean(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(name).agg(F.avg(value).alias("mean"))


def rank_at(n: Column, percent: int) -> Column:
    """0-based rank floor(n * p / 100), clamped to the last row."""
    return F.least(F.floor(n * percent / 100), n - 1)


def percentile(df: DataFrame, group: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """Rows (group, percent, value): the sorted value at ``rank_at``."""
    wanted = {f"{p}": lambda n, p=p: rank_at(n, p) for p in percents}
    # the group columns may be called name and value themselves
    keys = {c: f"_g{i}" for i, c in enumerate(group)}
    frame = df.select(*[F.col(c).alias(k) for c, k in keys.items()], F.col(value).alias("_x"))
    out = select_ranks(frame, list(keys.values()), "_x", wanted)
    return out.select(
        *[F.col(k).alias(c) for c, k in keys.items()], F.col("value"), F.col("name").cast("int").alias("percent")
    )


def names(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def exists(df: DataFrame, name: str, wanted: Sequence[str]) -> DataFrame:
    """Rows (name, present) for the wanted names, from one aggregate."""
    row = df.agg(*[F.coalesce(F.bool_or(F.col(name) == w), F.lit(False)).alias(f"p{i}") for i, w in enumerate(wanted)])
    pairs = F.array(*[F.struct(F.lit(w).alias("name"), F.col(f"p{i}").alias("present")) for i, w in enumerate(wanted)])
    return row.select(F.inline(pairs))


def latency_report(df: DataFrame, phase: str, value: str, percents: Sequence[int] = (50, 90, 99)) -> DataFrame:
    """One row per phase: percentiles, count, and throughput per unit of total time."""
    long = percentile(df, [phase], value, percents)
    wide = long.groupBy(phase).agg(
        *[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(f"p{p}") for p in percents]
    )
    totals = df.groupBy(phase).agg(F.count("*").alias("n"), (F.count("*") / F.sum(value)).alias("throughput"))
    return wide.join(totals, phase)


def training_speed(df: DataFrame, group: Sequence[str], batch_size: str, seconds: str) -> DataFrame:
    """Items per second, and the P50 / P90 of the batch time, per group."""
    speed = df.groupBy(*group).agg((F.sum(batch_size) / F.sum(seconds)).alias("items_per_second"))
    long = percentile(df, group, seconds, (50, 90))
    wide = long.groupBy(*group).agg(
        F.max(F.when(F.col("percent") == 50, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("percent") == 90, F.col("value"))).alias("p90"),
    )
    return speed.join(wide, list(group))


def epoch_evaluations(df: DataFrame, stage: str, evaluator: str, epoch: str, value: str) -> DataFrame:
    """The latest value per stage and evaluator, one column per stage."""
    last = df.groupBy(evaluator, stage).agg(F.max_by(value, epoch).alias("v"), F.max(epoch).alias("e"))
    return last.groupBy(evaluator).agg(
        F.max("e").alias("epoch"),
        F.max(F.when(F.col(stage) == "train", F.col("v"))).alias("train"),
        F.max(F.when(F.col(stage) == "validate", F.col("v"))).alias("validate"),
    )
