"""Reductions down the rows (axis 0): all elements or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.core.quantile import interpolated


def norm(x: Column, order: float = 2.0) -> Column:
    if order == float("inf"):
        return F.max(F.abs(x))
    if order == 2.0:
        return F.sqrt(F.sum(x * x))
    return F.pow(F.sum(F.pow(F.abs(x), F.lit(order))), F.lit(1.0 / order))


def _no_rows_true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(True))


def all_true(x: Column) -> Column:
    return _no_rows_true(F.bool_and(x != 0))


def any_true(x: Column) -> Column:
    return F.coalesce(F.bool_or(x != 0), F.lit(False))


def none_true(x: Column) -> Column:
    return ~any_true(x)


def count_nonzero(x: Column) -> Column:
    return F.count_if(x != 0)


def percentile(df: DataFrame, value: str, fractions: dict[str, float], group: Sequence[str] = ()) -> DataFrame:
    return interpolated(df, list(group), value, fractions)


def extreme_position(df: DataFrame, value: str, order_by: Sequence[str], largest: bool = True) -> DataFrame:
    """One row ``position``: the index of the first maximum (or minimum).

    The winner's key comes from one aggregate; its index is the number of
    smaller keys, so the table is neither sorted nor numbered.
    """
    best = df.agg((F.max if largest else F.min)(value)).scalar()
    winner = df.filter(F.col(value) == best).agg(F.min(F.struct(*order_by))).scalar()
    return df.filter(F.struct(*order_by) < winner).agg(F.count("*").alias("position"))


def vector_sum(df: DataFrame, vector: str | Column, group: Sequence[str] = (), how=F.sum) -> DataFrame:
    """Element-wise aggregate of equal-shaped vectors: rows (group, pos, value)."""
    col = F.col(vector) if isinstance(vector, str) else vector
    long = df.select(*group, F.posexplode(col).alias("pos", "_x"))
    return long.groupBy(*group, "pos").agg(how(F.col("_x").cast("double")).alias("value"))


def token_frequency(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.groupBy(token).agg(F.count("*").alias("n"))


def stage_totals(df: DataFrame, stage: str, epoch: str, value: str) -> DataFrame:
    """Mean and count per (stage, epoch), plus the totals per stage over all epochs."""
    return (
        df.groupingSets([[F.col(stage), F.col(epoch)], [F.col(stage)]], F.col(stage), F.col(epoch))
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    )
