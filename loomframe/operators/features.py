"""Featurizers: string columns to numeric vectors, and standardisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.core.order import row_index
from loomframe.core.session import materialize
from loomframe.functions import elementwise as E
from loomframe.operators.joins import lookup_join


def select_features_labels(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    if not features or not labels:
        raise ValueError("at least one feature and one label column are needed")
    return df.select(*features, *labels)


def numeric_feature(col: str | Column) -> Column:
    """Parse as a number; a malformed string is an error under ANSI."""
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def first_seen_index(df: DataFrame, col: str, order_by: Sequence[str]) -> DataFrame:
    """(value, index): distinct values numbered by their first occurrence.

    The running map of a sequential reader becomes a min-key aggregate, which
    combines map-side whatever the skew of the values. Values that are first seen
    at one key are an error: the order does not tell them apart.
    """
    first = df.groupBy(col).agg(F.min(F.struct(*order_by)).alias("_first"))
    return row_index(first, "_first", "index").select(col, "index")


def categorical_index_auto(df: DataFrame, col: str, order_by: Sequence[str], out: str) -> DataFrame:
    """Append the first-seen index of ``col``; NULL is a category like any other, hot categories are split."""
    mapping = materialize(first_seen_index(df, col, order_by), "categories")
    return lookup_join(df, mapping.withColumnRenamed("index", out), col, null_safe=True)


def categorical_index_map(df: DataFrame, col: str, mapping: dict[str, int], out: str) -> DataFrame:
    """Index from a given map; a value outside it is an error.

    The map is a driver-side dict, so broadcasting it adds no new bound.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(list(mapping.items()), f"{col} string, _i long")
    message = F.concat(F.lit(f"value not in the map of {col}: "), F.col(col).cast("string"))
    return (
        df.join(F.broadcast(table), col, "left")
        .withColumn(out, F.when(F.col("_i").isNull(), F.raise_error(message)).otherwise(F.col("_i")))
        .drop("_i")
    )


def categorical_one_hot(df: DataFrame, col: str, mapping: dict[str, int], out: str) -> DataFrame:
    from loomframe.functions.vectors import one_hot

    indexed = categorical_index_map(df, col, mapping, "_index")
    return indexed.withColumn(out, one_hot(F.col("_index"), len(mapping))).drop("_index")


def assemble_vector(*parts: Column) -> Column:
    """Concatenate scalars and arrays, in the given order, into one vector.

    Scalars are given as ``F.array(column)``.
    """
    return F.concat(*[p.cast("array<double>") for p in parts])


def custom_featurizer(fn: Callable) -> Callable[[Column], Column]:
    """Lift ``fn(str) -> list[float]`` to a column function (Arrow batches)."""
    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [float(x) for x in fn(v)])

    return run


def standardize(df: DataFrame, cols: Sequence[str], over: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std, statistics from ``over`` (default: ``df``); a constant column gives NaN.

    The statistics are one row, read as a scalar subquery: no join, no driver
    round trip, and the scan for them reads only these columns.
    """
    source = df if over is None else over
    stats = source.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
        ).alias("stats")
    ).scalar()
    scaled = {c: E.div(F.col(c) - stats.getField(f"m_{c}"), stats.getField(f"s_{c}")) for c in cols}
    return df.withColumns(scaled)


def channel_normalize(v: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(x - mean[c]) / std[c] with the channel given by the array position."""
    m = F.array(*[F.lit(float(x)) for x in mean])
    s = F.array(*[F.lit(float(x)) for x in std])
    n = len(mean)
    return F.transform(v, lambda x, i: (x - F.get(m, i % n)) / F.get(s, i % n))


def scale_to_unit(x: Column) -> Column:
    return x.cast("double") / F.lit(255.0)


def label_encode_positions(text: Column, positions: int = 6, missing: int = 11) -> Column:
    """One digit class per character position; beyond the string: ``missing``."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(positions)),
        lambda i: F.when(i > F.length(text), F.lit(missing)).otherwise(
            F.substring(text, i, F.lit(1)).cast("int")
        ),
    )


def apply_steps(df: DataFrame, steps: Sequence[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Ordered transforms, each bound to one column by name."""
    for name, step in steps:
        df = df.withColumn(name, step(F.col(name)))
    return df
