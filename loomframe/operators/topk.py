"""Classification results, top-k and dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def classifications(probs: Column, names: Sequence[str]) -> Column:
    """array<struct(class, prob)> from a probability array."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.zip_with(labels, probs, lambda c, p: F.struct(c.alias("class"), p.alias("prob")))


def topk(probs: Column, names: Sequence[str], k: int) -> Column:
    """The k most probable classes, falling; ties by class position; k is clamped."""
    labels = F.array(*[F.lit(n) for n in names])
    keyed = F.transform(probs, lambda p, i: F.struct((-p).alias("m"), i.alias("i")))
    return F.transform(
        F.slice(F.array_sort(keyed), 1, k),
        lambda s: F.struct(F.get(labels, s["i"]).alias("class"), (-s["m"]).alias("prob")),
    )


def best(probs: Column, names: Sequence[str]) -> Column:
    labels = F.array(*[F.lit(n) for n in names])
    top = F.array_max(probs)
    return F.struct(
        F.get(labels, (F.array_position(probs, top) - 1).cast("int")).alias("class"), top.alias("prob")
    )


def get(items: Column, name: str) -> Column:
    """The first item of that class, or NULL."""
    return F.get(F.filter(items, lambda s: s["class"] == name), F.lit(0))


def topk_rows(df: DataFrame, group: Sequence[str], order_by: Sequence, k: int, name: str = "rank") -> DataFrame:
    """The first k rows per group. Spark keeps k per group before the shuffle
    (window group limit), so a hot group costs no more than k rows per task."""
    over = Window.partitionBy(*group).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(over)).filter(F.col(name) <= k)


def dictionary_top_n(counts: DataFrame, reserved: Sequence[str], size: int) -> DataFrame:
    """(token, index): reserved tokens first, then by falling count (ties by token), ``size`` in all."""
    spark = counts.sparkSession
    room = size - len(reserved)
    fixed = spark.createDataFrame(list(zip(reserved, range(len(reserved)))), "token string, index long")
    top = counts.filter(~F.col("token").isin(list(reserved))).orderBy(F.desc("n"), "token").limit(room)
    # at most ``size`` rows are left to number
    order = Window.orderBy(F.desc("n"), "token")
    numbered = top.select("token", (F.row_number().over(order) - 1 + len(reserved)).cast("bigint").alias("index"))
    return fixed.unionByName(numbered)
