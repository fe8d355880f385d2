"""Window-shaped operators that hold when one series has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.core.order import blocked, group_prefix_sum, group_rank, prefix_sum, row_index
from loomframe.core.session import materialize


def cum_sum(df: DataFrame, value: str, order_by, group: Sequence[str] = (), name: str = "running") -> DataFrame:
    if group:
        return group_prefix_sum(df, value, list(group), order_by, name)
    return prefix_sum(df, value, order_by, name)


def _placed(df: DataFrame, group: Sequence[str], order_by) -> DataFrame:
    """Each row's position ``_p`` in its series and the series length ``_n``."""
    # one row per series, written: its true size decides how the join runs
    lengths = materialize(df.groupBy(*group).agg(F.count("*").alias("_n")), "lengths")
    return group_rank(df, group, order_by, "_p").join(lengths, list(group))


def _scatter(
    df: DataFrame, group: Sequence[str], order_by, kernel: int, stride: int, padding: int, dilation: int, ceil_mode: bool
) -> DataFrame:
    """One row per (element, window it falls into): ``out``, ``_tap``.

    Sliding sums become a plain aggregation on (series, out), which spreads a
    long series over all tasks and combines neighbouring rows map-side.
    """
    placed = _placed(df, group, order_by)
    span = dilation * (kernel - 1) + 1
    room = F.col("_n") + F.lit(2 * padding - span)
    if ceil_mode:
        outputs = F.ceil(room / stride) + 1
        # the last window has to start inside the data or the left padding
        outputs = F.when((outputs - 1) * stride >= F.col("_n") + padding, outputs - 1).otherwise(outputs)
    else:
        outputs = F.floor(room / stride) + 1
    taps = placed.withColumn("_outputs", outputs.cast("bigint")).withColumn(
        "_tap", F.explode(F.sequence(F.lit(0), F.lit(kernel - 1)))
    )
    start = F.col("_p") + F.lit(padding) - F.col("_tap") * F.lit(dilation)
    return (
        taps.withColumn("_start", start)
        .filter((F.col("_start") >= 0) & (F.pmod(F.col("_start"), F.lit(stride)) == 0))
        .withColumn("out", F.floor(F.col("_start") / stride).cast("bigint"))
        .filter(F.col("out") < F.col("_outputs"))
    )


def pool1d(
    df: DataFrame,
    value: str,
    group: Sequence[str],
    order_by,
    how: str,
    kernel: int,
    stride: int = 1,
    padding: int = 0,
    ceil_mode: bool = False,
    count_include_pad: bool = True,
    p: float = 2.0,
) -> DataFrame:
    """max, avg or lp pooling over an ordered series: rows (group, out, value)."""
    scattered = _scatter(df, group, order_by, kernel, stride, padding, 1, ceil_mode)
    x = F.col(value).cast("double")
    if how == "max":
        agg = F.max(x)
    elif how == "avg":
        if count_include_pad:
            # padding counts, positions past the padded end (ceil mode) do not
            first = F.col("out") * stride
            end = F.least(first + kernel, F.col("_n") + 2 * padding)
            agg = F.sum(x) / F.max(end - first)
        else:
            agg = F.avg(x)
    elif how == "lp":
        agg = F.pow(F.sum(F.pow(F.abs(x), F.lit(p))), F.lit(1.0 / p))
    else:
        raise ValueError(f"unknown pooling {how!r}")
    return scattered.groupBy(*group, "out").agg(agg.alias("value"))


def global_pool(df: DataFrame, value: str, group: Sequence[str], how: str, p: float = 2.0) -> DataFrame:
    x = F.col(value).cast("double")
    agg = {
        "max": lambda: F.max(x),
        "avg": lambda: F.avg(x),
        "lp": lambda: F.pow(F.sum(F.pow(F.abs(x), F.lit(p))), F.lit(1.0 / p)),
    }[how]()
    return df.groupBy(*group).agg(agg.alias("value"))


def conv1d(
    df: DataFrame,
    channels: Sequence[str],
    group: Sequence[str],
    order_by,
    weights: Sequence[Sequence[Sequence[float]]],
    bias: Sequence[float] | None = None,
    stride: int = 1,
    padding: int = 0,
    dilation: int = 1,
    groups: int = 1,
) -> DataFrame:
    """1-d convolution; ``weights[filter][channel in group][tap]``.

    Returns one row per (series, out) with a column ``f0``, ``f1``… per filter.
    """
    filters, kernel = len(weights), len(weights[0][0])
    scattered = _scatter(df, group, order_by, kernel, stride, padding, dilation, False)
    per_group, in_group = filters // groups, len(channels) // groups
    sums = []
    for f in range(filters):
        first = (f // per_group) * in_group
        term = F.lit(0.0)
        for c in range(in_group):
            w = F.array(*[F.lit(float(x)) for x in weights[f][c]])
            term = term + F.col(channels[first + c]).cast("double") * F.get(w, F.col("_tap"))
        total = F.sum(term)
        sums.append((total + F.lit(float(bias[f])) if bias else total).alias(f"f{f}"))
    return scattered.groupBy(*group, "out").agg(*sums)


def consecutive_pairs(df: DataFrame, group: Sequence[str], pos: str, value: str) -> DataFrame:
    """Elements 2k and 2k+1 of a group as one row; an odd last one is dropped."""
    half = F.floor(F.col(pos) / 2).cast("bigint")
    side = lambda s: F.max(F.when(F.pmod(F.col(pos), F.lit(2)) == s, F.col(value)))
    return (
        df.groupBy(*group, half.alias("pair"))
        .agg(side(0).alias("first"), side(1).alias("second"))
        .filter(F.col("second").isNotNull())
    )


def latest(df: DataFrame, name: str, order_by: Sequence[str]) -> DataFrame:
    """The last row per name, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c != name]
    return df.groupBy(name).agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_r")).select(name, "_r.*")


def argsort_rank(df: DataFrame, order_by, name: str = "rank") -> DataFrame:
    return row_index(df, order_by, name)


def previous(df: DataFrame, value: str, group: Sequence[str], order_by, name: str = "previous") -> DataFrame:
    """The preceding value in the group, with no task holding a whole group."""
    ranked = group_rank(df, group, order_by, "_p")
    cut = blocked(ranked, "_p", group, before=1, after=0)
    over = Window.partitionBy(*group, "_block").orderBy("_p")
    return cut.withColumn(name, F.lag(value).over(over)).filter("_owned").drop("_p", "_block", "_owned")
