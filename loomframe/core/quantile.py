"""Exact order statistics per group by radix selection: a fixed number of counting passes.

Values map to 64-bit whole numbers in the same order. A pass counts, for every
wanted rank, the rows under each next 16 bits of the numbers that share the bits
found so far; the bin that holds the rank gives the next bits. After four passes
all 64 bits of the value at the rank are known. Counting is combined in the tasks,
so a group with a third of all rows sends at most 65,536 counts per task, and no
group is sorted or held by one reducer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from loomframe.core.session import materialize

DIGIT = 16
#: What a group's keys, a rank's name and its numbers may take in memory.
ROW_BYTES = 256
_ALL_BUT_SIGN = np.int64(0x7FFF_FFFF_FFFF_FFFF)


def _turned(bits: np.ndarray) -> np.ndarray:
    """The order of doubles as whole numbers, and back: magnitudes of negative numbers are turned over."""
    return bits ^ ((bits >> np.int64(63)) & _ALL_BUT_SIGN)


def _bits_of_doubles(v: pa.Array) -> pa.Array:
    x = v.to_numpy(zero_copy_only=False) + 0.0  # the two zeros are one value
    x = np.where(np.isnan(x), np.nan, x)  # one NaN, above all numbers
    return pa.array(_turned(x.view(np.int64)))


def _doubles_of_bits(v: pa.Array) -> pa.Array:
    return pa.array(_turned(v.to_numpy(zero_copy_only=False)).view(np.float64))


def _ordered_bits(kind: T.DataType) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """From values of a type to whole numbers in the same order, and back."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        to_bits, from_bits = F.arrow_udf(_bits_of_doubles, "long"), F.arrow_udf(_doubles_of_bits, "double")
        return lambda v: to_bits(v.cast("double")), lambda b: from_bits(b).cast(kind)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return lambda v: v.cast("long"), lambda b: b.cast(kind)
    if isinstance(kind, T.DateType):
        return lambda v: F.unix_date(v).cast("long"), lambda b: F.date_from_unix_date(b.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros, F.timestamp_micros
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        one = 10**kind.scale
        return lambda v: (v * F.lit(one)).cast("long"), lambda b: (b.cast("decimal(20,0)") / F.lit(one)).cast(kind)
    raise TypeError(f"values of type {kind.simpleString()} have no 64-bit order")


def _broadcast_bytes(spark: SparkSession) -> int:
    """Spark's own bound for broadcast tables; below zero it is switched off."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which a null key is a key; the keys come from the left."""
    named = right.select(*[F.col(k).alias(f"{k}_r") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys]
    return left.join(named, on).drop(*[f"{k}_r" for k in keys])


def _selected(df: DataFrame, group: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows ``(_k0, _k1, ..., name, value, n)``: the value at each rank, and the group's rows."""
    keys = [f"_k{i}" for i in range(len(group))]
    to_bits, from_bits = _ordered_bits(df.schema[value].dataType)
    chosen = df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(group, keys)], to_bits(F.col(value)).alias("_bits"))
    base = materialize(chosen, "bits")
    first = base.groupBy(*keys, F.shiftright("_bits", 64 - DIGIT).alias("_p")).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*keys)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("_rank")) for name, rank in ranks.items()])
    upto = lambda w: F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    holds = (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c"))
    left = (F.col("_rank") - (F.col("_end") - F.col("_c"))).alias("_rank")
    counted = first.withColumn("n", F.sum("_c").over(whole)).withColumn("_end", upto(whole))
    found = counted.select("*", F.inline(wanted)).filter(holds).select(*keys, "name", "n", "_p", left)
    # every pass keeps a row per group and rank: their number decides how they meet the rows
    small = True
    if keys:
        found = materialize(found, "found")
        small = found.count() * ROW_BYTES <= _broadcast_bytes(df.sparkSession)
    for shift in (32, 16, 0):
        if not small:
            found = materialize(found, "found")
        # ranks that share their bits so far are counted side by side
        open_ = found.withColumnRenamed("_p", "_q")
        inside = _joined(base.withColumn("_q", F.shiftright("_bits", shift + DIGIT)), F.broadcast(open_) if small else open_, [*keys, "_q"])
        of = [*keys, "name", "n", "_rank"]
        counts = inside.groupBy(*of, F.shiftright("_bits", shift).alias("_p")).agg(F.count("*").alias("_c"))
        found = counts.withColumn("_end", upto(Window.partitionBy(*of))).filter(holds).select(*keys, "name", "n", "_p", left)
    return found.select(*keys, "name", from_bits(F.col("_p")).alias("value"), "n")


def select_ranks(df: DataFrame, group: Sequence[str], value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per (group, name): the value at an exact 0-based rank; nulls are not counted.

    ``wanted`` maps a result name to the rank as a function of the group's number of
    rows. NaN is above all numbers, the two zeros are one value, and a null group is
    a group; without any row there is no group. Numbers, dates and timestamps have an order.
    """
    out = _selected(df, group, value, wanted)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(group)], "name", "value")


def interpolated(df: DataFrame, group: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles, one row per (group, name)."""
    wanted: dict[str, Callable[[Column], Column]] = {}

    def rank(p: float, edge: Callable) -> Callable[[Column], Column]:
        return lambda n: edge((n - 1) * F.lit(float(p)))

    for name, p in fractions.items():
        wanted[f"{name}|lo"] = rank(p, F.floor)
        wanted[f"{name}|hi"] = rank(p, F.ceil)
    picked = _selected(df, group, value, wanted)
    keys = [f"_k{i}" for i in range(len(group))]
    side, plain = F.substring_index("name", "|", -1), F.substring_index("name", "|", 1)
    wide = picked.groupBy(*keys, plain.alias("name")).agg(
        F.max(F.when(side == "lo", F.col("value"))).alias("lo"), F.max(F.when(side == "hi", F.col("value"))).alias("hi"), F.max("n").alias("n")
    )
    share = F.lit(None).cast("double")
    for name, p in fractions.items():
        share = F.when(F.col("name") == name, F.lit(float(p))).otherwise(share)
    at = (F.col("n") - 1) * share
    between = F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))
    return wide.select(*[F.col(k).alias(c) for c, k in zip(group, keys)], "name", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(between).alias("value"))
