"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2^bits`` cells by cut values at even shares of
its rows, so a skewed dimension still spreads over its cells. A row's place on
the Hilbert curve through the grid of cells is the sort key; the sorted rows are
cut into runs of equal counts. Neighbours on the curve are neighbours in every
dimension, so a shard covers a narrow range of each and a query that bounds
several of them reads few shards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomframe.core.order import row_index
from loomframe.llm.common import free_name


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (n x dimensions, below 2^bits).

    Works down the bits: at each level the cell's octant is rotated and reflected
    to the curve's standard pose, then the levels' Gray codes are undone.
    """
    x = [cells[:, j].astype(np.int64).copy() for j in range(cells.shape[1])]
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for j in range(d):
            flip = (x[j] & level) != 0
            swap = np.where(flip, 0, (x[0] ^ x[j]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[j] ^= swap
        level >>= 1
    for j in range(1, d):
        x[j] ^= x[j - 1]
    parity = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        parity ^= np.where(x[d - 1] & level, level - 1, 0)
        level >>= 1
    out = np.zeros_like(parity)
    for b in range(bits - 1, -1, -1):
        for j in range(d):
            out = out << 1 | ((x[j] ^ parity) >> b & 1)
    return out


def quantile_cuts(df: DataFrame, dimensions: Sequence[Column], bits: int, accuracy: int = 10_000) -> list[list[float]]:
    """For each dimension, the values at even shares of its rows: at most ``2^bits - 1`` numbers."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(d.cast("double"), shares, accuracy).alias(f"c{j}") for j, d in enumerate(dimensions)]).first()
    return [sorted(set(row[j] or [])) for j in range(len(dimensions))]


def with_curve_index(df: DataFrame, dimensions: Sequence[str], cuts: list[list[float]], bits: int, name: str) -> DataFrame:
    """``df`` with the curve position of its dimensions; a null dimension lies in the first cell."""
    at = [df.columns.index(c) for c in dimensions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, len(at)), np.int64)
            for j, column in enumerate(at):
                values = batch.column(column).to_numpy(zero_copy_only=False).astype(np.float64)
                found = np.searchsorted(np.array(cuts[j], np.float64), values, side="right")
                cells[:, j] = np.where(np.isnan(values), 0, np.minimum(found, (1 << bits) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(cells, bits))], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def shard_by_curve(df: DataFrame, dimensions: dict[str, Column], ties: Sequence[str], shards: int = 24, bits: int = 8) -> DataFrame:
    """``df`` with its dimensions, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Counts of shards differ by at most one: the first ``rows mod shards`` hold one
    row more. Rows in one cell are ordered by ``ties``; rows equal in those too
    (repeated rows) are ordered anyhow, which exchanges equal rows only. With
    fewer rows than shards, the last shards are empty; an empty table gives an
    empty result. A dimension that is null or NaN counts as its first cell.
    """
    if bits * len(dimensions) > 62:
        raise ValueError("the curve index must fit 62 bits")
    names = [free_name(df, n) for n in dimensions]
    spread = df.withColumns(dict(zip(names, dimensions.values())))
    cuts = quantile_cuts(spread, [F.col(n) for n in names], bits)
    index, place = free_name(spread, "_curve"), free_name(spread, "_place")
    ordered = row_index(with_curve_index(spread, names, cuts, bits, index), [index, *ties], place, unique=False)
    total = ordered.count()
    each, more = divmod(total, shards)
    long_rows = more * (each + 1)
    p = F.col(place)
    shard = F.when(p < long_rows, F.floor(p / F.lit(each + 1))).otherwise(F.lit(more) + F.floor((p - long_rows) / F.lit(max(each, 1))))
    slot = F.when(p < long_rows, p % F.lit(each + 1)).otherwise((p - long_rows) % F.lit(max(each, 1)))
    return ordered.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop(index, place)


def shard_ranges(sharded: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Per shard the least and greatest value of each dimension, for pruning; and its rows."""
    bounds = [f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *bounds)


def shards_to_read(ranges: DataFrame, box: dict[str, tuple]) -> DataFrame:
    """Shards whose ranges meet every ``(low, high)`` of the box."""
    for c, (low, high) in box.items():
        ranges = ranges.filter((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return ranges.select("shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in slot order, so that a reader prunes by ``shard``."""
    rows = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
