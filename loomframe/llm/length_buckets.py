"""Packing into length buckets whose bounds minimise padding.

A batch pads its documents to the bound of their bucket. Dynamic programming
over the global histogram of lengths finds the bounds with the least padding in
total; batches of a token budget then form inside each bucket, in an order given
by a hash of the document's id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomframe.core.order import group_rank, literal_array

OUTPUTS = ("bucket", "bound", "batch", "slot", "padding")


def word_count(column):
    """Words of a text, runs other than space and the ASCII controls 0x09-0x0D, plus one end token."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1


def histogram(lengths: DataFrame, column: str) -> DataFrame:
    """Rows ``n`` of each ``length``. k different lengths sum to k(k-1)/2 or more, so a corpus of t tokens has at most sqrt(2t) + 1."""
    return lengths.groupBy(F.col(column).alias("length")).agg(F.count("*").alias("n"))


def best_bounds(length: np.ndarray, n: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds, ascending, that minimise ``sum(n * (bound - length))``; among equal ones, the fewest buckets.

    Bounds are lengths that occur; ``best[j]`` is the least padding of the j
    shortest lengths. The first length of the last bucket moves up with j, so each
    round halves the steps between the j it has solved and looks, for a new one,
    only between the answers of its two neighbours: k lengths cost k log k a round.
    """
    order = np.argsort(length)
    top = length[order].astype(np.float64)
    rows = np.concatenate(([0.0], np.cumsum(n[order], dtype=np.float64)))
    tokens = np.concatenate(([0.0], np.cumsum(n[order] * top)))
    bins = len(top)
    best = np.full(bins + 1, np.inf)
    best[0] = 0.0
    choice = []
    for _ in range(min(buckets, bins)):
        cost, split = _extend(best, top, rows, tokens)
        fewer = best <= cost
        split[fewer] = -1
        if fewer.all():
            break
        best = np.where(fewer, best, cost)
        choice.append(split)
    bounds, j = [], bins
    for split in reversed(choice):
        if j and split[j] >= 0:
            bounds.append(int(length[order[j - 1]]))
            j = int(split[j])
    return bounds[::-1]


def _extend(best: np.ndarray, top: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the j shortest lengths with one more bucket, and how many of them lie before that bucket."""
    bins = len(top)
    cost, split = np.zeros(bins + 1), np.zeros(bins + 1, np.int64)
    step = 1 << bins.bit_length()
    while step > 1:
        step //= 2
        j = np.arange(step, bins + 1, 2 * step)
        above = np.where(j + step <= bins, split[np.minimum(j + step, bins)], bins)
        low, high = split[j - step], np.minimum(above, j - 1)
        width = high - low + 1
        ends = np.cumsum(width)
        of = np.repeat(np.arange(len(j)), width)
        i = np.arange(ends[-1]) - (ends - width)[of] + low[of]
        padding = best[i] + top[j[of] - 1] * (rows[j[of]] - rows[i]) - (tokens[j[of]] - tokens[i])
        least = np.minimum.reduceat(padding, ends - width)
        at = np.flatnonzero(padding == least[of])
        cost[j], split[j] = least, i[at[np.unique(of[at], return_index=True)[1]]]
    return cost, split


def pack(docs: DataFrame, id_col: str, length_col: str, buckets: int = 16, budget: int = 32_768) -> DataFrame:
    """``(id, length, bucket, bound, batch, slot, padding)`` for every row of ``docs``.

    ``batch`` numbers the batches of a bucket from 0, ``slot`` the rows of a batch
    from 0; a batch has ``max(1, budget // bound)`` rows, its last one fewer. A
    document longer than the budget is a batch alone. Lengths must not be
    negative; a null length counts as 0. Rows with a null id come first in their
    bucket; repeated rows are packed each. An empty table gives an empty result. An
    id or length column named like another output comes back as ``id`` or ``length``.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("_n"))
    bins = histogram(rows, "_n").toArrow()
    bounds = best_bounds(bins.column("length").to_numpy(), bins.column("n").to_numpy(), buckets)
    if not bounds:
        bounds = [0]
    every = literal_array(bounds, "bigint")
    placed = rows.withColumn("bucket", F.size(F.filter(every, lambda b: b < F.col("_n")))).withColumn("_h", F.xxhash64("_id"))
    ranked = group_rank(placed, ["bucket"], ["_h", "_id", "_n"], "_rank", unique=False)
    bound = F.element_at(every, F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bound", F.lit(1))))
    return ranked.withColumn("bound", bound).select(
        F.col("_id").alias("id" if id_col in OUTPUTS else id_col),
        F.col("_n").alias("length" if length_col in OUTPUTS else length_col),
        "bucket",
        "bound",
        F.floor(F.col("_rank") / room).alias("batch"),
        (F.col("_rank") % room).alias("slot"),
        (F.col("bound") - F.col("_n")).alias("padding"),
    )
