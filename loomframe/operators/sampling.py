"""Splitting, sampling, batching, bucketing and padding of datasets of any size."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.core.keyed import HASH_BITS, keyed_hash
from loomframe.core.order import group_rank, random_rank, row_index
from loomframe.core.session import materialize

_DIGIT_BITS = 13  # 52 = 4 digits of 13 bits


def _cut_points(ratios: Sequence[int], size: int) -> list[int]:
    """Ends of all parts but the last, which takes the remainder."""
    if len(ratios) < 2:
        raise ValueError("a split needs at least two ratios")
    parts = [int(r / sum(ratios) * size) for r in ratios[:-1]]
    return list(accumulate(parts))


def _locate(hashed: DataFrame, ratios: Sequence[int], enough: int):
    """For every cut, a hash interval holding it and the rows before the interval.

    Counts rows by leading hash digits: 8192 numbers per pass. A second pass
    (over the rows of the intervals only) runs where an interval is still large.
    """

    def counts(frame: DataFrame, low: int, bits: int) -> dict[int, int]:
        shift = HASH_BITS - bits
        rows = (
            frame.select(F.shiftright(F.col("_h") - F.lit(low), shift).alias("d"))
            .groupBy("d")
            .agg(F.count("*").alias("n"))
            .collect()
        )
        return {row.d: row.n for row in rows}

    top = counts(hashed, 0, _DIGIT_BITS)
    size = sum(top.values())
    cuts = _cut_points(ratios, size)
    intervals = [(0, 1 << HASH_BITS, 0, size)] * len(cuts)
    bits, known = _DIGIT_BITS, {0: top}
    while True:
        width = 1 << (HASH_BITS - bits)
        narrowed = []
        for cut, (low, high, before, inside) in zip(cuts, intervals):
            found = (high, high, before + inside, 0)  # an empty last part
            for digit in sorted(known.get(low, {})):
                n = known[low][digit]
                if before + n > cut:
                    start = low + digit * width
                    found = (start, start + width, before, n)
                    break
                before += n
            narrowed.append(found)
        intervals = narrowed
        if bits == HASH_BITS or all(n <= enough for *_, n in intervals):
            return cuts, intervals
        bits += _DIGIT_BITS
        known = {
            low: counts(hashed.filter((F.col("_h") >= low) & (F.col("_h") < high)), low, bits)
            for low, high, _, n in intervals
            if n
        }


def random_split(
    df: DataFrame, ratios: Sequence[int], seed, key, name: str = "split", enough: int = 100_000
) -> DataFrame:
    """Label every row with its part; part sizes are exact and the rows unshuffled.

    Two passes over the key columns find the row at which each part begins: one
    counts hash digits, one ranks the few rows around a cut. The label itself is
    then a comparison with constants, so the data is neither moved nor sorted.
    A key that repeats on both sides of a cut could not give the exact sizes and raises.
    """
    key = [key] if isinstance(key, str) else list(key)
    hashed = df.select(*key, keyed_hash(seed, *key).alias("_h"))
    cuts, intervals = _locate(hashed, ratios, enough)
    near, start, before = F.lit(False), F.lit(0), F.lit(0)
    for low, high, b, n in intervals:
        here = (F.col("_h") >= low) & (F.col("_h") < high) & F.lit(n > 0)
        near = near | here
        start = F.when(here, F.lit(low)).otherwise(start)
        before = F.when(here, F.lit(b)).otherwise(before)
    order = Window.partitionBy("_start").orderBy("_h", *key)
    ranked = (
        hashed.filter(near)
        .withColumns({"_start": start, "_before": before})
        .withColumn("_rank", F.row_number().over(order) - 1 + F.col("_before"))
    )
    # the rows on both sides of each cut
    sides = [*cuts, *[c - 1 for c in cuts]]
    first = {row["_rank"]: row for row in ranked.filter(F.col("_rank").isin(sides)).select("_rank", "_h", *key).collect()}
    h = keyed_hash(seed, *key)
    types = dict(df.select(*key).dtypes)
    part = F.lit(0)
    for cut in cuts:
        if cut not in first:
            continue  # nothing is left for the later parts
        row = first[cut]
        if cut - 1 in first and all(first[cut - 1][k] == row[k] for k in key):
            raise ValueError(f"key {key} is not unique: rows of one key lie on both sides of a cut")
        at = F.struct(*[F.lit(row[k]).cast(types[k]).alias(k) for k in key])
        part = part + ((h > row["_h"]) | ((h == row["_h"]) & (F.struct(*key) >= at))).cast("int")
    return df.withColumn(name, part)


def sub_dataset(df: DataFrame, start: int, stop: int, idx: str = "idx") -> DataFrame:
    return df.filter((F.col(idx) >= start) & (F.col(idx) < stop))


def random_sample(df: DataFrame, seed, key, name: str = "rank") -> DataFrame:
    return random_rank(df, seed, key, name)


def batch_sample(df: DataFrame, rank: str, size: int, drop_last: bool = False) -> DataFrame:
    """``batch_id`` and ``batch_pos`` from a 0-based rank column; a narrow operator."""
    out = df.withColumns(
        {
            "batch_id": F.floor(F.col(rank) / size).cast("bigint"),
            "batch_pos": F.pmod(F.col(rank), F.lit(size)).cast("bigint"),
        }
    )
    if not drop_last:
        return out
    full = df.agg(F.floor(F.count("*") / size).cast("bigint")).scalar()
    return out.filter(F.col("batch_id") < full)


def bucket_edges(low: int, high: int, buckets: int) -> list[int]:
    """Sorted distinct upper edges of the length buckets."""
    step = max((1 + high - low) // buckets, 1)
    return sorted({max(high - (buckets - i - 1) * step, low) for i in range(buckets)})


def fixed_bucket_sample(
    df: DataFrame,
    length: str,
    order_by: Sequence[str],
    buckets: int,
    size: int,
    seed=None,
) -> DataFrame:
    """Batches that never mix length buckets: ``bucket``, ``batch_in_bucket``, ``batch_pos``.

    With a seed, rows are shuffled inside the bucket and ``batch_order`` gives
    the batches a random order.
    """
    bounds = df.agg(F.min(length).alias("lo"), F.max(length).alias("hi")).first()
    edges = bucket_edges(bounds.lo, bounds.hi, buckets)
    bucket = F.lit(None).cast("int")
    for i, edge in reversed(list(enumerate(edges))):
        bucket = F.when(F.col(length) <= edge, F.lit(i)).otherwise(bucket)
    labelled = df.withColumn("bucket", bucket)
    order = list(order_by)
    if seed is not None:
        labelled = labelled.withColumn("_h", keyed_hash(seed, *order))
        order = ["_h", *order]
    ranked = group_rank(labelled, ["bucket"], order, "_rank")
    out = ranked.withColumns(
        {
            "batch_in_bucket": F.floor(F.col("_rank") / size).cast("bigint"),
            "batch_pos": F.pmod(F.col("_rank"), F.lit(size)).cast("bigint"),
        }
    ).drop("_rank")
    if seed is None:
        return out
    return out.withColumn("batch_order", keyed_hash(f"{seed}/batch", "bucket", "batch_in_bucket")).drop("_h")


def _collected(batch: list[str], pos: str, value: str) -> Column:
    """Values of one batch in position order (a batch has a fixed row bound)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return F.transform(ordered, lambda s: s["v"])


def stack_batchify(df: DataFrame, value: str, batch: list[str], pos: str, out: str = "stack") -> DataFrame:
    """One row per batch holding its samples; unequal sample shapes are an error."""
    stacked = df.groupBy(*batch).agg(
        _collected(batch, pos, value).alias(out),
        F.min(F.size(value)).alias("_lo"),
        F.max(F.size(value)).alias("_hi"),
    )
    check = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.lit("samples of one batch differ in shape")))
    return stacked.withColumn(out, F.when(check.isNull(), F.col(out))).drop("_lo", "_hi")


def pad_stack_batchify(
    df: DataFrame,
    value: str,
    batch: list[str],
    pos: str,
    pad,
    width: int | None = None,
    out: str = "stack",
) -> DataFrame:
    """Pad to the widest sample of the batch, or to ``width`` (error if a sample is wider)."""
    stacked = df.groupBy(*batch).agg(
        _collected(batch, pos, value).alias("_s"), F.max(F.size(value)).alias("_w")
    )
    if width is not None:
        too_wide = F.raise_error(F.lit(f"a sample is wider than {width}"))
        stacked = stacked.withColumn("_w", F.when(F.col("_w") > width, too_wide).otherwise(F.lit(width)))
    padded = F.transform(
        "_s", lambda v: F.concat(v, F.array_repeat(F.lit(pad), F.col("_w") - F.size(v)))
    )
    return stacked.withColumn(out, padded).withColumn(
        "valid_lengths", F.transform("_s", lambda v: F.size(v))
    ).drop("_s", "_w")


def unbatchify(df: DataFrame, batch: list[str], stack: str, pos: str = "batch_pos", out: str = "value") -> DataFrame:
    return df.select(*batch, F.posexplode(stack).alias(pos, out))


def unpad(df: DataFrame, value: str, valid: str) -> DataFrame:
    return df.withColumn(value, F.slice(value, F.lit(1), F.col(valid)))


def split_batch(df: DataFrame, slices: int, even: bool, size: str = "size", pos: str = "batch_pos") -> DataFrame:
    """``slice_id`` and ``slice_pos`` for min(slices, size) slices of each batch."""
    parts = F.least(F.lit(slices), F.col(size))
    uneven = F.raise_error(F.lit("batch size is not a multiple of the slices"))
    step = F.ceil(F.col(size) / parts)
    if even:
        step = F.when(F.pmod(F.col(size), parts) != 0, uneven.cast("bigint")).otherwise(step)
    return (
        df.withColumn("_step", step)
        .withColumn("slice_id", F.floor(F.col(pos) / F.col("_step")).cast("bigint"))
        .withColumn("slice_pos", F.pmod(F.col(pos), F.col("_step")).cast("bigint"))
        .drop("_step")
    )


def replay_buffer(
    df: DataFrame, order_by: str, capacity: int, draws: int, seed
) -> DataFrame:
    """``draws`` rows drawn with replacement from the ``capacity`` most recent ones."""
    recent = row_index(df.orderBy(F.desc(order_by)).limit(capacity), order_by, "slot")
    kept = materialize(recent, "replay")
    held = kept.agg(F.count("*")).scalar()
    picks = df.sparkSession.range(draws).select(
        F.col("id").alias("draw"),
        F.pmod(keyed_hash(seed, "id"), held).alias("slot"),
    )
    return picks.join(kept, "slot")


