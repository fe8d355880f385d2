"""Global order without a single-task window.

Rows of a DataFrame have no position. Three mechanisms give them one, and none
of them sends more than one range of the data through a task:

* ``row_index`` / ``prefix_sum``: range-partition by the order key, sort inside
  the partitions, number and sum the rows in the same tasks that write the result
  (which freezes the layout), then add one offset per partition. Those tasks also
  compare each key with the one before it, which proves the key unique.
* ``group_rank`` / ``group_prefix_sum``: the same over (group, order), so a group
  holding a third of all rows is spread over many tasks. The rows move once.
* ``random_rank``: the order is a uniform keyed hash, so equal-width hash
  buckets are balanced by construction; needs one counting pass and no write.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomframe.core.keyed import HASH_BITS, keyed_hash
from loomframe.core.session import materialize

def literal_array(values: Sequence, element_type: str) -> Column:
    """A constant-folded array literal (one plan node whatever its length)."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element_type}>")


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when ``keys`` does not identify a row; order-dependent operators need it."""
    clash = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    if not clash.isEmpty():
        raise ValueError(f"order key {list(keys)} is not unique")


def _order_columns(order_by) -> list:
    return [order_by] if isinstance(order_by, (str, Column)) else list(order_by)


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls equal each other, and so do NaNs."""
    a, b = column[:-1], column[1:]
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([x != y for x, y in zip(values, values[1:])], bool)
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        other &= ~(pc.fill_null(pc.is_nan(a), False).to_numpy(zero_copy_only=False) & pc.fill_null(pc.is_nan(b), False).to_numpy(zero_copy_only=False))
    return other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _changes(columns: list[pa.Array], before: list[pa.Array] | None) -> np.ndarray:
    """Whether each row's values differ from those of the row before it; ``before`` are the last values of an earlier batch."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    for i, column in enumerate(columns):
        joined = column if before is None else pa.concat_arrays([before[i], column])
        out[1 if before is None else 0 :] |= _differs(joined)
    if before is None:
        out[:1] = True
    return out


_SCANNED = [("_scan_pid", T.LongType()), ("_scan_pos", T.LongType()), ("_scan_rank", T.LongType()), ("_scan_sum", T.DoubleType()), ("_scan_opens", T.BooleanType()), ("_scan_edge", T.IntegerType())]
_FIRST, _LAST = 1, 2


def _freeze_range(df: DataFrame, order_by, group: Sequence[str] = (), value: str | None = None, unique: bool = True) -> DataFrame:
    """Range-partition, sort, scan and write in one pass.

    Beside its columns a row gets the partition and its place there (``_scan_pid``, ``_scan_pos``),
    its place in its group's run and the running sum of ``value`` over the run within
    the partition (``_scan_rank``, ``_scan_sum``; null before the first value), whether that run opens the partition
    (``_scan_opens``), and whether the row is the partition's first or last (``_scan_edge``). A
    neighbour with the same key is an error if the key must be unique; a key with
    sort expressions in it isn't checked.
    """
    order = _order_columns(order_by)
    cols = [*group, *order]
    keys = [df.columns.index(c) for c in [*group, *order]] if unique and all(isinstance(c, str) for c in order) else []
    groups = [df.columns.index(c) for c in group]
    number = "_number"
    while number in df.columns:
        number = f"_{number}"
    frame = df.withColumn(number, F.col(value).cast("double")) if value else df
    width, sums_wanted = len(df.columns), value is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        pos, rank, total, seen, opens = 0, 0, 0.0, 0, True
        last_keys = last_groups = held = None

        def marked(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] += _FIRST * (batch.column("_scan_pos")[0].as_py() == 0)
            edge[-1] += _LAST * last
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(edge)], [*batch.schema.names, "_scan_edge"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if keys:
                columns = [batch.column(i) for i in keys]
                if not _changes(columns, last_keys).all():
                    raise ValueError(f"order key {[batch.schema.names[i] for i in keys]} is not unique")
                last_keys = [c.slice(n - 1, 1) for c in columns]
            at = np.arange(n)
            start = np.full(n, -1)
            if groups:
                columns = [batch.column(i) for i in groups]
                changed = _changes(columns, last_groups)
                if last_groups is None:
                    changed[0] = False  # the run that opens the partition
                last_groups = [c.slice(n - 1, 1) for c in columns]
                start = np.maximum.accumulate(np.where(changed, at, -1))
            inside = start < 0
            ranks = np.where(inside, at + rank, at - start)
            made = [pa.array(np.full(n, pid)), pa.array(pos + at), pa.array(ranks)]
            if sums_wanted:
                x = batch.column(number)
                valid = x.is_valid().to_numpy(zero_copy_only=False)
                v = np.where(valid, x.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
                sums, counts = _run_sums(v, start, total), _run_sums(valid.astype(float), start, float(seen))
                made.append(pa.array(sums, mask=counts == 0))
                total, seen = sums[-1], int(counts[-1])
            else:
                made.append(pa.nulls(n, pa.float64()))
            made.append(pa.array(inside & opens))
            opens = opens and bool(inside[-1])
            pos, rank = pos + n, int(ranks[-1]) + 1
            kept = batch.columns[:width]
            if held is not None:
                yield marked(held, False)
            held = pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:width], *[name for name, _ in _SCANNED[:-1]]])
        if held is not None:
            yield marked(held, True)

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in _SCANNED]])
    return materialize(frame.repartitionByRange(*cols).sortWithinPartitions(*cols).mapInArrow(run, schema), "range")


def _run_sums(v: np.ndarray, start: np.ndarray, carried: float) -> np.ndarray:
    """Running sums that begin anew at each run; ``start`` is a row's run's first row, or -1 for the run that was carried in."""
    out = np.cumsum(v)
    if (start < 0).any():
        first = int((start < 0).sum())
        out[:first] += carried
    else:
        first = 0
    # a run's own sums, so that large sums before it cost no precision
    edges = np.flatnonzero(start[first:] == np.arange(first, len(v))) + first
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(v)]):
        out[a:b] = np.cumsum(v[a:b])
    return out


def _offsets(stats: dict[int, float | int], zero) -> list:
    """Exclusive prefix sums indexed by partition id (one number per partition)."""
    if not stats:
        return [zero]
    dense = [stats.get(i, zero) for i in range(max(stats) + 1)]
    return [zero, *accumulate(dense)][: len(dense)]


def _at(offsets: list, element_type: str, position: Column) -> Column:
    return F.get(literal_array(offsets, element_type), position.cast("int"))


def _without_scan(df: DataFrame) -> DataFrame:
    return df.drop(*[name for name, _ in _SCANNED])


def _edges(frozen: DataFrame, edge: int, *columns) -> list:
    """The first or last row of each partition: one row a partition reaches the driver."""
    return frozen.filter(F.col("_scan_edge").bitwiseAND(edge) > 0).select("_scan_pid", *columns).orderBy("_scan_pid").collect()


def row_index(df: DataFrame, order_by, name: str = "idx", unique: bool = True) -> DataFrame:
    """Append the 0-based position of each row in ``order_by``.

    Two rows with one key are an error unless ``unique`` is off: then they are
    numbered anyhow.
    """
    frozen = _freeze_range(df, order_by, unique=unique)
    counts = {r._scan_pid: r._scan_pos + 1 for r in _edges(frozen, _LAST, "_scan_pos")}
    offset = _at(_offsets(counts, 0), "bigint", F.col("_scan_pid"))
    return _without_scan(frozen.withColumn(name, offset + F.col("_scan_pos")))


def prefix_sum(df: DataFrame, value: str, order_by, name: str = "running", unique: bool = True) -> DataFrame:
    """Inclusive running sum of ``value`` over the whole table in ``order_by``; nulls add nothing."""
    frozen = _freeze_range(df, order_by, value=value, unique=unique)
    sums = {r._scan_pid: r._scan_sum or 0.0 for r in _edges(frozen, _LAST, "_scan_sum")}
    offset = _at(_offsets(sums, 0.0), "double", F.col("_scan_pid"))
    return _without_scan(frozen.withColumn(name, offset + F.coalesce("_scan_sum", F.lit(0.0))))


def _carries(frozen: DataFrame, group: Sequence[str], measure: Column) -> dict[int, float]:
    """What earlier partitions hold of the group whose run opens each partition; None if nothing.

    Only the first and last run of a partition can span partitions.
    """
    key = F.to_json(F.struct(*group)).alias("key")
    first = {r._scan_pid: r.key for r in _edges(frozen, _FIRST, key)}
    carries: dict[int, float] = {}
    open_key, open_m = None, None
    for r in _edges(frozen, _LAST, key, "_scan_opens", measure.alias("m")):
        carries[r._scan_pid] = open_m if first[r._scan_pid] == open_key else None
        inherited = carries[r._scan_pid] if r._scan_opens else None
        open_key, open_m = r.key, r.m if inherited is None else inherited + (r.m or 0)
    return carries


def _carried(frozen: DataFrame, group: Sequence[str], measure: Column, element_type: str) -> Column:
    carries = _carries(frozen, group, measure)
    dense = [carries.get(i) for i in range(max(carries, default=0) + 1)]
    return F.when(F.col("_scan_opens"), _at(dense, element_type, F.col("_scan_pid")))


def group_rank(df: DataFrame, group: Sequence[str], order_by, name: str = "rank", unique: bool = True) -> DataFrame:
    """Append the 0-based position of each row inside its group, skew-safe; keys as for ``row_index``."""
    if not group:
        return row_index(df, order_by, name, unique)
    frozen = _freeze_range(df, order_by, group, unique=unique)
    carry = _carried(frozen, group, F.col("_scan_rank") + 1, "bigint")
    return _without_scan(frozen.withColumn(name, F.col("_scan_rank") + F.coalesce(carry, F.lit(0))))


def group_prefix_sum(
    df: DataFrame, value: str, group: Sequence[str], order_by, name: str = "running", unique: bool = True
) -> DataFrame:
    """Inclusive running sum of ``value`` inside each group, skew-safe; null before a group's first value."""
    frozen = _freeze_range(df, order_by, group, value, unique)
    carry = _carried(frozen, group, F.col("_scan_sum"), "double")
    both = F.coalesce(F.col("_scan_sum") + carry, F.col("_scan_sum"), carry)
    return _without_scan(frozen.withColumn(name, both))


def hash_bucket(hashed: Column, bits: int) -> Column:
    return F.shiftright(hashed, HASH_BITS - bits)


def bucket_counts(df: DataFrame, hash_col: str, bits: int) -> list[int]:
    """Rows per hash bucket: 2^bits numbers, whatever the size of ``df``."""
    rows = (
        df.select(hash_bucket(F.col(hash_col), bits).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    found = {r.b: r.n for r in rows}
    return [found.get(i, 0) for i in range(1 << bits)]


def _hash_bits(rows: int, bucket_rows: int = 1_000_000) -> int:
    """Enough hash buckets for about a million rows each, 64 to 65,536 of them."""
    return min(max((rows // bucket_rows).bit_length(), 6), 16)


def random_rank(
    df: DataFrame, seed, key: Sequence[str], name: str = "rank", bits: int | None = None, bucket_rows: int = 1_000_000
) -> DataFrame:
    """Append each row's 0-based position in a seeded random permutation; a task sorts about ``bucket_rows`` at a time."""
    key = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_h", keyed_hash(seed, *key))
    bits = bits or _hash_bits(df.count(), bucket_rows)
    counts = bucket_counts(hashed, "_h", bits)
    starts = [0, *accumulate(counts)][:-1]
    bucket = hash_bucket(F.col("_h"), bits)
    inside = Window.partitionBy("_b").orderBy("_h", *key)
    return (
        hashed.withColumn("_b", bucket)
        .withColumn(name, F.row_number().over(inside) - 1 + _at(starts, "bigint", F.col("_b")))
        .drop("_h", "_b")
    )


def blocked(
    df: DataFrame, position: str, group: Sequence[str], before: int, after: int, size: int = 65536
) -> DataFrame:
    """Cut each group's positions into blocks with a halo, for sliding windows.

    A window over ``[*group, "_block"]`` then sees ``before`` earlier and
    ``after`` later rows of every row it owns (``_owned``), while no task gets
    more than ``size + before + after`` rows of one group at a time.
    """
    if size <= max(before, after):
        size = max(before, after) + 1
    own = F.floor(F.col(position) / size)
    offset = F.pmod(F.col(position), F.lit(size))
    copies = F.array_compact(
        F.array(
            own,
            F.when((F.lit(after) > 0) & (offset < after) & (own > 0), own - 1),
            F.when((F.lit(before) > 0) & (offset >= size - before), own + 1),
        )
    )
    return df.withColumn("_block", F.explode(copies)).withColumn(
        "_owned", F.col("_block") == own
    )
