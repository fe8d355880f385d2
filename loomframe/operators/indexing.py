"""Index expressions: rows by a global index column, columns by array position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions import vectors as V

Axis = "int | slice | list[int] | None"


def as_axis(part):
    """'3' -> 3, 'a:b:s' -> slice, '*' or ':' -> everything; Python objects pass."""
    if not isinstance(part, str):
        return part
    part = part.strip()
    if part in ("*", ":", "..."):
        return slice(None)
    if ":" not in part:
        return int(part)
    return slice(*[int(b) if b.strip() else None for b in part.split(":")])


def _count(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def row_selector(df: DataFrame, idx: str, axis) -> Column:
    """A predicate on the index column; only open or negative bounds need the row count."""
    at = F.col(idx)
    axis = as_axis(axis)
    if axis is None:
        return F.lit(True)
    if isinstance(axis, int):
        return at == (F.lit(axis) if axis >= 0 else _count(df) + F.lit(axis))
    if isinstance(axis, slice):
        step = axis.step or 1
        if step < 0:
            raise ValueError("rows are selected in index order; use flip for a negative step")
        start, stop = axis.start or 0, axis.stop
        low = F.lit(start) if start >= 0 else _count(df) + F.lit(start)
        keep = at >= low
        if stop is not None:
            keep = keep & (at < (F.lit(stop) if stop >= 0 else _count(df) + F.lit(stop)))
        return keep & (F.pmod(at - low, F.lit(step)) == 0) if step != 1 else keep
    return at.isin([int(i) for i in axis])


def column_selector(v: Column, axis) -> Column:
    axis = as_axis(axis)
    if axis is None:
        return v
    if isinstance(axis, int):
        return F.element_at(v, axis + 1 if axis >= 0 else axis)
    if isinstance(axis, slice):
        return V.slice_range(v, axis.start, axis.stop, axis.step or 1) if axis != slice(None) else v
    return F.array(*[F.element_at(v, i + 1 if i >= 0 else i) for i in axis])


def index_get(df: DataFrame, index, idx: str = "idx", vector: str | None = None) -> DataFrame:
    """``index`` is one axis or a (rows, columns) pair; strings such as '2:-1:3, 4' work too."""
    if isinstance(index, str):
        index = tuple(index.split(","))
    rows, cols = (index if len(index) == 2 else (index[0], None)) if isinstance(index, tuple) else (index, None)
    picked = df.filter(row_selector(df, idx, rows))
    if cols is not None and vector is not None:
        picked = picked.withColumn(vector, column_selector(F.col(vector), cols))
    return picked


def boolean_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.filter(mask)


def slice_axis(df: DataFrame, start: int, stop: int, idx: str = "idx") -> DataFrame:
    return df.filter((F.col(idx) >= start) & (F.col(idx) < stop))


def gather(df: DataFrame, positions: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows named by ``positions(slot, idx)``, repeats kept, ordered by slot."""
    return positions.join(df, idx)


def gather_list(df: DataFrame, positions: Sequence[int], idx: str = "idx") -> DataFrame:
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(positions)), f"slot long, {idx} long")
    return gather(df, F.broadcast(table), idx)


def index_set(df: DataFrame, column: str, selector: Column, value) -> DataFrame:
    """A new frame where the selected positions hold ``value`` (scalar, column or function)."""
    new = value(F.col(column)) if callable(value) and not isinstance(value, Column) else value
    new = new if isinstance(new, Column) else F.lit(new)
    return df.withColumn(column, F.when(selector, new).otherwise(F.col(column)))
