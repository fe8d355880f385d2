"""Shape changes, matrix products and creation.

A matrix is a table with one row vector per row, or the long form
(row, col, value). Shape changes are arithmetic on coordinates; products of two
distributed matrices are block joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.core.arrow import blocks, matrix, vectors
from loomframe.core.keyed import keyed_normal, keyed_uniform
from loomframe.core.session import materialize


def to_long(df: DataFrame, row: str, vector: str) -> DataFrame:
    return df.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "v")).select(
        "i", F.col("j").cast("bigint").alias("j"), "v"
    )


def to_rows(long: DataFrame, out: str = "v") -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("j", "v")))
    return long.groupBy("i").agg(F.transform(pairs, lambda s: s["v"]).alias(out))


def flatten(long: DataFrame, width: int) -> DataFrame:
    return long.select((F.col("i") * width + F.col("j")).alias("pos"), "v")


def reshape(long: DataFrame, width: int, shape: Sequence[int], size: Column | None = None) -> DataFrame:
    """Long matrix of ``width`` columns to coordinates ``d0, d1, …`` of ``shape``.

    A leading -1 needs nothing; a -1 elsewhere is inferred from ``size``.
    """
    shape = list(shape)
    if shape.count(-1) > 1:
        raise ValueError("only one dimension can be inferred")
    known = int(np.prod([s for s in shape if s != -1]))
    dims = [size / known if s == -1 and i else F.lit(s) for i, s in enumerate(shape)]
    flat = F.col("i") * width + F.col("j")
    out = []
    for i in range(len(shape)):
        inner = F.lit(1)
        for d in dims[i + 1 :]:
            inner = inner * d
        at = F.floor(flat / inner)
        out.append((at if i == 0 else F.pmod(at, dims[i].cast("bigint"))).cast("bigint").alias(f"d{i}"))
    return long.select(*out, "v")


def transpose(long: DataFrame) -> DataFrame:
    return long.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def flip(long: DataFrame, rows: Column | None = None, cols: int | None = None) -> DataFrame:
    """Reverse the rows (given their number) and/or the columns."""
    i = rows - 1 - F.col("i") if rows is not None else F.col("i")
    j = F.lit(cols) - 1 - F.col("j") if cols is not None else F.col("j")
    return long.select(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), "v")


def rotate90(long: DataFrame, rows: Column, cols: int, times: int = 1) -> DataFrame:
    """Counter-clockwise rotations in the (row, column) plane."""
    i, j = F.col("i"), F.col("j")
    last_row, last_col = rows - 1, F.lit(cols) - 1
    new = {0: (i, j), 1: (last_col - j, i), 2: (last_row - i, last_col - j), 3: (j, last_row - i)}[times % 4]
    return long.select(new[0].cast("bigint").alias("i"), new[1].cast("bigint").alias("j"), "v")


def split_vector(v: Column, width: int, sections: int | Sequence[int]) -> list[Column]:
    """Equal sections (error if not divisible) or sections at the given positions."""
    if isinstance(sections, int):
        if width % sections:
            raise ValueError(f"{width} columns do not divide into {sections} sections")
        cuts = list(range(0, width, width // sections))
    else:
        cuts = [0, *sections]
    ends = [*cuts[1:], width]
    return [F.slice(v, a + 1, b - a) for a, b in zip(cuts, ends)]


def tile_rows(df: DataFrame, idx: str, times: int, size: Column) -> DataFrame:
    copies = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn(idx, F.col("_c") * size + F.col(idx)).drop("_c")


def repeat_rows(df: DataFrame, idx: str, times: int) -> DataFrame:
    copies = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn(idx, F.col(idx) * times + F.col("_c")).drop("_c")


def nonzero(long: DataFrame) -> DataFrame:
    return long.filter(F.col("v") != 0).select("i", "j")


def to_sparse(df: DataFrame, row: str, vector: str, form: str = "coo") -> DataFrame:
    """coo: (i, j, v); csr: (i, indices, values); row: rows that hold a non-zero."""
    if form == "coo":
        return to_long(df, row, vector).filter(F.col("v") != 0)
    entries = F.filter(F.transform(vector, lambda x, j: F.struct(j.alias("j"), x.alias("v"))), lambda s: s["v"] != 0)
    if form == "csr":
        return df.select(
            F.col(row).alias("i"),
            F.transform(entries, lambda s: s["j"]).alias("indices"),
            F.transform(entries, lambda s: s["v"]).alias("values"),
        )
    if form == "row":
        return df.filter(F.exists(vector, lambda x: x != 0))
    raise ValueError(f"unknown sparse form {form!r}")


def to_dense(coo: DataFrame, width: int, out: str = "v") -> DataFrame:
    """(i, j, v) to full rows; a row is an array of ``width``, absent entries 0."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1)
            rows = np.zeros((len(cells), width))
            flat = cells.flatten()
            at = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy(zero_copy_only=False)))
            rows[at, flat.field("j").to_numpy(zero_copy_only=False)] = flat.field("v").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors(rows)], ["i", out])

    grouped = coo.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("_c"))
    return grouped.mapInArrow(scatter, f"i {dict(coo.dtypes)['i']}, `{out}` array<double>")


def gram(df: DataFrame, vector: str, other: str | None = None) -> DataFrame:
    """X^T Y of two row-vector columns: rows (i, j, v).

    Each task folds its Arrow batches into one small matrix, so the shuffle
    carries one partial matrix per task whatever the number of rows.
    """
    other = other or vector

    def partial(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = matrix(batch["_x"]).T @ matrix(batch["_y"])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            cells = [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "v"])

    pairs = df.select(F.col(vector).alias("_x"), F.col(other).alias("_y"))
    parts = pairs.mapInArrow(partial, "i bigint, j bigint, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


#: Cells of the products that a task holds at a time.
PRODUCT_CELLS = 1 << 20


def inner_splits(left: DataFrame, right: DataFrame, keys: Sequence[str], tasks: int) -> dict[int, int]:
    """Hash of the inner block to the number of parts its tile pairs are dealt in; blocks of one part are left out.

    A block with more than 1 / ``tasks`` of all tile pairs is split; there are fewer
    than ``tasks`` of those, and only they come to the driver.
    """
    of = lambda m, name: m.groupBy(*keys).agg(F.count("*").alias(name))
    met = of(left, "_l").join(of(right, "_r"), list(keys)).select(
        F.xxhash64(*keys).alias("k"), (F.col("_l").cast("double") * F.col("_r")).alias("pairs"), F.greatest("_l", "_r").alias("most")
    )
    part = met.agg(F.sum("pairs") / tasks).scalar()
    parts = F.least(F.ceil(F.col("pairs") / part), F.col("most"), F.lit(tasks)).cast("int")
    return {r.k: r.n for r in met.filter(F.col("pairs") > part).select("k", parts.alias("n")).collect() if r.n > 1}


def mat_mul(a: DataFrame, b: DataFrame, block: int = 64, batch: Sequence[str] = (), sparse: bool = False) -> DataFrame:
    """Product of two long matrices, optionally one per batch key.

    Every cell of a row of ``a`` and a column of ``b`` comes out, zeros included;
    ``sparse`` leaves out the cells whose value is zero. Cells of one position add up
    only across inner blocks, so (i, j) must not repeat.

    Cells are packed into ``block`` x ``block`` tiles that meet in one join on the
    inner block index. An inner block that holds a large share of all tile pairs is
    dealt in parts: tiles of the side that has more go each to one part, those of the
    other side to all. Tasks multiply stacks of tile pairs and return cells.
    """
    batch = list(batch)
    keys = [*batch, "_inner"]

    def tiles(m: DataFrame, name: str, inner: str, outer: str, out: str) -> DataFrame:
        cells = F.collect_list(
            F.struct(F.pmod(F.col("i"), F.lit(block)).alias("r"), F.pmod(F.col("j"), F.lit(block)).alias("c"), "v")
        )
        at = [F.floor(F.col(inner) / block).alias("_inner"), F.floor(F.col(outer) / block).alias(out)]
        return materialize(m.groupBy(*batch, *at).agg(cells.alias(name)), "tiles")

    left, right = tiles(a, "_a", "j", "i", "_row"), tiles(b, "_b", "i", "j", "_col")
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = inner_splits(left, right, keys, tasks)
    if splits:
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kn in splits.items() for x in kn]), F.xxhash64(*keys)), F.lit(1))
        dealt = lambda m, out: m.withColumn("_part", F.pmod(F.xxhash64(out), parts))
        copied = lambda m: m.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
        if left.count() >= right.count():
            left, right = dealt(left, "_row"), copied(right)
        else:
            left, right = copied(left), dealt(right, "_col")
        keys.append("_part")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PRODUCT_CELLS // (block * block))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                x, has_row = blocks(part["_a"], block, "r")
                y, has_col = blocks(part["_b"], block, "c")
                which, r, c = np.nonzero(has_row[:, :, None] & has_col[:, None, :])
                row, col = (part[name].to_numpy()[which] * block for name in ("_row", "_col"))
                of = pa.array(which)
                cells = [pa.array(row + r), pa.array(col + c), pa.array((x @ y)[which, r, c])]
                yield pa.RecordBatch.from_arrays([*(part[k].take(of) for k in batch), *cells], [*batch, "i", "j", "v"])

    kinds = dict(a.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in batch), "i bigint, j bigint, v double"])
    joined = left.join(right, keys).select(*batch, "_row", "_col", "_a", "_b")
    out = joined.mapInArrow(products, schema).groupBy(*batch, "i", "j").agg(F.sum("v").alias("v"))
    return out.filter(F.col("v") != 0) if sparse else out


def mat_vec(df: DataFrame, vector: str, weights, out: str, bias=None) -> DataFrame:
    """x . W^T + b per row for weights that fit a task: one product per Arrow batch."""
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(len(w)) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.arrow_udf("array<double>")
    def product(x: pa.Array) -> pa.Array:
        return vectors(matrix(x).reshape(len(x), w.shape[1]) @ w.T + b)

    # a generator over the result would let the optimizer run the product once more in a filter
    return df.withColumn(out, product.asNondeterministic()(F.col(vector)))


# creation ---------------------------------------------------------------------------
def constant(df: DataFrame, value: float, width: int | None = None, name: str = "v") -> DataFrame:
    """A constant column, or constant row vectors, shaped like ``df``."""
    x = F.lit(float(value))
    return df.withColumn(name, x if width is None else F.array_repeat(x, width))


def arange(idx: str, start: float, step: float) -> Column:
    return F.lit(start) + F.col(idx) * F.lit(step)


def linspace(idx: str, start: float, stop: float, size: Column, endpoint: bool = True) -> Column:
    steps = size - 1 if endpoint else size
    return F.lit(start) + F.col(idx) * (F.lit(float(stop) - float(start)) / steps)


def eye_row(idx: str, width: int, k: int = 0) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.when(j == F.col(idx) + k, F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def truncated_normal(seed, *keys, sigma: float = 1.0, redraws: int = 16) -> Column:
    """Normal draws within two sigma: the first of several keyed draws that fits; all sixteen miss with probability 3e-22."""
    draws = [keyed_normal(f"{seed}/{i}", *keys) for i in range(redraws)]
    out = F.lit(0.0)
    for d in reversed(draws):
        out = F.when(F.abs(d) <= 2.0, d).otherwise(out)
    return out * F.lit(float(sigma))


def xavier_scale(fan_in: int, fan_out: int, factor: str = "avg", magnitude: float = 3.0) -> float:
    by = {"avg": (fan_in + fan_out) / 2.0, "in": float(fan_in), "out": float(fan_out)}[factor]
    return float(np.sqrt(magnitude / by))


def xavier(seed, *keys, fan_in: int, fan_out: int, factor: str = "avg", magnitude: float = 3.0, normal: bool = False) -> Column:
    scale = xavier_scale(fan_in, fan_out, factor, magnitude)
    if normal:
        return keyed_normal(seed, *keys) * F.lit(scale)
    return (keyed_uniform(seed, *keys) * 2.0 - 1.0) * F.lit(scale)


def multinomial(draws: DataFrame, probabilities: Sequence[float], seed, *keys) -> DataFrame:
    """Counts per class of one draw per row of ``draws``."""
    total = float(sum(probabilities))
    upper = np.cumsum([p / total for p in probabilities])
    u = keyed_uniform(seed, *keys)
    cls = F.lit(len(upper) - 1)
    for i in range(len(upper) - 2, -1, -1):
        cls = F.when(u < float(upper[i]), F.lit(i)).otherwise(cls)
    return draws.groupBy(cls.cast("bigint").alias("class")).agg(F.count("*").alias("n"))


def shape_of(df: DataFrame, vector: str) -> DataFrame:
    """Rows, narrowest and widest vector, element count, emptiness, raggedness."""
    return df.agg(
        F.count("*").alias("rows"),
        F.min(F.size(vector)).cast("bigint").alias("min_width"),
        F.max(F.size(vector)).cast("bigint").alias("max_width"),
        F.coalesce(F.sum(F.size(vector)), F.lit(0)).cast("bigint").alias("size"),
    ).withColumns(
        {
            "empty": F.col("size") == 0,
            "ragged": F.coalesce(F.col("min_width") != F.col("max_width"), F.lit(False)),
        }
    )
