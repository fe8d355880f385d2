"""Near duplicates among embeddings: all pairs in blocks, or passes of random projections.

All pairs are compared in blocks, unless a caller asks for passes. A pass gives each vector a code, the signs of ``prefix`` random projections, and
compares all vectors of one code with each other, in blocks. Whether two vectors
share a code depends on the angle between them alone, not on what lies around
them, so a number of independent passes, taken from ``prefix``, brings each pair
at the threshold together with probability ``recall`` in at least one, in a dense
region as in a sparse one. ``prefix`` is the one of least work: a sample tells
how many pairs share a code of each length. With 0 all pairs are compared, once.

A block pair hands on a spanning forest of its links, not the pairs. All links of
a vector lie inside its component, so the components that the passes find are
then compared whole, in blocks, and their links counted without writing out pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.common import Scratch
from loomframe.llm.components import components

#: Longest code.
BITS = 40
#: Rows of a block: at most the last, fewer where a table would fill less than ``SPREAD`` of them.
LEAST_ROWS, GROUP_ROWS, SPREAD = 64, 8192, 16
#: Pairs that can be compared while a row is dealt out once.
ROW_COST = 2000
SAMPLE_ROWS, PROBES, PROBE_FROM = 100_000, 4, 1 << 20
_CODED = "pass int, width int, code long, id long, v {v}"


def passes_for(prefix: int, at_least: float, recall: float) -> int | None:
    """Passes after which a pair at the threshold has shared a code with probability ``recall``; None if it never does."""
    same = 1 - math.acos(max(-1.0, min(1.0, at_least))) / math.pi
    met = same**prefix
    if met >= recall:
        return 1
    return math.ceil(math.log(1 - recall) / math.log1p(-met)) if met > 1e-9 else None


def cheapest_prefix(rows: int, sharing: dict[int, float], at_least: float, recall: float) -> int:
    """The code length of least work, given the share of all pairs that have equal codes of each length."""
    work = {}
    for prefix, share in sharing.items():
        number = passes_for(prefix, at_least, recall)
        if number is not None:
            pairs = share * rows * rows / 2
            work[prefix] = number * (ROW_COST * (rows + 2 * pairs / GROUP_ROWS) + pairs)
    return min(work, key=lambda p: (work[p], p))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _codes(passes: list[int], prefix: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                x = _matrix(part.column(2)).astype(np.float64)
                for p in passes:
                    planes = np.random.default_rng([seed, p, width]).standard_normal((width, prefix))
                    signs = (x @ planes > 0).astype(np.int64)
                    code = signs @ (1 << np.arange(prefix - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), p), pa.int32()), part.column(1), pa.array(code, pa.int64()), part.column(0), part.column(2)],
                        ["pass", "width", "code", "id", "v"],
                    )

    return run


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows, one batch for each value of the first ``width`` columns."""
    key, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in range(width)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            now = tuple(keys[:, a].tolist())
            if key is not None and now != key:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (left, right) that connect what the cells of ``close`` connect: fewer than it has rows and columns."""
    left, right = [], []
    new_left, new_right = close.any(axis=1), close.any(axis=0)
    for start in np.flatnonzero(new_left).tolist():
        if not new_left[start]:
            continue
        new_left[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(close[i] & new_right)
            new_right[found] = False
            left.append(np.full(len(found), i))
            right.append(found)
            for j in found.tolist():
                back = np.flatnonzero(close[:, j] & new_left)
                new_left[back] = False
                left.append(back)
                right.append(np.full(len(back), j))
                todo.extend(back.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _linked(at_least: float) -> Callable:
    """Links that connect the close rows of each group, in groups sorted by (width, code, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 4):
            block, i, j = rows.column(4).to_numpy(), rows.column(2)[0].as_py(), rows.column(3)[0].as_py()
            ids, x = rows.column(5).to_numpy(), _unit(_matrix(rows.column(6)).astype(np.float64))
            left, right = (np.flatnonzero(block == b) for b in (i, j))
            close = np.zeros((len(left), len(right)), bool)
            for at in range(0, len(left), 512):
                close[at : at + 512] = x[left[at : at + 512]] @ x[right].T >= at_least
            if i == j:
                np.fill_diagonal(close, False)
            if np.count_nonzero(close) <= len(ids):
                a, b = np.nonzero(close)
            else:
                a, b = _forest(close)
            yield pa.RecordBatch.from_arrays([pa.array(ids[left[a]]), pa.array(ids[right[b]])], ["a", "b"])

    return run


def _count_links(at_least: float) -> Callable:
    """Links of each row in groups sorted by (root, i, j, width, slot); weights are how often a vector occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 4):
            block, i, j = rows.column(4).to_numpy(), rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
            weight, x = rows.column(6).to_numpy(), _unit(_matrix(rows.column(7)).astype(np.float64))
            links = np.zeros(rows.num_rows, np.int64)
            left, right = (np.flatnonzero(block == b) for b in (i, j))
            for at in np.array_split(left, 1 + len(left) // 1024):
                close = x[at] @ x[right].T >= at_least
                if i == j:
                    close[at[:, None] == right[None, :]] = False
                else:
                    links[right] += weight[at] @ close
                links[at] += close @ weight[right]
            yield pa.RecordBatch.from_arrays([rows.column(5), pa.array(links)], ["key", "links"])

    return run


def _in_blocks(rows: DataFrame, group: list[str], block_rows: int, out: list[str]) -> DataFrame:
    """Each row once for every pair (i, j) of blocks of its group that has its own; ``members`` is the size of a large group."""
    blocks = F.coalesce(F.ceil(F.col("members") / block_rows).cast("int"), F.lit(1))
    return (
        rows.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *out)
    )


def _sharing(vectors: DataFrame, total: int, seed: int) -> dict[int, float]:
    """The share of all pairs whose codes of each length are equal, from a sample of the vectors."""
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    some = vectors.filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).select("id", "width", "v")
    probes = [PROBE_FROM + p for p in range(PROBES)]
    codes = some.mapInArrow(_codes(probes, BITS, seed), _CODED.format(v=dict(vectors.dtypes)["v"]))
    same = (
        codes.select("pass", "width", "code", F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("prefix"))
        .withColumn("code", F.expr(f"shiftright(code, {BITS} - prefix)"))
        .groupBy("pass", "prefix", "width", "code").agg(F.count("*").alias("n"))
        .groupBy("prefix").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
        .collect()
    )
    return {r.prefix: r.pairs / max(r.n * (r.n / PROBES - 1), 1) for r in same}


def _usable(column: str) -> Column:
    fine = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(column, lambda x: x != 0), F.lit(False))


def near_duplicates(
    rows: DataFrame, id_col: str, vec_col: str, at_least: float = 0.9, recall: float = 0.99, prefix: int | None = 0, seed: int = 11
) -> DataFrame:
    """``(id, n_links, component_id, kept)``: one row per row.

    Rows link when the cosine of their vectors, in double precision, is at least
    ``at_least``; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` marks that row. A
    vector that is null, empty, zero or holds a null or non-finite component links
    with nothing, and vectors of different length do not link. Equal vectors are
    compared once and count as often as they occur; repeated rows (same id and
    vector) count once and give equal rows. A row without an id links with nothing
    and has a null component; an id with several vectors joins what each links to.
    All pairs of vectors are compared, in blocks, whatever their number, so every link
    is found. A ``prefix`` above 0 sets the length of the codes instead, and None
    the one of least work: then a link is found with probability ``recall`` or more.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    # floats stay floats until a task compares them, in double precision
    v_type = "array<float>" if dict(rows.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = F.when(F.col(id_col).isNotNull() & _usable(vec_col), F.col(vec_col).cast(v_type))
    keyed = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).withColumn(
        # two hashes stand for a vector; 128 bits do not meet by chance
        "key", F.when(F.col("v").isNotNull(), F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), "v"))))
    )
    classes = scratch.write(
        keyed.filter("key is not null").groupBy("key", "id").agg(F.first("v").alias("v"))
        .groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")),
        "vectors",
    )
    vectors = classes.select(F.col("rep").alias("id"), F.size("v").alias("width"), "v", "key")
    total = classes.count()
    block_rows = min(GROUP_ROWS, max(LEAST_ROWS, math.ceil(total / SPREAD)))
    if prefix is None:
        prefix = cheapest_prefix(total, _sharing(vectors, total, seed), at_least, recall)
    number = passes_for(prefix, at_least, recall)
    if number is None:
        raise ValueError(f"vectors at cosine {at_least} do not share codes of {prefix} signs")
    links = []
    for p in range(number):
        coded = vectors.select("id", "width", "v").mapInArrow(_codes([p], prefix, seed), _CODED.format(v=v_type))
        large = coded.groupBy("width", "code").agg(F.count("*").alias("members")).filter(F.col("members") > block_rows)
        # there is at most one large code for block_rows rows
        large = scratch.write(large, "large")
        placed = _in_blocks(
            coded.withColumn("key", F.col("id")).join(F.broadcast(large), ["width", "code"], "left"), ["width", "code"], block_rows, ["block", "id", "v"]
        )
        found = (
            placed.repartition("width", "code", "i", "j").sortWithinPartitions("width", "code", "i", "j")
            .mapInArrow(_linked(at_least), "a long, b long")
        )
        links.append(scratch.write(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"))
        scratch.drop(large)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    stars = scratch.write(components(every, scratch), "stars")
    scratch.drop(*links)
    rooted = scratch.write(classes.join(stars.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")
    sizes = scratch.write(rooted.groupBy("root").agg(F.count("*").alias("members")).filter("members > 1"), "sizes")
    # a component of many blocks meets block by block: each row goes to every pair of blocks that has its own
    placed = _in_blocks(rooted.join(sizes, "root"), ["root"], block_rows, [F.size("v").alias("width"), "block", "key", "n", "v"])
    counted = (
        placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "width", "key")
        .mapInArrow(_count_links(at_least), "key string, links long")
        .groupBy("key").agg(F.sum("links").alias("links"))
    )
    result = scratch.write(
        rooted.join(counted, "key", "left").select("key", "root", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "result"
    )
    scratch.drop(classes, stars, rooted, sizes)
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return keyed.select("id", "key").join(result, "key", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
