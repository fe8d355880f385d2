"""Exact top-k inner-product search over an impact-ordered index, score at a time.

The index is cut into blocks of rows. In a block every dimension is a posting
list ordered by value and cut into segments of equal quantised impact; a query
weight of either sign walks it from its own best end. A query takes the segments
of all dimensions by falling impact and adds each segment's middle impact to its
postings' accumulators. What is still to come and the width of the segments
bound every score from above and below; once so few rows can still reach the
k-th best that they can be rescored, which the bounds prove, it stops and
rescores those exactly. A first pass over one block gives each query a score
that its k-th best cannot fall below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.llm.common import Scratch

BLOCK_ROWS = 8192
QUERY_ROWS = 512
LEVELS = 16
#: Shares of all postings after which the bounds are tested.
TESTS = (0.5, 0.75, 0.9, 1.0)
_BLOCK = "block int, width int, ids binary, vectors binary"


def scaled(column: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component, x as double; null unless all components are finite numbers."""
    fine = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (block, width) from rows sorted by them; a partition holds whole blocks."""
    for block, width, ids, vectors in _groups(batches):
        row = [pa.array([block], pa.int32()), pa.array([width], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, ["block", "width", "ids", "vectors"])


def _groups(batches: Iterator[pa.RecordBatch]):
    key, ids, vectors = None, [], []
    for batch in batches:
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            if key is not None and key != tuple(keys[:, a].tolist()):
                yield *key, np.concatenate(ids), np.concatenate(vectors)
                ids, vectors = [], []
            key = tuple(keys[:, a].tolist())
            ids.append(batch.column(2).slice(a, b - a).to_numpy().astype(np.int64))
            vectors.append(batch.column(3).slice(a, b - a).flatten().to_numpy().astype(np.int64).reshape(b - a, -1))
    if key is not None:
        yield *key, np.concatenate(ids), np.concatenate(vectors)


def packed(rows: DataFrame, per_block: int, total: int) -> DataFrame:
    """``(id, v)`` rows as blocks of about ``per_block`` rows of one width, dealt by a hash of id and vector."""
    blocks = max(1, -(-total // per_block))
    dealt = rows.select(
        F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("width"), "id", "v"
    )
    return dealt.repartition("block").sortWithinPartitions("block", "width", "id").mapInArrow(_pack, _BLOCK)


class Block:
    """The impact-ordered index of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, width = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        span = np.maximum(high - low, 1)
        level = ((vectors - low) * LEVELS // (span + 1)).T
        self.order = np.argsort(vectors.T, axis=1, kind="stable")
        counts = np.stack([np.bincount(level[d], minlength=LEVELS) for d in range(width)])
        self.ends = np.cumsum(counts, axis=1)
        self.starts = self.ends - counts
        ordered = np.take_along_axis(vectors.T, self.order, 1)
        self.low = np.take_along_axis(ordered, np.minimum(self.starts, n - 1), 1)
        self.high = np.take_along_axis(ordered, np.maximum(self.ends - 1, 0), 1)
        self.filled = counts > 0

    def best(self, q: np.ndarray, own: int | None, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all rows that may be among the k best, ``own`` aside, none below ``floor``."""
        n = len(self.ids)
        ends = np.stack((q[:, None] * self.low, q[:, None] * self.high)).astype(np.float64)
        worst, most = ends.min(axis=0), ends.max(axis=0)
        base = np.where(self.filled, worst, np.inf).min(axis=1, keepdims=True)
        gain = np.where(self.filled & (q != 0)[:, None], most - base, -1.0)
        order = np.argsort(-gain, axis=None, kind="stable")
        order = order[gain.ravel()[order] >= 0]
        middle = ((worst + most) / 2 - base).ravel()
        # the widest segment of each dimension bounds the error of the middles
        slack = float((np.where(self.filled, most - worst, 0).max(axis=1) / 2).sum()) + 1e-6
        lengths = (self.ends - self.starts).ravel()[order]
        filled = np.cumsum(lengths)
        sums, at, left = np.full(n, float(base.sum())), 0, gain.copy().ravel()
        own_row = self.ids == own if own is not None else np.zeros(n, bool)
        maybe = np.flatnonzero(~own_row)
        for share in TESTS:
            upto = len(order) if share == 1.0 else int(np.searchsorted(filled, share * filled[-1])) if len(filled) else 0
            if upto > at:
                some = order[at:upto]
                postings = [self.order[s // LEVELS, self.starts.flat[s] : self.ends.flat[s]] for s in some.tolist()]
                sums += np.bincount(np.concatenate(postings), np.repeat(middle[some], lengths[at:upto]), n)
                left[some] = 0.0
                at = upto
            to_come = float(np.maximum(left.reshape(gain.shape).max(axis=1), 0).sum())
            free = sums[~own_row]
            kth = max(floor, float(np.partition(free, -k)[-k]) - slack) if len(free) >= k else floor
            maybe = np.flatnonzero((sums + slack + to_come >= kth) & ~own_row)
            if len(maybe) <= 4 * k:
                break
        exact = self.vectors[maybe] @ q
        keep = exact >= floor
        maybe, exact = maybe[keep], exact[keep]
        if len(maybe) > k:
            top = np.lexsort((self.ids[maybe], -exact))[:k]
            maybe, exact = maybe[top], exact[top]
        return self.ids[maybe], exact


def _search(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column(0)[i].as_py()
                ids, vectors, query_ids, queries, floors = (
                    np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in range(1, 6)
                )
                block = Block(ids, vectors.reshape(-1, width))
                out: list[list] = [[], [], []]
                for q, own, floor in zip(queries.reshape(-1, width), query_ids.tolist(), floors.tolist()):
                    found, scores = block.best(q, own, k, float(floor))
                    out[0].append(np.full(len(found), own)), out[1].append(found), out[2].append(scores)
                columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])

    return run


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attach to each query block the scores its queries' k-th best cannot fall below."""
    for batch in batches:
        floors = []
        for ids, known in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
            of = {r["query_id"]: r["floor"] for r in known or []}
            floors.append(np.array([of.get(i, -(2**62)) for i in np.frombuffer(ids, np.int64).tolist()], np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(floors, pa.binary())], ["part", "block", "width", "ids", "vectors", "floors"])


def top_k(rows: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``(query_id, rank, id, score)``: the k rows with the highest integer inner product for each query row.

    Components become ``floor(scale * x)``; scores must stay below 2^53. Ties go
    to the smaller id. A query is no candidate for itself (rows with its id are
    left out). Rows whose id or vector is null, or whose vector holds a null or a
    non-finite component, take no part; vectors meet only others of their length;
    an empty vector meets none. Repeated rows count once. No queries or no
    candidates give no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    whole = rows.select(F.col(id_col).cast("long").alias("id"), scaled(vec_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    whole = scratch.write(whole.filter("id is not null and size(v) > 0").distinct(), "vectors")
    total, asked = whole.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0))).first()
    index = scratch.write(packed(whole.select("id", "v"), BLOCK_ROWS, total), "index")
    queries = scratch.write(packed(whole.filter("q").select("id", "v"), QUERY_ROWS, asked), "queries")
    parts = max(1, -(-asked // QUERY_ROWS))

    def search(blocks: DataFrame, asking: DataFrame) -> DataFrame:
        # each block goes to each block of queries: a stated query set against all rows
        dealt = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "width", "ids", "vectors")
        both = dealt.join(asking, (dealt["part"] == asking["part"]) & (dealt["width"] == asking["width"]))
        return both.select(dealt["width"], dealt["ids"], dealt["vectors"], asking["ids"], asking["vectors"], asking["floors"]).toDF(
            "width", "ids", "vectors", "query_ids", "queries", "floors"
        ).repartition(F.xxhash64("ids", "query_ids")).mapInArrow(_search(k), "query_id long, id long, score long")

    named = queries.select(F.col("block").alias("part"), "block", "width", "ids", "vectors")
    none = named.withColumn("known", F.lit(None).cast("array<struct<query_id:long,floor:long>>"))
    shape = "part int, block int, width int, ids binary, vectors binary, floors binary"
    first = scratch.write(search(index.filter("block = 0"), none.mapInArrow(_floors, shape)), "first")
    # the k-th score found in one block; fewer than k found prove nothing
    kth = (
        first.groupBy("query_id")
        .agg(F.min("score").alias("floor"), F.count("*").alias("n"))
        .filter(F.col("n") >= k)
        .join(whole.filter("q").select(F.col("id").alias("query_id"), F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("part")), "query_id")
    )
    known = kth.groupBy("part").agg(F.collect_list(F.struct("query_id", "floor")).alias("known"))  # about QUERY_ROWS each
    asking = scratch.write(named.join(known, "part", "left").select("part", "block", "width", "ids", "vectors", "known").mapInArrow(_floors, shape), "asking")
    found = scratch.write(search(index, asking).distinct(), "found")
    scratch.drop(whole, index, queries, first, asking)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
