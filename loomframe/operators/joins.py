"""The joins of the data model: lookups, embeddings, zips, boxes, similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.core import skew
from loomframe.core.arrow import matrix as as_matrix
from loomframe.core.order import row_index
from loomframe.core.session import materialize


def lookup_join(
    df: DataFrame, table: DataFrame, key: str, how: str = "left", salt_from: Sequence[str] = (), null_safe: bool = False
) -> DataFrame:
    """Equi join of a large, possibly skewed ``df`` with a unique-key ``table``.

    A table of at most ``skew.BROADCAST_BYTES`` (counted) is broadcast. For a larger one
    a summary finds the hot keys of ``df``, and only those are salted: a token
    holding a third of all rows is spread over ``skew.SALTS`` tasks while all other
    rows of the table are shuffled once. With ``null_safe`` a null key meets a null key.
    """
    other = skew.free_name("_key", df, table)
    if skew.fits_broadcast(table):
        if not null_safe:
            return df.join(F.broadcast(table), key, how)
        return df.join(F.broadcast(table.withColumnRenamed(key, other)), F.col(key).eqNullSafe(F.col(other)), how).drop(other)
    salt = skew.free_name("_salt", df, table)
    left, right = skew.salted(df, table, [key], salt, salt_from)
    if not null_safe:
        return left.join(right, [key, salt], how).drop(salt)
    copy = skew.free_name("_copy", df, table)
    right = right.withColumnsRenamed({key: other, salt: copy})
    same = F.col(key).eqNullSafe(F.col(other)) & (F.col(salt) == F.col(copy))
    return left.join(right, same, how).drop(other, salt, copy)


def explode_tokens(df: DataFrame, key: Sequence[str], tokens: str | Column) -> DataFrame:
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    return df.select(*key, F.posexplode(col).alias("pos", "token"))


#: What a dictionary, or a table of vectors, may take as Arrow arrays to be sent to the tasks; a worker holds it and, of a dictionary, the hashes of a slice.
SHIPPED_BYTES = 192 << 20
#: Entries of a dictionary that are hashed at a time.
HASHED = 1 << 20


def _arrow_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of the columns as Arrow arrays, about, counted from their values."""
    kinds = dict(df.dtypes)
    size = lambda c: F.octet_length(c) + 4 if kinds[c] == "string" else F.size(c) * (4 if kinds[c] in ("array<float>", "array<int>") else 8) + 4 if kinds[c].startswith("array") else F.lit(8)
    row = sum((F.coalesce(size(c), F.lit(4)).cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def token_lookup(tokens: DataFrame, vocabulary: DataFrame, unknown: int) -> DataFrame:
    """(…, pos, token) -> plus ``index``, unknown tokens get the fallback.

    Of lists (…, tokens) ``index`` has the list of each: the vocabulary goes to the
    tasks, as Arrow arrays, and no token moves.
    """
    if "token" not in tokens.columns:
        return _list_lookup(tokens, vocabulary.select("token", "index"), unknown)
    joined = lookup_join(tokens, vocabulary.select("token", "index"), "token")
    return joined.withColumn("index", F.coalesce("index", F.lit(unknown).cast("bigint")))


def _list_lookup(lists: DataFrame, vocabulary: DataFrame, unknown: int) -> DataFrame:
    rest = [c for c in lists.columns if c != "tokens"]
    fits = _arrow_bytes(vocabulary, "token", "index") <= SHIPPED_BYTES
    known = vocabulary.toArrow().combine_chunks() if fits else None
    if known is None or pc.count_distinct(known["token"], mode="all").as_py() < known.num_rows:
        # the lists are numbered for good, and their tokens meet the vocabulary as rows
        row = skew.free_name("_row", lists)
        lists = materialize(lists.withColumn(row, F.monotonically_increasing_id()), "lists")
        ids = recollect(token_lookup(explode_tokens(lists, [row], "tokens"), vocabulary, unknown), [row], "index", "index")
        return lists.select(*rest, row).join(ids, row).select(*rest, "index")
    narrow = max(pc.max(known["index"]).as_py() or 0, abs(unknown)) < 2**31 and (pc.min(known["index"]).as_py() or 0) >= -(2**31)
    kind = pa.int32() if narrow else pa.int64()
    shipped = lists.sparkSession.sparkContext.broadcast((known["token"].combine_chunks(), known["index"].combine_chunks().cast(kind)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = shipped.value
        numbers = numbers.to_numpy()
        for batch in batches:
            texts = batch.column("tokens")
            flat = texts.flatten()
            found = np.full(len(flat), unknown, numbers.dtype)
            for start in range(0, len(words), HASHED):
                at = pc.index_in(flat, value_set=words.slice(start, HASHED), skip_nulls=True)
                there = at.is_valid().to_numpy(zero_copy_only=False)
                found[there] = numbers[start:][at.drop_null().to_numpy()]
            offsets = np.append(0, np.cumsum(pc.list_value_length(texts).to_numpy())).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))], [*rest, "index"])

    kinds = dict(lists.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", index array<{'int' if narrow else 'bigint'}>"
    return lists.select(*rest, "tokens").filter(F.size("tokens") > 0).mapInArrow(encode, schema)


def index_lookup(indices: DataFrame, vocabulary: DataFrame, unknown: str) -> DataFrame:
    joined = lookup_join(indices, vocabulary.select("index", F.col("token").alias("word")), "index")
    return joined.withColumn("word", F.coalesce("word", F.lit(unknown)))


def recollect(df: DataFrame, key: Sequence[str], value: str, out: str, pos: str = "pos") -> DataFrame:
    """Long rows back to one ordered array per key.

    Without a column ``pos`` the values are lists whose places are the positions: those of
    a key become one array of ``struct<pos, value>``, ordered by both. A list moves as it is.
    """
    if pos not in df.columns:
        placed = lambda part: F.transform(part, lambda v, i: F.struct(i.alias(pos), v.alias(value)))
        grouped = df.groupBy(*key).agg(F.collect_list(value).alias("_parts"))
        merged = F.array_sort(F.flatten(F.transform("_parts", placed)))
        return grouped.select(*key, F.when(F.size("_parts") == 1, placed(F.get("_parts", F.lit(0)))).otherwise(merged).alias(out))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return df.groupBy(*key).agg(F.transform(pairs, lambda s: s["v"]).alias(out))


def vocabulary_contains(df: DataFrame, vocabulary: DataFrame, present: bool = True) -> DataFrame:
    """Rows whose token is in the vocabulary, or those whose token (or null) is not; hot tokens are split."""
    return lookup_join(df, vocabulary.select("token"), "token", "left_semi" if present else "left_anti")


def embedding_lookup(
    items: DataFrame, table: DataFrame, key: str, vector: str, fallthrough: Sequence[float] | None = None
) -> DataFrame:
    """Item -> vector row; missing items get the fallthrough vector."""
    joined = lookup_join(items, table.select(key, vector), key)
    if fallthrough is None:
        return joined
    default = F.array(*[F.lit(float(x)) for x in fallthrough])
    return joined.withColumn(vector, F.coalesce(F.col(vector), default))


def _and_null(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([*column.chunks, pa.nulls(1, column.type)])


#: Ids whose vectors a task holds at a time, or gives back at a time.
BLOCK_IDS = 100_000


class _Vectors:
    """The vectors of each id, by rising place in the table; ``vectors`` has a null more than ``keys``, for an id without any."""

    def __init__(self, keys: pa.Array, vectors: pa.Array):
        known = keys.dictionary_encode(null_encoding="encode")
        codes = known.indices.to_numpy()
        self.keys = known.dictionary
        self.vectors = vectors
        self.order = np.append(np.argsort(codes, kind="stable"), len(codes))
        self.counts = np.append(np.bincount(codes, minlength=len(self.keys)), 1)

    def pairs(self, entries: pa.ListArray, key: str) -> pa.ListArray:
        """The lists of ``struct<pos, key>`` as lists of ``struct<p, v>``."""
        flat = entries.flatten()
        at = pc.fill_null(pc.index_in(flat.field(key).cast(self.keys.type), value_set=self.keys), len(self.keys)).to_numpy()
        times = self.counts[at]
        ends = np.cumsum(times)
        place = np.repeat((np.cumsum(self.counts) - self.counts)[at] - (ends - times), times) + np.arange(times.sum())
        pairs = pa.StructArray.from_arrays(
            [flat.field("pos").take(pa.array(np.repeat(np.arange(len(at)), times))), self.vectors.take(pa.array(self.order[place]))], ["p", "v"]
        )
        offsets = np.concatenate(([0], ends))[entries.offsets.to_numpy() - entries.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def embedding_matrices(lists: DataFrame, table: DataFrame, ids: str, key: str, vector: str, out: str = "matrix") -> DataFrame:
    """Rows with an ordered array of ``struct<pos, key>`` to the array of their vectors, as lookup and ``recollect`` give it.

    A table of at most ``SHIPPED_BYTES`` (counted, as Arrow arrays) goes to the tasks, and
    nothing moves. Of a larger one a vector moves once for each block of rows (about ``BLOCK_IDS`` ids) that has
    its id, not once for each occurrence. An id with several vectors gives all of them,
    by rising vector; one without any gives null.
    """
    rest = [c for c in lists.columns if c != ids]
    kinds = dict(lists.dtypes) | dict(table.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", _pairs array<struct<p:int,v:{kinds[vector]}>>"
    in_order = F.transform(F.array_sort("_pairs"), lambda s: s["v"]).alias(out)
    table = table.select(key, vector)
    if _arrow_bytes(table, key, vector) <= SHIPPED_BYTES:
        # a null key meets none
        held = table.filter(F.col(f"`{key}`").isNotNull()).toArrow()
        shipped = lists.sparkSession.sparkContext.broadcast((held[key].combine_chunks(), _and_null(held[vector])))
        del held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _Vectors(*shipped.value)
            for batch in batches:
                ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy())
                start = 0
                while start < batch.num_rows:
                    before = ends[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_IDS, "right")))
                    part = batch.slice(start, stop - start)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], found.pairs(part.column(ids), key)], [*rest, "_pairs"])
                    start = stop

        return lists.select(*rest, ids).mapInArrow(run, schema).select(*rest, in_order)
    lists = materialize(lists, "lists")
    total = lists.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0))).first()[0]
    dealt = lists.withColumn("_block", F.pmod(F.xxhash64(*rest), F.lit(max(-(-total // BLOCK_IDS), 1))))
    routes = dealt.select(F.col("_block").alias("_to"), F.explode(F.transform(ids, lambda s: s[key])).alias(key)).distinct()
    found = embedding_lookup(routes, table, key, vector)

    def attach(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        met = _Vectors(vectors.column(key).combine_chunks(), _and_null(vectors.column(vector)))
        return pa.table([*[rows.column(c) for c in rest], met.pairs(rows.column(ids).combine_chunks(), key)], [*rest, "_pairs"])

    joined = dealt.groupBy("_block").cogroup(found.groupBy("_to")).applyInArrow(attach, schema)
    return joined.select(*rest, in_order)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two (x1, y1, x2, y2) boxes; no overlap is 0."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda t: (t["x2"] - t["x1"]) * (t["y2"] - t["y1"])
    return F.when(inter > 0, inter / (area(a) + area(b) - inter)).otherwise(F.lit(0.0))


CORNERS = ("x1", "y1", "x2", "y2")


#: An image of more boxes is cut into grid cells; one of fewer is a single cell, so its boxes move once.
ONE_CELL = 512


def _cells(low: str, high: str, grid: Column) -> Column:
    cell = lambda c: F.floor(F.col(c) * grid).cast("bigint")
    return F.sequence(cell(low), cell(high))


def with_cells(df: DataFrame, grid: int | Column, corners: Sequence[str] = CORNERS) -> DataFrame:
    """One row per grid cell a box touches (``_cx``, ``_cy``)."""
    x1, y1, x2, y2 = corners
    grid = F.lit(grid) if isinstance(grid, int) else grid
    return df.withColumn("_cx", F.explode(_cells(x1, x2, grid))).withColumn("_cy", F.explode(_cells(y1, y2, grid)))


def _large_images(anchors: DataFrame, truths: DataFrame, image: list[str], limit: int) -> DataFrame:
    """Images of more than ``limit`` boxes: at most one for so many rows."""
    both = anchors.select(*image).unionByName(truths.select(*image))
    counted = both.groupBy(*image).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    return materialize(counted.select(*image, F.lit(1).alias("_large")), "large-images")


def iou_join(
    anchors: DataFrame, truths: DataFrame, image: Sequence[str], threshold: float = 0.0, grid: int = 8, one_cell: int = ONE_CELL
) -> DataFrame:
    """Pairs of overlapping boxes of one image with ``iou`` > threshold.

    The pairs of an image of more than ``one_cell`` boxes are never enumerated:
    its boxes meet only in the grid cells they touch, a pair is counted in the cell of
    its intersection's lower corner, and a positive threshold also needs areas within a
    factor of 1 / t. A smaller image is one cell, and none of its boxes is copied.
    The copies are shuffled and sorted, never broadcast: a plan knows the size of
    the boxes, not that of their copies. Columns of ``truths`` other than the keys
    come back with the prefix ``t_``.
    """
    image = list(image)
    right = truths.select(*image, *[F.col(c).alias(f"t_{c}") for c in truths.columns if c not in image])
    large = _large_images(anchors, truths, image, one_cell)
    if large.isEmpty():
        left, cells_a_side = anchors.withColumn("_large", F.lit(None).cast("int")), F.lit(0)
        right = right.withColumn("_large", F.lit(None).cast("int"))
    else:
        if skew.fits_broadcast(large):
            large = F.broadcast(large)
        left, right = anchors.join(large, image, "left"), right.join(large, image, "left")
        cells_a_side = F.when(F.col("_large").isNotNull(), grid).otherwise(0)
    left = with_cells(left, cells_a_side)
    right = with_cells(right, cells_a_side, [f"t_{c}" for c in CORNERS])
    keys = [*image, "_cx", "_cy"]
    if threshold > 0:
        def band(x1, y1, x2, y2):
            area = (F.col(x2) - F.col(x1)) * (F.col(y2) - F.col(y1))
            return F.floor(F.log(area) / F.lit(float(np.log(1.0 / threshold)))).cast("bigint")

        # a box without an area has no band and no pairs
        left = left.withColumn("_band", band("x1", "y1", "x2", "y2")).filter("_band is not null")
        near = band("t_x1", "t_y1", "t_x2", "t_y2")
        bands = F.when(F.col("_large").isNotNull(), F.sequence(near - 1, near + 1)).otherwise(F.array(near * 0))
        left = left.withColumn("_band", F.when(F.col("_large").isNotNull(), F.col("_band")).otherwise(0))
        right = right.filter(near.isNotNull()).withColumn("_band", F.explode(bands))
        keys.append("_band")
    a = {c: F.col(c) for c in CORNERS}
    b = {c: F.col(f"t_{c}") for c in CORNERS}
    side = F.when(F.col("_large").isNotNull(), grid).otherwise(0)
    home_x = F.floor(F.greatest(a["x1"], b["x1"]) * side)
    home_y = F.floor(F.greatest(a["y1"], b["y1"]) * side)
    pairs = left.join(right.drop("_large").hint("merge"), keys).filter((F.col("_cx") == home_x) & (F.col("_cy") == home_y))
    return pairs.withColumn("iou", iou(a, b)).filter(F.col("iou") > threshold).drop(
        "_large", *[k for k in keys if k not in image]
    )


def similarity_pairs(pairs: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """(cos + 1) / 2 of two vector columns of one row, scored in Arrow batches."""

    @F.arrow_udf("double")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = as_matrix(left), as_matrix(right)
        dots = np.einsum("ij,ij->i", x, y)
        lengths = np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        return pa.array((dots / lengths + 1.0) / 2.0)

    return pairs.withColumn(out, score(F.col(a), F.col(b)))


QUERY_BLOCK = 4096  # query vectors shipped to a task at a time


def topk_similar(
    vectors: DataFrame, queries: DataFrame, k: int, vec_id: str, vector: str, query_id: str, query_vector: str
) -> DataFrame:
    """The k nearest vectors by cosine of every query, exact.

    Queries go out in blocks of at most ``QUERY_BLOCK``; a task scores its Arrow
    batch against the block with one matrix product and keeps only the task's k
    best per query, so pairs are never emitted. More queries mean more passes
    over the vectors, not a larger broadcast. Scores are compared at 12 digits.
    """
    numbered = row_index(queries.select(query_id, query_vector), query_id, "_q")
    blocks = numbered.select(F.ceil(F.count("*") / QUERY_BLOCK)).first()[0]
    id_type = dict(vectors.dtypes)[vec_id]
    query_type = dict(queries.dtypes)[query_id]
    result = None
    for block in range(max(int(blocks), 1)):
        part = numbered.filter(F.floor(F.col("_q") / QUERY_BLOCK) == block).orderBy("_q").collect()
        if not part:
            continue
        names = [row[query_id] for row in part]
        matrix = np.array([row[query_vector] for row in part], dtype=np.float64)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        shipped = vectors.sparkSession.sparkContext.broadcast((names, matrix))

        def best_of_task(batches, shipped=shipped):
            names, q = shipped.value
            scores, ids = [np.empty(0)] * len(names), [np.empty(0, dtype=np.int64)] * len(names)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = as_matrix(batch[vector])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                fresh = np.round((q @ x.T + 1.0) / 2.0, 12)
                batch_ids = batch[vec_id].to_numpy(zero_copy_only=False)
                kth = max(fresh.shape[1] - k, 0)
                floors = np.partition(fresh, kth, axis=1)[:, kth]
                for i, row in enumerate(fresh):
                    near = np.nonzero(row >= floors[i])[0]
                    s = np.concatenate([scores[i], row[near]])
                    d = np.concatenate([ids[i], batch_ids[near]])
                    top = np.lexsort((d, -s))[:k]  # lowest id first among equal scores
                    scores[i], ids[i] = s[top], d[top]
            owner = np.repeat(np.arange(len(names)), [len(d) for d in ids])
            if len(owner):
                columns = [pa.array([names[i] for i in owner]), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))]
                yield pa.RecordBatch.from_arrays(columns, names=[query_id, vec_id, "similarity"])

        partial = vectors.select(vec_id, vector).mapInArrow(
            best_of_task, f"{query_id} {query_type}, {vec_id} {id_type}, similarity double"
        )
        result = partial if result is None else result.unionByName(partial)
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), vec_id)
    return result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def concat_rows(*frames: DataFrame, tag: str = "source") -> DataFrame:
    out = None
    for i, frame in enumerate(frames):
        tagged = frame.withColumn(tag, F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def concat_columns(a: DataFrame, b: DataFrame, idx: str = "idx") -> DataFrame:
    """Zip on the index; both sides must cover the same positions."""
    return a.join(b, idx, "inner")


def content_equals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``equal``: the same rows with the same multiplicity."""
    tagged = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    unbalanced = tagged.groupBy(*a.columns).agg(F.sum("_d").alias("d")).filter("d <> 0")
    return unbalanced.agg((F.count("*") == 0).alias("equal"))


def all_close(
    a: DataFrame, b: DataFrame, idx: str, value: str, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False
) -> DataFrame:
    """One row ``close``: |a - b| <= atol + rtol |b| everywhere, same positions."""
    both = a.select(idx, F.col(value).alias("_a")).join(b.select(idx, F.col(value).alias("_b")), idx, "full_outer")
    near = F.abs(F.col("_a") - F.col("_b")) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("_b"))
    near = F.when(F.isnan("_a") | F.isnan("_b"), F.lit(equal_nan) & F.isnan("_a") & F.isnan("_b")).otherwise(near)
    return both.agg(F.coalesce(F.bool_and(F.coalesce(near, F.lit(False))), F.lit(True)).alias("close"))


def distinct_pairs(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order_by`` wins (an aggregate, no sort)."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])
