"""Vector codes from exact k-means over parts, by metric trees of the anchors hierarchy.

Vectors are cut into equal parts and each part position has a codebook. Tasks
build, once, one metric tree per part position over each chunk of rows. A tree is
built middle-out: about sqrt(n) anchors, each owning the points nearest to it,
are found first; balls of neighbouring anchors are merged upwards and each
anchor's points split downwards by the same method. Every ball caches the sum and
the count of its points.

A round of k-means walks the trees level by level. A ball inherits its parent's
list of candidate entries and drops those that can't be nearest to any point
inside it; when one entry is left, the ball is wholly owned, and its cached sum
and count go to that entry without a look at its points. Leaves compare their
points with what is left. All sums and distances are integers, so the result
depends neither on how rows fall into chunks nor on the order of addition.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomframe.llm.common import Scratch, free_name

CHUNK = 4096
LEAF = 16
#: Rows whose distances to their candidates are held at once.
BLOCK = 512
#: Margin for radii and distances between entries, which are square roots.
SLACK = 1e-9


def scaled_parts(rows: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of an (n, width) matrix as (parts, n, width / parts) integers."""
    whole = np.floor(rows * scale)
    n, width = whole.shape
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    if whole.size and 8 * np.abs(whole).max() ** 2 * width >= 2.0**52:
        raise ValueError("components are too large for exact distances")
    return whole.astype(np.int64).reshape(n, parts, width // parts).transpose(1, 0, 2)


# trees ---------------------------------------------------------------------------------
class _Builder:
    """Nodes of one tree while it grows; points are numbered in the order of the leaves."""

    def __init__(self, points: np.ndarray, weights: np.ndarray):
        self.points, self.weights = points.astype(np.float64), weights
        self.order: list[np.ndarray] = []
        self.placed = 0
        self.nodes: list[tuple] = []  # left, right, start, end, pivot, radius, sum, count

    def _leaf(self, at: np.ndarray, pivot: int) -> int:
        own, w = self.points[at], self.weights[at]
        centre = self.points[pivot]
        radius = np.sqrt(((own - centre) ** 2).sum(axis=1).max())
        self.order.append(at)
        self.placed += len(at)
        self.nodes.append((-1, -1, self.placed - len(at), self.placed, centre, radius, w @ own, int(w.sum())))
        return len(self.nodes) - 1

    def _anchors(self, at: np.ndarray) -> tuple[list[int], np.ndarray]:
        """About sqrt(n) pivots, and the number of each point's nearest one."""
        own = self.points[at]
        pivots = [0]
        owner = np.zeros(len(at), np.int64)
        far = ((own - own[0]) ** 2).sum(axis=1)
        for k in range(1, int(np.ceil(np.sqrt(len(at))))):
            new = int(far.argmax())
            if far[new] == 0:
                break
            # an anchor loses points only from beyond half its distance to the new pivot
            apart = ((own[pivots] - own[new]) ** 2).sum(axis=1)
            open_to = np.flatnonzero(4 * far > apart[owner])
            d = ((own[open_to] - own[new]) ** 2).sum(axis=1)
            won = d < far[open_to]
            pivots.append(new)
            owner[open_to[won]] = k
            far[open_to[won]] = d[won]
        return pivots, owner

    def build(self, at: np.ndarray, pivot: int | None = None) -> int:
        """The tree over the points ``at``; returns its root."""
        if len(at) <= LEAF:
            return self._leaf(at, at[0] if pivot is None else pivot)
        pivots, owner = self._anchors(at)
        if len(pivots) == 1:
            return self._leaf(at, at[0])
        # merge the balls first, on paper, so that leaves are numbered from left to right
        groups = [np.flatnonzero(owner == k) for k in range(len(pivots))]
        centres = self.points[at[pivots]]
        radii = np.array([np.sqrt(((self.points[at[g]] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centres)])
        shape = _merged(centres, radii)
        return self._grow(shape, [at[g] for g in groups], [int(at[p]) for p in pivots])

    def _grow(self, shape, groups, pivots) -> int:
        """Children before parents, leaves from left to right, without recursion over the merges."""
        made: dict = {}  # nested pairs of distinct numbers are distinct keys
        stack = [(shape, False)]
        while stack:
            node, ready = stack.pop()
            if isinstance(node, int):
                made[node] = self.build(groups[node], pivots[node])
            elif not ready:
                stack += [(node, True), (node[1], False), (node[0], False)]
            else:
                made[node] = self._join(made[node[0]], made[node[1]])
        return made[shape]

    def _join(self, left: int, right: int) -> int:
        a, b = self.nodes[left], self.nodes[right]
        total, count = a[6] + b[6], a[7] + b[7]
        centre = np.round(total / count)
        radius = max(np.sqrt(((c[4] - centre) ** 2).sum()) + c[5] for c in (a, b))
        self.nodes.append((left, right, a[2], b[3], centre, radius, total, count))
        return len(self.nodes) - 1


def _merged(centres: np.ndarray, radii: np.ndarray):
    """Merge two balls at a time, those with the smallest ball around both first: nested pairs of ball numbers."""
    k = len(centres)
    shapes: list = list(range(k))
    centres, radii = centres.copy(), radii.copy()
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    both = np.maximum((apart + radii[:, None] + radii[None]) / 2, np.maximum(radii[:, None], radii[None]))
    np.fill_diagonal(both, np.inf)
    for _ in range(k - 1):
        i, j = divmod(int(both.argmin()), k)
        i, j = min(i, j), max(i, j)
        shapes[i], shapes[j] = (shapes[i], shapes[j]), None
        size = both[i, j]
        span = np.sqrt(((centres[i] - centres[j]) ** 2).sum())
        if span and size > radii[i]:
            centres[i] += (centres[j] - centres[i]) * ((size - radii[i]) / span)
        radii[i] = size
        both[j], both[:, j] = np.inf, np.inf
        row = np.maximum((np.sqrt(((centres - centres[i]) ** 2).sum(axis=1)) + radii + size) / 2, np.maximum(radii, size))
        row[~np.isfinite(both[i])] = np.inf
        row[i] = np.inf
        both[i], both[:, i] = row, row
    return shapes[0]


def build_tree(points: np.ndarray) -> tuple:
    """The tree over an (n, width) integer matrix as plain arrays.

    Equal points count as one with a weight. Returns (points in leaf order, weight
    of each, place of each given row, node arrays).
    """
    distinct, back, weights = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    builder = _Builder(distinct, weights.astype(np.float64))
    builder.build(np.arange(len(distinct)))
    order = np.concatenate(builder.order)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    left, right, start, end, pivot, radius, total, count = zip(*builder.nodes)
    nodes = (
        np.array(left),
        np.array(right),
        np.array(start),
        np.array(end),
        np.array(pivot).astype(np.int32),
        np.array(radius) * (1 + SLACK),
        np.array(total).astype(np.int64),
        np.array(count, np.int64),
    )
    return distinct[order].astype(np.int32), weights[order], place[back.ravel()].astype(np.int32), nodes


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``; whole numbers below 2^52 stay exact in doubles."""
    return (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None]


def walk(tree: tuple, entries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Who owns what: ``(nodes, entry)`` of wholly owned balls and ``(points, entry)`` of the points of open leaves.

    An entry stays on a ball's list unless the ball's entry nearest to the pivot is
    nearer for every point the ball can hold: the difference of squared distances
    grows along the line between the two entries only, so it is tested at the
    ball's point farthest along that line.
    """
    points, _, _, (left, right, start, end, pivot, radius, _, _) = tree
    entries = entries.astype(np.float64)
    apart = np.sqrt(np.maximum(_squares(entries, entries), 0)) * (1 + SLACK)
    at = np.array([len(left) - 1])
    listed = np.ones((1, len(entries)), bool)
    owned, leaves = [], []
    while len(at):
        d = _squares(pivot[at].astype(np.float64), entries)
        d[~listed] = np.inf
        near = d.argmin(axis=1)
        margin = d - d[np.arange(len(at)), near][:, None]
        listed &= margin <= 2 * radius[at][:, None] * apart[near] * (1 + SLACK) + SLACK
        single = listed.sum(axis=1) == 1
        owned.append((at[single], near[single]))
        leaf = ~single & (left[at] < 0)
        leaves.append((at[leaf], listed[leaf]))
        open_ = ~single & (left[at] >= 0)
        at = np.concatenate((left[at[open_]], right[at[open_]]))
        listed = np.concatenate((listed[open_], listed[open_]))
    nodes = np.concatenate([n for n, _ in leaves])
    lists = np.concatenate([m for _, m in leaves]) if len(nodes) else np.zeros((0, len(entries)), bool)
    by_place = np.argsort(start[nodes], kind="stable")
    nodes, lists = nodes[by_place], lists[by_place]
    sizes = end[nodes] - start[nodes]
    compared = []
    # neighbouring leaves share most candidates, so a block of them is compared with few entries
    block = np.cumsum(sizes) // BLOCK
    for b in np.unique(block):
        mine = block == b
        rows = np.concatenate([np.arange(s, e) for s, e in zip(start[nodes[mine]], end[nodes[mine]])])
        used = np.flatnonzero(lists[mine].any(axis=0))
        d = _squares(points[rows].astype(np.float64), entries[used])
        d[~np.repeat(lists[mine][:, used], sizes[mine], axis=0)] = np.inf
        compared.append((rows, used[d.argmin(axis=1)]))
    return owned, compared


def sums_of(tree: tuple, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of the points nearest to each entry (ties to the lower one)."""
    points, weights, _, (*_, total, count) = tree
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    owned, compared = walk(tree, entries)
    for nodes, entry in owned:
        np.add.at(sums, entry, total[nodes])
        np.add.at(counts, entry, count[nodes])
    for rows, entry in compared:
        np.add.at(sums, entry, points[rows].astype(np.int64) * weights[rows][:, None])
        np.add.at(counts, entry, weights[rows])
    return sums, counts


def nearest_of(tree: tuple, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each given row the nearest entry and the squared distance to it."""
    points, _, place, (_, _, start, end, *_) = tree
    found = np.empty(len(points), np.int64)
    owned, compared = walk(tree, entries)
    for nodes, entry in owned:
        for s, e, x in zip(start[nodes].tolist(), end[nodes].tolist(), entry.tolist()):
            found[s:e] = x
    for rows, entry in compared:
        found[rows] = entry
    error = ((points.astype(np.int64) - entries[found]) ** 2).sum(axis=1)
    return found[place], error[place]


# jobs ----------------------------------------------------------------------------------
def _finite(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def first_entries(kept: DataFrame, size: int, parts: int, scale: int) -> np.ndarray:
    """The codebooks to start from, (parts, entries, width): parts of the vectors with the smallest ids."""
    ids = [r.id for r in kept.select("id").filter("id is not null").distinct().orderBy("id").limit(size).collect()]
    if not ids:
        return np.zeros((parts, 0, 0), np.int64)
    rows = kept.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    return scaled_parts(np.array([r.v for r in rows], np.float64), parts, scale)


def _chunks(kept: DataFrame, parts: int, scale: int, id_type: T.DataType, label_type: T.DataType) -> DataFrame:
    """One row per chunk of rows: their ids, labels and trees."""

    def made(table: pa.Table) -> pa.RecordBatch:
        column = table.column("v").combine_chunks()
        n = len(column)
        lengths = np.diff(column.offsets.to_numpy())
        if lengths.min() != lengths.max():
            raise ValueError("vectors differ in length")
        rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        trees = [build_tree(p) for p in scaled_parts(rows, parts, scale)]
        one = pa.array([0, n], pa.int32())
        lists = [pa.ListArray.from_arrays(one, table.column(c).combine_chunks()) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(trees, 5)], pa.binary())], ["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= CHUNK:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, CHUNK))
                rest = table.slice(CHUNK)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield made(pa.Table.from_batches(held))

    schema = T.StructType().add("ids", T.ArrayType(id_type)).add("labels", T.ArrayType(label_type)).add("trees", "binary")
    return kept.mapInArrow(run, schema)


def _round(chunks: DataFrame, entries: np.ndarray) -> np.ndarray:
    """One round: assign all parts, then each used entry becomes the floor of its parts' mean."""
    parts, size, width = entries.shape
    held = chunks.sparkSession.sparkContext.broadcast(entries)  # parts x size x width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        sums = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for batch in batches:
            for stored in batch.column("trees"):
                for p, tree in enumerate(pickle.loads(stored.as_buffer())):
                    s, c = sums_of(tree, books[p])
                    sums[p, :, :-1] += s
                    sums[p, :, -1] += c
        used = np.flatnonzero(np.repeat(sums[:, :, -1].ravel() > 0, books.shape[2] + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums.ravel()[used])], ["cell", "s"])

    cells = chunks.select("trees").mapInArrow(run, "cell long, s long").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros(parts * size * (width + 1), np.int64)
    sums[cells.column("cell").to_numpy()] = cells.column("s").to_numpy()
    sums = sums.reshape(parts, size, width + 1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), entries)


def codebooks_digest(entries: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    size: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> tuple[DataFrame, np.ndarray]:
    """``(id_col, code, error, label_error)`` per row, and the codebooks as (parts, entries, width) integers.

    ``code`` is a string of hex digits, two per part (as many as ``size`` needs);
    ``error`` the squared distance summed over parts; ``label_error`` that summed
    over the rows of the same label, null labels together. Rows whose vector is
    null, empty or holds null or non-finite components are left out. Repeated
    rows each get a row; an id counts once among the smallest ids (with its least
    vector, if it has several), and a null id doesn't count there. With fewer
    ids than ``size`` there are as many entries as ids; with none, or an empty table,
    the result is empty. Vectors that differ in length, have no equal parts, or
    are too large for exact distances are an error. A result column takes an
    underscore before it if it would be called like ``id_col``.
    """
    scratch = Scratch(vectors.sparkSession)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = kept.filter(_finite(F.col("v")))
    types = {f.name: f.dataType for f in kept.schema.fields}
    entries = first_entries(kept, size, parts, scale)
    if not entries.shape[1]:
        kept = kept.limit(0)
    chunks = scratch.write(_chunks(kept, parts, scale, types["id"], types["label"]), "trees")
    if entries.shape[1]:
        for _ in range(rounds):
            entries = _round(chunks, entries)
    held = vectors.sparkSession.sparkContext.broadcast(entries)
    digits = max(len(f"{size - 1:x}"), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                found = [nearest_of(tree, book) for tree, book in zip(pickle.loads(one.column("trees")[0].as_buffer()), held.value)]
                names = np.array([f"{x:0{digits}x}" for x in range(held.value.shape[1])])
                code = names[found[0][0]]
                for entry, _ in found[1:]:
                    code = np.char.add(code, names[entry])
                error = sum(e for _, e in found)
                columns = [one.column("ids").flatten(), one.column("labels").flatten(), pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    schema = T.StructType().add("id", types["id"]).add("label", types["label"]).add("code", "string").add("error", "long")
    codes = scratch.write(chunks.mapInArrow(run, schema), "codes")
    scratch.drop(chunks)
    # a row per label: written, so that its size decides how the join runs
    totals = scratch.write(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "totals")
    joined = codes.join(totals, F.col("label").eqNullSafe(F.col("of")))
    given = kept.select(F.col("id").alias(id_col))
    named = [F.col(c).alias(free_name(given, c)) for c in ("code", "error", "label_error")]
    return joined.select(F.col("id").alias(id_col), *named), entries
