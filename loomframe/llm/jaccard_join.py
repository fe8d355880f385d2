"""N-gram Jaccard join by size-aware heavy and light sets.

Two sets that reach the similarity share at least ``o = ceil(t * n)`` members,
``n`` the size of either. Members get one global order, rare first, so the
first ``c`` shared members lie among the first ``n - o + c`` of each set.

* Light (small) sets enumerate all 2-subsets of their first ``n - o + 2``
  members; two light sets that reach the similarity have a subset in common.
* Heavy (large) sets scan inverted lists: one posting per member among the
  first ``n - o + 1``. Light sets that are large enough to reach a heavy one
  are in these lists too.
* The boundary is the size with the least estimated cost, from the histogram of
  all set sizes and the list lengths that the counts of all members foretell.

Lists are scanned three times. The first scan proposes, for each posting, only
the one before it and the first of its list, a number of pairs that is linear in
the list; verified pairs are united. The second looks, in a part of the lists that
still hold several components, at a few neighbours in random order. The last
compares all sets of a list that are still in different components, so a group of
thousands of near copies never becomes all its pairs and yet no link between
components is lost. Both later scans carry a parity bitmap with each posting and
propose a pair only where sizes and bitmaps leave the similarity possible; a list
longer than a block is dealt in blocks, in the last scan in pairs of blocks, so no
list is one task. What they propose passes the same bound on the full bitmaps and
is verified on the sets of the whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.common import Scratch, mix, plain_text, signed, text_bytes, text_slices
from loomframe.llm.components import components
from loomframe.llm.shingles import set_keys, shingle_sets

#: Counters of the member order; any number gives right results, more of them a finer order.
COUNTER_BITS = 18
COUNTERS = 1 << COUNTER_BITS
#: The second scan reads one in so many open lists and looks at so many neighbours; what it
#: leaves in different components, the last scan compares in full.
SHARE, REACH = 3, 4
#: Postings of a list that meet in one task, about; longer lists are dealt in blocks.
BLOCK = 1024
#: Bytes of the bitmap that travels with a posting, the full one folded.
BRIEF = 128
_PAIR = np.uint64(0x8CB92BA72F3D8DD7)
_SETS = "kind int, doc_id long, hi long, lo long, n int, bits array<long>, brief binary"


def _needed(n, percent: int):
    """Least intersection that a set of ``n`` members has with any set it reaches."""
    return (n * percent + 99) // 100


def _counter(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _parity(members: np.ndarray) -> np.ndarray:
    """One bit per hash class, set when an odd number of members falls into it; n to 2n bits, 1,024 at least, in longs."""
    width = max(8 * BRIEF, 1 << int(len(members) - 1).bit_length())
    odd = np.bincount((mix(members) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _describe(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        schema = None
        for batch in batches:
            texts, ids = plain_text(batch.column(1)), batch.column(0)
            for a, b in text_slices(texts):
                members, offsets = shingle_sets(*text_bytes(texts.slice(a, b - a)), words)
                counts += np.bincount(_counter(members), minlength=COUNTERS)
                hi, lo = set_keys(members, offsets)
                sizes = np.diff(offsets)
                bits = [_parity(members[x:y]) if y > x else None for x, y in zip(offsets[:-1], offsets[1:])]
                yield _sets_batch(np.zeros(b - a, np.int32), ids.slice(a, b - a), signed(hi), signed(lo), sizes, bits)
        at = np.flatnonzero(counts)
        for part in np.array_split(at, max(1, len(at) // 50_000)):
            ones = np.ones(len(part), np.int32)
            nothing = [None] * len(part)
            yield _sets_batch(ones, nothing, signed(part.view(np.uint64)), signed(counts[part].view(np.uint64)), 0 * ones, nothing)

    return run


def _sets_batch(kind, ids, hi, lo, n, bits) -> pa.RecordBatch:
    brief = [None if x is None else np.bitwise_xor.reduce(x.reshape(-1, BRIEF // 8), axis=0).tobytes() for x in bits]
    columns = [pa.array(kind, pa.int32()), pa.array(ids, pa.int64()), hi, lo, pa.array(n, pa.int32())]
    columns += [pa.array(bits, pa.list_(pa.int64())), pa.array(brief, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "hi", "lo", "n", "bits", "brief"])


def boundary(sizes: dict[int, int], counts: np.ndarray, percent: int) -> int:
    """The set size from which scanning lists is cheaper than enumerating 2-subsets.

    A light set of n costs its subsets. A heavy one costs its postings times one
    plus the length of the lists they are in, estimated as the mean count of the
    rarest members that together make up the share of members in prefixes.
    """
    if not sizes:
        return 0
    low = np.sort(counts[counts > 0]).astype(np.float64)
    upto = np.searchsorted(np.cumsum(low), low.sum() * (100 - percent) / 100) + 1
    # a counter holds many members: what exceeds the least filled ones is repetition
    excess = max(float((low[:upto] ** 2).sum() / low[:upto].sum() - low[:upto].mean()), 0.0)
    n = np.array(sorted(sizes))
    of = np.array([sizes[x] for x in n.tolist()], np.float64)
    two, one = n - _needed(n, percent) + 2, n - _needed(n, percent) + 1
    light = np.concatenate(([0.0], np.cumsum(of * two * (two - 1) / 2)))
    heavy = np.concatenate((np.cumsum((of * one)[::-1])[::-1], [0.0])) * (2.0 + excess)
    edges = np.concatenate((n, [n[-1] + 1]))
    also = heavy[np.searchsorted(n, edges * percent / 100)]
    return int(edges[int(np.argmin(light + also))])


def _signatures(words: int, percent: int, order, cut: int) -> Callable:
    """Postings; ``rest`` is the most that a set can share with another whose first shared members these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            texts = plain_text(batch.column(0))
            for a, b in text_slices(texts):
                members, offsets = shingle_sets(*text_bytes(texts.slice(a, b - a)), words)
                _, lo = set_keys(members, offsets)
                sizes = np.diff(offsets)
                _, first = np.unique(lo, return_index=True)
                out, of, rest = [], [], []
                for i in first.tolist():
                    n = int(sizes[i])
                    least = _needed(n, percent)
                    if n == 0 or 100 * n < percent * (n + 1):
                        continue  # only an equal set reaches it
                    own = members[offsets[i] : offsets[i + 1]]
                    # members come sorted, so a stable sort by count orders them by (count, hash)
                    own = own[np.argsort(counts[_counter(own)], kind="stable")[: n - least + 2]]
                    if n < cut:
                        x, y = np.triu_indices(len(own), 1)
                        out.append(mix(own[x] + own[y] * _PAIR) | np.uint64(1))
                        of += [i] * len(x)
                        rest.append(n + 1 - y)
                    if n >= cut * percent // 100:
                        out.append(own[: n - least + 1] & ~np.uint64(1))
                        of += [i] * (n - least + 1)
                        rest.append(n - np.arange(n - least + 1))
                if of:
                    at = np.array(of)
                    columns = [signed(np.concatenate(out)), signed(lo[at]), pa.array(sizes[at], pa.int32())]
                    columns.append(pa.array(np.concatenate(rest), pa.int32()))
                    yield pa.RecordBatch.from_arrays(columns, ["sig", "id", "n", "rest"])

    return run


def _lists(percent: int) -> Callable:
    """Scan postings sorted by (sig, n, id), most rest first: drop repeats and lists of one, name the neighbours to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        opened = (None, 0, 0)  # sig, id and n of the first set of the list that the held posting is in
        before = None  # the posting before the held one, when it is in the same list
        for batch in batches:
            rows = np.concatenate((held, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])), axis=1)
            again = np.zeros(rows.shape[1], bool)
            again[1:] = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
            rows = rows[:, ~again]
            result, opened, before, held = _scan(rows, opened, before, percent, False)
            if result is not None:
                yield result
        if held.shape[1]:
            result, *_ = _scan(held, opened, before, percent, True)
            if result is not None:
                yield result

    return run


def _scan(rows, opened, before, percent: int, last: bool):
    sig, ids, n, rest = rows
    size = rows.shape[1]
    if not size or (size == 1 and not last):
        return None, opened, before, rows
    new = np.ones(size, bool)
    new[1:] = sig[1:] != sig[:-1]
    new[0] = opened[0] is None or sig[0] != opened[0]
    start = np.maximum.accumulate(np.where(new, np.arange(size), -1))
    inside = start >= 0
    head_id = np.where(inside, ids[start], opened[1])
    head_n = np.where(inside, n[start], opened[2])
    prev_id, prev_n = np.concatenate(([0], ids[:-1])), np.concatenate(([0], n[:-1]))
    has = ~new
    if has[0]:
        has[0] = before is not None
        if before is not None:
            prev_id[0], prev_n[0] = before
    more = np.zeros(size, bool)
    more[:-1] = ~new[1:]
    done = size if last else size - 1
    keep = (has | more)[:done]
    near = has & (100 * prev_n >= percent * n)
    far = ~new & (head_id != ids) & (100 * head_n >= percent * n)
    columns = [
        pa.array(sig[:done][keep]),
        pa.array(ids[:done][keep]),
        pa.array(n[:done][keep].astype(np.int32)),
        pa.array(rest[:done][keep].astype(np.int32)),
        pa.array(prev_id[:done][keep], mask=~near[:done][keep]),
        pa.array(head_id[:done][keep], mask=~far[:done][keep]),
    ]
    after = None
    if not last:
        opened = (int(sig[-1]), int(head_id[-1]), int(head_n[-1]))
        after = (int(prev_id[-1]), int(prev_n[-1])) if has[-1] else None
    result = pa.RecordBatch.from_arrays(columns, ["sig", "id", "n", "rest", "near", "far"]) if keep.any() else None
    return result, opened, after, rows[:, size - 1 :]


def _compare(percent: int, reach: int | None) -> Callable:
    """Scan postings sorted by (sig, tile): pairs of different components that sizes and bitmaps let reach the similarity.

    Compared are sets at most ``reach`` places apart in a tile, or, without it, all
    of a tile, which are then sorted by size; in a tile of two blocks only those
    of different blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bits = np.zeros((7, 0), np.int64), np.zeros((0, BRIEF // 8), np.uint64)
        for batch in batches:
            rows = np.concatenate((rows, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)])), axis=1)
            bits = np.concatenate((bits, _briefs(batch.column(7))))
            if rows.shape[1]:
                # the last tile may go on in the next batch
                change = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
                done = int(change[-1]) + 1 if len(change) else 0
                yield from _near_pairs(rows[:, :done], bits[:done], percent, reach)
                rows, bits = rows[:, done:], bits[done:]
        yield from _near_pairs(rows, bits, percent, reach)

    return run


def _briefs(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, BRIEF // 8), np.uint64)
    data, offsets = column.buffers()[2], column.buffers()[1]
    width = 8 if pa.types.is_large_binary(column.type) else 4
    start = int(np.frombuffer(offsets, np.int64 if width == 8 else np.int32)[column.offset])
    return np.frombuffer(data, np.uint64, len(column) * BRIEF // 8, start).reshape(-1, BRIEF // 8)


def _near_pairs(rows: np.ndarray, bits: np.ndarray, percent: int, reach: int | None) -> Iterator[pa.RecordBatch]:
    size = rows.shape[1]
    if size < 2:
        return
    sig, tile, block, ids, n, rest, root = rows
    new = np.ones(size, bool)
    new[1:] = (sig[1:] != sig[:-1]) | (tile[1:] != tile[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    at, step, found = np.arange(size), 0, []
    while reach is None or step < reach:
        step += 1
        at = at[at - step >= start[at]]
        if reach is None:
            at = at[100 * n[at - step] >= percent * n[at]]  # smaller sets further on fail too
        if not len(at):
            break
        x, y = at, at - step
        apart = root[x] != root[y]
        if reach is None:
            apart &= (tile[x] % 2 == 0) | (block[x] != block[y])
            # a pair is met in the list of its first shared members, where the rest of both bounds what it shares
            apart &= (100 + percent) * np.minimum(rest[x], rest[y]) >= percent * (n[x] + n[y])
        apart &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        x, y = x[apart], y[apart]
        differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        may = differ * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
        found.append(np.stack((ids[x[may]], ids[y[may]])))
    a, b = np.unique(np.sort(np.concatenate(found or [np.zeros((2, 0), np.int64)], axis=1), axis=0), axis=1)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _may_reach(left: str, right: str, n: str, m: str, percent: int) -> Column:
    """Whether two parity bitmaps leave the similarity possible.

    Bitmaps that differ in d places prove a symmetric difference of at least d,
    and sets of n and m members that reach t differ in at most (1-t)/(1+t)*(n+m).
    A bitmap of twice the width folds into its halves' exclusive or.
    """

    def folded(x: str, y: str) -> Column:
        half = F.size(y)
        halves = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > half, halves).otherwise(F.col(x))

    each = F.zip_with(folded(left, right), folded(right, left), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    differ = F.aggregate(each, F.lit(0), lambda total, x: total + x)
    uneven = (F.size(left) > 2 * F.size(right)) | (F.size(right) > 2 * F.size(left))
    bound = (F.col(n).cast("long") + F.col(m)) * (100 - percent)
    return uneven | (differ * (100 + percent) <= bound)


def _verify(words: int, percent: int) -> Callable:
    """Exact test on the sets of both whole texts; also that a text is the one its id stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            left, right = plain_text(batch.column(2)), plain_text(batch.column(3))
            keep = np.zeros(len(a), bool)
            for x, y in text_slices(left):
                one, at = shingle_sets(*text_bytes(left.slice(x, y - x)), words)
                two, to = shingle_sets(*text_bytes(right.slice(x, y - x)), words)
                right_ids = (set_keys(one, at)[1].view(np.int64) == a[x:y]) & (set_keys(two, to)[1].view(np.int64) == b[x:y])
                for i in np.flatnonzero(right_ids).tolist():
                    p, q = one[at[i] : at[i + 1]], two[to[i] : to[i + 1]]
                    both = len(p) + len(q)
                    merged = np.sort(np.concatenate((p, q)), kind="stable")
                    shared = int((merged[1:] == merged[:-1]).sum())
                    keep[x + i] = 100 * shared >= percent * (both - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(keep)], ["a", "b", "linked"])

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs``.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets
    of ``words``-word shingles; ``component_id`` is the smallest id reachable by
    links. Equal sets link. A text that is null, empty or without words has the
    empty set and links with nothing (its component is its own id). A row without
    an id links with nothing and has a null component. Repeated rows give equal
    rows; one id with several texts belongs to the component of each in turn.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = scratch.write(docs.mapInArrow(_describe(words), _SETS), "sets")
    rows = described.filter("kind = 0").drop("kind")
    classes = scratch.write(
        rows.filter("n > 0 and doc_id is not null")
        .groupBy("lo", "hi", "n")
        .agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("brief").alias("brief")),
        "classes",
    )
    counters = described.filter("kind = 1").groupBy("hi").agg(F.sum("lo").alias("c")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[counters.column("hi").to_numpy()] = counters.column("c").to_numpy()
    sizes = {r.n: r.c for r in _histogram(classes).collect()}
    cut = boundary(sizes, counts, percent)
    order = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))  # COUNTERS numbers
    lists = scratch.write(
        docs.filter("doc_id is not null")
        .select("text")
        .mapInArrow(_signatures(words, percent, order, cut), "sig long, id long, n int, rest int")
        .repartition("sig")
        .sortWithinPartitions("sig", "n", "id", F.desc("rest"))
        .mapInArrow(_lists(percent), "sig long, id long, n int, rest int, near long, far long"),
        "lists",
    )

    def verified(pairs: DataFrame) -> DataFrame:
        size = classes.select(F.col("lo").alias("id"), "n", "bits", "rep")
        first = size.select(F.col("id").alias("a"), "n", F.col("bits").alias("left"))
        second = size.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("right"))
        close = pairs.join(first, "a").join(second, "b").filter(_may_reach("left", "right", "n", "m", percent))
        close = scratch.write(close.select("a", "b"), "close")
        texts = docs.select(F.col("doc_id").alias("rep"), "text")
        wanted = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
        # one text per set: a repeated row, or another text of the same id, is sorted out by its set key
        found = scratch.write(texts.join(size.join(wanted, "id").select("id", "rep"), "rep").select("id", "text"), "texts")
        pairs_texts = close.join(found.select(F.col("id").alias("a"), F.col("text").alias("one")), "a").join(
            found.select(F.col("id").alias("b"), F.col("text").alias("two")), "b"
        )
        result = scratch.write(
            pairs_texts.select("a", "b", "one", "two").mapInArrow(_verify(words, percent), "a long, b long, linked boolean"),
            "verified",
        )
        scratch.drop(close, found)
        return result

    def tested() -> DataFrame:
        return reduce(DataFrame.unionByName, tried)

    def open_postings(stars: DataFrame) -> DataFrame:
        """Postings of the lists that hold several components, with component and bitmap, and in how many blocks their list is dealt."""
        labelled = scratch.write(
            lists.join(stars.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", "n", "rest", F.coalesce("root", "id").alias("root")),
            "labelled",
        )
        mixed = labelled.groupBy("sig").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("c"))
        blocks = F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks")
        several = labelled.join(mixed.filter("p <> q").select("sig", blocks), "sig")
        result = scratch.write(several.join(classes.select(F.col("lo").alias("id"), "brief"), "id"), "open")
        scratch.drop(labelled)
        return result

    def united(links: DataFrame) -> DataFrame:
        return scratch.write(components(links, scratch), "united")

    columns = ["sig", "tile", "block", "id", "n", "rest", "root", "brief"]
    proposed = lists.select("id", F.explode(F.array("near", "far")).alias("b")).filter("b is not null")
    tried = [verified(proposed.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct())]
    stars = united(tried[0].filter("linked").select("a", "b"))
    block = F.pmod(F.xxhash64("id", "sig"), F.col("blocks")).alias("block")
    # second scan: neighbours in random order inside random blocks
    postings = open_postings(stars)
    nearby = (
        postings.filter(F.pmod(F.xxhash64("sig"), F.lit(SHARE)) == 0)
        .select("*", block)
        .withColumn("tile", F.col("block"))
        .select(columns)
        .repartition("sig", "tile")
        .sortWithinPartitions("sig", "tile", F.xxhash64("id", "tile"))
        .mapInArrow(_compare(percent, REACH), "a long, b long")
    )
    tried.append(verified(nearby.distinct().join(tested().select("a", "b"), ["a", "b"], "left_anti")))
    scratch.drop(postings)
    before = stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = scratch.write(before.union(tried[1].filter("linked").select("a", "b")), "links")
    scratch.drop(stars)
    stars = united(links)
    scratch.drop(links)
    # last scan: every block of a list with every other and with itself; odd tiles hold two blocks
    postings = open_postings(stars)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = postings.select("*", block).select("*", other).withColumn(
        "tile",
        (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")) * 2 + (F.col("block") != F.col("other")).cast("long"),
    )
    across = (
        tiles.select(columns)
        .repartition("sig", "tile")
        .sortWithinPartitions("sig", "tile", "n", "id")
        .mapInArrow(_compare(percent, None), "a long, b long")
    )
    tried.append(verified(across.distinct().join(tested().select("a", "b"), ["a", "b"], "left_anti")))
    scratch.drop(postings)
    before = stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = scratch.write(before.union(tried[2].filter("linked").select("a", "b")), "links")
    scratch.drop(stars)
    stars = united(links)
    roots = classes.join(stars.withColumnRenamed("node", "lo"), "lo", "left").select(
        "lo", "hi", "n", "rep", F.coalesce("root", "lo").alias("root")
    )
    smallest = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = scratch.write(roots.join(smallest, "root").select("lo", "hi", "n", "component_id"), "of-set")
    order.unpersist()
    scratch.drop(classes, lists, links, *tried, stars)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.drop("bits", "brief").join(of_set, ["lo", "hi", "n"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id")
    )


def _histogram(classes: DataFrame) -> DataFrame:
    """Sets per size; sizes above 1,024 fall into steps of a thousandth, so the table stays short at any corpus size."""
    step = F.greatest(F.lit(1), F.pow(2.0, F.floor(F.log2(F.col("n") / 1024.0))).cast("int"))
    return classes.groupBy((F.floor(F.col("n") / step) * step).cast("int").alias("n")).agg(F.count("*").alias("c"))


def keep_one_of_each(docs: DataFrame, linked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, repeated rows once.

    Rows without an id are kept as they are.
    """
    dropped = linked.filter("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    rest = docs.join(dropped, id_col, "left_anti")
    with_id = rest.filter(F.col(id_col).isNotNull())
    repeated = with_id.select(id_col).groupBy(id_col).count().filter("count > 1").select(id_col)
    single = with_id.join(repeated, id_col, "left_anti")
    several = with_id.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return single.unionByName(several).unionByName(rest.filter(F.col(id_col).isNull()))
