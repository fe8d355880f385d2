"""Word vectors: skip-gram and continuous bag of words with negative sampling.

The vocabulary's vectors are a table. Sentences are dealt into blocks of a bounded
number of tokens, each written once as one row of word numbers; in a round each
block trains on its sentences alone, from the round's vectors, and the changes of a
word are averaged by how often the blocks used it. While the vectors of all words
take no more than a bound they are sent to the tasks, no sentence moves, and a task
returns one change a word for all its blocks. Beyond that a bundle of blocks names
the words that it will touch and gets their current vectors by a join. Nothing else
depends on the size of the vocabulary but the sampler's two numbers a word, whose
size is checked.

All draws depend on the seed, the round and the block, so a lost task repeats them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.core import skew
from loomframe.core.order import row_index
from loomframe.core.session import materialize

#: What the sampler's table may take when it is sent to all tasks.
MAX_SAMPLER_BYTES = 512 << 20
#: Pairs that are scored against the same state of the vectors, at most; a block of few words takes fewer.
STEP = 512
#: What the vectors of the whole vocabulary may take to be sent to all tasks; a task holds them and as much again of changes.
SHIPPED_BYTES = 96 << 20
#: Tokens of a task, about, when the tasks of two rounds of all cores would have more.
TASK_TOKENS = 16 << 20
#: Blocks that meet the vectors of their words together when those are joined, while the words they are expected to touch stay within the bytes.
BUNDLE, BUNDLE_BYTES = 32, 64 << 20
MODES = ("skipgram", "cbow")


@dataclass(frozen=True)
class Options:
    """Words of fewer than ``min_count`` occurrences are left out of the sentences.

    A word with a share f of all tokens stays with probability
    sqrt(t / f) + t / f, t the ``sampling_threshold`` (0: all stay). The window of each
    word is drawn from 1 to ``window``; ``negatives`` words are drawn, with counts
    raised to ``power``, against each pair. The rate falls linearly over the rounds.
    """

    mode: str = "skipgram"
    dimensions: int = 100
    window: int = 5
    negatives: int = 5
    epochs: int = 5
    min_count: int = 5
    learning_rate: float = 0.05
    sampling_threshold: float = 1e-4
    power: float = 0.75
    block_tokens: int = 20_000
    seed: int = 0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keep probability and alias of each slot: a draw takes a slot evenly, then the slot's own number or its alias."""
    n = len(weights)
    scaled = np.asarray(weights, np.float64) * (n / np.sum(weights)) if n else np.zeros(0)
    keep, alias = np.ones(n), np.arange(n)
    small, large = list(np.flatnonzero(scaled < 1.0)), list(np.flatnonzero(scaled >= 1.0))
    while small and large:
        low, high = small.pop(), large[-1]
        keep[low], alias[low] = scaled[low], high
        scaled[high] -= 1.0 - scaled[low]
        if scaled[high] < 1.0:
            small.append(large.pop())
    return keep.astype(np.float32), alias.astype(np.int32)


def draw(table: tuple[np.ndarray, np.ndarray], rng: np.random.Generator, shape) -> np.ndarray:
    keep, alias = table
    slot = rng.integers(0, len(keep), shape)
    return np.where(rng.random(shape) < keep[slot], slot, alias[slot])


def _plan(sentences: list[np.ndarray], stays: np.ndarray | None, table, options: Options, seed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that stay, (place, place) of each centre and neighbour, and the words drawn against each centre."""
    rng = np.random.default_rng(seed)
    words = np.concatenate(sentences) if sentences else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    if stays is not None:
        left = rng.random(len(words)) < stays[words]
        words, of = words[left], of[left]
    reach = rng.integers(1, options.window + 1, len(words))
    pairs = []
    for offset in range(1, options.window + 1):
        a = np.arange(max(len(words) - offset, 0))
        same = of[a] == of[a + offset]
        for centre, other in ((a, a + offset), (a + offset, a)):
            use = same & (reach[centre] >= offset)
            pairs.append(np.stack((centre[use], other[use])))
    centre, other = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    order = np.argsort(centre, kind="stable")
    against = draw(table, rng, (len(words), options.negatives)) if len(table[0]) else np.zeros((len(words), 0), np.int64)
    return words, centre[order], other[order], against


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(z, -30, 30, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1.0
    return np.reciprocal(z, out=z)


def _add_rows(rows: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
    """``np.add.at(rows, at, more)``, for an (n, width) array: adding numbers at flat places, two of them as one complex number, is several times as fast."""
    flat, values, width = rows.reshape(-1), more.reshape(-1), rows.shape[1]
    if width % 2 == 0:
        flat, values, width = flat.view(np.complex128), values.view(np.complex128), width // 2
    np.add.at(flat, (at.reshape(-1, 1) * width + np.arange(width)).reshape(-1), values)


def _train(local, centre, other, drawn, ids: int, vin, vout, options: Options, rate: float, seed) -> None:
    """Run the block's pairs over its words' vectors, which change in place, a step at a time, in a drawn order.

    ``local`` has the rows of the tokens in ``vin`` and in ``vout``, ``drawn`` those of the
    words against each token in ``vout``; ``ids`` is the number of words touched.
    """
    rng = np.random.default_rng(seed)
    # a word that recurs within a step moves by the sum of its pairs
    size = min(STEP, max(32, 2 * ids))
    into, out = local

    def step(inputs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Move the output vectors, the target's first and then those drawn against it; returns the direction for each input vector."""
        rows = vout.take(at, axis=0)
        g = _sigmoid(np.einsum("pd,pkd->pk", inputs, rows))
        np.negative(g, out=g)
        g[:, 0] += 1.0
        # a word drawn against itself says nothing
        g[:, 1:] *= at[:, 1:] != at[:, :1]
        g *= rate
        move = np.einsum("pk,pkd->pd", g, rows)
        np.einsum("pk,pd->pkd", g, inputs, out=rows)
        _add_rows(vout, at, rows)
        return move

    def against(targets: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.concatenate((out[targets][:, None], drawn[of]), axis=1)

    if options.mode == "skipgram":
        order = rng.permutation(len(centre))
        centre = centre[order]
        inputs, at = into[centre], against(other[order], centre)
        for i in range(0, len(order), size):
            c = inputs[i : i + size]
            _add_rows(vin, c, step(vin.take(c, axis=0), at[i : i + size]))
        return
    centres, first, sizes = np.unique(centre, return_index=True, return_counts=True)
    order = rng.permutation(len(centres))
    first, sizes, neighbours = first[order], sizes[order], into[other]
    targets = against(centres[order], centres[order])
    for i in range(0, len(order), size):
        n = sizes[i : i + size]
        rows = np.repeat(np.arange(len(n)), n)
        around = neighbours[np.repeat(first[i : i + size] - (np.cumsum(n) - n), n) + np.arange(len(rows))]
        share = 1.0 / n
        inputs = np.zeros((len(n), vin.shape[1]))
        _add_rows(inputs, rows, vin.take(around, axis=0) * share[rows, None])
        _add_rows(vin, around, (step(inputs, targets[i : i + size]) * share[:, None]).take(rows, axis=0))


class _Changes:
    """Blocks trained from the same vectors, each as if it were alone, and the sums of their changes, weighted by their uses.

    Row i has the vectors of word ``every[i]``, or of word i; ``words`` is the size of the vocabulary.
    """

    def __init__(self, vin: np.ndarray, vout: np.ndarray, words: int, every: np.ndarray | None = None):
        self.vin, self.vout, self.every = vin, vout, every
        self.uses, self.moved_in, self.moved_out = np.zeros(len(vin)), np.zeros_like(vin), np.zeros_like(vout)
        self.row = np.zeros(words, np.int64)

    def _rows_of(self, ids: np.ndarray) -> np.ndarray:
        return ids if self.every is None else np.searchsorted(self.every, ids)

    def add(self, plan, options: Options, rate: float, seed) -> None:
        words, centre, other, against = plan
        # input vectors are those of the words that occur, output vectors of those drawn too
        used, ids = _distinct(self.row, words), _distinct(self.row, words, against.ravel())
        self.row[ids] = np.arange(len(ids))
        out, drawn = self.row[words], self.row[against]
        self.row[used] = np.arange(len(used))
        into = self.row[words]
        a, b = self._rows_of(used), self._rows_of(ids)
        vin, vout = self.vin[a], self.vout[b]
        new_in, new_out = vin.copy(), vout.copy()
        _train((into, out), centre, other, drawn, len(ids), new_in, new_out, options, rate, seed)
        uses = np.bincount(out, minlength=len(ids)) + 1e-3
        self.uses[b] += uses
        new_in -= vin
        new_in *= (np.bincount(into, minlength=len(used)) + 1e-3)[:, None]
        self.moved_in[a] += new_in
        new_out -= vout
        new_out *= uses[:, None]
        self.moved_out[b] += new_out

    def means(self) -> Iterator[pa.Table]:
        at = np.flatnonzero(self.uses)
        for i in range(0, len(at), CHANGED_ROWS):
            part = at[i : i + CHANGED_ROWS]
            uses = self.uses[part]
            lists = [_lists(moved[part] / uses[:, None]) for moved in (self.moved_in, self.moved_out)]
            yield pa.table([pa.array(part if self.every is None else self.every[part], pa.int64()), pa.array(uses), *lists], _CHANGES.names)


def _distinct(row: np.ndarray, *ids: np.ndarray) -> np.ndarray:
    """The distinct word numbers in order; ``row`` has a place for each and is overwritten."""
    for x in ids:
        row[x] = -1
    found = np.flatnonzero(row == -1)
    row[found] = 0
    return found


def _start(ids: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Input vectors to begin with, even in (-0.5, 0.5) / dimensions, by a hash of seed, word and position."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64)[:, None] * np.uint64(dimensions) + np.arange(dimensions, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)) / 2.0**53 - 0.5) / dimensions


def _lists(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(rows.ravel()))


def _rows(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


_VECTORS = "id long, vin array<double>, vout array<double>"
_CHANGES = pa.schema([("id", pa.int64()), ("uses", pa.float64()), ("vin", pa.list_(pa.float64())), ("vout", pa.list_(pa.float64()))])
#: Changes that a task returns at a time.
CHANGED_ROWS = 10_000


def vocabulary(df: DataFrame, tokens: Column, min_count: int) -> DataFrame:
    """``(word, n, id)``: words by falling count, then by name."""
    counts = df.select(F.explode(tokens).alias("word")).filter("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    return row_index(counts.filter(F.col("n") >= min_count), [F.desc("n"), "word"], "id")


def sentences(df: DataFrame, tokens: Column, key: Sequence[str], words: DataFrame, options: Options, blocks: int) -> DataFrame:
    """``(block, lengths, ids)``, a row for each block: its sentences' known words one after the other, by sentence.

    Texts are cut into pieces of at most ``block_tokens`` tokens; those of one key are
    merged by position. A vocabulary of at most ``skew.BROADCAST_BYTES`` (counted) goes to the
    tasks, and a sentence moves as word numbers, -1 for an unknown word; a larger one meets the tokens in a join.
    """
    given = df.select(F.to_json(F.struct(*key)).alias("sentence"), tokens.alias("tokens")).filter(F.size("tokens") > 0)
    known = words.select("word", "id")
    cut = options.block_tokens
    if skew.fits_broadcast(known):
        shipped = df.sparkSession.sparkContext.broadcast(known.toArrow().sort_by("id")["word"].combine_chunks())

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("tokens")
                codes = pc.fill_null(pc.index_in(texts.flatten(), value_set=shipped.value, skip_nulls=True), -1)
                lengths = pc.list_value_length(texts).to_numpy().astype(np.int64)
                pieces = -(-lengths // cut)
                row = np.repeat(np.arange(len(lengths)), pieces)
                piece = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
                starts = (np.cumsum(lengths) - lengths)[row] + piece * cut
                offsets = pa.array(np.append(starts, len(codes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("sentence").take(pa.array(row)), pa.array(piece), pa.ListArray.from_arrays(offsets, codes)], ["sentence", "piece", "ids"])

        packed = given.mapInArrow(encode, "sentence string, piece long, ids array<int>")
    else:
        long = given.select("sentence", F.posexplode("tokens").alias("at", "word"))
        met = long.join(known, "word")
        places = F.array_sort(F.collect_list(F.struct("at", "id")))
        packed = met.groupBy("sentence", F.floor(F.col("at") / cut).alias("piece")).agg(F.transform(places, lambda s: s["id"].cast("int")).alias("ids"))

    def gather(table: pa.Table) -> pa.Table:
        label = pc.binary_join_element_wise(table["sentence"], table["piece"].cast(pa.string()), "/").combine_chunks()
        order = pc.sort_indices(label)
        label, lists = label.take(order), table["ids"].combine_chunks().take(order)
        lengths = pc.list_value_length(lists).to_numpy()
        group = np.cumsum(np.append(0, pc.not_equal(label[1:], label[:-1]).to_numpy(zero_copy_only=False)))
        of, ids = np.repeat(group, lengths), lists.flatten().to_numpy()
        if group[-1] + 1 < len(group):
            at = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            merged = np.lexsort((ids, at, of))
            of, ids = of[merged], ids[merged]
        there = ids >= 0
        of, ids = of[there], ids[there]
        counts = np.bincount(of, minlength=1)
        counts = counts[counts > 0]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32)))
        made = pa.table([pa.array(table["block"][:1].to_pylist(), pa.int32()), one(counts), one(ids)], ["block", "lengths", "ids"])
        return made if len(ids) else made.slice(0, 0)

    block = F.pmod(F.xxhash64("sentence", "piece"), F.lit(blocks)).cast("int")
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(2, -(-blocks * cut // (TASK_TOKENS * cores)))
    dealt = packed.select(block.alias("block"), "*").repartition(min(tasks, blocks), "block")
    return dealt.groupBy("block").applyInArrow(gather, "block int, lengths array<int>, ids array<int>")


@dataclass(frozen=True)
class Corpus:
    """A vocabulary ``(word, n, id)`` with its size and number of tokens, and the blocks of its sentences: what fits of the same texts share."""

    words: DataFrame
    size: int
    total: int
    blocks: int
    dealt: DataFrame
    min_count: int
    block_tokens: int


def prepare(df: DataFrame, tokens: Column, key: Sequence[str], options: Options = Options()) -> Corpus:
    """The texts for ``fit`` with any options of the same ``min_count`` and ``block_tokens``."""
    words = materialize(vocabulary(df, tokens, options.min_count), "vocabulary")
    size, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size * 16 > MAX_SAMPLER_BYTES:
        raise ValueError(f"the sampler of {size} words exceeds {MAX_SAMPLER_BYTES} bytes: raise min_count")
    blocks = max(1, -(-int(total) // options.block_tokens))
    dealt = materialize(sentences(df, tokens, key, words, options, blocks), "sentences")
    return Corpus(words, size, total, blocks, dealt, options.min_count, options.block_tokens)


def _together(counts: np.ndarray, stays: np.ndarray | None, blocks: int, cores: int, o: Options) -> int:
    """Blocks of a bundle: as many as are expected to touch no more words than fit ``BUNDLE_BYTES``."""
    if not len(counts):
        return 1
    kept = counts if stays is None else counts * stays
    against = counts**o.power
    # uses of each word in a block of average length
    uses = (kept + o.negatives * kept.sum() * against / against.sum()) / blocks
    most = max(1, min(BUNDLE, blocks // (2 * cores)))
    while most > 1 and -np.expm1(-most * uses).sum() * o.dimensions * 16 > BUNDLE_BYTES:
        most //= 2
    return most


def fit(df: DataFrame, tokens: Column, key: Sequence[str], options: Options = Options(), corpus: Corpus | None = None) -> DataFrame:
    """``(word, n, vector)`` for every word of the vocabulary.

    ``key`` identifies a row: it orders the sentences of a block. Null token lists
    and null tokens are left out; with no word of ``min_count`` occurrences, or an
    empty table, the result is empty. Fits of the same texts may share what ``prepare`` made of them.
    """
    o, d = options, options.dimensions
    corpus = corpus or prepare(df, tokens, key, o)
    if (corpus.min_count, corpus.block_tokens) != (o.min_count, o.block_tokens):
        raise ValueError("the corpus was prepared with another min_count or block_tokens")
    words, size, dealt = corpus.words, corpus.size, corpus.dealt
    counted = words.select("id", "n").toArrow()  # two numbers a word, checked in prepare
    counts = np.zeros(size)
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    stays = None
    if o.sampling_threshold > 0 and size:
        ratio = o.sampling_threshold * corpus.total / counts
        stays = np.minimum(np.sqrt(ratio) + ratio, 1.0).astype(np.float32)
    context = df.sparkSession.sparkContext
    held = context.broadcast((stays, alias_table(counts**o.power)))
    shipped = size * d * 16 <= SHIPPED_BYTES
    if not shipped:
        together = _together(counts, stays, corpus.blocks, context.defaultParallelism, o)
        bundled = dealt.select(F.floor(F.col("block") / together).cast("int").alias("bundle"), "*")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(_start(ids, d, o.seed)), _lists(np.zeros((len(ids), d)))], ["id", "vin", "vout"])

    vectors = materialize(words.select("id").mapInArrow(begin, _VECTORS), "vectors")

    def round_of(epoch: int, rate: float):
        """The functions of a round: which words a bundle touches, and how blocks change them."""

        def plans(rows: pa.Table | pa.RecordBatch):
            """Block by block what its sentences use."""
            stays, sampler = held.value
            for block, lengths, ids in zip(rows.column("block").to_pylist(), rows.column("lengths"), rows.column("ids")):
                each = np.split(ids.values.to_numpy().astype(np.int64), np.cumsum(lengths.values.to_numpy())[:-1])
                yield block, _plan(each, stays, sampler, o, [o.seed, epoch, block])

        def changed(rows: pa.Table | pa.RecordBatch, changes: _Changes) -> None:
            for block, plan in plans(rows):
                changes.add(plan, o, rate, [o.seed, epoch, block, 1])

        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            changes = _Changes(*current.value, size)
            for batch in batches:
                changed(batch, changes)
            for table in changes.means():
                yield from table.to_batches()

        def touched(table: pa.Table) -> pa.Table:
            row = np.zeros(size, np.int64)
            ids = _distinct(row, *[x.ravel() for _, plan in plans(table) for x in (plan[0], plan[3])])
            return pa.table({"bundle": pa.array(np.full(len(ids), table.column("bundle")[0].as_py()), pa.int32()), "id": pa.array(ids, pa.int64())})

        def trained_bundle(table: pa.Table, found: pa.Table) -> pa.Table:
            if not len(table) or not len(found):
                return _CHANGES.empty_table()
            found = found.sort_by("id")
            changes = _Changes(_rows(found.column("vin"), d), _rows(found.column("vout"), d), size, found.column("id").to_numpy())
            changed(table, changes)
            return pa.concat_tables(changes.means())

        if not shipped:
            return touched, trained_bundle
        table = vectors.toArrow()  # checked above
        places = table.column("id").to_numpy()
        state = np.empty((2, size, d))
        state[0, places], state[1, places] = _rows(table.column("vin"), d), _rows(table.column("vout"), d)
        current = context.broadcast((state[0], state[1]))
        return current, trained

    schema = "id long, uses double, vin array<double>, vout array<double>"
    for epoch in range(o.epochs):
        given, trained = round_of(epoch, o.learning_rate * (1.0 - epoch / o.epochs))
        if shipped:
            changes = dealt.mapInArrow(trained, schema)
        else:
            routes = bundled.groupBy("bundle").applyInArrow(given, "bundle int, id long")
            current = routes.join(vectors, "id").select("bundle", "id", "vin", "vout")
            changes = bundled.groupBy("bundle").cogroup(current.groupBy("bundle")).applyInArrow(trained, schema)
        vectors = materialize(_moved(vectors, changes, d), "vectors")
        if shipped:
            given.destroy()
    return words.join(vectors, "id").select("word", "n", F.col("vin").alias("vector"))


def _moved(vectors: DataFrame, changes: DataFrame, d: int) -> DataFrame:
    """Each word's vectors plus the mean of its changes, weighted by their uses; sums are kept per word, not rows."""
    both = vectors.withColumn("uses", F.lit(0.0)).unionByName(changes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        base, moved, uses = np.zeros((0, 2 * d)), np.zeros((0, 2 * d)), np.zeros(0)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            at = np.array([place.setdefault(i, len(place)) for i in ids], np.int64)
            more = len(place) - len(uses)
            if more > 0:
                grow = max(more, len(uses))
                base, moved, uses = np.pad(base, ((0, grow), (0, 0))), np.pad(moved, ((0, grow), (0, 0))), np.pad(uses, (0, grow))
            w = batch.column("uses").to_numpy()
            x = np.concatenate((_rows(batch.column("vin"), d), _rows(batch.column("vout"), d)), axis=1)
            own = w == 0
            base[at[own]] = x[own]
            _add_rows(moved, at, x * w[:, None])
            np.add.at(uses, at, w)
        n = len(place)
        if n:
            out = base[:n] + moved[:n] / np.where(uses[:n] > 0, uses[:n], 1.0)[:, None]
            ids = pa.array(list(place), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, _lists(np.ascontiguousarray(out[:, :d])), _lists(np.ascontiguousarray(out[:, d:]))], ["id", "vin", "vout"])

    return both.select("id", "uses", "vin", "vout").repartition("id").mapInArrow(run, _VECTORS)


def nearest(vectors: DataFrame, word: str, k: int = 10) -> DataFrame:
    """``(word, cosine)`` of the ``k`` words nearest to ``word``, without itself; empty for an unknown word."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    length = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    asked = vectors.filter(F.col("word") == word).select(F.col("vector").alias("_q")).limit(1)
    others = vectors.filter(F.col("word") != word).withColumn("_q", asked.scalar()).filter("_q is not null")
    dot = total(F.zip_with("vector", "_q", lambda a, b: a * b))
    scored = others.select("word", (dot / (length(F.col("vector")) * length(F.col("_q")))).alias("cosine"))
    return scored.orderBy(F.desc("cosine"), "word").limit(k)
