"""Toxicity of whole texts: a linear model on character n-grams scaled by naive Bayes.

Features are the n-grams of ``SIZES`` characters inside words, in lower case and
with the space before and after, each present or absent in a text and scaled by its naive
Bayes log-count ratio between toxic and other texts. Only the ``keep`` n-grams
with the most significant ratio stay; a logistic regression with an L2 penalty
weighs them. All texts are scored whole; only the fit uses a bounded sample.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loomframe.llm.common import Scratch, free_name, plain_text, remembered, text_bytes, text_slices

SIZES = (4, 6, 8)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
_ROLL, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _folding() -> np.ndarray:
    """Per code point: its lower case if it is a letter, mark or digit, else a space."""
    out = np.full(0x110000, 0x20, np.uint32)
    for point in range(0x34000):
        c = chr(point)
        if unicodedata.category(c)[0] in "LMN":
            folded = c.lower()
            out[point] = ord(folded) if len(folded) == 1 else point
    return out


@dataclass
class ToxicityModel:
    weights: np.ndarray  # per bucket: coefficient times log-count ratio, 0 when not kept
    bias: float


def grams(texts: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the text and the bucket of every n-gram of every text, of the ``wanted`` buckets if given."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # a space before each text and after the last one
    folded = np.insert(remembered("folding", _folding)[points], begins, np.uint32(0x20))
    at = begins + np.arange(n + 1)
    space = folded == 0x20
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at] = True
    opens = (np.cumsum(keep) - 1)[at]  # where each text starts now
    space, letters = space[keep], folded[keep].astype(np.uint64)
    # so many letters follow before the next space, that space included
    gaps = np.flatnonzero(space)
    room = gaps[np.minimum(np.cumsum(space), len(gaps) - 1)] - np.arange(len(letters)) + 1
    code = np.zeros(len(letters), np.uint64)
    for size in range(1, max(SIZES) + 1):
        m = len(letters) - size + 1
        if m <= 0:
            return
        code = code[:m] * _ROLL + letters[size - 1 :]
        if size in SIZES:
            bucket = ((code ^ (code >> np.uint64(32))) * _SPREAD) >> np.uint64(64 - BUCKET_BITS)
            fits = room[:m] >= size
            hit = np.flatnonzero(fits if wanted is None else wanted[bucket] & fits)
            # the space that closes a text is the one that opens the next
            hit = hit[hit < opens[-1]]
            yield np.searchsorted(opens, hit, side="right") - 1, bucket[hit].astype(np.int64)


def _present(texts: pa.Array, wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct (text * BUCKETS + bucket) keys of the n-grams, of the ``wanted`` buckets if given."""
    keys = [text << BUCKET_BITS | bucket for text, bucket in grams(texts, wanted)]
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        texts, toxic = plain_text(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in text_slices(texts):
            keys = _present(texts.slice(a, b - a))
            of, bucket = toxic[a:b][keys >> BUCKET_BITS], keys & (BUCKETS - 1)
            for label in (0, 1):
                counts[label] += np.bincount(bucket[of == label], minlength=BUCKETS)
    at = np.flatnonzero(counts.any(axis=0))
    for part in np.array_split(at, 1 + len(at) // 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[0, part]), pa.array(counts[1, part])], ["bucket", "q", "p"])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = 20_000,
    keep: int = 2_048,
    penalty: float = 3e-4,
) -> ToxicityModel:
    """Fit on at most ``fit_rows`` labelled texts, chosen by a hash of their id.

    Labels that are null, or whose id is null or has no document, teach nothing;
    an id with several labels counts as toxic if any of them says so. The driver
    sees ``keep`` ratios and, per sampled text, which of the kept n-grams it has.
    With labels of one class only, every score is the share of toxic labels; with
    none at all it is 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_toxic")
    )
    # somewhat below the bound, which the limit then keeps exactly
    share = min(1.0, 0.95 * fit_rows / max(known.count(), 1)) if fit_rows else 0.0
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))
    chosen = scratch.write(chosen.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).limit(fit_rows), "labels")
    sample = scratch.write(
        # at most fit_rows pairs of numbers
        docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id")).select(F.col(text_col).alias("text"), F.col("_toxic").alias("toxic")),
        "sample",
    )
    of = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total, positive = sum(of.values()), of.get(1, 0)
    weights = np.zeros(BUCKETS, np.float32)
    if not positive or positive == total:
        scratch.close()
        rate = positive / total if total else 0.0
        return ToxicityModel(weights, float(np.clip(np.log(rate / (1 - rate)) if 0 < rate < 1 else (50 if rate else -800), -800, 50)))
    ratio = F.log((F.col("p") + 1) / (positive + 2)) - F.log((F.col("q") + 1) / (total - positive + 2))
    kept = (
        sample.select("text", "toxic")
        .mapInArrow(_count, "bucket int, q long, p long")
        .groupBy("bucket")
        .agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
        .filter("p + q >= 5")
        .select("bucket", ratio.alias("r"), (ratio * ratio / (1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))).alias("z"))
        .orderBy(F.desc("z"), "bucket")
        .limit(keep)
        .toArrow()
    )
    bucket, r = kept.column("bucket").to_numpy(), kept.column("r").to_numpy()
    place = np.full(BUCKETS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))
    held = spark.sparkContext.broadcast(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain_text(batch.column(0))
            for a, b in text_slices(texts):
                keys = _present(texts.slice(a, b - a), held.value >= 0)
                cut = np.searchsorted(keys >> BUCKET_BITS, np.arange(b - a + 1))
                own = held.value[keys & (BUCKETS - 1)]
                rows = [own[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(rows, pa.binary())], ["toxic", "has"])

    # at most fit_rows rows of at most keep numbers
    rows = sample.mapInArrow(features, "toxic int, has binary").toArrow()
    scratch.close()
    y = rows.column("toxic").to_numpy().astype(np.float64)
    has = [np.frombuffer(x, np.int32) for x in rows.column("has").to_pylist()]
    row = np.repeat(np.arange(len(has)), [len(x) for x in has])
    column = np.concatenate(has) if has else np.zeros(0, np.int32)
    w, bias = _logistic(row, column, r[column], y, len(bucket), penalty)
    weights[bucket] = w * r
    held.unpersist()
    return ToxicityModel(weights, bias)


def _logistic(row, column, value, y, width: int, penalty: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """L2 logistic regression on sparse rows by accelerated gradient descent with backtracking."""
    n = len(y)

    def loss(v):
        z = np.bincount(row, v[column] * value, n) + v[-1]
        return (np.logaddexp(0, z) - y * z).mean() + 0.5 * penalty * (v[:-1] @ v[:-1]), z

    v = np.zeros(width + 1)
    v[-1] = np.log(y.mean() / (1 - y.mean()))
    last, speed, size = v.copy(), 1.0, 1.0
    for _ in range(steps):
        upcoming = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        at = v + (speed - 1) / upcoming * (v - last)
        f, z = loss(at)
        error = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) / n
        slope = np.empty(width + 1)
        slope[:-1] = np.bincount(column, error[row] * value, width) + penalty * at[:-1]
        slope[-1] = error.sum()
        square = slope @ slope
        if square < 1e-12:
            break
        size *= 1.5
        while loss(at - size * slope)[0] > f - 0.5 * size * square and size > 1e-9:
            size /= 2
        last, v, speed = v, at - size * slope, upcoming
    return v[:-1], float(v[-1])


def score_texts(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    keys = _present(texts, model.weights != 0)
    z = np.bincount(keys >> BUCKET_BITS, model.weights[keys & (BUCKETS - 1)], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more likely toxic) of the whole text.

    A text that is null or empty has no n-grams and gets the score of the bias
    alone. If ``docs`` has a column ``score``, that stays and the new one gets an
    underscore before it.
    """
    name = free_name(docs, "score")
    # BUCKETS numbers; plain arrays, which executors without this package can read
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = ToxicityModel(*held.value)
        for batch in batches:
            texts = plain_text(batch.column(position))
            parts = [score_texts(texts.slice(a, b - a), learned) for a, b in text_slices(texts)]
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, same columns, that score below ``limit``."""
    scored = score(docs, model, text_col)
    return scored.filter(F.col(scored.columns[-1]) < limit).select(docs.columns)
