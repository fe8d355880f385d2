"""Language identification of whole texts and of the spans inside mixed ones.

The script of a word (from Unicode ranges) narrows the languages it can be in to
those whose training text uses that script. Each word gets a score per language,
the log probability of its letter trigrams, and Viterbi with a penalty for every
switch labels the words, so that a text in several languages falls into spans.

Viterbi runs over all texts of a batch at once: texts are cut into chunks of
``CHUNK`` words, the best path between every first and last language of a chunk
is found for all chunks together, and the chunks are then joined text by text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loomframe.llm.common import SLICE_BYTES, free_name, mix, plain_text, remembered, text_bytes, text_slices

# First and last code point of Unicode blocks, by script.
SCRIPTS = {
    "latin": [(0x0041, 0x005A), (0x0061, 0x007A), (0x00AA, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
#: Scripts count from 1; a letter outside all ranges belongs to script 0.
NAMES = ["other", *SCRIPTS]
BUCKETS = 1 << 16
CHUNK = 48
#: A script is one of a language's when it has this share of the letters in its training text.
SCRIPT_SHARE = 0.01


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: 0 for what is no letter, else 1 + script; and the lower-case code point."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x34000):
        c = chr(point)
        category = unicodedata.category(c)
        if category[0] == "L" or category == "Mn" or category == "Mc":
            kind[point] = 1
            folded = c.lower()
            if len(folded) == 1:
                lower[point] = ord(folded)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            part = kind[first : last + 1]
            part[part > 0] = 1 + number
    return kind, lower


@dataclass
class Words:
    """The letter runs of many texts: where each starts in the code points, and what it holds."""

    start: np.ndarray  # code point position of the first letter
    length: np.ndarray
    script: np.ndarray
    text: np.ndarray  # number of the text
    grams: np.ndarray  # trigram bucket of every letter, in order
    first: np.ndarray  # position of each word's first letter among all letters


def words_of(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of all texts, and the code point position where each text starts."""
    data, offsets = text_bytes(texts)
    head = (data & 0xC0) != 0x80
    begins = np.concatenate(([0], np.cumsum(head)))[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kind, lower = remembered("scripts", _tables)
    kinds = kind[points]
    letter = kinds > 0
    new = letter.copy()
    new[1:] &= ~letter[:-1]
    edges = begins[1:-1]
    edges = edges[edges < len(points)]
    new[edges] = letter[edges]
    at = np.flatnonzero(letter)
    starts = np.flatnonzero(new)
    first = np.searchsorted(at, starts)
    length = np.diff(np.concatenate((first, [len(at)])))
    folded = lower[points[at]].astype(np.uint64)
    before = np.concatenate(([np.uint64(0)], folded[:-1])) if len(folded) else folded
    after = np.concatenate((folded[1:], [np.uint64(0)])) if len(folded) else folded
    if len(starts):
        before[first] = 0
        after[first + length - 1] = 0
    grams = (mix((before << np.uint64(42)) | (folded << np.uint64(21)) | after) & np.uint64(BUCKETS - 1)).astype(np.int32)
    text = np.searchsorted(begins, starts, side="right") - 1
    return Words(starts, length, kinds[starts].astype(np.int64) - 1, text, grams, first), begins


@dataclass
class LanguageModel:
    """Log probabilities of trigram buckets, and the scripts, of each learned language."""

    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS
    uses: np.ndarray  # scripts x languages
    log_prior: np.ndarray
    switch: float = 12.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, labels = plain_text(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
        for a, b in text_slices(texts):
            words, _ = words_of(texts.slice(a, b - a))
            of = labels[a:b]
            for label in set(of.tolist()):
                mine = of[words.text] == label
                each = np.repeat(mine, words.length)
                total = grams.setdefault(label, np.zeros(BUCKETS + len(NAMES) + 1, np.int64))
                total[:BUCKETS] += np.bincount(words.grams[each], minlength=BUCKETS)
                total[BUCKETS:-1] += np.bincount(words.script[mine], words.length[mine], len(NAMES)).astype(np.int64)
                total[-1] += int((of == label).sum())
    for label, total in grams.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "cell", "n"]
        )


def fit_languages(
    labelled: DataFrame, id_col: str, text_col: str, lang_col: str, fit_rows: int = 20_000, switch: float = 12.0
) -> LanguageModel:
    """Learn from about ``fit_rows`` of the labelled rows (all, if fewer), chosen by a hash of their id.

    Rows without a label or an id teach nothing. The driver sees one count per
    language and used trigram bucket.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    total = rows.count()
    share = min(1.0, fit_rows / max(total, 1))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))
    cells = (
        chosen.select(F.col(text_col), F.col(lang_col).cast("string"))
        .mapInArrow(_count, "lang string, cell int, n long")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = cells.column("lang").combine_chunks().dictionary_encode() if cells.num_rows else None
    languages = sorted(names.dictionary.to_pylist()) if names is not None else []
    counts = np.zeros((len(languages), BUCKETS + len(NAMES) + 1))
    if languages:
        place = np.array([languages.index(x) for x in names.dictionary.to_pylist()])
        counts[place[names.indices.to_numpy()], cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    grams, scripts, rows_of = counts[:, :BUCKETS], counts[:, BUCKETS:-1], counts[:, -1]
    log_p = np.log(grams + 0.1) - np.log(grams.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)
    uses = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T & (scripts.T > 0)
    prior = np.log((rows_of + 1) / (rows_of.sum() + len(languages))) if languages else rows_of
    return LanguageModel(languages, log_p.astype(np.float32), uses, prior, switch)


def word_scores(words: Words, model: LanguageModel) -> np.ndarray:
    """Log probability of every word in every language, the best candidate at 0.

    A language that does not use the word's script is no candidate. A script
    that no language uses tells nothing: all scores are 0.
    """
    n, k = len(words.start), len(model.languages)
    scores = np.empty((n, k))
    for j in range(k):
        scores[:, j] = np.add.reduceat(model.log_p[j][words.grams], words.first, dtype=np.float64) if n else 0
    allowed = model.uses[words.script]
    scores[~allowed] = -1e4
    scores[~allowed.any(axis=1)] = 0.0
    return scores - scores.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, ends: np.ndarray, switch: float) -> np.ndarray:
    """The best labels of all words when each change of label costs ``switch``.

    ``ends[t]`` is the number of words in the texts up to and including t. Among
    equal paths the one that stays, then the lower label, wins.
    """
    n, k = scores.shape
    labels = np.zeros(n, np.int64)
    if not n:
        return labels
    lengths = np.diff(np.concatenate(([0], ends)))
    chunks_of = -(-lengths // CHUNK)
    text = np.repeat(np.arange(len(lengths)), chunks_of)
    first_chunk = np.concatenate(([0], np.cumsum(chunks_of)[:-1]))
    number = np.arange(len(text)) - first_chunk[text]
    start = (ends - lengths)[text] + number * CHUNK
    size = np.minimum(CHUNK, ends[text] - start)
    # chunks by falling size, so that those which reach a step are a prefix of every array
    by_size = np.argsort(-size, kind="stable")
    rank = np.empty_like(by_size)
    rank[by_size] = np.arange(len(by_size))
    begin, reach = start[by_size], np.searchsorted(-size[by_size], -np.arange(CHUNK), side="left")
    columns = np.ascontiguousarray(scores.T, dtype=np.float32)
    # best[e, s, c]: best path through chunk c whose first word has label s and whose last has label e
    best = np.full((k, k, len(text)), -np.inf, np.float32)
    for j in range(k):
        best[j, j] = columns[j][begin]
    back = np.zeros((CHUNK, k, k, len(text)), np.uint8)
    for step in range(1, CHUNK):
        m = int(reach[step])
        if not m:
            break
        b = best[:, :, :m]
        top, high = np.zeros((k, m), np.uint8), b[0].copy()
        for e in range(1, k):
            np.copyto(top, e, where=b[e] > high)
            np.maximum(high, b[e], out=high)
        high -= switch
        for e in range(k):
            move = high > b[e]
            back[step, e, :, :m] = np.where(move, top, np.uint8(e))
            np.maximum(b[e], high, out=b[e])
            b[e] += columns[e][begin[:m] + step]
    best = best.transpose(2, 1, 0)[rank].astype(np.float64)
    # join the chunks of each text
    stay = np.arange(k, dtype=np.uint8)
    value = np.zeros((len(lengths), k))
    enter = np.zeros((len(text), k), np.uint8)  # label before the chunk, for each first label
    inside = np.zeros((len(text), k), np.uint8)  # first label of the chunk, for each last label
    order = np.argsort(number, kind="stable")
    rounds = np.split(order, np.cumsum(np.bincount(number))[:-1])
    for i, c in enumerate(rounds):
        t = text[c]
        if i:
            v = value[t]
            top = v.argmax(axis=1)
            jump = np.take_along_axis(v, top[:, None], 1) - switch
            enter[c] = np.where(jump > v, top[:, None].astype(np.uint8), stay)
            v = np.maximum(v, jump)
        else:
            v = value[t]
        through = v[:, :, None] + best[c]
        inside[c] = through.argmax(axis=1)
        value[t] = through.max(axis=1)
    last = np.zeros(len(lengths), np.int64)
    has = lengths > 0
    last[has] = value[has].argmax(axis=1)
    first, final = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    for c in reversed(rounds):
        final[c] = last[text[c]]
        first[c] = inside[c, final[c]]
        last[text[c]] = enter[c, first[c]]
    at, first = final[by_size], first[by_size]
    for step in range(CHUNK - 1, -1, -1):
        m = int(reach[step])
        labels[begin[:m] + step] = at[:m]
        if step:
            at[:m] = back[step, at[:m], first[:m], np.arange(m)]
    return labels


def label_texts(texts: pa.Array, model: LanguageModel) -> tuple[list, np.ndarray, list, np.ndarray]:
    """Per text: its language (or None), the confidence, its spans (start, end, language) in code points, and the share of letters in scripts that no language uses."""
    words, begins = words_of(texts)
    n, k = len(texts), len(model.languages)
    if not k:
        return [None] * n, np.zeros(n), [[] for _ in range(n)], np.bincount(words.text, minlength=n)[:n].astype(bool).astype(float)
    ends = np.searchsorted(words.text, np.arange(n), side="right")
    scores = word_scores(words, model)
    labels = viterbi(scores, ends, model.switch)
    letters = np.bincount(words.text * k + labels, words.length, n * k).reshape(n, k)
    # the label's probability for each word, averaged over the letters
    sure = np.exp(scores[np.arange(len(labels)), labels]) / np.exp(scores).sum(axis=1) if len(labels) else np.zeros(0)
    total = letters.sum(axis=1)
    ranked = letters + np.exp(model.log_prior - model.log_prior.max()) * 1e-6
    best = ranked.argmax(axis=1)
    mine = labels == best[words.text]
    weight = np.bincount(words.text[mine], (sure * words.length)[mine], n)
    score = np.divide(weight, total, out=np.zeros(n), where=total > 0)
    unused = np.bincount(words.text, words.length * ~model.uses[words.script].any(axis=1), n)
    foreign = np.divide(unused, total, out=np.zeros(n), where=total > 0)
    names = [model.languages[j] if t else None for j, t in zip(best.tolist(), total.tolist())]
    change = np.ones(len(labels), bool)
    change[1:] = (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])
    opens = np.flatnonzero(change)
    closes = np.concatenate((opens[1:], [len(labels)])) - 1 if len(opens) else opens
    spans: list[list] = [[] for _ in range(n)]
    finish = words.start + words.length
    for o, c in zip(opens.tolist(), closes.tolist()):
        t = int(words.text[o])
        spans[t].append((int(words.start[o] - begins[t]), int(finish[c] - begins[t]), model.languages[labels[o]]))
    return names, np.clip(score, 0.0, 1.0), spans, foreign


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``spans`` and ``foreign`` of the whole text.

    ``score`` is the mean probability of the predicted language over all letters
    (0 for letters in another language's span). ``foreign`` is the share of its
    letters in scripts that no learned language uses; they tell nothing, so a text
    of such letters alone gets the language with most training rows and an equal
    score for each. A text that is null, empty or without a letter, or any text
    when nothing was learned, gets ``und``, 0 and no spans. Ties go to the language with more
    training rows, then by name. An existing column of one of these names is
    kept; the new one then gets an underscore before it.
    """
    names = [free_name(docs, c) for c in ("lang_pred", "score", "spans", "foreign")]
    # languages x BUCKETS numbers; plain arrays, which executors without this package can read
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.uses, model.log_prior, model.switch))
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = LanguageModel(*held.value)
        for batch in batches:
            texts = plain_text(batch.column(position))
            # paths through a chunk take languages x languages numbers a word
            for a, b in text_slices(texts, SLICE_BYTES * 16 // max(16, len(learned.languages) ** 2)):
                lang, score, spans, foreign = label_texts(texts.slice(a, b - a), learned)
                extra = [
                    pa.array(["und" if x is None else x for x in lang], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(spans, _SPANS),
                    pa.array(foreign, pa.float64()),
                ]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, *names])

    span = T.StructType().add("start", "integer").add("end", "integer").add("lang", "string")
    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.ArrayType(span)), T.StructField(names[3], T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, same columns, whose language is determined with at least ``min_score`` and whose letters are mostly of scripts that a learned language uses."""
    scored = identify(docs, model, text_col)
    lang, score, _, foreign = scored.columns[len(docs.columns) :]
    return scored.filter((F.col(lang) != "und") & (F.col(score) >= min_score) & (F.col(foreign) <= 0.5)).select(docs.columns)
