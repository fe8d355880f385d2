"""Fill-in-middle documents by a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that
never change: the texts as they came, and the sentinels. Cutting splits a
descriptor, an arrangement permutes descriptors and puts sentinels before them,
and restoring applies the inverse permutation to descriptors over the arranged
text. Bytes are copied once, when the arranged text is written out; digests
stream over descriptors and copy nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from loomframe.llm.common import free_name, plain_text, text_bytes, text_slices

# What opens the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
PREFIX, SUFFIX, MIDDLE = range(3)
#: The order of the parts in each arrangement; a sentinel stands before each part.
ARRANGEMENTS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN = "plain"
READING_ORDER = (PREFIX, MIDDLE, SUFFIX)

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True


@dataclass(frozen=True)
class Rule:
    """Of 100 documents ``rearranged`` are, and of these ``suffix_first`` in 100 start with the suffix."""

    rearranged: int = 90
    suffix_first: int = 20
    seed: int = 1

    def draw(self, ident) -> tuple[int, int, int, int]:
        """Four numbers that depend on the seed and the id alone; a row without an id draws as the empty id."""
        text = f"{self.seed}:{'' if ident is None else ident}"
        digest = hashlib.sha256(text.encode()).digest()
        return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


class PieceTable:
    """Descriptors of many documents, in rows of equally many, over immutable buffers."""

    def __init__(self, buffers: list[memoryview], buffer: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.buffers, self.buffer, self.start, self.length = buffers, buffer, start, length

    @classmethod
    def whole(cls, text: memoryview, offsets: np.ndarray, sentinels=SENTINELS) -> PieceTable:
        """One descriptor per document."""
        marks = memoryview("".join(sentinels).encode())
        start, length = offsets[:-1, None], np.diff(offsets)[:, None]
        return cls([text, marks], np.zeros_like(start), start, length)

    def cut(self, at: np.ndarray) -> PieceTable:
        """Split each document's one descriptor at the rising positions of its row of ``at``."""
        edges = np.concatenate((self.start, at, self.start + self.length), axis=1)
        return PieceTable(self.buffers, np.repeat(self.buffer, edges.shape[1] - 1, axis=1), edges[:, :-1], np.diff(edges))

    def permuted(self, order) -> PieceTable:
        order = list(order)
        return PieceTable(self.buffers, self.buffer[:, order], self.start[:, order], self.length[:, order])

    def behind_sentinels(self, sentinels, order) -> PieceTable:
        """Put before the k-th piece the sentinel number ``order[k]``."""
        sizes = np.array([len(s.encode()) for s in sentinels])
        places = np.cumsum(sizes) - sizes
        n, k = self.start.shape
        out = [np.empty((n, 2 * k), np.int64) for _ in range(3)]
        for column, mark, piece in zip(out, (np.ones(k, np.int64), places[list(order)], sizes[list(order)]), (self.buffer, self.start, self.length)):
            column[:, 0::2], column[:, 1::2] = mark, piece
        return PieceTable(self.buffers, *out)

    def rows(self, picked: np.ndarray) -> PieceTable:
        return PieceTable(self.buffers, self.buffer[picked], self.start[picked], self.length[picked])

    def __iter__(self) -> Iterator[list[memoryview]]:
        """The pieces of each document as views of the buffers."""
        for b, s, n in zip(self.buffer.tolist(), self.start.tolist(), self.length.tolist()):
            yield [self.buffers[x][i : i + m] for x, i, m in zip(b, s, n)]

    def digests(self) -> list[str]:
        """SHA-256 of each document, streamed over its descriptors."""
        out = []
        for pieces in self:
            digest = hashlib.sha256()
            for piece in pieces:
                digest.update(piece)
            out.append(digest.hexdigest())
        return out

    def texts(self) -> list[bytes]:
        return [b"".join(pieces) for pieces in self]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where units start: runs of A-Z and a-z, and every other code point by itself."""
    letter = _LETTER[data]
    starts = ~letter & ((data & 0xC0) != 0x80)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    first[edges] = letter[edges]
    return np.flatnonzero(starts | first)


def _array(values: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(offsets), pa.py_buffer(b"".join(values)))


def _scatter(n: int, parts: list[tuple[np.ndarray, list]]) -> list:
    out = [None] * n
    for picked, values in parts:
        for i, v in zip(picked.tolist(), values):
            out[i] = v
    return out


def arrange(texts: pa.Array, ids: list, rule: Rule, sentinels=SENTINELS) -> dict[str, pa.Array]:
    """Units, form, arranged text and its digest, and lengths of prefix and middle of each text."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    blob = data.tobytes()
    starts = np.append(unit_starts(data, offsets), len(data))
    first = np.searchsorted(starts[:-1], offsets)
    units = np.diff(first)
    draws = np.array([rule.draw(i) for i in ids], np.int64).reshape(n, 4)
    marks = [s.encode() for s in sentinels]
    has_mark = np.array([any(blob.find(m, a, b) >= 0 for m in marks) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], bool)
    plain = (units == 0) | has_mark | (draws[:, 2] % 100 >= rule.rearranged)
    form = np.where(plain, PLAIN, np.where(draws[:, 3] % 100 < rule.suffix_first, "spm", "psm"))
    cuts = np.sort(draws[:, :2] % (units + 1)[:, None], axis=1)
    # the unit after a text's last one starts where the text ends
    at = np.where(cuts < units[:, None], starts[np.minimum(first[:-1, None] + cuts, len(starts) - 1)], offsets[1:, None])
    whole = PieceTable.whole(memoryview(blob), offsets, sentinels)
    split = whole.cut(at)
    parts = [(np.flatnonzero(plain), whole.rows(np.flatnonzero(plain)))]
    for name, order in ARRANGEMENTS.items():
        picked = np.flatnonzero(form == name)
        reading = split.rows(picked)
        parts.append((picked, reading.permuted([READING_ORDER.index(p) for p in order]).behind_sentinels(sentinels, order)))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.diff(points[np.concatenate((offsets[:-1, None], at), axis=1)], axis=1)
    return {
        "n": pa.array(units, pa.int64()),
        "form": pa.array(form.tolist(), pa.string()),
        "fim_text": _array(_scatter(n, [(p, t.texts()) for p, t in parts])),
        "fim_sha256": pa.array(_scatter(n, [(p, t.digests()) for p, t in parts]), pa.string()),
        "prefix_chars": pa.array(chars[:, 0], pa.int64(), mask=plain),
        "middle_chars": pa.array(chars[:, 1], pa.int64(), mask=plain),
    }


def restored_pieces(texts: pa.Array, forms: list, sentinels=SENTINELS) -> list[tuple[np.ndarray, PieceTable]]:
    """Descriptors over arranged texts that give the texts as they were: (rows, their table), ...

    Rows whose form is unknown or whose sentinels aren't where their form has them are in no table.
    """
    data, offsets = text_bytes(texts)
    blob = data.tobytes()
    form = np.array([f or "" for f in forms], object)
    whole = PieceTable.whole(memoryview(blob), offsets, sentinels)
    plain = np.flatnonzero(form == PLAIN)
    found = [(plain, whole.rows(plain))]
    marks = [s.encode() for s in sentinels]
    for name, order in ARRANGEMENTS.items():
        picked, edges = [], []
        for i in np.flatnonzero(form == name).tolist():
            at, end, row = int(offsets[i]), int(offsets[i + 1]), []
            for p in order:
                at = blob.find(marks[p], at, end)
                if at < 0:
                    break
                row += [at, at + len(marks[p])]
                at += len(marks[p])
            if len(row) == 6 and row[0] == offsets[i]:
                picked.append(i)
                edges.append(row)
        rows = np.array(picked, np.int64)
        # sentinel, part, sentinel, part, sentinel, part: the parts alone, back in reading order
        pieces = whole.rows(rows).cut(np.array(edges, np.int64).reshape(len(picked), 6)).permuted([2, 4, 6])
        found.append((rows, pieces.permuted([order.index(p) for p in READING_ORDER])))
    return found


def _mapped(df: DataFrame, make, fields: list[tuple[str, T.DataType]], text_col: str, other_col: str, keep: list[str] | None) -> DataFrame:
    text, other = df.columns.index(text_col), df.columns.index(other_col)
    keep = df.columns if keep is None else keep
    kept = [df.columns.index(c) for c in keep]
    names = [free_name(df.select(*keep), n) for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain_text(batch.column(text))
            for a, b in text_slices(texts):
                made = make(texts.slice(a, b - a), batch.column(other).slice(a, b - a).to_pylist())
                columns = [batch.column(i).slice(a, b - a) for i in kept]
                yield pa.RecordBatch.from_arrays(columns + [made[n] for n, _ in fields], [batch.schema.names[i] for i in kept] + names)

    added = [T.StructField(name, kind) for name, (_, kind) in zip(names, fields)]
    return df.mapInArrow(run, T.StructType([*[df.schema.fields[i] for i in kept], *added]))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), sentinels=SENTINELS, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n``, ``form``, ``fim_text``, ``fim_sha256``, ``prefix_chars`` and ``middle_chars``.

    ``n`` counts the units (``[A-Za-z]+|[^A-Za-z]``) of the whole text. The prefix
    ends after the smaller, the middle after the larger of two drawn numbers of
    units. A text that is null or empty, holds a sentinel, or is drawn to stay has
    the form ``plain``, its own text (empty for null) and null lengths; lengths
    count code points. Draws depend on the id alone, so repeated rows get equal
    results; a null id draws as an empty one. A kept column that has one
    of the new names stays; the new one then gets an underscore before it. An
    empty table gives an empty result.
    """
    whole, long = T.StringType(), T.LongType()
    fields = [("n", long), ("form", whole), ("fim_text", whole), ("fim_sha256", whole), ("prefix_chars", long), ("middle_chars", long)]
    return _mapped(docs, lambda texts, ids: arrange(texts, ids, rule, sentinels), fields, text_col, id_col, keep)


def restore(docs: DataFrame, text_col: str = "fim_text", form_col: str = "form", sentinels=SENTINELS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``restored_text`` and ``restored_sha256``, from the arranged text and its form alone.

    Both are null where the form is unknown or null, or the text doesn't hold the form's sentinels in their order.
    """

    def make(texts: pa.Array, forms: list) -> dict[str, pa.Array]:
        parts = restored_pieces(texts, forms, sentinels)
        rebuilt = _scatter(len(texts), [(p, t.texts()) for p, t in parts])
        digests = _scatter(len(texts), [(p, t.digests()) for p, t in parts])
        missing = np.array([r is None for r in rebuilt], bool)
        text = _array([r or b"" for r in rebuilt])
        if missing.any():
            text = pc.if_else(pa.array(missing), pa.scalar(None, pa.string()), text)
        return {"restored_text": text, "restored_sha256": pa.array(digests, pa.string())}

    return _mapped(docs, make, [("restored_text", T.StringType()), ("restored_sha256", T.StringType())], text_col, form_col, keep)
