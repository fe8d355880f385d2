"""Byte-level BPE encoding and decoding.

Words are split by the vocabulary's pattern. A short word is a contiguous array
of its parts and one of the ranks of adjacent parts: scan for the least rank,
delete that boundary, refresh the ranks on both sides, until no pair merges. The
arrays of many words of equal length are scanned together, one row each. Longer
words keep the same order of merges with a heap over a linked list.

Words repeat, so each worker encodes a word once and remembers it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from loomframe.llm.chunks import PieceCache
from loomframe.llm.common import free_name, plain_text, remembered, text_slices

SHORT = 48
_NONE = np.int32(2**31 - 1)
_EDGE_SPACE = regex.compile(r"^\s|\s$")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class ByteBpe:
    """A byte-level vocabulary: ids of bytes, merges by rank, bytes of ids, special strings."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray  # left * width + right, ascending
    pair_ranks: np.ndarray
    merged: np.ndarray  # id that the merge of each rank makes
    width: int
    token_bytes: list[bytes]
    special: dict[str, int]
    pattern: str
    _of_pair: dict = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, path: str, pattern: str) -> ByteBpe:
        """From a tokenizers file with a byte-level pre-tokenizer and no normalizer."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        width = max([*vocab.values(), *special.values()]) + 1
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        token_bytes = [b""] * width
        for token, i in vocab.items():
            token_bytes[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(
            np.array([vocab[alphabet[b]] for b in range(256)], np.int32),
            keys[order],
            order.astype(np.int32),
            np.array([vocab[a + b] for a, b in pairs], np.int32),
            width,
            token_bytes,
            special,
            pattern,
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_rows(self, parts: np.ndarray) -> list[np.ndarray]:
        """Encode words of one length: each row holds the ids of a word's bytes."""
        done: list = [None] * len(parts)
        row = np.arange(len(parts))
        ranks = self.ranks(parts[:, :-1], parts[:, 1:]) if parts.shape[1] > 1 else np.zeros((len(parts), 0), np.int32)
        size = np.full(len(parts), parts.shape[1])
        while len(row):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(row)), at]
                live = least < _NONE
            else:
                live = np.zeros(len(row), bool)
            for i in np.flatnonzero(~live).tolist():
                done[row[i]] = parts[i, : size[i]]
            if not live.any():
                break
            row, parts, ranks, size = row[live], parts[live], ranks[live], size[live] - 1
            at, least = at[live], least[live]
            each = np.arange(len(row))
            # delete the boundary after part `at`: everything right of it moves one place
            place = np.arange(parts.shape[1] - 1)[None, :]
            parts = np.take_along_axis(parts, place + (place > at[:, None]), 1)
            parts[each, at] = self.merged[least]
            place = np.arange(ranks.shape[1] - 1)[None, :]
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), 1)
            for left in (at - 1, at):
                ok = np.flatnonzero((left >= 0) & (left + 1 < size))
                ranks[ok, left[ok]] = self.ranks(parts[ok, left[ok]], parts[ok, left[ok] + 1])
        return done

    def merge_long(self, word: bytes) -> np.ndarray:
        """Encode one long word: the least rank, leftmost first, from a heap."""
        if not self._of_pair:
            self._of_pair.update(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        rank_of, width, n = self._of_pair, self.width, len(word)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank_of.get(ids[a] * width + ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, a match of the pattern."""
        data = [w.encode() for w in words]
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, b in enumerate(data):
            if len(b) > SHORT:
                out[i] = self.merge_long(b)
            else:
                by_length.setdefault(len(b), []).append(i)
        for length, at in by_length.items():
            for start in range(0, len(at), 8192):
                some = at[start : start + 8192]
                raw = np.frombuffer(b"".join([data[i] for i in some]), np.uint8).reshape(len(some), length)
                for i, ids in zip(some, self.merge_rows(self.byte_ids[raw])):
                    out[i] = ids
        return out

    def decode(self, ids) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become the replacement character."""
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")


class Codec:
    """Encoding of whole texts with the memory of one worker."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self._words = regex.compile(bpe.pattern)
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(bpe.special, key=len, reverse=True)) or "(?!)")
        self.pieces = PieceCache(self._digest)

    def _digest(self, pieces: list[str]) -> list[tuple[int, str, bytes]]:
        """Number of ids, the ids as text, and their bytes decoded again, of texts between which no word lies."""
        words = [self._words.findall(p) for p in pieces]
        distinct = list({w for some in words for w in some})
        ids = dict(zip(distinct, [x.tolist() for x in self.bpe.encode_words(distinct)]))
        table = self.bpe.token_bytes
        out = []
        for some in words:
            all_ids = [i for w in some for i in ids[w]]
            out.append((len(all_ids), ",".join(map(str, all_ids)), b"".join([table[i] for i in all_ids])))
        return out

    def whole(self, text: str) -> list[int]:
        """Ids of one text, special strings as their own ids."""
        out, at = [], 0
        for m in [*self._special.finditer(text), None]:
            words = self._words.findall(text[at : m.start() if m else len(text)])
            distinct = list(set(words))
            ids = dict(zip(distinct, [x.tolist() for x in self.bpe.encode_words(distinct)]))
            out += [i for w in words for i in ids[w]]
            if m:
                out.append(self.bpe.special[m.group()])
                at = m.end()
        return out

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Per text: the number of ids, SHA-256 of the ids and of the decoded text.

        Text between single spaces is encoded on its own: the pattern joins a
        space to the word after it, so nothing crosses such a place. A text where
        a piece is empty or has other white space at its edge, or that holds a
        special string, is encoded in one go.
        """
        split = pc.split_pattern(texts, " ")
        cut = split.offsets.to_numpy()
        codes = split.flatten().dictionary_encode()
        distinct, index = codes.dictionary.to_numpy(zero_copy_only=False).tolist(), codes.indices.to_numpy()
        odd = np.array([not p or _EDGE_SPACE.search(p) is not None for p in distinct], bool)
        has_special = np.zeros(len(texts), bool)
        for s in self.bpe.special:
            has_special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        made = self.pieces([" " + p for p in distinct])
        firsts = self.pieces([distinct[index[a]] if b > a else "" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])
        counts = np.array([m[0] for m in made], np.int64)
        ids_of, bytes_of = [m[1] for m in made], [m[2] for m in made]
        bad = np.concatenate(([0], np.cumsum(odd[index])))
        n, ids_hash, text_hash = [], [], []
        for t, (a, b) in enumerate(zip((cut[:-1] - cut[0]).tolist(), (cut[1:] - cut[0]).tolist())):
            if b == a + 1 and not distinct[index[a]]:
                ids_text, decoded, count = "", b"", 0
            elif has_special[t] or bad[b] > bad[a]:
                ids = self.whole(texts[t].as_py())
                ids_text, count = ",".join(map(str, ids)), len(ids)
                decoded = b"".join([self.bpe.token_bytes[i] for i in ids])
            else:
                rest = index[a + 1 : b]
                of = rest.tolist()
                ids_text = ",".join([firsts[t][1], *[ids_of[i] for i in of]])
                decoded = b"".join([firsts[t][2], *[bytes_of[i] for i in of]])
                count = firsts[t][0] + int(counts[rest].sum())
            n.append(count)
            ids_hash.append(hashlib.sha256(ids_text.encode()).hexdigest())
            text_hash.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
        return n, ids_hash, text_hash


def _codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary, so that its memory lasts from task to task."""
    return remembered(("bpe", path, pattern), lambda: Codec(ByteBpe.read(path, pattern)))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text; a text that is null or empty has none.

    ``path`` must name the vocabulary file on every executor. An existing column
    of that name stays, the new one then gets an underscore before it.
    """
    name, position = free_name(docs, name), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            ids = [codec.whole(t) for t in plain_text(batch.column(position)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of each list of ids, special ones included; null stays null."""
    name, position = free_name(rows, name), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _codec(path, pattern).bpe
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids and of the text decoded from them.

    A text that is null or empty has no ids and decodes to the empty text.
    Repeated rows give equal rows; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            texts = plain_text(batch.column(1))
            for a, b in text_slices(texts):
                n, ids_hash, text_hash = codec.digests(texts.slice(a, b - a))
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [docs.schema[id_col]]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
