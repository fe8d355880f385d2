"""Token ids of a corpus as binary files, and back.

Ids are replaced by their rank in the corpus's frequency order, so that common
tokens get small numbers, and ranks are written in a byte-aligned code: of each
rank only its 1 to 4 significant bytes, little-endian, in a data section, and
its number of bytes less one in 2 bits of a separate control section, four ranks
to a control byte. The reader takes lengths from a table of 256 x 4 entries.

A file is a sequence of blocks; every number is little-endian:

    magic "LFTB", version u32, documents u64, ids u64, start u64 (ids of all
    documents before the block), control bytes u64, data bytes u64;
    per document: id i64, id present u8 (as three sections: ids, flags, and
    lengths u64); control section; data section; the byte 0x0A

Blocks lie in ``part=N`` folders in ascending order of document id. ``ranks`` is
a block of the same kind whose one document lists the ids by falling frequency.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.llm.byte_bpe import byte_alphabet
from loomframe.llm.chunks import PieceCache, gather, ragged
from loomframe.llm.common import SLICE_BYTES, Scratch, plain_text, remembered, text_slices

_HEAD = "<4sIQQQQQ"
_MAGIC, _VERSION = b"LFTB", 1
#: Ids of a block; a longer document is a block alone.
BLOCK_IDS = 1 << 20
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1
#: A word of lower-case Latin letters in composed form, then punctuation that cannot join it.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN_WORD = re.compile(f"[{_LETTERS}]+")
_TRAILING = r"([a-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}])([.,!?;:]+)([ \n\t\r]|$)"


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data sections of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4", copy=False)
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4)[None, :] < size[:, None]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks of both sections, lengths by table lookup."""
    size = _LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4)[None, :] < size[:, None]] = data
    return out.reshape(-1).view("<u4")


def write_block(doc_ids: list, lengths: np.ndarray, ranks: np.ndarray, start: int) -> bytes:
    control, data = pack_ranks(ranks)
    head = struct.pack(_HEAD, _MAGIC, _VERSION, len(doc_ids), len(ranks), start, len(control), len(data))
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    present = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    return b"".join((head, ids, present, lengths.astype("<u8").tobytes(), control, data))


def read_blocks(content: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray, int]]:
    """``(document ids, lengths, ranks, start)`` of each block of a file."""
    at = 0
    while at < len(content):
        magic, version, docs, ids, start, controls, size = struct.unpack_from(_HEAD, content, at)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a token file")
        at += struct.calcsize(_HEAD)
        doc_ids = np.frombuffer(content, "<i8", docs, at).tolist()
        present = np.frombuffer(content, np.uint8, docs, at + 8 * docs).tolist()
        lengths = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        control = np.frombuffer(content, np.uint8, controls, at)
        data = np.frombuffer(content, np.uint8, size, at + controls)
        at += controls + size + 1
        yield [d if p else None for d, p in zip(doc_ids, present)], lengths, unpack_ranks(control, data, ids), start


class WordTokenizer:
    """A tokenizers file that drops white space, applied to distinct words only.

    White space separates words for good in such a file, so a text's ids are
    those of its words. A word of plain lower-case letters goes to the merges
    directly, any other through the whole tokenizer. Texts with a special string
    keep their case until then.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        alphabet = byte_alphabet()
        self._bytes = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(256) if _PLAIN_WORD.fullmatch(chr(c))}
        self._words = PieceCache(self._encode, 800_000)

    def _encode(self, words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if _PLAIN_WORD.fullmatch(w):
                # what a plain word's pre-tokenization gives: itself, byte by byte
                out[i] = array("I", [t.id for t in self._model.tokenize(w if w.isascii() else w.translate(self._bytes))]).tobytes()
            else:
                rest.append(i)
        for i, e in zip(rest, self._tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text."""
        lowered = pc.ascii_lower(texts)
        for s in self._special:
            lowered = pc.if_else(pc.match_substring(texts, s), texts, lowered)
        spaced = pc.replace_substring_regex(lowered, pattern=_TRAILING, replacement=r"\1 \2\3")
        split = pc.ascii_split_whitespace(spaced)
        words = split.flatten().dictionary_encode()
        index = words.indices.to_numpy()
        ids, of_word = ragged(self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint32)
        ids, of = gather(ids, of_word, index)
        cut = split.offsets.to_numpy()
        return ids, of[cut - cut[0]]


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker and file, so that its memory lasts from task to task."""
    return remembered(("tokenizer", path), lambda: WordTokenizer(path))


def _tokenize(path: str, end: int) -> Callable:
    """Ids of sorted documents, with the number of their partition and the ids before each in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, before = _tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = plain_text(batch.column(1))
            for a, b in text_slices(texts, 2 * SLICE_BYTES):
                ids, cut = tokenizer(texts.slice(a, b - a))
                if len(ids) and ids.max() >= 1 << 24:
                    raise ValueError("ids of 2^24 and more are not supported")
                rows = [np.append(ids[x:y], np.uint32(end)).astype("<u4").tobytes() for x, y in zip(cut[:-1], cut[1:])]
                n = np.diff(cut) + 1
                ends = before + np.cumsum(n)
                columns = [
                    pa.array(np.full(b - a, part), pa.int32()),
                    pa.array(ends - n, pa.int64()),
                    batch.column(0).slice(a, b - a),
                    pa.array(n, pa.int64()),
                    pa.array([_narrow(r) for r in rows], pa.binary()),
                ]
                before = int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, ["part", "before", "doc_id", "n", "ids"])

    return run


def _narrow(ids: bytes) -> bytes:
    """Three of the four bytes of each id, byte by byte in planes, which compresses well."""
    return np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _wide(planes: bytes) -> np.ndarray:
    raw = np.frombuffer(planes, np.uint8).reshape(3, -1)
    return raw[0].astype(np.uint32) | raw[1].astype(np.uint32) << 8 | raw[2].astype(np.uint32) << 16


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.column(0):
            some = np.bincount(_wide(row.as_py()))
            if len(some) > len(counts):
                some, counts = counts, some
            counts[: len(some)] += some
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["id", "n"])


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize the whole texts, append ``end`` to each, and write token files below ``path``.

    A text that is null or empty has the end id alone. Documents are written in
    ascending id order, null ids first; repeated ids in the order of a hash of
    their texts. Texts are sorted before they become ids, for a range partitioning
    evaluates its input twice. An empty table writes ``ranks`` and no blocks. The driver
    sees one count per used id and one sum per written partition.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    placed = scratch.write(
        rows.repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .mapInArrow(_tokenize(tokenizer_path, end), "part int, before long, doc_id long, n long, ids binary"),
        "ids",
    )
    sums = {r.part: r.n for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sums):
        starts[part], total = total, total + sums[part]
    counted = placed.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    by_count = np.lexsort((counted.column("id").to_numpy(), -counted.column("n").to_numpy()))
    by_rank = counted.column("id").to_numpy()[by_count].astype(np.uint32)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    held = spark.sparkContext.broadcast((rank_of, starts))  # one number per id and per partition

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, begin = held.value
        for batch in batches:
            part, before, n = (batch.column(i).to_numpy() for i in (0, 1, 3))
            doc_ids, filled = batch.column(2).to_pylist(), np.cumsum(n)
            a = 0
            while a < len(n):
                room = (filled[a] - n[a]) + BLOCK_IDS
                b = max(int(np.searchsorted(filled, room, side="right")), a + 1)
                new = np.flatnonzero((part[a + 1 : b] != part[a]) | (before[a + 1 : b] != before[a : b - 1] + n[a : b - 1]))
                b = a + 1 + int(new[0]) if len(new) else b
                ids = np.concatenate([_wide(batch.column(4)[i].as_py()) for i in range(a, b)])
                block = write_block(doc_ids[a:b], n[a:b], ranks[ids], begin[int(part[a])] + int(before[a]))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array(part[a : a + 1], pa.int32())], ["block", "part"])
                a = b

    encoded = placed.mapInArrow(blocks, "block binary, part int")
    # a text row is the block's bytes as they are; the line's end is the block's last byte
    encoded.select(F.col("block").cast("string").alias("value"), "part").write.partitionBy("part").text(f"{path}/blocks")
    ranks_block = write_block([0], np.array([len(by_rank)]), by_rank, 0)
    table = spark.createDataFrame([(bytearray(ranks_block),)], "block binary")
    table.select(F.col("block").cast("string").alias("value")).coalesce(1).write.text(f"{path}/ranks")
    held.unpersist()
    scratch.close()


def _ids_by_rank(spark: SparkSession, path: str) -> np.ndarray:
    files = spark.read.format("binaryFile").load(f"{path}/ranks").filter("length > 0").select("content").collect()
    return next(read_blocks(bytes(files[0].content)))[2]


def _read(spark: SparkSession, path: str, take: Callable, schema: str) -> DataFrame:
    by_rank = spark.sparkContext.broadcast(_ids_by_rank(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for doc_ids, lengths, ranks, start in read_blocks(content.as_py()):
                    ids = by_rank.value[ranks]
                    cut = np.concatenate(([0], np.cumsum(lengths)))
                    yield take(doc_ids, lengths, ids, cut, start)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(f"{path}/blocks").select("content").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document in token files."""

    def take(doc_ids, lengths, ids, cut, start):
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + cut[:-1], pa.int64()), lists], ["doc_id", "start", "ids"])

    return _read(spark, path, take, "doc_id long, start long, ids array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in token files."""

    def take(doc_ids, lengths, ids, cut, start):
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(memoryview(raw)[4 * x : 4 * y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
        columns = [pa.array(doc_ids, pa.int64()), pa.array(start + cut[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(spark, path, take, "doc_id long, start long, n_tokens long, ids_crc32 long")
