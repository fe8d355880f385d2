"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomframe.core.session import new_path

#: Text that one vectorised step inside a task works on; a longer single text is one step.
SLICE_BYTES = 2 << 20


def remembered(key, make: Callable):
    """``make()``, once per process: a worker keeps it from task to task, however this module reached it."""
    name = "_loomframe_memory"
    memory = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in memory:
        memory[key] = make()
    return memory[key]


class Scratch:
    """Written intermediates of one operator call, in the folder that all executors share.

    Writing cuts the lineage, so a lost executor costs one step and not the
    whole plan. ``drop`` deletes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            found = self._paths.pop(id(table), None)
            if found:
                delete_path(self.spark, found[1])

    def close(self) -> None:
        for _, path in self._paths.values():
            delete_path(self.spark, path)
        self._paths.clear()


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark itself uses for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plain_text(column) -> pa.Array:
    """A string column as one array of 64-bit offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets into them."""
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay near ``limit`` bytes; at least one row each."""
    _, offsets = text_bytes(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the signed longs that Spark has."""
    return pa.array(x.view(np.int64), pa.int64())


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
