"""Keyed operators with state of their own: recent rows, first-seen values, batches that close when idle.

State lives in Spark's state store below the query's checkpoint, so a query that
stops or loses executors goes on where it was. Each key's state is bounded: a
number of rows, one value, or one open batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomframe.core.order import row_index
from loomframe.core.session import new_path

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Choose the state store that keyed operators need, unless the session names one."""
    if not spark.conf.get(_STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_STORE, _ROCKS)


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _plain(frame: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Rows as tuples of Python values of the schema's types, missing ones as None.

    A column of whole numbers with a null comes as floating point.
    """
    kinds = [int if isinstance(f.dataType, _WHOLE) else lambda x: x for f in schema.fields]
    rows = frame.astype(object).itertuples(index=False, name=None)
    return [tuple(None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else kind(x) for kind, x in zip(kinds, row)) for row in rows]


class Recent(StatefulProcessor):
    """The ``capacity`` rows of a key with the greatest order value; emits all of them, by rank, whenever a batch changes them."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], schema: T.StructType, order_at: int, capacity: int):
        self.keys, self.columns, self.schema, self.order_at, self.capacity = list(keys), list(columns), schema, order_at, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("recent", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = [tuple(r) for r in self.held.get()]
        for frame in rows:
            best += [r for r in _plain(frame[self.columns], self.schema) if r[self.order_at] is not None]
            # never more than the capacity and one Arrow batch
            best = sorted(best, key=lambda r: r[self.order_at], reverse=True)[: self.capacity]
        if best:
            self.held.put(best)
            out = pd.DataFrame(best, columns=self.columns)
            for name, value in zip(self.keys, key):
                out[name] = value
            out["rank"] = range(1, len(best) + 1)
            yield out[[*self.keys, "rank", *self.columns]]

    def close(self) -> None: ...


def recent_rows(stream: DataFrame, group: Sequence[str], order_by: str, capacity: int) -> DataFrame:
    """``(group, rank, other columns)``: the ``capacity`` most recent rows of each group, as updates keyed by group and rank.

    Rows without an order value are left out; a null group is a group. Of rows
    with one order value those that came first stay.
    """
    with_state(stream.sparkSession)
    group = list(group)
    columns = [c for c in stream.columns if c not in group]
    schema = T.StructType(_fields(stream, columns))
    out = T.StructType([*_fields(stream, group), T.StructField("rank", T.LongType()), *schema.fields])
    processor = Recent(group, columns, schema, columns.index(order_by), capacity)
    return stream.groupBy(*group).transformWithStateInPandas(processor, out, "Update", "None")


class FirstSeen(StatefulProcessor):
    """Emits a key once, with the least order value of the batch that brought it."""

    def __init__(self, keys: Sequence[str], order_by: str):
        self.keys, self.order_by = list(keys), order_by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        first = None
        for frame in rows:
            least = frame[self.order_by].min()
            first = least if first is None or least < first else first
        if not known:
            self.seen.update((True,))
            yield pd.DataFrame({**{n: [v] for n, v in zip(self.keys, key)}, "first": [first]})

    def close(self) -> None: ...


def first_seen(stream: DataFrame, token: str, order_by: str) -> DataFrame:
    """``(token, first)``: each value once, when it first comes."""
    with_state(stream.sparkSession)
    out = T.StructType([stream.schema[token], T.StructField("first", stream.schema[order_by].dataType)])
    return stream.groupBy(token).transformWithStateInPandas(FirstSeen([token], order_by), out, "Append", "None")


class IdleBatch(StatefulProcessor):
    """Counts and sums a key's rows until none came for ``idle_ms``; then emits the batch, with no need of further input."""

    def __init__(self, keys: Sequence[str], value: str, idle_ms: int):
        self.keys, self.value, self.idle_ms = list(keys), value, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType().add("n", "long").add("total", "double").add("due", "long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, due = self.open.get() if self.open.exists() else (0, 0.0, None)
        for frame in rows:
            n, total = n + len(frame), total + float(frame[self.value].sum())
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(due)
        self.open.update((n, total, due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total, _ = self.open.get()
        self.open.clear()
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "n": [n], "total": [total]})

    def close(self) -> None: ...


def idle_batches(stream: DataFrame, key: str, value: str, idle_ms: int) -> DataFrame:
    """``(key, n, total)``: a batch per key that closes once its key had no input for ``idle_ms`` of processing time.

    The query must run with a trigger that fires without input (a processing-time
    one). Null values count as rows and add nothing.
    """
    with_state(stream.sparkSession)
    out = T.StructType([stream.schema[key], T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    return stream.groupBy(key).transformWithStateInPandas(IdleBatch([key], value, idle_ms), out, "Append", "ProcessingTime")


# sinks that go on after a stop ---------------------------------------------------------
def run_updates(stream: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Take all available input in update mode and return the last version of each key, over all runs with this ``path``.

    A repeated micro-batch rewrites its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").outputMode("update")
    writer.trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    versions = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())]))
    last = F.max_by(F.struct(*rest), F.col("epoch")).alias("_l")
    return versions.option("basePath", path).parquet(path).groupBy(*keys).agg(last).select(*keys, "_l.*")


def run_vocabulary(stream: DataFrame, token: str, order_by: str, path: str) -> DataFrame:
    """``(token, index)``: dense indices in the order in which values were first seen, over all runs with this ``path``.

    State tells what is new, so a micro-batch reads nothing of earlier ones but
    their row counts, which Parquet keeps in its footers.
    """
    spark = stream.sparkSession
    fresh = first_seen(stream, token, order_by)
    schema = T.StructType([stream.schema[token], T.StructField("index", T.LongType())])
    all_ = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])

    def write(batch: DataFrame, epoch: int) -> None:
        earlier = 0
        if epoch:
            earlier = spark.read.schema(all_).option("basePath", path).parquet(path).filter(F.col("epoch") < epoch).count()
        numbered = row_index(batch, ["first", token], "index").select(token, (F.col("index") + earlier).alias("index"))
        numbered.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = fresh.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(all_).option("basePath", path).parquet(path).select(token, "index")


def drain_recent(stream: DataFrame, group: Sequence[str], order_by: str, capacity: int, label: str) -> DataFrame:
    """The most recent rows of each group at the end of the available input."""
    return run_updates(recent_rows(stream, group, order_by, capacity), [*group, "rank"], new_path(stream.sparkSession, label))


def drain_vocabulary(stream: DataFrame, token: str, order_by: str, label: str) -> DataFrame:
    """The vocabulary at the end of the available input."""
    return run_vocabulary(stream, token, order_by, new_path(stream.sparkSession, label))
