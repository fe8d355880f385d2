"""Bounds of joins: the bytes of a table that may be broadcast, and the hot keys of the other side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A table is broadcast up to this size; its hash relation takes about twice as much in every executor.
BROADCAST_BYTES = 64 << 20
#: What the hash relation adds to a row, about.
ROW_OVERHEAD = 32
#: A key with at least this share of the rows is hot, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 128
#: Entries of the summary; it misses a count by less than 3.5 / SUMMARY of all rows.
SUMMARY = 1 << 14
SALTS = 16


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores before it until no column of the frames has it (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            size = F.size(value) * 8
        else:
            size = F.aggregate(F.transform(value, lambda x: _value_bytes(x, kind.elementType)), F.lit(0).cast("long"), lambda s, x: s + x)
    elif isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        size = _value_bytes(F.map_entries(value), entries)
    elif isinstance(kind, T.StructType):
        size = sum((_value_bytes(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    else:
        size = F.lit(0)
    return F.coalesce(size, F.lit(0)).cast("long") + 8


def table_bytes(df: DataFrame) -> int:
    """Bytes of all rows of ``df`` as a hash relation, about: counted, not taken from the plan."""
    row = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_OVERHEAD).cast("long"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame) -> bool:
    return table_bytes(df) <= BROADCAST_BYTES


def _key_hash(key: Sequence[str]) -> Column:
    return F.xxhash64(F.lit("hot"), *[F.col(f"`{k}`") for k in key])


def hot_keys(df: DataFrame, key: Sequence[str], share: float | None = None) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of the rows, nulls too, by a frequent-items summary merged over all tasks."""
    share = share or HOT_SHARE
    most = int(1 / share)
    hashed = df.select(_key_hash(key).alias("k"))
    found = hashed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(k, {2 * most}, {max(SUMMARY, 4 * most)})").alias("top")).first()
    # counts of the summary may fall short by its error
    least = (share - 3.5 / max(SUMMARY, 4 * most)) * found.n
    return sorted(r["item"] for r in found.top or [] if r["count"] >= least)


def salted(df: DataFrame, table: DataFrame, key: Sequence[str], salt: str, salt_from: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` with a column ``salt``: rows of hot keys are spread over salts, the table's rows of those keys copied to each.

    The salt is a hash of the row (or of ``salt_from``), so a retried task deals alike;
    rows equal in all columns stay together and are left to the adaptive skew join.
    """
    hot = hot_keys(df, key)
    if not hot:
        return df.withColumn(salt, F.lit(0)), table.withColumn(salt, F.lit(0))
    is_hot = _key_hash(key).isin(hot)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (salt_from or df.columns)]), F.lit(SALTS)).cast("int")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return (
        df.withColumn(salt, F.when(is_hot, spread).otherwise(0)),
        table.withColumn(salt, F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0))))),
    )
