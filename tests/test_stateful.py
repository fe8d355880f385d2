"""Keyed state: stop and resume gives the batch twin, and a batch closes by idleness alone."""

import time

import pytest
from pyspark.sql import functions as F

from loomframe.core.session import new_path
from loomframe.streaming import ops as ST, stateful as SF

SCHEMA = "id long, kind string, ts long, value double"


def rows(first, last):
    # files come out of order in time, with a null key and a null order value
    return [(i, [None, "a", "b", "c"][i % 4], None if i % 17 == 0 else (i * 37) % 1000, float(i)) for i in range(first, last)]


def add_file(spark, folder, first, last):
    spark.createDataFrame(rows(first, last), SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture()
def folder(spark):
    path = new_path(spark, "stream-input")
    for first in (0, 40, 80):
        add_file(spark, path, first, first + 40)
    return path


def stream(spark, folder):
    return ST.read_events(spark, folder, SCHEMA)


def test_recent_rows_resume(spark, folder):
    path = new_path(spark, "recent")
    run = lambda: SF.run_updates(SF.recent_rows(stream(spark, folder), ["kind"], "ts", 5), ["kind", "rank"], path)
    run()
    add_file(spark, folder, 120, 150)
    add_file(spark, folder, 150, 155)
    got = {}
    for r in run().collect():
        got.setdefault(r.kind, []).append((r.rank, r.ts, r.id))
    for kind in (None, "a", "b", "c"):
        best = sorted((r for r in rows(0, 155) if r[1] == kind and r[2] is not None), key=lambda r: -r[2])[:5]
        assert sorted(got[kind]) == [(k, r[2], r[0]) for k, r in enumerate(best, 1)]


def test_vocabulary_resumes(spark, folder):
    path = new_path(spark, "words")
    words = lambda: stream(spark, folder).withColumn("word", (F.col("id") * 7 % 50).cast("string"))
    before = {r.word: r["index"] for r in SF.run_vocabulary(words(), "word", "id", path).collect()}
    assert sorted(before.values()) == list(range(50))
    spark.createDataFrame([(1000 + i, "x", i, 0.0) for i in range(3)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    more = lambda: stream(spark, folder).withColumn("word", F.when(F.col("id") >= 1000, F.concat(F.lit("new"), "id")).otherwise((F.col("id") * 7 % 50).cast("string")))
    after = {r.word: r["index"] for r in SF.run_vocabulary(more(), "word", "id", path).collect()}
    assert {w: i for w, i in after.items() if w in before} == before
    assert [after[f"new{1000 + i}"] for i in range(3)] == [50, 51, 52] and len(after) == 53
    again = SF.run_vocabulary(more(), "word", "id", path)
    assert again.count() == 53


def test_a_batch_closes_without_further_input(spark):
    folder, path = new_path(spark, "idle-input"), new_path(spark, "idle")
    spark.createDataFrame([(i, "ab"[i % 2], i, float(i)) for i in range(10)], SCHEMA).coalesce(1).write.parquet(folder)
    out = SF.idle_batches(ST.read_events(spark, folder, SCHEMA), "kind", "value", 1500)
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint")
    query = writer.outputMode("append").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        found = []
        while time.time() < until and len(found) < 2:
            time.sleep(2)
            assert query.exception() is None
            try:
                found = spark.read.schema(out.schema).parquet(path).collect()
            except Exception:
                found = []
    finally:
        query.stop()
    assert sorted(tuple(r) for r in found) == [("a", 5, 20.0), ("b", 5, 25.0)]
