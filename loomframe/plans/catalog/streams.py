"""Streaming operators over ``events``, drained to the end of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.core.session import new_path
from loomframe.operators.inference import batch_predict
from loomframe.plans.catalog.training import _DIRECTION, MeanDirection
from loomframe.plans.registry import Tables, query, r
from loomframe.streaming import ops as ST, stateful as SF


def event_stream(t: Tables):
    stream = ST.read_events(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema)
    return stream.withColumn("ts", ST.event_time())


def _micros(c: str):
    return F.unix_micros(c)


@query("stream_microbatch_score", _DIRECTION)
def _score(t: Tables):
    stream = ST.read_events(t.spark, f"{t.sf_dir}/embeddings.parquet", t.embeddings.schema).select("vec_id", "embedding")
    schema = "vec_id bigint, class string, score double"
    return ST.drain_append(ST.score_stream(stream, lambda df: batch_predict(df, MeanDirection(), schema)), "scored")


@query(
    "stream_idle_flush",
    f"""
WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR, true)::INT AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 HOUR) AS "end", count(*) AS n, {r('sum(value)', 2)} AS total FROM s GROUP BY user_id, sid""",
)
def _idle(t: Tables):
    events = event_stream(t).select("user_id", "ts", "value")
    last = t.events.agg(F.max(ST.event_time()).alias("ts"))
    # a row of no user, late enough to end every session
    closing = last.select(
        F.lit(None).cast("bigint").alias("user_id"),
        F.expr("ts + INTERVAL 3 HOURS").alias("ts"),
        F.lit(0.0).alias("value"),
    )
    sessions = lambda stream: ST.idle_sessions(stream, "ts", "user_id", "value", "2 hours", late="10 minutes")
    out = ST.drain_closed(events, sessions, closing, "sessions").filter("user_id IS NOT NULL")
    return out.select(
        "user_id", _micros("start").alias("start"), _micros("end").alias("end"), "n", F.round("total", 2).alias("total")
    )


@query(
    "stream_metrics",
    f"""
SELECT 'tumbling' AS form, epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start, event_type, count(*) AS n, {r('sum(value)', 2)} AS total, {r('avg(value)')} AS mean FROM events GROUP BY 2, 3
UNION ALL SELECT 'sliding', epoch_us(time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 3 HOUR), event_type, count(*), {r('sum(value)', 2)}, {r('avg(value)')} FROM events, range(2) g(k) GROUP BY 2, 3""",
)
def _metrics(t: Tables):
    def drained(slide, width, form):
        out = ST.windowed_metrics(event_stream(t), "ts", "event_type", "value", width, slide, late="10 minutes")
        rows = ST.drain_updates(out, ["start", "end", "event_type"], f"metrics-{form}")
        return rows.select(
            F.lit(form).alias("form"),
            _micros("start").alias("start"),
            "event_type",
            "n",
            F.round("total", 2).alias("total"),
            F.round("mean", 6).alias("mean"),
        )

    return drained(None, "6 hours", "tumbling").unionByName(drained("3 hours", "6 hours", "sliding"))


@query(
    "stream_accumulator",
    f"SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS start, event_type, count(*) AS n, {r('sum(value)', 2)} AS total FROM events GROUP BY 1, 2",
)
def _accumulator(t: Tables):
    out = ST.stage_accumulator(event_stream(t), "ts", "event_type", "value", "1 day", late="10 minutes")
    rows = ST.drain_updates(out, ["start", "end", "event_type"], "stages")
    return rows.select(_micros("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "stream_replay",
    "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events) WHERE k <= 64",
)
def _replay(t: Tables):
    """Events dealt by a hash into files out of time order, one micro-batch each."""
    path = new_path(t.spark, "dealt")
    t.events.repartition(3, F.xxhash64("event_id")).write.parquet(path)
    stream = ST.read_events(t.spark, path, t.events.schema)
    rows = stream.select("event_type", "event_id", F.unix_micros(ST.event_time()).alias("at"), "value")
    return SF.drain_recent(rows, ["event_type"], "at", 64, "replay").select("event_type", "event_id", "value")


@query("stream_vocabulary", "SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS index FROM events GROUP BY 1")
def _vocabulary(t: Tables):
    return SF.drain_vocabulary(event_stream(t).select("user_id", "event_id"), "user_id", "event_id", "vocabulary")
