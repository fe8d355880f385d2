"""Dataset operators: index, split, sample, batch, bucket, pad."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.core.order import row_index
from loomframe.core.session import materialize, spread
from loomframe.functions import text as T, vectors as V
from loomframe.operators import sampling as S
from loomframe.plans.registry import LINE_KEY, LINE_KEY_SQL, LONG_EMBEDDINGS, Tables, h, query, r

ORDERS_IDX = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)"
TOKENS_SQL = "string_split(rtrim(text, ' '), ' ')"


@query(
    "row_index",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (ORDER BY {LINE_KEY_SQL}) - 1 AS idx FROM lineitem""",
)
def _row_index(t: Tables):
    return row_index(t.lineitem.select(*LINE_KEY), LINE_KEY).drop("l_shipdate")


@query(
    "random_split",
    f"""
WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {h(7, 'o_orderkey')}, o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, ((rk >= floor(7 / 10.0 * n))::INT + (rk >= floor(7 / 10.0 * n) + floor(2 / 10.0 * n))::INT) AS split FROM k""",
)
def _random_split(t: Tables):
    return S.random_split(t.orders.select("o_orderkey"), [7, 2, 1], 7, "o_orderkey")


@query("sub_dataset", f"SELECT idx, o_orderkey, o_totalprice FROM {ORDERS_IDX} WHERE idx >= 250 AND idx < 1250")
def _sub(t: Tables):
    df = row_index(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")
    return S.sub_dataset(df, 250, 1250)


@query("sequence_sample", f"SELECT idx, o_orderkey FROM {ORDERS_IDX}")
def _sequence(t: Tables):
    return row_index(t.orders.select("o_orderkey"), "o_orderkey").orderBy("idx")


@query(
    "random_sample",
    f"SELECT o_orderkey, row_number() OVER (ORDER BY {h(11, 'o_orderkey')}, o_orderkey) - 1 AS rank FROM orders",
)
def _random(t: Tables):
    return S.random_sample(t.orders.select("o_orderkey"), 11, "o_orderkey")


@query(
    "batch_sample",
    f"""
WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {h(3, 'o_orderkey')}, o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, rank, rank // 64 AS batch_id, rank % 64 AS batch_pos FROM k WHERE rank // 64 < n // 64""",
)
def _batch(t: Tables):
    df = S.random_sample(t.orders.select("o_orderkey"), 3, "o_orderkey")
    return S.batch_sample(df, "rank", 64, drop_last=True)


def document_lengths(t: Tables):
    """(doc_id, length), tokenised once: the table is read several times below."""
    docs = spread(t.documents.select("doc_id", "text"), "doc_id")
    return materialize(docs.select("doc_id", F.size(T.tokenize_simple(F.col("text"))).cast("bigint").alias("length")), "lengths")


DOC_LENGTHS = f"(SELECT doc_id, len({TOKENS_SQL})::BIGINT AS length FROM documents)"
_EDGE = "greatest(mx - (8 - i - 1) * greatest((1 + mx - mn) // 8, 1), mn)"


@query(
    "fixed_bucket_sample",
    f"""
WITH d AS {DOC_LENGTHS}, s AS (SELECT min(length) mn, max(length) mx FROM d),
e AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS bucket FROM (SELECT DISTINCT {_EDGE} AS edge FROM s, range(8) g(i))),
b AS (SELECT doc_id, length, min(bucket) AS bucket FROM d JOIN e ON length <= edge GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY length, doc_id) - 1 AS rk FROM b)
SELECT doc_id, length, bucket::INT AS bucket, rk // 16 AS batch_in_bucket, rk % 16 AS batch_pos FROM k""",
)
def _bucket(t: Tables):
    return S.fixed_bucket_sample(document_lengths(t), "length", ["length", "doc_id"], 8, 16)


@query("length_sorted_samples", f"SELECT row_number() OVER (ORDER BY length, doc_id) - 1 AS idx, doc_id, length FROM {DOC_LENGTHS}")
def _length_sorted(t: Tables):
    return row_index(document_lengths(t), ["length", "doc_id"])


def embedding_batches(t: Tables, size: int = 32):
    df = row_index(t.embeddings.select("vec_id", V.doubles("embedding").alias("v")), "vec_id")
    return S.batch_sample(df, "idx", size)


EMBEDDING_BATCHES = """(SELECT vec_id, embedding::DOUBLE[] AS v, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch_id,
  (row_number() OVER (ORDER BY vec_id) - 1) % 32 AS batch_pos FROM embeddings)"""


@query(
    "stack_batchify",
    f"""SELECT batch_id, count(*)::BIGINT AS size, {r('sum(batch_pos * list_sum(v))')} AS print FROM {EMBEDDING_BATCHES} GROUP BY 1""",
)
def _stack(t: Tables):
    stacked = S.stack_batchify(embedding_batches(t), "v", ["batch_id"], "batch_pos")
    rows = F.transform("stack", lambda v, i: V.total(v) * i)
    return stacked.select(
        "batch_id", F.size("stack").cast("bigint").alias("size"), F.round(V.total(rows), 6).alias("print")
    )


def token_batches(t: Tables):
    """Token lengths of the documents' words, batched by doc_id."""
    lengths = F.transform(T.tokenize_simple(F.col("text")), lambda w: F.length(w).cast("double"))
    df = row_index(t.documents.select("doc_id", lengths.alias("v")), "doc_id")
    return S.batch_sample(df, "idx", 16)


TOKEN_BATCHES = f"""(SELECT doc_id, v, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id,
  (row_number() OVER (ORDER BY doc_id) - 1) % 16 AS batch_pos
  FROM (SELECT doc_id, list_transform({TOKENS_SQL}, lambda w: length(w)::DOUBLE) AS v FROM documents))"""


@query(
    "pad_stack_batchify",
    f"""
WITH b AS {TOKEN_BATCHES}, m AS (SELECT batch_id, max(len(v)) AS width FROM b GROUP BY 1)
SELECT batch_id, batch_pos, width::BIGINT AS width, len(v)::BIGINT AS valid, list_sum(v) - (width - len(v)) AS total FROM b JOIN m USING (batch_id)""",
)
def _pad(t: Tables):
    padded = S.pad_stack_batchify(token_batches(t).drop("idx"), "v", ["batch_id"], "batch_pos", -1.0)
    zipped = F.arrays_zip("stack", "valid_lengths")
    return padded.select("batch_id", F.posexplode(zipped).alias("batch_pos", "z")).select(
        "batch_id",
        F.col("batch_pos").cast("bigint").alias("batch_pos"),
        F.size("z.stack").cast("bigint").alias("width"),
        F.col("z.valid_lengths").cast("bigint").alias("valid"),
        V.total(F.col("z.stack")).alias("total"),
    )


@query("unbatchify", f"SELECT batch_id, batch_pos, {r('list_sum(v)')} AS total, len(v)::BIGINT AS width FROM {EMBEDDING_BATCHES}")
def _unbatch(t: Tables):
    stacked = S.stack_batchify(embedding_batches(t), "v", ["batch_id"], "batch_pos")
    out = S.unbatchify(stacked, ["batch_id"], "stack")
    return out.select(
        "batch_id",
        F.col("batch_pos").cast("bigint").alias("batch_pos"),
        F.round(V.total(F.col("value")), 6).alias("total"),
        F.size("value").cast("bigint").alias("width"),
    )


@query("unpad", f"SELECT batch_id, batch_pos, len(v)::BIGINT AS width, list_sum(v) AS total FROM {TOKEN_BATCHES}")
def _unpad(t: Tables):
    padded = S.pad_stack_batchify(token_batches(t).drop("idx"), "v", ["batch_id"], "batch_pos", -1.0)
    zipped = F.arrays_zip("stack", "valid_lengths")
    long = padded.select("batch_id", F.posexplode(zipped).alias("batch_pos", "z")).select(
        "batch_id", F.col("batch_pos").cast("bigint").alias("batch_pos"), "z.*"
    )
    out = S.unpad(long, "stack", "valid_lengths")
    return out.select(
        "batch_id", "batch_pos", F.size("stack").cast("bigint").alias("width"), V.total(F.col("stack")).alias("total")
    )


@query(
    "split_batch",
    f"""
WITH b AS (SELECT o_orderkey, idx // 100 AS batch_id, idx % 100 AS batch_pos, least(100, n - (idx // 100) * 100) AS size FROM {ORDERS_IDX}),
s AS (SELECT *, ceil(size / least(3, size)::DOUBLE)::BIGINT AS step FROM b)
SELECT o_orderkey, batch_id, batch_pos // step AS slice_id, batch_pos % step AS slice_pos FROM s""",
)
def _split_batch(t: Tables):
    df = row_index(t.orders.select("o_orderkey"), "o_orderkey")
    n = t.orders.agg(F.count("*")).scalar()
    batches = S.batch_sample(df, "idx", 100).withColumn("size", F.least(F.lit(100), n - F.col("batch_id") * 100))
    return S.split_batch(batches, 3, even=False).select("o_orderkey", "batch_id", "slice_id", "slice_pos")


@query(
    "batch_progress",
    f"""
SELECT batch_id, size, sum(size) OVER (ORDER BY batch_id)::BIGINT AS progress, sum(size) OVER ()::BIGINT AS total
FROM (SELECT idx // 100 AS batch_id, count(*) AS size FROM {ORDERS_IDX} GROUP BY 1)""",
)
def _progress(t: Tables):
    df = S.batch_sample(row_index(t.orders.select("o_orderkey"), "o_orderkey"), "idx", 100)
    total = t.orders.agg(F.count("*")).scalar()
    sizes = df.groupBy("batch_id").agg(F.count("*").alias("size"))
    # batches are consecutive and only the last may be short: progress needs no running sum
    return sizes.select(
        "batch_id", "size", (F.col("batch_id") * 100 + F.col("size")).alias("progress"), total.alias("total")
    )


@query(
    "dataset_to_array",
    f"""SELECT idx * 2 + j AS pos, CASE j WHEN 0 THEN o_custkey::DOUBLE ELSE o_totalprice END AS value
FROM {ORDERS_IDX}, range(2) g(j)""",
)
def _to_array(t: Tables):
    df = row_index(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    record = F.array(F.col("o_custkey").cast("double"), F.col("o_totalprice"))
    long = df.select("idx", F.posexplode(record).alias("j", "value"))
    return long.select((F.col("idx") * 2 + F.col("j")).alias("pos"), "value")


@query(
    "sparse_sequence_mask",
    f"""SELECT vec_id, {r('sum((pos + 1) * CASE WHEN pos < label * 7 THEN x ELSE -1.0 END)')} AS print FROM {LONG_EMBEDDINGS} GROUP BY 1""",
)
def _seq_mask(t: Tables):
    v = V.sequence_mask(V.doubles("embedding"), F.col("label") * 7, -1.0)
    return t.embeddings.select("vec_id", F.round(V.fingerprint(v), 6).alias("print"))


@query(
    "replay_buffer",
    f"""
WITH k AS (SELECT event_id, value, row_number() OVER (ORDER BY ts DESC) AS back, count(*) OVER () AS n FROM events),
held AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS slot FROM k WHERE back <= 1024)
SELECT d.i AS draw, event_id, value FROM (SELECT i, {h(5, 'i')} % (SELECT count(*) FROM held) AS slot FROM range(256) g(i)) d JOIN held USING (slot)""",
)
def _replay(t: Tables):
    out = S.replay_buffer(t.events.select("event_id", "ts", "value"), "ts", 1024, 256, 5)
    return out.select("draw", "event_id", "value")
