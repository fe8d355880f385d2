"""Joins, shapes, matrix products, creation and row-wise neural operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomframe.core import keyed
from loomframe.core.order import row_index
from loomframe.functions import activations as A, text as T, vectors as V
from loomframe.operators import joins as J, nn as N, shape as S
from loomframe.plans.catalog.features import INDEXED, indexed_embeddings
from loomframe.plans.catalog.text import TOKEN_ROWS_SQL, VOCAB_SQL, document_lists, token_rows, vocabulary
from loomframe.plans.registry import LONG_EMBEDDINGS, Tables, h, query, r, register

LONG = f"(SELECT idx AS i, generate_subscripts(v, 1) - 1 AS j, unnest(v)::DOUBLE AS v, n FROM {INDEXED})"


def long_matrix(t: Tables):
    return S.to_long(indexed_embeddings(t), "idx", "v")


def row_count(t: Tables):
    return t.embeddings.agg(F.count("*")).scalar()


# lookups ------------------------------------------------------------------------
@query(
    "token_lookup",
    f"SELECT token, coalesce(index, 3) AS index, count(*) AS n FROM {TOKEN_ROWS_SQL} LEFT JOIN {VOCAB_SQL} v USING (token) GROUP BY 1, 2",
)
def _token_lookup(t: Tables):
    return J.token_lookup(token_rows(t), vocabulary(t), 3).groupBy("token", "index").agg(F.count("*").alias("n"))


@query(
    "index_lookup",
    f"SELECT l_orderkey, l_linenumber, l_partkey, coalesce(token, '<unk>') AS word FROM lineitem LEFT JOIN {VOCAB_SQL} v ON index = l_partkey * 7",
)
def _index_lookup(t: Tables):
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 7).alias("index"))
    return J.index_lookup(items, vocabulary(t), "<unk>").drop("index")


@query(
    "vocabulary_contains",
    f"""SELECT doc_id, count(*) FILTER (index IS NOT NULL) AS present, count(*) FILTER (index IS NULL) AS absent
FROM {TOKEN_ROWS_SQL} LEFT JOIN {VOCAB_SQL} v USING (token) GROUP BY 1""",
)
def _contains(t: Tables):
    vocab = vocabulary(t)
    rows = token_rows(t)
    inside = J.vocabulary_contains(rows, vocab, True).select("doc_id", F.lit(1).alias("p"))
    outside = J.vocabulary_contains(rows, vocab, False).select("doc_id", F.lit(0).alias("p"))
    return inside.unionByName(outside).groupBy("doc_id").agg(
        F.sum("p").alias("present"), F.sum(1 - F.col("p")).alias("absent")
    )


@query(
    "embedding_lookup",
    f"""
WITH e AS (SELECT vec_id, list_sum(embedding::DOUBLE[]) AS s FROM embeddings)
SELECT o_orderkey, {r('coalesce(s, 64 * 0.125)')} AS s FROM orders LEFT JOIN e ON vec_id = o_custkey""",
)
def _embedding(t: Tables):
    items = t.orders.select("o_orderkey", F.col("o_custkey").alias("vec_id"))
    table = t.embeddings.select("vec_id", V.doubles("embedding").alias("v"))
    out = J.embedding_lookup(items, table, "vec_id", "v", [0.125] * 64)
    return out.select("o_orderkey", F.round(V.total(F.col("v")), 6).alias("s"))


@query(
    "text_embedding",
    f"""
WITH w AS (SELECT doc_id, pos, coalesce(index, 3) % (SELECT count(*) FROM embeddings) AS vec_id FROM {TOKEN_ROWS_SQL} LEFT JOIN {VOCAB_SQL} v USING (token)),
e AS (SELECT vec_id, list_sum(embedding::DOUBLE[]) AS s FROM embeddings)
SELECT doc_id, count(*) AS n, {r('sum((pos + 1) * s)', 4)} AS print FROM w JOIN e USING (vec_id) GROUP BY 1""",
)
def _text_embedding(t: Tables):
    n = row_count(t)
    found = J.token_lookup(document_lists(t), vocabulary(t), 3).withColumn("n", n)
    kind = dict(found.dtypes)["index"]
    ids = found.select("doc_id", F.transform("index", lambda x: F.pmod(x, F.col("n"))).cast(kind).alias("vec_id"))
    lists = J.embedding_matrices(J.recollect(ids, ["doc_id"], "vec_id", "ids"), t.embeddings, "ids", "vec_id", "embedding")
    # vectors move as they are stored
    rows = F.transform("matrix", lambda v, i: V.total(V.doubles(v)) * (i + 1))
    return lists.select("doc_id", F.size("matrix").cast("bigint").alias("n"), F.round(V.total(rows), 4).alias("print"))


@query(
    "unembed",
    f"SELECT vec_id, coalesce(token, '<unk>') AS word FROM embeddings LEFT JOIN {VOCAB_SQL} v ON index = vec_id - 1 AND vec_id > 0",
)
def _unembed(t: Tables):
    # index 0 is the fallthrough; word k sits at index k + 1
    vocab = vocabulary(t).select((F.col("index") + 1).alias("index"), "token")
    items = t.embeddings.select("vec_id", F.col("vec_id").alias("index"))
    return J.index_lookup(items, vocab, "<unk>").select("vec_id", "word")


@query(
    "similarity_join",
    f"""
WITH c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM {LONG_EMBEDDINGS} GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, label::BIGINT AS label, {r('(list_cosine_similarity(embedding::DOUBLE[], c) + 1) / 2')} AS similarity FROM embeddings JOIN c USING (label)""",
)
def _similarity(t: Tables):
    long = t.embeddings.select("label", F.posexplode(V.doubles("embedding")).alias("pos", "x"))
    centre = J.recollect(long.groupBy("label", "pos").agg(F.avg("x").alias("m")), ["label"], "m", "c")
    pairs = t.embeddings.select("vec_id", "label", V.doubles("embedding").alias("v")).join(centre, "label")
    out = J.similarity_pairs(pairs, "v", "c")
    return out.select("vec_id", F.col("label").cast("bigint").alias("label"), F.round("similarity", 6).alias("similarity"))


@query(
    "topk_similar",
    f"""
WITH q AS (SELECT label AS query_id, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM {LONG_EMBEDDINGS} GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT query_id, vec_id, (list_cosine_similarity(embedding::DOUBLE[], c) + 1) / 2 AS sim FROM embeddings, q),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM s)
SELECT query_id::BIGINT AS query_id, vec_id, rank, {r('sim')} AS similarity FROM k WHERE rank <= 20""",
)
def _topk_similar(t: Tables):
    long = t.embeddings.select(F.col("label").cast("bigint").alias("query_id"), F.posexplode(V.doubles("embedding")).alias("pos", "x"))
    queries = J.recollect(long.groupBy("query_id", "pos").agg(F.avg("x").alias("m")), ["query_id"], "m", "c")
    out = J.topk_similar(t.embeddings, queries, 20, "vec_id", "embedding", "query_id", "c")
    return out.select(
        "query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity")
    )


@query("broadcast_op", f"SELECT o_orderkey, {r('o_totalprice - (SELECT min(o_totalprice) FROM orders)', 2)} AS y FROM orders")
def _broadcast(t: Tables):
    low = t.orders.agg(F.min("o_totalprice")).scalar()
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") - low, 2).alias("y"))


@query(
    "concat_rows",
    """SELECT 0 AS source, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier""",
)
def _concat_rows(t: Tables):
    return J.concat_rows(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
    )


@query("concat_columns", f"SELECT idx, (2 * len(v))::BIGINT AS width, {r('list_sum(v::DOUBLE[]) * 3')} AS total FROM {INDEXED}")
def _concat_columns(t: Tables):
    a = indexed_embeddings(t).select("idx", "v")
    b = a.select("idx", F.transform("v", lambda x: x * 2).alias("w"))
    both = J.concat_columns(a, b).select("idx", F.concat("v", "w").alias("v"))
    return both.select("idx", F.size("v").cast("bigint").alias("width"), F.round(V.total(F.col("v")), 6).alias("total"))


@query(
    "stack_arrays",
    f"SELECT vec_id, pos, j, {r('CASE j WHEN 0 THEN x ELSE x * x END')} AS value FROM {LONG_EMBEDDINGS}, (VALUES (0::BIGINT), (1)) s(j)",
)
def _stack_arrays(t: Tables):
    v = V.doubles("embedding")
    stacked = t.embeddings.select("vec_id", F.posexplode(F.transform(v, lambda x: F.array(x, x * x))).alias("pos", "s"))
    return stacked.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.posexplode("s").alias("j", "value")).select(
        "vec_id", "pos", F.col("j").cast("bigint").alias("j"), F.round("value", 6).alias("value")
    )


@query(
    "content_equals",
    """SELECT 'same' AS pair, true AS equal UNION ALL SELECT 'changed', count(*) = 0 FROM (SELECT o_orderkey, o_totalprice FROM orders EXCEPT ALL
  SELECT o_orderkey, CASE WHEN o_orderkey = 5 THEN 0 ELSE o_totalprice END FROM orders)""",
)
def _equals(t: Tables):
    a = t.orders.select("o_orderkey", "o_totalprice")
    changed = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 5, 0.0).otherwise(F.col("o_totalprice")))
    same = J.content_equals(a, t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_orderkey")))
    return same.select(F.lit("same").alias("pair"), "equal").unionByName(
        J.content_equals(a, changed).select(F.lit("changed").alias("pair"), "equal")
    )


@query(
    "all_close",
    """SELECT 'near' AS pair, bool_and(abs(o_totalprice - o_totalprice * 1.000001) <= 1e-8 + 1e-5 * abs(o_totalprice * 1.000001)) AS close FROM orders
UNION ALL SELECT 'far', bool_and(abs(o_totalprice - o_totalprice * 1.001) <= 1e-8 + 1e-5 * abs(o_totalprice * 1.001)) FROM orders""",
)
def _close(t: Tables):
    a = t.orders.select("o_orderkey", "o_totalprice")
    scaled = lambda f: a.withColumn("o_totalprice", F.col("o_totalprice") * f)
    near = J.all_close(a, scaled(1.000001), "o_orderkey", "o_totalprice").select(F.lit("near").alias("pair"), "close")
    far = J.all_close(a, scaled(1.001), "o_orderkey", "o_totalprice").select(F.lit("far").alias("pair"), "close")
    return near.unionByName(far)


@query("distinct_pairs", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _distinct(t: Tables):
    df = t.orders.select("o_custkey", "o_totalprice", "o_orderkey")
    return J.distinct_pairs(df, ["o_custkey"], ["o_orderkey"])


# shapes ------------------------------------------------------------------------
@query("flatten", f"SELECT i * 64 + j AS pos, {r('v')} AS v FROM {LONG}")
def _flatten(t: Tables):
    return S.flatten(long_matrix(t), 64).withColumn("v", F.round("v", 6))


@query(
    "reshape",
    f"SELECT (i * 64 + j) // 256 AS d0, ((i * 64 + j) // 16) % 16 AS d1, (i * 64 + j) % 16 AS d2, {r('v')} AS v FROM {LONG}",
)
def _reshape(t: Tables):
    return S.reshape(long_matrix(t), 64, [-1, 16, 16]).withColumn("v", F.round("v", 6))


@query("expand_dims", f"SELECT vec_id, 1::BIGINT AS outer_size, len(embedding)::BIGINT AS inner_size, {r('list_sum(embedding::DOUBLE[])')} AS total FROM embeddings")
def _expand(t: Tables):
    df = t.embeddings.select("vec_id", F.array(V.doubles("embedding")).alias("m"))
    return df.select(
        "vec_id",
        F.size("m").cast("bigint").alias("outer_size"),
        F.size(F.col("m")[0]).cast("bigint").alias("inner_size"),
        F.round(V.total(F.col("m")[0]), 6).alias("total"),
    )


@query("squeeze", "SELECT o_orderkey, o_totalprice FROM orders")
def _squeeze(t: Tables):
    expanded = t.orders.select("o_orderkey", F.array(F.array("o_totalprice")).alias("m"))
    return expanded.select("o_orderkey", F.col("m")[0][0].alias("o_totalprice"))


@query("transpose", f"SELECT j AS i, count(*) AS width, {r('sum((i + 1) * v)', 4)} AS print FROM {LONG} GROUP BY 1")
def _transpose(t: Tables):
    moved = S.transpose(long_matrix(t))
    return moved.groupBy("i").agg(F.count("*").alias("width"), F.round(F.sum((F.col("j") + 1) * F.col("v")), 4).alias("print"))


@query("swap_axes", f"SELECT (i * 64 + j) // 256 AS d0, (i * 64 + j) % 16 AS d1, ((i * 64 + j) // 16) % 16 AS d2, {r('v')} AS v FROM {LONG}")
def _swap(t: Tables):
    cube = S.reshape(long_matrix(t), 64, [-1, 16, 16])
    return cube.select("d0", F.col("d2").alias("d1"), F.col("d1").alias("d2"), F.round("v", 6).alias("v"))


@query("flip", f"SELECT n - 1 - i AS i, 63 - j AS j, {r('v')} AS v FROM {LONG}")
def _flip(t: Tables):
    return S.flip(long_matrix(t), rows=row_count(t), cols=64).withColumn("v", F.round("v", 6))


@query(
    "rotate90",
    f"SELECT 1 AS times, 63 - j AS i, i AS j, {r('v')} AS v FROM {LONG} UNION ALL SELECT 3, j, n - 1 - i, {r('v')} FROM {LONG}",
)
def _rotate(t: Tables):
    m, n = long_matrix(t), row_count(t)
    once, thrice = S.rotate90(m, n, 64, 1), S.rotate90(m, n, 64, 3)
    return (
        once.withColumn("times", F.lit(1)).unionByName(thrice.withColumn("times", F.lit(3))).withColumn("v", F.round("v", 6))
    )


@query(
    "split_array",
    f"""SELECT vec_id, 'equal' AS form, pos // 16 AS part, {r('sum(x)')} AS total FROM {LONG_EMBEDDINGS} GROUP BY 1, 3
UNION ALL SELECT vec_id, 'at', CASE WHEN pos < 10 THEN 0 WHEN pos < 37 THEN 1 ELSE 2 END::BIGINT, {r('sum(x)')} FROM {LONG_EMBEDDINGS} GROUP BY 1, 3""",
)
def _split(t: Tables):
    v = V.doubles("embedding")

    def parts(sections, form):
        sums = F.array(*[F.round(V.total(p), 6) for p in S.split_vector(v, 64, sections)])
        return t.embeddings.select("vec_id", F.lit(form).alias("form"), F.posexplode(sums).alias("part", "total"))

    return parts(4, "equal").unionByName(parts([10, 37], "at")).withColumn("part", F.col("part").cast("bigint"))


@query(
    "tile",
    f"""SELECT 'rows' AS form, c * n + idx AS id, {r('list_sum(v::DOUBLE[])')} AS y FROM {INDEXED}, range(3) g(c)
UNION ALL SELECT 'array', vec_id, {r('sum(x * (pos + 1 + pos + 65))')} FROM {LONG_EMBEDDINGS} GROUP BY vec_id""",
)
def _tile(t: Tables):
    tiled = S.tile_rows(indexed_embeddings(t).select("idx", "v"), "idx", 3, row_count(t))
    rows = tiled.select(F.lit("rows").alias("form"), F.col("idx").alias("id"), F.round(V.total(F.col("v")), 6).alias("y"))
    arrays = t.embeddings.select(
        F.lit("array").alias("form"),
        F.col("vec_id").alias("id"),
        F.round(V.fingerprint(V.tile(V.doubles("embedding"), 2)), 6).alias("y"),
    )
    return rows.unionByName(arrays)


@query(
    "repeat",
    f"""SELECT 'rows' AS form, idx * 3 + c AS id, {r('list_sum(v::DOUBLE[])')} AS y FROM {INDEXED}, range(3) g(c)
UNION ALL SELECT 'array', vec_id, {r('sum(x * (2 * pos + 1 + 2 * pos + 2))')} FROM {LONG_EMBEDDINGS} GROUP BY vec_id""",
)
def _repeat(t: Tables):
    repeated = S.repeat_rows(indexed_embeddings(t).select("idx", "v"), "idx", 3)
    rows = repeated.select(F.lit("rows").alias("form"), F.col("idx").alias("id"), F.round(V.total(F.col("v")), 6).alias("y"))
    arrays = t.embeddings.select(
        F.lit("array").alias("form"),
        F.col("vec_id").alias("id"),
        F.round(V.fingerprint(V.repeat_each(V.doubles("embedding"), 2)), 6).alias("y"),
    )
    return rows.unionByName(arrays)


@query(
    "dot",
    f"""SELECT 'columns' AS form, 0::BIGINT AS id, {r('sum(l_quantity * l_discount)', 2)} AS y FROM lineitem
UNION ALL SELECT 'rows', vec_id, {r('list_dot_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))')} FROM embeddings""",
)
def _dot(t: Tables):
    columns = t.lineitem.agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 2).alias("y")).select(
        F.lit("columns").alias("form"), F.lit(0).cast("bigint").alias("id"), "y"
    )
    v = V.doubles("embedding")
    rows = t.embeddings.select(
        F.lit("rows").alias("form"), F.col("vec_id").alias("id"), F.round(V.dot(v, F.reverse(v)), 6).alias("y")
    )
    return columns.unionByName(rows)


# weights of the products below, as data: the mean vector per label
CENTRES = f"(SELECT label::BIGINT AS j, pos AS i, avg(x) AS v FROM {LONG_EMBEDDINGS} GROUP BY 1, 2)"


def centres(t: Tables):
    long = t.embeddings.select(F.col("label").cast("bigint").alias("j"), F.posexplode(V.doubles("embedding")).alias("i", "x"))
    return long.groupBy("j", F.col("i").cast("bigint").alias("i")).agg(F.avg("x").alias("v"))


@query(
    "mat_mul",
    f"SELECT a.i, b.j, {r('sum(a.v * b.v)')} AS v FROM {LONG} a JOIN {CENTRES} b ON a.j = b.i GROUP BY 1, 2",
)
def _mat_mul(t: Tables):
    return S.mat_mul(long_matrix(t), centres(t)).withColumn("v", F.round("v", 6))


@query(
    "batch_dot",
    f"""
WITH e AS (SELECT vec_id, label::BIGINT AS label, pos // 8 AS i, pos % 8 AS j, x FROM {LONG_EMBEDDINGS})
SELECT a.vec_id, a.i, b.j, {r('sum(a.x * b.x)')} AS v FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.j = b.i GROUP BY 1, 2, 3""",
)
def _batch_dot(t: Tables):
    long = t.embeddings.select("vec_id", F.posexplode(V.doubles("embedding")).alias("p", "v")).select(
        "vec_id", F.floor(F.col("p") / 8).alias("i"), (F.col("p") % 8).cast("bigint").alias("j"), "v"
    )
    return S.mat_mul(long, long, block=8, batch=["vec_id"]).withColumn("v", F.round("v", 6))


@query(
    "gram_matrix",
    f"SELECT a.pos AS i, b.pos AS j, {r('sum(a.x * b.x)')} AS v FROM {LONG_EMBEDDINGS} a JOIN {LONG_EMBEDDINGS} b USING (vec_id) GROUP BY 1, 2",
)
def _gram(t: Tables):
    return S.gram(t.embeddings, "embedding").withColumn("v", F.round("v", 6))


@query("one_hot", "SELECT vec_id, j, CASE WHEN label = j THEN 2.0::DOUBLE ELSE -1.0::DOUBLE END AS v FROM embeddings, range(10) g(j)")
def _one_hot(t: Tables):
    hot = V.one_hot(F.col("label"), 10, 2.0, -1.0)
    return t.embeddings.select("vec_id", F.posexplode(hot).alias("j", "v")).withColumn("j", F.col("j").cast("bigint"))


@query("nonzero", f"SELECT i, j FROM {LONG} WHERE trunc(v * 5) <> 0")
def _nonzero(t: Tables):
    m = long_matrix(t).withColumn("v", F.floor(F.abs(F.col("v") * 5)))
    return S.nonzero(m)


@query(
    "to_sparse",
    f"""SELECT 'coo' AS form, i, j, {r('v')} AS v FROM {LONG} WHERE v > 0.1 UNION ALL
SELECT 'csr', i, count(*), {r('sum(v * (j + 1))')} FROM {LONG} WHERE v > 0.1 GROUP BY i
UNION ALL SELECT 'row', i, 64, {r('sum(v)')} FROM {LONG} WHERE v > 0.1 GROUP BY i""",
)
def _to_sparse(t: Tables):
    df = indexed_embeddings(t).withColumn("v", F.transform("v", lambda x: F.when(x > 0.1, x).otherwise(F.lit(0.0))))
    coo = S.to_sparse(df, "idx", "v", "coo").select(F.lit("coo").alias("form"), "i", "j", F.round("v", 6).alias("v"))
    csr = S.to_sparse(df, "idx", "v", "csr").filter(F.size("indices") > 0)
    dots = V.total(F.zip_with("indices", "values", lambda j, v: (j + 1) * v))
    csr = csr.select(F.lit("csr").alias("form"), "i", F.size("indices").cast("bigint").alias("j"), F.round(dots, 6).alias("v"))
    rows = S.to_sparse(df, "idx", "v", "row").select(
        F.lit("row").alias("form"), F.col("idx").alias("i"), F.size("v").cast("bigint").alias("j"), F.round(V.total(F.col("v")), 6).alias("v")
    )
    return coo.unionByName(csr).unionByName(rows)


@query("to_dense", f"SELECT i, j, {r('CASE WHEN v > 0.1 THEN v ELSE 0 END')} AS v FROM {LONG} WHERE i IN (SELECT i FROM {LONG} WHERE v > 0.1)")
def _to_dense(t: Tables):
    dense = S.to_dense(long_matrix(t).filter(F.col("v") > 0.1), 64)
    return S.to_long(dense, "i", "v").withColumn("v", F.round("v", 6))


# creation ------------------------------------------------------------------------
for _name, _value, _width in (("zeros", 0.0, None), ("ones", 1.0, None), ("full", 2.5, 8), ("zeros_like", 0.0, 64), ("ones_like", 1.0, 64)):
    register(
        _name,
        lambda t, x=_value, w=_width: S.constant(t.embeddings.select("vec_id"), x, w).select(
            "vec_id",
            (F.lit(1) if w is None else F.size("v")).cast("bigint").alias("width"),
            (F.col("v") if w is None else V.total(F.col("v"))).alias("total"),
        ),
        f"SELECT vec_id, {_width or 1}::BIGINT AS width, {_value * (_width or 1)}::DOUBLE AS total FROM embeddings",
    )


def order_index(t: Tables):
    return row_index(t.orders.select("o_orderkey"), "o_orderkey")


ORDER_INDEX = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)"


@query("arange", f"SELECT o_orderkey, {r('-3.5 + idx * 0.25')} AS v FROM {ORDER_INDEX}")
def _arange(t: Tables):
    return order_index(t).select("o_orderkey", F.round(S.arange("idx", -3.5, 0.25), 6).alias("v"))


@query("linspace", f"SELECT o_orderkey, {r('-1.0 + idx * (2.0 / (n - 1))')} AS closed, {r('-1.0 + idx * (2.0 / n)')} AS half_open FROM {ORDER_INDEX}")
def _linspace(t: Tables):
    n = t.orders.agg(F.count("*")).scalar()
    return order_index(t).select(
        "o_orderkey",
        F.round(S.linspace("idx", -1.0, 1.0, n), 6).alias("closed"),
        F.round(S.linspace("idx", -1.0, 1.0, n, False), 6).alias("half_open"),
    )


@query("eye", f"SELECT idx AS i, j, (j = idx + 2)::INT::DOUBLE AS v FROM {INDEXED}, range(64) g(j)")
def _eye(t: Tables):
    df = indexed_embeddings(t).select("idx", S.eye_row("idx", 64, 2).alias("v"))
    return S.to_long(df, "idx", "v")


_TWO_52 = "4503599627370496.0::DOUBLE"


@query("random_uniform", f"SELECT o_orderkey, {r(f'2.0 + 3.0 * ({h(21, 'o_orderkey')} / {_TWO_52})')} AS v FROM orders")
def _uniform(t: Tables):
    return t.orders.select("o_orderkey", F.round(2.0 + 3.0 * keyed.keyed_uniform(21, "o_orderkey"), 6).alias("v"))


_NORMAL = f"(sqrt(-2.0 * ln(({h('22/a', 'o_orderkey')} + 1.0::DOUBLE) / {_TWO_52})) * cos(6.283185307179586::DOUBLE * ({h('22/b', 'o_orderkey')} / {_TWO_52})))"


@query("random_normal", f"SELECT o_orderkey, {r(f'1.0 + 0.5 * {_NORMAL}')} AS v FROM orders")
def _normal(t: Tables):
    return t.orders.select("o_orderkey", F.round(1.0 + 0.5 * keyed.keyed_normal(22, "o_orderkey"), 6).alias("v"))


@query("random_integer", f"SELECT o_orderkey, (5 + floor({h(23, 'o_orderkey')} / {_TWO_52} * 37))::BIGINT AS v FROM orders")
def _integer(t: Tables):
    return t.orders.select("o_orderkey", keyed.keyed_integer(23, 5, 42, "o_orderkey").cast("bigint").alias("v"))


@query(
    "random_multinomial",
    f"""SELECT CASE WHEN u < 0.1 THEN 0 WHEN u < 0.3 THEN 1 WHEN u < 0.6 THEN 2 ELSE 3 END::BIGINT AS class, count(*) AS n
FROM (SELECT {h(24, 'o_orderkey')} / {_TWO_52} AS u FROM orders) GROUP BY 1""",
)
def _multinomial(t: Tables):
    return S.multinomial(t.orders, [1.0, 2.0, 3.0, 4.0], 24, "o_orderkey")


@query("init_xavier", f"SELECT vec_id, pos, {r(f'({h(25, 'vec_id', 'pos')} / {_TWO_52} * 2.0 - 1.0) * sqrt(3.0 / ((64 + 10) / 2.0))')} AS w FROM {LONG_EMBEDDINGS}")
def _xavier(t: Tables):
    long = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    w = S.xavier(25, "vec_id", "pos", fan_in=64, fan_out=10)
    return long.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round(w, 6).alias("w"))


def _draw(i: int) -> str:
    a, b = h(f"26/{i}/a", "o_orderkey"), h(f"26/{i}/b", "o_orderkey")
    return f"(sqrt(-2.0 * ln(({a} + 1.0::DOUBLE) / {_TWO_52})) * cos(6.283185307179586::DOUBLE * ({b} / {_TWO_52})))"


_FIRST_FIT = "CASE " + " ".join(f"WHEN abs({_draw(i)}) <= 2 THEN {_draw(i)}" for i in range(8)) + " ELSE 0 END"


@query("init_truncated_normal", f"SELECT o_orderkey, {r(f'0.02 * {_FIRST_FIT}')} AS w FROM orders")
def _truncated(t: Tables):
    return t.orders.select("o_orderkey", F.round(S.truncated_normal(26, "o_orderkey", sigma=0.02), 6).alias("w"))


@query(
    "shape_of",
    """SELECT count(*) AS rows, min(len(embedding))::BIGINT AS min_width, max(len(embedding))::BIGINT AS max_width, sum(len(embedding))::BIGINT AS size,
  sum(len(embedding)) = 0 AS empty, min(len(embedding)) <> max(len(embedding)) AS ragged FROM embeddings
UNION ALL SELECT count(*), min(len(w))::BIGINT, max(len(w))::BIGINT, sum(len(w))::BIGINT, sum(len(w)) = 0, min(len(w)) <> max(len(w))
FROM (SELECT string_split(rtrim(text, ' '), ' ') AS w FROM documents)""",
)
def _shape(t: Tables):
    words = t.documents.select(T.tokenize_simple(F.col("text")).alias("w"))
    return S.shape_of(t.embeddings, "embedding").unionByName(S.shape_of(words, "w"))


# row-wise neural operators -----------------------------------------------------------
@query(
    "softmax",
    f"""SELECT 'array' AS form, vec_id AS id, {r('sum((pos + 1) * e / s)')} AS y FROM (SELECT vec_id, pos, exp(x) AS e, sum(exp(x)) OVER (PARTITION BY vec_id) AS s FROM {LONG_EMBEDDINGS}) GROUP BY vec_id
UNION ALL SELECT 'rows', o_orderkey, round(1e6 * exp(x) / sum(exp(x)) OVER (), 6) FROM (SELECT o_orderkey, o_totalprice / 250000.0 AS x FROM orders)""",
)
def _softmax(t: Tables):
    arrays = t.embeddings.select(
        F.lit("array").alias("form"),
        F.col("vec_id").alias("id"),
        F.round(V.fingerprint(A.softmax(V.doubles("embedding"))), 6).alias("y"),
    )
    df = t.orders.select("o_orderkey", (F.col("o_totalprice") / 250000.0).alias("x"))
    rows = N.softmax_rows(df, "x", "y").select(
        F.lit("rows").alias("form"), F.col("o_orderkey").alias("id"), F.round(F.col("y") * 1e6, 6).alias("y")
    )
    return arrays.unionByName(rows)


@query("log_softmax", f"SELECT vec_id, {r('sum((pos + 1) * (x - s))')} AS y FROM (SELECT vec_id, pos, x, ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS s FROM {LONG_EMBEDDINGS}) GROUP BY 1")
def _log_softmax(t: Tables):
    return t.embeddings.select("vec_id", F.round(V.fingerprint(A.log_softmax(V.doubles("embedding"))), 6).alias("y"))


_W = [[((i + 1) * (j + 1) % 7 - 3) / 10.0 for j in range(64)] for i in range(4)]
_B = [0.5, -0.5, 0.25, 0.0]


@query(
    "linear",
    f"""SELECT vec_id, i AS output, {r('sum(x * (((i + 1) * (pos + 1)) % 7 - 3) / 10.0) + any_value(([0.5, -0.5, 0.25, 0.0])[i + 1])')} AS y FROM {LONG_EMBEDDINGS}, range(4) g(i) GROUP BY 1, 2""",
)
def _linear(t: Tables):
    df = S.mat_vec(t.embeddings.select("vec_id", "embedding"), "embedding", _W, "y", _B)
    return df.select("vec_id", F.posexplode("y").alias("output", "y")).select(
        "vec_id", F.col("output").cast("bigint").alias("output"), F.round("y", 6).alias("y")
    )


@query(
    "batch_norm",
    f"""
WITH s AS (SELECT avg(l_quantity) mq, var_pop(l_quantity) vq, avg(l_extendedprice) me, var_pop(l_extendedprice) ve FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('(l_quantity - mq) / sqrt(vq + 1e-5) * 1.5 + 0.1')} AS q, {r('(l_extendedprice - me) / sqrt(ve + 1e-5) * 0.5 - 0.2')} AS p FROM lineitem, s""",
)
def _batch_norm(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    out = N.batch_norm(df, ["q", "p"], [1.5, 0.5], [0.1, -0.2])
    return out.withColumns({"q": F.round("q", 6), "p": F.round("p", 6)})


@query(
    "dropout",
    f"SELECT vec_id, {r(f'sum((pos + 1) * CASE WHEN {h(27, 'vec_id', 'pos')} / {_TWO_52} < 0.3::DOUBLE THEN 0 ELSE x * (1.0::DOUBLE / 0.7::DOUBLE) END)')} AS y FROM {LONG_EMBEDDINGS} GROUP BY 1",
)
def _dropout(t: Tables):
    v = N.dropout(V.doubles("embedding"), 0.3, 27, "vec_id")
    return t.embeddings.select("vec_id", F.round(V.fingerprint(v), 6).alias("y"))


def _mlp_layers():
    w1 = [[((i * 3 + j * 5) % 11 - 5) / 10.0 for j in range(64)] for i in range(8)]
    w2 = [[((i * 2 + j * 7) % 5 - 2) / 4.0 for j in range(8)] for i in range(3)]
    return [(np.array(w1), np.full(8, 0.1)), (np.array(w2), np.zeros(3))]


@query(
    "mlp_score",
    f"""
WITH l1 AS (SELECT vec_id, i AS u, greatest(sum(x * ((i * 3 + pos * 5) % 11 - 5) / 10.0) + 0.1, 0.0) AS a FROM {LONG_EMBEDDINGS}, range(8) g(i) GROUP BY 1, 2)
SELECT vec_id, o AS output, {r('sum(a * ((o * 2 + u * 7) % 5 - 2) / 4.0)')} AS y FROM l1, range(3) k(o) GROUP BY 1, 2""",
)
def _mlp(t: Tables):
    out = N.mlp_score(t.embeddings.select("vec_id", "embedding"), "embedding", _mlp_layers(), "y")
    return out.select("vec_id", F.posexplode("y").alias("output", "y")).select(
        "vec_id", F.col("output").cast("bigint").alias("output"), F.round("y", 6).alias("y")
    )


@query(
    "attention_weights",
    f"""
WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS seq FROM embeddings),
s AS (SELECT a.label, a.seq, a.vec_id, b.v, list_dot_product(a.v, b.v) / 8.0 AS s FROM e a JOIN e b ON a.label = b.label AND a.seq = b.seq),
w AS (SELECT label, seq, vec_id, v, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS w FROM s),
u AS (SELECT label, seq, vec_id, w, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM w)
SELECT label::BIGINT AS label, seq AS sequence, vec_id, {r('sum(w * x * p)')} AS y FROM u GROUP BY 1, 2, 3""",
)
def _attention(t: Tables):
    out = N.attention(t.embeddings, ["label"], "vec_id", "embedding", 16)
    return out.select(
        F.col("label").cast("bigint").alias("label"), "sequence", "vec_id", F.round(V.fingerprint(F.col("attended")), 6).alias("y")
    )
