"""Projection, featurization, predicates and index expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.core.order import row_index
from loomframe.core.session import spread
from loomframe.functions import elementwise as E, vectors as V
from loomframe.operators import features as X, indexing as I, sampling as S
from loomframe.plans.registry import LINE_KEY, LINE_KEY_SQL, LONG_EMBEDDINGS, Tables, h, query, r

FLAGS = {"A": 0, "N": 1, "R": 2}
PRIORITIES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


@query(
    "flagship_featurize_split",
    f"""
WITH first AS (SELECT l_returnflag, row_number() OVER (ORDER BY min(k)) - 1 AS flag
  FROM (SELECT l_returnflag, row_number() OVER (ORDER BY {LINE_KEY_SQL}) AS k FROM lineitem) GROUP BY 1),
st AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) me,
  stddev_pop(l_extendedprice) se, avg(l_discount) md, stddev_pop(l_discount) sd FROM lineitem),
x AS (SELECT flag, (l_quantity - mq) / sq AS q, (l_extendedprice - me) / se AS e, (l_discount - md) / sd AS d,
  row_number() OVER (ORDER BY {h(42, *LINE_KEY[:5], "round(l_extendedprice * 100)::BIGINT")}, {LINE_KEY_SQL}) - 1 AS rk,
  count(*) OVER () AS n FROM lineitem JOIN first USING (l_returnflag), st)
SELECT CASE WHEN rk < floor(8 / 10.0 * n) THEN 0 ELSE 1 END AS split, count(*) AS n,
  {r('avg(q)')} AS mean_quantity, {r('avg(e)')} AS mean_price, {r('avg(d)')} AS mean_discount,
  sum(flag)::BIGINT AS flag_total, {r('avg(sqrt(flag * flag + q * q + e * e + d * d))')} AS mean_norm
FROM x GROUP BY 1""",
)
def _flagship(t: Tables):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    # the timestamp is written as text exactly as SQL writes it
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    used = [*LINE_KEY, "l_quantity", "l_discount", "l_returnflag"]
    df = spread(t.lineitem.select(*used)).withColumns({"cents": cents, "shipped": shipped, "price": F.col("l_extendedprice")})
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "shipped", "cents"]
    df = S.random_split(df, [8, 2], 42, key)
    df = X.categorical_index_auto(df, "l_returnflag", LINE_KEY, "flag")
    df = X.standardize(df, ["l_quantity", "price", "l_discount"], over=t.lineitem.withColumn("price", F.col("l_extendedprice")))
    vector = X.assemble_vector(*[F.array(c) for c in ("flag", "l_quantity", "price", "l_discount")])
    return (
        df.withColumn("features", vector)
        .groupBy("split")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("l_quantity"), 6).alias("mean_quantity"),
            F.round(F.avg("price"), 6).alias("mean_price"),
            F.round(F.avg("l_discount"), 6).alias("mean_discount"),
            F.sum("flag").alias("flag_total"),
            F.round(F.avg(V.norm(F.col("features"))), 6).alias("mean_norm"),
        )
    )


@query("select_features_labels", "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders")
def _select(t: Tables):
    return X.select_features_labels(t.orders, ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_totalprice"])


@query(
    "numeric_feature",
    "SELECT o_orderkey, round(o_totalprice::VARCHAR::DOUBLE * 2, 2) AS doubled FROM orders",
)
def _numeric(t: Tables):
    text = F.col("o_totalprice").cast("string")
    return t.orders.select("o_orderkey", F.round(X.numeric_feature(text) * 2, 2).alias("doubled"))


@query(
    "categorical_index_auto",
    """
WITH m AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS priority FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, priority FROM orders JOIN m USING (o_orderpriority)""",
)
def _auto(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderpriority")
    return X.categorical_index_auto(df, "o_orderpriority", ["o_orderkey"], "priority")


@query(
    "categorical_index_map",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
  WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END::BIGINT AS priority FROM orders""",
)
def _mapped(t: Tables):
    df = X.categorical_index_map(t.orders, "o_orderpriority", PRIORITIES, "priority")
    return df.select("o_orderkey", "priority")


@query(
    "categorical_one_hot",
    f"""SELECT {LINE_KEY_SQL.replace(', l_shipdate', '')}, (l_returnflag = 'A')::INT::DOUBLE AS s0,
  (l_returnflag = 'N')::INT::DOUBLE AS s1, (l_returnflag = 'R')::INT::DOUBLE AS s2 FROM lineitem""",
)
def _one_hot_cat(t: Tables):
    df = X.categorical_one_hot(t.lineitem, "l_returnflag", FLAGS, "slots")
    keys = [k for k in LINE_KEY if k != "l_shipdate"]
    return df.select(*keys, *[F.col("slots")[i].alias(f"s{i}") for i in range(3)])


@query(
    "custom_featurizer",
    """SELECT p_partkey, length(p_name)::DOUBLE AS chars,
  (length(p_name) - length(replace(p_name, 'e', '')))::DOUBLE AS es FROM part""",
)
def _custom(t: Tables):
    fn = X.custom_featurizer(lambda s: [len(s), s.count("e")])
    return t.part.withColumn("v", fn("p_name")).select(
        "p_partkey", F.col("v")[0].alias("chars"), F.col("v")[1].alias("es")
    )


@query(
    "assemble_vector",
    f"""SELECT l_returnflag, count(*) AS n, {r('sum(1 * l_quantity + 2 * l_discount + 3 * l_tax + 4 * (l_returnflag = $$A$$)::INT + 5 * (l_returnflag = $$N$$)::INT + 6 * (l_returnflag = $$R$$)::INT)', 4)} AS print FROM lineitem GROUP BY 1""",
)
def _assemble(t: Tables):
    df = X.categorical_one_hot(t.lineitem, "l_returnflag", FLAGS, "slots")
    v = X.assemble_vector(F.array("l_quantity"), F.array("l_discount", "l_tax"), F.col("slots"))
    return df.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum(V.fingerprint(v)), 4).alias("print")
    )


@query(
    "standardize",
    f"""
WITH s AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) d, avg(o_custkey) mc, stddev_pop(o_custkey) dc FROM orders)
SELECT o_orderkey, {r('(o_totalprice - m) / d')} AS price, {r('(o_custkey - mc) / dc')} AS cust FROM orders, s""",
)
def _standardize(t: Tables):
    df = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))
    out = X.standardize(df, ["price", "cust"])
    return out.select("o_orderkey", F.round("price", 6).alias("price"), F.round("cust", 6).alias("cust"))


_MEAN, _STD = [0.1, -0.2, 0.3], [0.5, 0.25, 2.0]


@query(
    "channel_normalize",
    f"""SELECT vec_id, {r('sum((pos + 1) * (x - ([0.1, -0.2, 0.3])[pos % 3 + 1]) / ([0.5, 0.25, 2.0])[pos % 3 + 1])')} AS print
FROM {LONG_EMBEDDINGS} GROUP BY vec_id""",
)
def _channel(t: Tables):
    v = X.channel_normalize(V.doubles("embedding"), _MEAN, _STD)
    return t.embeddings.select("vec_id", F.round(V.fingerprint(v), 6).alias("print"))


def pixels(t: Tables):
    """A pixel table (image, y, x, c, v): every embedding as an 8 x 8 one-channel image."""
    level = F.floor((F.col("e") + 1.0) * 127.0).cast("int")
    return t.embeddings.select("vec_id", F.posexplode(V.doubles("embedding")).alias("p", "e")).select(
        F.col("vec_id").alias("image"),
        F.floor(F.col("p") / 8).cast("bigint").alias("y"),
        (F.col("p") % 8).cast("bigint").alias("x"),
        F.lit(0).cast("bigint").alias("c"),
        level.cast("bigint").alias("v"),
    )


PIXELS = f"""(SELECT vec_id AS image, (pos // 8)::BIGINT AS y, (pos % 8)::BIGINT AS x, 0::BIGINT AS c,
  floor((x + 1.0::DOUBLE) * 127.0::DOUBLE)::BIGINT AS v FROM {LONG_EMBEDDINGS})"""


@query(
    "scale_to_unit",
    f"SELECT image, c, y, x, {r('v / 255.0::DOUBLE')} AS unit FROM {PIXELS}",
)
def _scale(t: Tables):
    return pixels(t).select("image", "c", "y", "x", F.round(X.scale_to_unit(F.col("v")), 6).alias("unit"))


@query(
    "label_encode_multi",
    """SELECT o_orderkey, i AS position, CASE WHEN i > length(k) THEN 11 ELSE substr(k, i, 1)::INT END AS label
FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS k, unnest(range(1, 7))::INT AS i FROM orders)""",
)
def _label_encode(t: Tables):
    labels = X.label_encode_positions(F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", F.posexplode(labels).alias("position", "label")).withColumn(
        "position", F.col("position") + 1
    )


@query(
    "boolean_mask",
    f"""SELECT 'rows' AS form, o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_totalprice > 250000
UNION ALL SELECT 'array', vec_id, {r('sum(x)')} FROM {LONG_EMBEDDINGS} WHERE x > 0 GROUP BY vec_id""",
)
def _mask(t: Tables):
    rows = I.boolean_mask(t.orders, F.col("o_totalprice") > 250000).select(
        F.lit("rows").alias("form"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")
    )
    kept = V.mask(V.doubles("embedding"), lambda x, i: x > 0)
    arrays = t.embeddings.select(F.lit("array").alias("form"), F.col("vec_id").alias("id"), F.round(V.total(kept), 6).alias("value"))
    return rows.unionByName(arrays)


@query(
    "where_select",
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice ELSE -1.5 END AS value FROM orders""",
)
def _where(t: Tables):
    return t.orders.select(
        "o_orderkey", E.where_select(F.col("o_custkey") % 3, F.col("o_totalprice"), -1.5).alias("value")
    )


def indexed_embeddings(t: Tables):
    df = t.embeddings.select("vec_id", "label", V.doubles("embedding").alias("v"))
    return row_index(df, "vec_id")


INDEXED = """(SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id) - 1 AS idx,
  count(*) OVER () AS n FROM embeddings)"""


@query(
    "index_get",
    f"""
SELECT '10:-10:7, 3' AS ix, idx, {r('v[4]::DOUBLE')} AS value FROM {INDEXED} WHERE idx >= 10 AND idx < n - 10 AND (idx - 10) % 7 = 0
UNION ALL SELECT '-1, *', idx, {r('list_sum(v::DOUBLE[])')} FROM {INDEXED} WHERE idx = n - 1
UNION ALL SELECT '*, 2:60:3', idx, {r('list_sum((v::DOUBLE[])[3:60:3])')} FROM {INDEXED}
UNION ALL SELECT ':5, -1', idx, {r('v[64]::DOUBLE')} FROM {INDEXED} WHERE idx < 5""",
)
def _index_get(t: Tables):
    df = indexed_embeddings(t)
    one = lambda ix, value: I.index_get(df, ix, vector="v").select(
        F.lit(ix).alias("ix"), "idx", F.round(value, 6).alias("value")
    )
    return (
        one("10:-10:7, 3", F.col("v"))
        .unionByName(one("-1, *", V.total(F.col("v"))))
        .unionByName(one("*, 2:60:3", V.total(F.col("v"))))
        .unionByName(one(":5, -1", F.col("v")))
    )


@query(
    "slice_axis",
    f"""SELECT idx, vec_id, {r('list_sum((v::DOUBLE[])[9:16])')} AS s FROM {INDEXED} WHERE idx >= 20 AND idx < n - 100""",
)
def _slice(t: Tables):
    df = I.index_get(indexed_embeddings(t), (slice(20, -100), slice(8, 16)), vector="v")
    return df.select("idx", "vec_id", F.round(V.total(F.col("v")), 6).alias("s"))


@query("pick", f"SELECT vec_id, {r('embedding[label + 1]::DOUBLE')} AS picked FROM embeddings")
def _pick(t: Tables):
    return t.embeddings.select("vec_id", F.round(V.pick(V.doubles("embedding"), F.col("label")), 6).alias("picked"))


@query(
    "gather",
    f"""
WITH p AS (SELECT o_orderkey AS slot, o_custkey % (SELECT count(*) FROM embeddings) AS idx FROM orders)
SELECT slot, vec_id, {r('list_sum(v::DOUBLE[])')} AS s FROM p JOIN {INDEXED} e USING (idx)""",
)
def _gather(t: Tables):
    n = t.embeddings.agg(F.count("*")).scalar()
    positions = t.orders.select(F.col("o_orderkey").alias("slot"), F.pmod("o_custkey", n).alias("idx"))
    out = I.gather(indexed_embeddings(t), positions)
    return out.select("slot", "vec_id", F.round(V.total(F.col("v")), 6).alias("s"))


@query(
    "index_set",
    """SELECT o_orderkey, CASE WHEN o_orderkey >= 100 AND o_orderkey < 9000 AND o_orderkey % 2 = 0 THEN -1.0
  WHEN o_custkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS value FROM orders""",
)
def _index_set(t: Tables):
    df = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("value"))
    df = I.index_set(df, "value", F.col("o_custkey") % 5 == 0, lambda v: v * 2)
    df = I.index_set(df, "value", I.row_selector(df, "o_orderkey", slice(100, 9000, 2)), -1.0)
    return df.select("o_orderkey", "value")


@query(
    "cast_type",
    """SELECT o_orderkey, trunc(o_totalprice)::INT AS as_int, trunc(o_totalprice)::BIGINT AS as_long,
  round(o_totalprice::FLOAT::DOUBLE, 2) AS as_float, (o_custkey % 2 <> 0) AS as_bool FROM orders""",
)
def _cast(t: Tables):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        price.cast("int").alias("as_int"),
        price.cast("long").alias("as_long"),
        F.round(price.cast("float").cast("double"), 2).alias("as_float"),
        (F.col("o_custkey") % 2).cast("boolean").alias("as_bool"),
    )


@query(
    "transform_pipeline",
    f"SELECT o_orderkey, upper(trim(substr(o_orderpriority, 3))) AS o_orderpriority, {r('ln(o_totalprice / 100.0)')} AS o_totalprice FROM orders",
)
@query(
    "transform_chain",
    f"SELECT o_orderkey, upper(trim(substr(o_orderpriority, 3))) AS o_orderpriority, {r('ln(o_totalprice / 100.0)')} AS o_totalprice FROM orders",
)
def _chain(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    steps = [
        ("o_orderpriority", lambda c: F.substring(c, 3, 100)),
        ("o_orderpriority", F.trim),
        ("o_orderpriority", F.upper),
        ("o_totalprice", lambda c: c / 100.0),
        ("o_totalprice", lambda c: F.round(E.ln(c), 6)),
    ]
    return X.apply_steps(df, steps)


@query(
    "target_transform",
    """
WITH i AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders),
b AS (SELECT *, idx // 32 AS batch_id FROM i)
SELECT batch_id, idx, round(o_totalprice - min(o_totalprice) OVER (PARTITION BY batch_id), 2) AS label FROM b""",
)
def _target(t: Tables):
    df = row_index(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")
    batches = S.batch_sample(df, "idx", 32)
    stacked = batches.groupBy("batch_id").agg(F.collect_list(F.struct("idx", "o_totalprice")).alias("s"))
    # the label transform sees the whole batch
    low = F.array_min(F.transform("s", lambda p: p["o_totalprice"]))
    return stacked.withColumn("low", low).select("batch_id", "low", F.inline("s")).select(
        "batch_id", "idx", F.round(F.col("o_totalprice") - F.col("low"), 2).alias("label")
    )
