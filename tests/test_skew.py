"""Joins and products whose keys are skewed: hot keys are split, broadcasts are bounded by counted bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.core import skew
from loomframe.operators import features, joins, shape


@pytest.fixture
def shuffled(monkeypatch, spark):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tokens_of(spark, rows=6000):
    token = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise((F.col("id") % 997).cast("string"))
    return spark.range(rows).select("id", F.lit(7).alias("_salt"), token.alias("token"))


def test_hot_keys_are_those_with_a_share_of_the_rows(spark):
    df = tokens_of(spark)
    hashes = {r.token: r.h for r in df.select("token", skew._key_hash(["token"]).alias("h")).distinct().collect()}
    assert set(skew.hot_keys(df, ["token"])) == {hashes["hot"], hashes[None]}
    assert skew.hot_keys(df.limit(0), ["token"]) == []
    assert skew.hot_keys(spark.range(5000), ["id"]) == []


def test_only_hot_keys_are_spread(spark):
    df = tokens_of(spark)
    table = spark.createDataFrame([("hot", 1), ("5", 2)], "token string, index long")
    left, right = skew.salted(df, table, ["token"], "s")
    salts = {r.token: r.n for r in left.groupBy("token").agg(F.count_distinct("s").alias("n")).collect()}
    assert salts["hot"] == salts[None] == skew.SALTS and {n for t, n in salts.items() if t not in ("hot", None)} == {1}
    assert {r.token: r["count"] for r in right.groupBy("token").count().collect()} == {"hot": skew.SALTS, "5": 1}
    fullest = left.filter("token = 'hot'").groupBy("s").count().agg({"count": "max"}).first()[0]
    assert fullest < 2 * 2000 / skew.SALTS


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_split_lookups_equal_plain_joins(spark, shuffled, how):
    df = tokens_of(spark)
    table = spark.createDataFrame([("hot", 1), ("5", 2), ("x", 4)], "token string, index long")
    plain = df.join(table, "token", how)
    got = joins.lookup_join(df, table, "token", how)
    assert got.columns == plain.columns
    order = lambda rows: sorted(map(str, rows.collect()))
    assert order(got) == order(plain)


def test_vocabulary_contains_with_null_and_hot_tokens(spark, shuffled):
    df = tokens_of(spark)
    vocabulary = spark.createDataFrame([("hot", 0), (None, 1)], "token string, index long")
    inside = joins.vocabulary_contains(df, vocabulary)
    assert inside.count() == df.filter("token = 'hot'").count() and inside.columns == ["token", "id", "_salt"]
    assert joins.vocabulary_contains(df, vocabulary, False).count() == df.filter("token is null or token <> 'hot'").count()


def test_categories_with_a_hot_and_a_null_value(spark, shuffled):
    df = tokens_of(spark)
    got = features.categorical_index_auto(df, "token", ["id"], "category")
    seen = {}
    for r in df.orderBy("id").collect():
        seen.setdefault(r.token, len(seen))
    rows = got.collect()
    assert len(rows) == 6000 and all(r.category == seen[r.token] for r in rows)


def test_categories_need_an_order_that_tells_them_apart(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "pos int, c string")
    with pytest.raises(Exception, match="key"):
        features.first_seen_index(df, "c", ["pos"]).collect()


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(200).select("id", F.array_repeat(F.lit(0.5), 1024).alias("v"), F.array(F.lit("abc"), F.lit(None)).alias("w"))
    held = skew.table_bytes(wide)
    assert 200 * 1024 * 8 < held < 200 * 1024 * 9
    assert skew.table_bytes(wide.limit(0)) == 0
    nested = spark.range(3).select(F.struct(F.lit("xy").alias("a"), F.create_map(F.lit("k"), F.lit(1)).alias("m")).alias("s"))
    assert skew.table_bytes(nested) > 3 * skew.ROW_OVERHEAD


def test_wide_vectors_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1 << 20)
    table = spark.range(200).select("id", F.array_repeat(F.col("id").cast("double"), 1024).alias("v"))
    items = spark.range(3000).select(F.col("id").alias("item"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 400).alias("id"))
    out = joins.embedding_lookup(items, table, "id", "v", [0.25] * 1024)
    rows = out.select("item", "id", F.element_at("v", 1024).alias("last")).collect()
    assert len(rows) == 3000 and all(r.last == (float(r.id) if r.id < 200 else 0.25) for r in rows)


def long_form(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "i long, j long, v double")


@pytest.mark.parametrize("flip", [False, True])
def test_one_inner_block_is_dealt_to_all_tasks(spark, shuffled, flip):
    rng = np.random.default_rng(3)
    tall, small = rng.normal(size=(150, 4)), rng.normal(size=(4, 6))
    a, b = (small.T, tall.T) if flip else (tall, small)
    left = spark.range(38).select(F.lit(0).alias("_inner"), F.col("id").alias("_row"))
    right = spark.range(2).select(F.lit(0).alias("_inner"))
    assert list(shape.inner_splits(left, right, ["_inner"], 8).values()) == [8]
    out = shape.mat_mul(long_form(spark, a), long_form(spark, b), block=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    got = np.zeros((len(a), b.shape[1]))
    rows = out.collect()
    for r in rows:
        got[r.i, r.j] = r.v
    assert len(rows) == got.size and np.allclose(got, a @ b)


def test_products_per_batch_key(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 5, 5))
    rows = [(f"b{k}", i, j, float(v)) for (k, i, j), v in np.ndenumerate(x)]
    m = spark.createDataFrame(rows, "name string, i long, j long, v double")
    got = {(r.name, r.i, r.j): r.v for r in shape.mat_mul(m, m, block=4, batch=["name"]).collect()}
    assert len(got) == 75 and all(np.isclose(v, (x[int(n[1])] @ x[int(n[1])])[i, j]) for (n, i, j), v in got.items())
    assert shape.mat_mul(m.limit(0), m, block=4, batch=["name"]).count() == 0


@pytest.mark.parametrize("name", ["linear", "mlp_score", "to_dense", "mat_mul", "batch_dot"])
def test_python_runs_once(spark, sf_dir, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1


def test_dense_rows(spark):
    coo = spark.createDataFrame([(0, 1, 2.0), (2, 0, -1.0), (0, 3, 4.0)], "i int, j int, v double")
    assert {r.i: r.w for r in shape.to_dense(coo, 4, "w").collect()} == {0: [0.0, 2.0, 0.0, 4.0], 2: [-1.0, 0.0, 0.0, 0.0]}
    assert shape.to_dense(coo.limit(0), 4).count() == 0
