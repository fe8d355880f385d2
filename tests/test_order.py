"""Global order and exact ranks, on skewed and tiny inputs."""

import random

import pytest
from pyspark.sql import functions as F

from loomframe.core import order as O, quantile as Q
from loomframe.core.keyed import keyed_hash
from loomframe.operators import sampling as S


@pytest.fixture(scope="module")
def skewed(spark):
    """5,000 rows; one group holds two thirds of them."""
    return spark.range(5000).select(
        "id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).cast("int").alias("g"), (F.col("id") * 37 % 101).alias("v")
    )


def test_row_index_is_dense_and_ordered(skewed):
    rows = O.row_index(skewed, ["v", "id"]).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(5000))
    assert [(r.v, r.id) for r in rows] == sorted((r.v, r.id) for r in rows)


def test_row_index_of_nothing(spark):
    assert O.row_index(spark.range(0), "id").collect() == []


def test_unique_key_is_checked(skewed):
    O.assert_unique_key(skewed, ["id"])
    with pytest.raises(ValueError):
        O.assert_unique_key(skewed, ["g"])


def test_group_rank_spans_partitions(spark, skewed):
    spread = O.group_rank(skewed.repartition(16), ["g"], "id")
    by_group = {}
    for r in spread.collect():
        by_group.setdefault(r.g, []).append((r.id, r["rank"]))
    for rows in by_group.values():
        rows.sort()
        assert [k for _, k in rows] == list(range(len(rows)))


def test_group_rank_over_many_ranges(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = O.group_prefix_sum(skewed, "v", ["g"], "id")
        rows = sorted((r.g, r.id, r.v, r.running) for r in ranked.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    total, last = 0, None
    for g, _, v, running in rows:
        total = v if g != last else total + v
        last = g
        assert running == total


def test_prefix_sum(skewed):
    total = 0
    for r in sorted(O.prefix_sum(skewed, "v", "id").collect(), key=lambda r: r.id):
        total += r.v
        assert r.running == total


def test_random_rank_is_a_permutation_and_keyed(spark, skewed):
    a = {r.id: r["rank"] for r in O.random_rank(skewed, 1, "id").collect()}
    b = {r.id: r["rank"] for r in O.random_rank(skewed.repartition(7), 1, "id").collect()}
    c = {r.id: r["rank"] for r in O.random_rank(skewed, 2, "id").collect()}
    assert sorted(a.values()) == list(range(5000))
    assert a == b and a != c


@pytest.mark.parametrize("ratios", [[1, 1], [7, 2, 1], [1, 0, 1], [5, 0]])
@pytest.mark.parametrize("enough", [100_000, 1])
def test_random_split_sizes(skewed, ratios, enough):
    out = S.random_split(skewed, ratios, 3, "id", enough=enough)
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    sizes = [int(r / sum(ratios) * 5000) for r in ratios[:-1]]
    sizes.append(5000 - sum(sizes))
    assert [got.get(i, 0) for i in range(len(ratios))] == sizes
    # the same order as a full sort by (hash, key)
    rows = sorted((r.h, r.id, r.split) for r in out.select(keyed_hash(3, "id").alias("h"), "id", "split").collect())
    assert [s for *_, s in rows] == sorted(s for *_, s in rows)


def test_split_needs_two_parts(skewed):
    with pytest.raises(ValueError):
        S.random_split(skewed, [1], 3, "id")


def test_select_ranks_is_exact(spark):
    rng = random.Random(5)
    data = [("a", rng.choice([0.0, 1.0, rng.random()])) for _ in range(3000)] + [("b", rng.random()) for _ in range(7)]
    df = spark.createDataFrame(data, "g string, x double")
    wanted = {"p10": lambda n: F.floor(n * 10 / 100), "p99": lambda n: F.floor(n * 99 / 100), "max": lambda n: n - 1}
    got = {(r.g, r.name): r.value for r in Q.select_ranks(df, ["g"], "x", wanted).collect()}
    for g in "ab":
        values = sorted(x for k, x in data if k == g)
        n = len(values)
        assert got[g, "p10"] == values[n * 10 // 100]
        assert got[g, "p99"] == values[n * 99 // 100]
        assert got[g, "max"] == values[-1]


def test_blocked_window_equals_plain_lag(spark):
    from pyspark.sql import Window

    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("p"), "id")
    cut = O.blocked(df, "p", ["g"], before=2, after=1, size=7)
    over = Window.partitionBy("g", "_block").orderBy("p")
    got = cut.select("g", "p", F.lag("id", 2).over(over).alias("l"), F.lead("id").over(over).alias("n"), "_owned").filter("_owned")
    want = df.select("g", "p", F.lag("id", 2).over(Window.partitionBy("g").orderBy("p")).alias("l"), F.lead("id").over(Window.partitionBy("g").orderBy("p")).alias("n"))
    assert sorted(map(tuple, got.drop("_owned").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

def test_split_refuses_a_key_that_repeats_across_a_cut(spark):
    repeated = spark.range(1000).select((F.col("id") % 10).alias("k"))
    with pytest.raises(ValueError):
        S.random_split(repeated, [85, 15], 3, "k")


def test_repeated_order_keys_raise(spark):
    df = spark.createDataFrame([(i // 2, "g", float(i)) for i in range(2000)], "k long, g string, v double").repartition(4)
    for run in (
        lambda u: O.row_index(df, "k", unique=u),
        lambda u: O.prefix_sum(df, "v", ["k"], unique=u),
        lambda u: O.group_rank(df, ["g"], "k", unique=u),
        lambda u: O.group_prefix_sum(df, "v", ["g"], ["k"], unique=u),
    ):
        with pytest.raises(Exception, match="not unique"):
            run(True)
        assert run(False).count() == 2000


def test_scans_over_nulls_and_nans(spark):
    rows = [(None, i, None if i % 3 else float(i)) for i in range(50)] + [("a", i, float(i)) for i in range(700)] + [("b", 0, None), ("b", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        ranks = {(r.g, r.i): r["rank"] for r in O.group_rank(df, ["g"], "i").collect()}
        sums = {(r.g, r.i): r.running for r in O.group_prefix_sum(df, "v", ["g"], "i").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(k == i for (_, i), k in ranks.items()) and len(ranks) == 752
    assert sums["b", 0] is None and sums["b", 1] == 2.0 and sums["a", 699] == 699 * 700 / 2
    assert all(sums[None, i] == sum(x for x in range(0, i + 1, 3)) for i in range(50))
    nan = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (1.0, 1)], "g double, i int")
    assert sorted(r["rank"] for r in O.group_rank(nan, ["g"], "i").collect()) == [0, 0, 1]


def test_no_exchange_after_the_range_write(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    for out in (O.group_rank(df, ["g"], "id"), O.group_prefix_sum(df, "id", ["g"], "id"), O.prefix_sum(df, "id", "id")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
