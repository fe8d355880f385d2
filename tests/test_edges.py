"""Values outside the test tables: zeros, nulls, huge numbers, ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import elementwise as E
from loomframe.operators import features, fit, shape
from loomframe.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_product_keeps_zero_cells(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 0.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 0, 1.0), (1, 0, -1.0)], "i long, j long, v double")
    cells = {(r.i, r.j): r.v for r in shape.mat_mul(a, b).collect()}
    assert cells == {(0, 0): 0.0, (1, 0): 2.0}
    assert [(r.i, r.v) for r in shape.mat_mul(a, b, sparse=True).collect()] == [(1, 2.0)]


def test_null_is_a_category(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "a")], "k long, c string")
    rows = {r.k: r.i for r in features.categorical_index_auto(df, "c", ["k"], "i").collect()}
    assert rows == {0: 0, 1: 1, 2: 0}


def test_rounding_keeps_what_is_whole_already(spark):
    for f in (E.floor, E.ceil, E.trunc):
        for x in (1e300, math.inf, -math.inf):
            assert one(spark, f(F.lit(x))) == x
        assert math.isnan(one(spark, f(F.lit(math.nan))))
    assert one(spark, E.floor(F.lit(-1.5))) == -2.0 and one(spark, E.trunc(F.lit(-1.5))) == -1.0


def test_null_in_null_out(spark):
    null = F.lit(None).cast("double")
    assert one(spark, E.maximum(null, 5.0)) is None and one(spark, E.minimum(1.0, null)) is None
    assert one(spark, E.clip(null, 0.0, 1.0)) is None


def test_division_by_signed_zero(spark):
    assert math.isnan(one(spark, E.div(F.lit(math.nan), 0.0)))
    assert one(spark, E.div(1.0, F.lit(-0.0))) == -math.inf and one(spark, E.div(-1.0, F.lit(0.0))) == -math.inf


def test_constant_column_has_no_scale(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert all(math.isnan(r.x) for r in features.standardize(df, ["x"]).collect())


def test_batches_need_a_key(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    with pytest.raises(ValueError):
        fit.fit(df, F.array("x"), F.col("y"), 1, batches=4)


def test_folder_class_named_like_the_root(spark, tmp_path):
    for name in ("cat", "dog"):
        (tmp_path / "cat" / name).mkdir(parents=True)
        (tmp_path / "cat" / name / "1.jpg").write_bytes(b"x")
    found = readers.list_image_folder(spark, str(tmp_path / "cat")).collect()
    assert sorted(r["class"] for r in found) == ["cat", "dog"]


def test_line_without_a_tab_is_an_error(spark, tmp_path):
    (tmp_path / "pairs.tsv").write_text("a\tb\nbroken\n")
    with pytest.raises(Exception, match="without a tab"):
        readers.read_parallel_text(spark, str(tmp_path)).collect()


def test_categories_in_another_order_are_one_table(spark, tmp_path):
    names = [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]
    import json

    for k, order in enumerate((names, names[::-1])):
        (tmp_path / f"{k}.json").write_text(json.dumps({"images": [], "annotations": [], "categories": order}))
    categories = readers.read_annotations_json(spark, str(tmp_path))["categories"].collect()
    assert sorted((r.id, r.name) for r in categories) == [(1, "a"), (2, "b")]


def test_exact_ranks_of_every_kind_of_number(spark):
    from loomframe.core.quantile import interpolated, select_ranks

    rng = np.random.default_rng(9)
    values = [*(rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist(), -0.0, 0.0, 0.0, float("inf"), float("-inf"), 5e-324, None, *[1.5] * 200]
    groups = [None if i % 3 == 0 else "ab"[i % 2] for i in range(len(values))]
    df = spark.createDataFrame(list(zip(groups, values)), "g string, x double")
    wanted = {"first": lambda n: n * 0, "mid": lambda n: n / 2, "last": lambda n: n - 1}
    got = {(r.g, r.name): r.value for r in select_ranks(df, ["g"], "x", wanted).collect()}
    for g in (None, "a", "b"):
        held = sorted(x for h, x in zip(groups, values) if h == g and x is not None)
        assert [got[g, n] for n in wanted] == [held[0], held[len(held) // 2], held[-1]]
    whole = [r.value for r in interpolated(df.filter("abs(x) < 1e9"), [], "x", {"p": 0.37}).collect()]
    assert np.isclose(whole[0], np.quantile([x for x in values if x is not None and abs(x) < 1e9], 0.37), rtol=1e-12)
    assert select_ranks(df.limit(0), [], "x", wanted).count() == 0
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert np.isnan(select_ranks(nan, [], "x", {"last": lambda n: n - 1}).first().value)
    typed = df.select(F.lit(-7).cast("int").alias("i"), F.lit("2024-02-29").cast("date").alias("d"), F.lit("-12.34").cast("decimal(9,2)").alias("m"), F.lit(2**62).alias("l"))
    for c, v in typed.first().asDict().items():
        assert select_ranks(typed, [], c, {"r": lambda n: n - 1}).first().value == v
    with pytest.raises(TypeError, match="no 64-bit order"):
        select_ranks(df, [], "g", wanted)


@pytest.mark.parametrize("bound", ["10485760", "-1"])
def test_ranks_with_and_without_broadcasts(spark, bound):
    from loomframe.core.quantile import interpolated

    df = spark.range(20_000).selectExpr("id % 7 as g", "cast(hash(id) as double) as x")
    held = {g: sorted(r.x for r in df.filter(F.col("g") == g).collect()) for g in (0, 3)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    try:
        got = {(r.g, r.name): r.value for r in interpolated(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 21
    assert all(np.isclose(got[g, n], np.quantile(x, p)) for g, x in held.items() for n, p in (("a", 0.1), ("b", 0.5), ("c", 0.9)))
