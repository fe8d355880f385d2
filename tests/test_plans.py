"""Physical plans: no single-task exchange of rows, pruned scans, no Python where SQL does."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["row_index", "random_sample", "random_split", "batch_sample", "fixed_bucket_sample", "cum_sum", "pool1d_max", "conv1d", "text_to_ids", "metric_percentile"],
)
def test_no_unpartitioned_window(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    # a window over one partition shows as Window fed by Exchange SinglePartition
    assert not re.search(r"Window \[(?:(?!\n).)*\n(?:[^\n]*Sort[^\n]*\n)?[^\n]*Exchange SinglePartition", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["ew_add", "act_gelu", "softmax", "standardize", "text_chain", "loss_softmax_ce", "eval_topk_accuracy", "topk_similar"])
def test_python_only_where_needed(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    runs_python = any(node in text for node in ("Python", "MapInPandas", "MapInArrow"))
    assert runs_python == (name == "topk_similar")


def test_split_moves_no_rows(spark, sf_dir):
    assert "Exchange" not in plan(QUERIES["random_split"](spark, sf_dir))


@pytest.mark.parametrize(
    "name, columns",
    [("standardize", {"o_orderkey", "o_totalprice", "o_custkey"}), ("metric_mean", {"event_type", "value"}), ("batch_norm", {"l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"})],
)
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, sf_dir))):
        assert {f.split(":")[0] for f in schema.split(",")} <= columns


def test_filters_reach_the_scan(spark, sf_dir):
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,250000.0)]" in plan(QUERIES["boolean_mask"](spark, sf_dir))


def test_topk_limits_groups_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["nms_topk"](spark, sf_dir))
