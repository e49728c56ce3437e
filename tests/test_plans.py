"""Plans are the ones meant: pruned scans, pushed filters, no nested loops, limits before shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import analysis, graph, resolve, search
from weftgraph.plans.catalogue import QUERIES
from weftgraph.plans.projections import frame

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def full(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["j1_callers_topk", "j6_name_or_qualified", "r1_resolution", "j7_changed_symbols", "f12_refs_to_names", "f1_exact_lookup", "g9_cochange", "a6_layer_coupling", "q7_embed", "s13_stale_files", "k5_delete_cascade"])
def test_joins_are_hash_or_merge_joins(spark, name):
    assert not re.search("BroadcastNestedLoopJoin|CartesianProduct|BatchEvalPython|ArrowEvalPython", plan(QUERIES[name](spark, SF)))


def test_top_k_is_limited_before_the_shuffle(spark):
    p = plan(graph.callers(frame(spark, SF, "supply_edges"), frame(spark, SF, "supply_nodes"), 10))
    assert "WindowGroupLimit" in p
    p = plan(search.full_text(frame(spark, SF, "corpus"), "the of"))
    assert "TakeOrderedAndProject" in p and "Generate explode" not in p


def test_scans_read_what_they_need(spark):
    text = full(QUERIES["a2_by_language"](spark, SF))
    assert "ReadSchema: struct<lang:string>" in text
    text = full(QUERIES["w1_topk_per_key"](spark, SF))
    assert "c_mktsegment" not in text
    orders = spark.read.parquet(f"{SF}/orders.parquet").filter(F.col("o_custkey") == 7).select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]" in full(orders)


def test_the_range_join_keeps_its_equality(spark):
    nodes = frame(spark, SF, "part_nodes")
    lines = nodes.select("file_path", F.col("start_line").alias("line"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(analysis.changed_symbols(nodes, lines))
        q = plan(resolve.candidates(frame(spark, SF, "refs"), nodes))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in p and "SortMergeJoin" in q and "NestedLoop" not in p + q
