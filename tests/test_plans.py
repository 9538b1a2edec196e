"""Plan checks: no cartesian products or nested-loop joins, no Python UDFs
except the batch responder, labels stay narrow (no exchange), pushdown and
pruning reach the scan."""

import pytest

from conftest import SF001
from quillspark.plans import all_queries

SKIP = {"gen_v2_dedup", "sinks_roundtrip", "latest_file", "stream_harvest", "stream_sessions", "stream_append",
        "stream_stats", "stream_quiescence", "stream_stable_polls", "stream_timeouts"}


def plan(spark, key):
    return all_queries()[key](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(all_queries()) - SKIP))
def test_no_pairs_no_row_udf(spark, key):
    p = plan(spark, key)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p
    if key != "batch_responder":
        assert "MapInPandas" not in p and "ArrowEvalPython" not in p


@pytest.mark.parametrize("key", ["intent_full", "difficulty_full", "products", "capabilities", "language_cascade",
                                 "gen_v1", "gen_v3", "context_match", "build_prompt"])
def test_row_labels_do_not_aggregate(spark, key):
    p = plan(spark, key)
    assert "HashAggregate" not in p and "SortAggregate" not in p and "SortMergeJoin" not in p


def test_scan_pruning(spark):
    p = plan(spark, "intent_rules")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
