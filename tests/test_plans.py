"""Plan rules, registry rules, and named queries beside DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LAZY = ["b9_status_ladder", "c9_contract_report", "c19_violation_rows", "f12_expanded_status", "g4_association_delta", "h8_impact_comparison", "d9_drift_report", "e16_slice_metrics", "m3_sla_metrics"]
SAMPLE = ["a8_stratified_split", "b13_hash_bucket", "c16_gate", "c17_fingerprint", "c20_split_rows", "d9_drift_report", "e16_slice_metrics", "f12_expanded_status", "h8_impact_comparison", "j7_decisions", "k1_health_snapshot", "s2_stream_request_counts"]


def test_every_oracle_has_a_query():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and len(queries) > 150


@pytest.mark.parametrize("name", LAZY)
def test_plans_have_no_python_no_cross_join_no_single_task_window(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line or "Window(" in line:
            assert not any("SinglePartition" in below for below in lines[i + 1 : i + 4])


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    message, _ = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert message == ""


def test_scan_reads_only_needed_columns(spark):
    from wardline.plans.bridge import table

    plan = table(spark, SF, "events").where("event_type = 'error'").groupBy("user_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan and "props" not in plan
