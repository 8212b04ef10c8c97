"""Cases that must not be cut short: long chains, long value lists, rows without score, label, key or order."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wardline.functions.scalar import floor6
from wardline.operators import contract as ct
from wardline.operators import evidence as ev
from wardline.operators import fairness, impact, incidents, metrics, whatif


def chain(spark, n, failed):
    rows = [(1, k, [] if k == 0 else [k - 1], "FAIL" if k == failed else "PASS") for k in range(n)]
    return spark.createDataFrame(rows, "run_id int, task_id int, depends_on array<int>, own_status string")


def test_long_chain_is_followed_to_its_end(spark):
    row = ev.run_status(ev.run_rollup(chain(spark, 16, 0))).first()
    assert (row["passed"], row["failed"], row["skipped"], row["run_status"]) == (0, 1, 15, "FAIL")


def test_cycles_and_unknown_tasks_are_refused(spark):
    schema = "run_id int, task_id int, depends_on array<int>, own_status string"
    loop = spark.createDataFrame([(1, 0, [1], "PASS"), (1, 1, [0], "PASS"), (1, 2, [1], "PASS")], schema)
    with pytest.raises(ValueError, match="cycle"):
        ev.run_rollup(loop)
    with pytest.raises(ValueError, match="no task"):
        ev.run_rollup(spark.createDataFrame([(1, 0, [7], "PASS")], schema))


def test_every_unexpected_value_counts(spark):
    df = spark.range(1500).select(F.concat(F.lit("v"), "id").alias("c"))
    rules = ct.Contract("t", "1", columns=(ct.ColumnRule("c", "string", allowed_values=("a",)),))
    row = ct.validate_batch(df, rules).where("rule_id = 'c.allowed_values'").first()
    assert (row["passed"], row["observed"], row["observed_value"]) == (False, "1500", 1500.0)
    assert ct.unexpected_values(df, rules).count() == 1500


def test_floor6_keeps_what_it_cannot_cut(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e14,), (-1e14,), (0.1234567,)], "x double")
    got = [r[0] for r in rows.select(floor6("x")).collect()]
    assert math.isnan(got[0]) and got[1:] == [float("inf"), 1e14, -1e14, 0.123457]


def test_events_without_order_stay_and_are_bad(spark):
    rows = [("i", "e1", "A", 10, 1), ("i", "e2", "B", 11, None), ("i", "e3", "C", 12, 2), (None, "e4", "A", 13, 1)]
    events = spark.createDataFrame(rows, "incident_id string, event_id string, event_type string, occurred_at int, seq int")
    found = {r["incident_id"]: r for r in incidents.timeline_checks(events).collect()}
    assert (found["i"]["event_count"], found["i"]["bad_timestamps"], found["i"]["valid"]) == (3, 1, False)


def test_previous_value_keeps_rows_without_key(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 1, "c"), ("k", None, "d")], "k string, o int, v string")
    got = {(r["k"], r["o"]): r["p"] for r in ev.previous_in_order(rows, ["k"], ["o"], F.col("o"), "v", "p").collect()}
    assert got == {(None, 1): None, (None, 2): "a", ("k", None): None, ("k", 1): "d"}


SCORED = [("g", 1, 0.9), ("g", 0, 0.1), ("g", None, 0.9), ("g", 1, None), ("g", 0, float("nan")), ("g", 0, 1.5)]


def scored(spark):
    return spark.createDataFrame(SCORED, "grp string, default_30d int, risk_probability double").withColumns(
        {"batch": F.lit("reference"), "scenario": F.lit("s"), "device_risk_score": F.lit(0.5)}
    )


def test_rows_without_label_or_score_count_nowhere_but_in_left_out(spark):
    df = scored(spark)
    a, b = metrics.classification_metrics(df).first(), metrics.threshold_metrics(df).first()
    assert a["n_samples"] == b["n_samples"] == 2 and (b["tp"], b["tn"], b["fp"], b["fn"]) == (1, 1, 0, 0)
    out = metrics.left_out(df).first()
    assert (out["row_count"], out["unlabelled"], out["unscored"], out["left_out"]) == (6, 1, 3, 4)
    rates = fairness.group_metrics(fairness.group_counts(df, ["grp"])).first()
    assert (rates["sample_count"], rates["false_positive_rate"], rates["true_positive_rate"]) == (2, 0.0, 1.0)
    assert impact.scenario_metrics(df).first()["sample_count"] == 2
    with pytest.raises(Exception, match="no default_30d or no valid"):
        metrics.threshold_metrics(df, strict=True).collect()


def test_roc_curve_is_whole_unless_thinning_is_asked_for(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("default_30d"), (F.col("id") / 1000).alias("risk_probability"))
    assert metrics.roc_points(df).count() == 1000
    assert metrics.roc_points(df, points=10).count() <= 11


def test_null_class_is_held_out_too(spark):
    df = spark.range(100).select(F.col("id").alias("application_id"), F.when(F.col("id") < 50, 1).alias("y"))
    split = whatif.stratified_split(df, "y").where("split = 'holdout'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in split} == {1: 15, None: 15}
