"""Frame comparison, incident reports, contracts from files and the event log as a stream."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from wardline.operators import contract, impact, incidents
from wardline.sources import files


def test_frames_equal_on_nan_infinity_null_and_relative_tolerance(spark):
    nan, inf = float("nan"), float("inf")
    left = spark.createDataFrame([(1, nan), (2, 1e9), (3, inf), (4, None), (5, 1.0), (6, inf)], "k long, x double")
    right = spark.createDataFrame([(1, nan), (2, 1e9 + 1), (3, inf), (4, None), (5, None), (6, 1.0)], "k long, x double")
    wrong = lambda **limits: impact.frames_equal(left, right, "k", ["x"], **limits).first()["mismatched_rows"]
    assert wrong() == 3
    assert wrong(relative=1e-8) == 2


def test_report_of_an_incident_with_all_parts_and_of_one_with_few(spark):
    rows = [(1, "INCIDENT_DETECTED", 10), (1, "ALERT_CREATED", 12), (1, "TRIAGE_STARTED", 11), (2, "ALERT_CREATED", 5), (3, "TRIAGE_STARTED", 9)]
    events = spark.createDataFrame(rows, "incident_id long, event_type string, m int")
    events = events.select("incident_id", "event_type", F.timestamp_seconds(F.col("m") * 60).alias("occurred_at"))
    signals = spark.createDataFrame([(1, 0.2, 0.1), (2, 0.05, 0.1), (3, 0.9, 0.1)], "incident_id long, observed double, expected_max double")
    types = ["INCIDENT_STARTED", "INCIDENT_DETECTED", "ALERT_CREATED", "GOVERNANCE_BLOCKED", "TRIAGE_STARTED", "ROOT_CAUSE_COMPLETED"]
    checks = [("triage_after_alert", "ALERT_CREATED", "TRIAGE_STARTED"), ("alert_after_detection", "INCIDENT_DETECTED", "ALERT_CREATED")]
    parts = incidents.response_parts(events, signals, types, ["TRIAGE_STARTED", "ALERT_CREATED"], checks)
    quality = spark.createDataFrame([(1, "BLOCK"), (4, "ALLOW")], "incident_id long, decision string")
    got = {r["incident_id"]: r for r in incidents.incident_report({"quality": quality, **parts}).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["quality"]["decision"] == "BLOCK" and got[1]["alert"]["severity"] == "HIGH"
    assert got[1]["root_cause"]["failed_checks"] == ["triage_after_alert"] and not got[1]["root_cause"]["in_order"]
    assert got[1]["timeline"]["complete"] and got[2]["timeline"]["missing"] == ["TRIAGE_STARTED"]
    assert [got[k]["alert"] for k in (2, 3, 4)] == [None] * 3  # below the limit; no alert event; no events
    assert len(got[1]["sla"]["metrics"]) == len(incidents.SLAS) and not got[1]["sla"]["all_met"]


def test_a_contract_file_judges_like_the_contract_in_memory(spark, tmp_path):
    spec = {"contract": {"name": "c", "version": "1", "minimum_rows": 2}, "columns": {"id": {"type": "long", "unique": True}, "x": {"type": "double", "min": 0, "max": 1, "max_null_rate": 0.5}}}
    path = tmp_path / "contract.json"
    path.write_text(json.dumps(spec))
    df = spark.createDataFrame([(1, 0.5), (1, 2.0), (2, None)], "id long, x double")
    loaded = files.load_contract(str(path))
    rows = [sorted(map(str, contract.validate_batch(df, c, "b").collect())) for c in (loaded, contract.Contract.from_dict(spec))]
    assert rows[0] == rows[1] and rows[0]


def test_the_event_log_as_a_stream_of_several_batches_equals_the_log(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for k in range(3):
        new = spark.range(k * 10, k * 10 + 10, numPartitions=1).select(F.timestamp_seconds("id").alias("at"), F.lit(f"kind{k}").alias("event_type"), "id")
        files.append_events(files.event_rows(new, at="at"), log)
    run = files.stream_events(spark, log, max_files=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    assert run.lastProgress is not None and run.lastProgress["batchId"] >= 2
    both = [sorted(map(str, t.collect())) for t in (spark.read.parquet(out), files.read_events(spark, log))]
    assert both[0] == both[1] and len(both[0]) == 30


def test_evidence_joins_the_applications_once(spark, monkeypatch):
    from wardline.plans import release

    made, kept = [], release.stored
    monkeypatch.setattr(release, "stored", lambda df, name: made.append(name) or kept(df, name))
    for run in (lambda: release.gates(spark, "/root/testdata/sf0.001"), lambda: release.j16(spark, "/root/testdata/sf0.001")):
        made.clear()
        plan = run()._jdf.queryExecution().optimizedPlan().toString()
        assert made == ["apps"] and "l_orderkey" not in plan
