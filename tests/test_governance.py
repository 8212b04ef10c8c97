"""Contract, fairness, impact, evidence, rollout, incidents: small literal cases and error paths."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from wardline.functions import scalar as s
from wardline.functions import status as st
from wardline.operators import contract as ct
from wardline.operators import evidence as ev
from wardline.operators import fairness as fair
from wardline.operators import impact, incidents, release, whatif
from wardline.plans import release as release_plans
from wardline.sources import files

CONTRACT = ct.Contract(
    "c", "1", minimum_rows=2,
    columns=(
        ct.ColumnRule("id", "string", unique=True, max_null_rate=0.0),
        ct.ColumnRule("age", "integer", min=21, max=70, max_null_rate=0.0),
        ct.ColumnRule("score", "number", min=0.0, max=1.0, max_null_rate=0.5),
        ct.ColumnRule("region", "string", allowed_values=("north", "south"), max_null_rate=0.0),
    ),
)


def batch(spark):
    rows = [("a", 30, 0.5, "north"), ("b", 90, None, "unknown-region"), ("b", None, float("nan"), "south")]
    return spark.createDataFrame(rows, "id string, age int, score double, region string")


def test_contract_rules(spark):
    rules = {r["rule_id"]: r for r in ct.validate_batch(batch(spark), CONTRACT).collect()}
    failed = {k for k, r in rules.items() if not r["passed"]}
    assert failed == {"id.unique", "age.null_rate", "age.range", "score.null_rate", "region.allowed_values"}
    assert rules["id.unique"]["observed"] == "2" and rules["score.null_rate"]["observed"] == "0.666667"
    assert rules["region.allowed_values"]["observed"] == "1"  # the values themselves are rows of their own
    assert [tuple(r) for r in ct.unexpected_values(batch(spark), CONTRACT).collect()] == [("region", "unknown-region", 1)]
    missing = {r["rule_id"]: r for r in ct.validate_batch(batch(spark).drop("age"), CONTRACT).collect()}
    assert not missing["schema.required_columns"]["passed"] and "age.range" not in missing
    gate = ct.gate(ct.both_engines(batch(spark), CONTRACT)).first()
    assert gate["decision"] == "BLOCK" and "gx.age.expect_column_values_to_be_between" in gate["failed_rule_ids"]
    empty = {r["rule_id"]: r["passed"] for r in ct.validate_batch(batch(spark).limit(0), CONTRACT).collect()}
    assert not empty["table.minimum_rows"] and not empty["age.null_rate"]


def test_row_rules_split_and_fingerprint(spark):
    found = ct.violation_rows(batch(spark).withColumn("n", F.monotonically_increasing_id()), CONTRACT, "age").collect()
    assert sorted(r["rule_id"] for r in found) == ["age.null", "age.range", "region.allowed_values"]
    valid, held = ct.split_rows(batch(spark), CONTRACT)
    assert valid.count() == 1 and held.count() == 2
    prints = {ct.fingerprint(d).first()["fingerprint"] for d in (batch(spark), batch(spark).repartition(5), batch(spark).orderBy(F.desc("age")))}
    assert len(prints) == 1 and ct.fingerprint(batch(spark).limit(2)).first()["fingerprint"] not in prints


def test_undefined_values_and_nulls(spark):
    df = spark.createDataFrame([(None, "12x", "NaN")], "x double, t string, n string")
    row = df.select(
        st.ratio_status(F.col("x")).alias("open"), st.ratio_status(F.col("x"), strict=True).alias("closed"),
        s.clip("x", 0, 1).alias("clip"), s.number("t").alias("t"), s.number("n").alias("n"),
        st.worst([], st.FAIRNESS_LEVELS).alias("none"),
    ).first()
    assert tuple(row) == ("PASS", "FAIL", None, None, None, "PASS")


def test_fairness_literals(spark):
    y = [0, 0, 1, 0, 1, 0, 0, 1, 0, 1, 0, 1]
    p = [0.1, 0.2, 0.8, 0.3, 0.7, 0.2, 0.7, 0.8, 0.6, 0.9, 0.7, 0.8]
    rows = [("current", "group_a" if i < 6 else "group_c", a, b) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "batch string, g string, default_30d int, risk_probability double")
    row = fair.assess(fair.group_metrics(fair.group_counts(df, ["g"]))).first()
    assert row["status"] == "FAIL" and row["demographic_parity_ratio"] < 0.80
    cells = [("female", "a"), ("female", "a"), ("female", "c"), ("female", "c"), ("male", "a"), ("male", "a"), ("male", "c"), ("male", "c")]
    scores = [0.1, 0.8, 0.9, 0.9, 0.1, 0.8, 0.1, 0.8]
    rows = [("current", a, b, i % 2, q) for i, ((a, b), q) in enumerate(zip(cells, scores))]
    df = spark.createDataFrame(rows, "batch string, sex string, grp string, default_30d int, risk_probability double")
    df = s.intersection_key(df, ["sex", "grp"], "both")
    counts = fair.group_counts(df, ["both"])
    assert fair.expanded_assess(fair.expanded_group_metrics(counts, 2)).first()["status"] == "FAIL"
    unsupported = fair.expanded_assess(fair.expanded_group_metrics(counts, 3))
    assert unsupported.first()["status"] == "UNSUPPORTED"
    with pytest.raises(Exception, match="eligible_groups = 1|eligible_groups = 0"):
        fair.require_support(unsupported).collect()
    with pytest.raises(ValueError):
        s.intersection_key(df, ["absent"], "x")


def versions(spark, scores, ids="ABCD", labels=(0, 1, 1, 1)):
    rows = [(i, y, x, p) for i, y, x, p in zip(ids, labels, [0.1, 0.2, None, 0.8], scores)]
    return spark.createDataFrame(rows, "application_id string, default_30d int, device_risk_score double, risk_probability double")


def test_impact(spark):
    before, after = versions(spark, [0.2, 0.4, 0.6, 0.8]), versions(spark, [0.1, 0.3, 0.4, 0.7])
    one = impact.scenario_metrics(before.withColumn("scenario", F.lit("healthy"))).first()
    assert (one["approval_count"], one["approval_rate"], one["approved_default_rate"], one["device_risk_null_rate"]) == (2, 0.5, 0.5, 0.25)
    row = impact.compare(before, after).first()
    assert (row["newly_approved_count"], row["newly_rejected_count"], row["decision_flip_count"]) == (1, 0, 1)
    assert row["approval_rate_change"] == pytest.approx(0.25) and row["approved_default_rate_change"] == pytest.approx(1 / 6)
    assert row["newly_approved_default_rate"] == 1.0
    with pytest.raises(Exception, match="one_sided = 2"):
        impact.compare(before, versions(spark, [0.1, 0.3, 0.4, 0.7], ids="ABCX")).collect()
    with pytest.raises(Exception, match="changed_labels = 1"):
        impact.compare(before, versions(spark, [0.1, 0.3, 0.4, 0.7], labels=(1, 1, 1, 1))).collect()
    check = impact.population_check(before, before.unionByName(before.limit(1))).first()
    assert check["repeated_keys"] == 1 and not check["same_population"]


def test_factorial_and_group_shift(spark):
    table = spark.createDataFrame(list(zip(whatif.SCENARIOS, [10.0, 12.0, 13.0, 18.0])), "scenario string, m double")
    row = whatif.factorial_table(table, ["m"]).first()
    assert (row["semantic_main_effect"], row["missingness_main_effect"], row["interaction_effect"]) == (3.5, 4.5, 3.0)
    df = spark.createDataFrame([("a", 0.4), ("c", 0.4), ("c", None)], "g string, x double")
    moved = [r["x"] for r in whatif.shift(df, [whatif.Shift("x", 0.12)], where=F.col("g") == "c").collect()]
    assert moved[0] == 0.4 and moved[1] == pytest.approx(0.52) and moved[2] is None
    with pytest.raises(Exception, match="0 rows match"):
        whatif.require_group(df, F.col("g") == "z").collect()


def test_promotion(spark):
    rows = [
        ("healthy", "PASS", 0.80, 0.65, 0.15, "STABLE", "PASS", 7, 7), ("drift", "PASS", 0.80, 0.65, 0.15, "CRITICAL", "PASS", 7, 7),
        ("fairness", "PASS", 0.80, 0.65, 0.15, "STABLE", "FAIL", 7, 7), ("weak", "PASS", 0.74, 0.59, 0.21, "STABLE", "PASS", 7, 6),
    ]
    evidence = spark.createDataFrame(
        rows, "model_version string, quality_decision string, roc_auc double, pr_auc double, brier_score double, drift_status string, fairness_status string, total_artifacts int, valid_artifacts int"
    )
    gates = ev.gates(evidence)
    failed = {(r["model_version"], r["name"]) for r in gates.where("NOT passed").collect()}
    assert failed == {("drift", "drift"), ("fairness", "fairness"), ("weak", "performance"), ("weak", "calibration"), ("weak", "evidence_integrity")}
    stages = {r["model_version"]: r["target_stage"] for r in ev.apply_decisions(ev.decide(gates)).collect()}
    assert stages == {"healthy": "STAGING", "drift": "REJECTED", "fairness": "REJECTED", "weak": "REJECTED"}


def test_registry_and_rollup(spark):
    history = [("m", 1, "REGISTERED"), ("m", 2, "CANDIDATE"), ("m", 3, "PRODUCTION"), ("n", 4, "STAGING")]
    df = spark.createDataFrame(history, "model string, seq long, stage string")
    for width in (1, 100):
        audit = ev.transitions_audit(df, ["model"], ["seq"], F.floor(F.col("seq") / width)).orderBy("seq").collect()
        assert [r["is_legal"] for r in audit] == [True, True, False, False]
    tasks = spark.createDataFrame(
        [("r", "a", [], "FAIL"), ("r", "b", ["a"], "PASS"), ("r", "c", ["b"], "PASS"), ("s", "a", [], "PASS")],
        "run_id string, task_id string, depends_on array<string>, own_status string",
    )
    rolled = ev.run_rollup(tasks)
    assert {(r["run_id"], r["task_id"]): r["status"] for r in rolled.collect()} == {
        ("r", "a"): "FAIL", ("r", "b"): "SKIPPED", ("r", "c"): "SKIPPED", ("s", "a"): "PASS",
    }
    assert {r["run_id"]: r["run_status"] for r in ev.run_status(rolled).collect()} == {"r": "FAIL", "s": "PASS"}


def test_rollout(spark):
    rows = [("good", i, 200, 0.0, 40.0, 0.0) for i in range(1, 6)] + [("bad", 1, 200, 0.0, 40.0, 0.0), ("bad", 2, 500, 0.08, 450.0, 0.12), ("bad", 3, 500, 0.0, 40.0, 0.0)]
    snaps = spark.createDataFrame(rows, "version string, seq int, request_count long, error_rate double, p95_latency_ms double, mean_risk_delta double")
    snaps = snaps.withColumn("phase", F.when(F.col("seq") == 1, "shadow").otherwise("canary"))
    done = release.replay_rollout(release.checkpoint_results(release.release_gates(snaps, ["version", "seq"], "phase"), ["version", "seq"]))
    found = {r["version"]: r for r in done.collect()}
    assert found["good"]["stage"] == "PRODUCTION" and found["good"]["completed_shares"] == 4
    assert found["bad"]["stage"] == "STAGING" and found["bad"]["canary_share"] == 0.0
    assert found["bad"]["rollback_reason"] == "release gates failed: error_rate, mean_risk_delta, p95_latency_ms"
    keys = spark.range(4000).select(F.concat(F.lit("request-"), "id").alias("k"))
    share = keys.agg(F.avg((s.route("k", 0.25) == "candidate").cast("double"))).first()[0]
    assert 0.22 <= share <= 0.28
    plans = spark.createDataFrame([([0.1, 1.0],), ([0.5, 0.2, 1.0],), ([0.5],), ([0.0, 1.0],)], "p array<double>")
    assert [r[0] for r in plans.select(release.plan_valid(F.col("p"))).collect()] == [True, False, False, False]


def test_incident_sla_and_timeline(spark):
    rows = [("i", "e1", 1, "START", "2026-01-01T00:00:00+00:00"), ("i", "e2", 2, "END", "2026-01-01T03:04:00Z"), ("j", "e1", 1, "START", "2026-01-01T00:00:00")]
    df = spark.createDataFrame(rows, "incident_id string, event_id string, seq long, event_type string, text string")
    events = df.withColumn("occurred_at", s.parse_timestamp("text"))
    times = incidents.event_times(events, ["START", "END"])
    sla = incidents.sla(times, [("slow", "START", "END", 240), ("fast", "START", "END", 100)])
    found = {(r["incident_id"], r["name"]): (r["observed_minutes"], r["status"]) for r in sla.collect()}
    assert found[("i", "slow")] == (184, "PASS") and found[("i", "fast")] == (184, "FAIL") and found[("j", "slow")][1] == "MISSING"
    checks = {r["incident_id"]: r for r in incidents.timeline_checks(events).collect()}
    assert checks["i"]["valid"] and checks["j"]["bad_timestamps"] == 1
    late = incidents.timeline_checks(events.withColumn("seq", -F.col("seq"))).where("incident_id = 'i'").first()
    assert late["steps_back"] == 1 and not late["valid"]


def test_manifest_takes_a_folder_as_one_artifact(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "table.parquet"))
    (tmp_path / "file.parquet").write_bytes(b"abc")
    (tmp_path / "other.txt").write_bytes(b"abc")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.parquet").write_bytes(b"abc")
    parts = sorted(p for p in (tmp_path / "table.parquet").iterdir() if p.name.startswith("part"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    whole = sha("\n".join(f"{p.name} {sha(p.read_bytes())}" for p in parts).encode())
    found = {r["name"]: (r["sha256"], r["size_bytes"]) for r in ev.manifest(spark, str(tmp_path), "*.parquet").collect()}
    assert found == {"file.parquet": (sha(b"abc"), 3), "table.parquet": (whole, sum(p.stat().st_size for p in parts))} and len(parts) == 3
    named = ev.manifest(spark, [str(tmp_path / "file.parquet"), str(tmp_path / "other.txt")]).collect()
    assert {r["name"]: r["sha256"] for r in named} == {"file.parquet": sha(b"abc"), "other.txt": sha(b"abc")}
    fresh = ev.manifest(spark, str(tmp_path), "*.parquet")
    recorded = spark.createDataFrame(fresh.collect(), fresh.schema)
    (parts[1].parent / f".{parts[1].name}.crc").unlink()
    parts[1].write_bytes(parts[1].read_bytes()[::-1])
    changed = ev.verify_manifest(recorded, ev.manifest(spark, str(tmp_path), "*.parquet")).collect()
    assert {r["name"]: r["state"] for r in changed} == {"file.parquet": "OK", "table.parquet": "HASH"}


def test_a_file_larger_than_a_value_is_hashed(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as out:  # sparse: it takes no disk
        out.truncate(2**31 + 1)
    with open(tmp_path / "large.bin", "rb") as made:
        wanted = hashlib.file_digest(made, "sha256").hexdigest()
    found = files.file_hashes(spark, str(tmp_path), "*.bin").collect()
    assert [(r["sha256"], r["size_bytes"]) for r in found] == [(wanted, 2**31 + 1)]


def test_verifying_a_manifest_holds_no_file(spark, tmp_path):
    for name in ("orders", "lineitem", "region", "nation", "part"):
        (tmp_path / f"{name}.parquet").write_bytes(name.encode() * 1000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # Spark refuses to hold a longer file as a value
    try:
        found = {r["name"]: r["state"] for r in release_plans.j10(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == {
        "orders.parquet": "OK", "lineitem.parquet": "OK", "part.parquet": "OK", "region.parquet": "SIZE", "nation.parquet": "HASH", "ghost.parquet": "MISSING",
    }


def test_a_manifest_reads_stores_that_only_spark_reads(spark, tmp_path):
    made = {"plain.parquet": b"abc", "a b%20#?[x]y.parquet": b"a" * 100_000, "bom.gz.parquet": b"\xef\xbb\xbfabc\r\n"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    settings = {"fs.viewfs.mounttable.wardline.link./in": f"file://{tmp_path}", "spark.sql.sources.binaryFile.maxLength": "10"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = ev.manifest(spark, "viewfs://wardline/in", "*.parquet").collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert {r["name"]: (r["sha256"], r["size_bytes"]) for r in found} == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in made.items()}
    assert all(r["path"].startswith("viewfs://wardline/in/") for r in found)
