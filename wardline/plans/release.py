"""Evidence, release, telemetry, incident and acceptance queries (families J, K, L, M, N)."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from wardline.operators import impact, incidents, telemetry
from wardline.operators import evidence as ev
from wardline.operators import release as rel
from wardline.plans import bridge as b
from wardline.plans import drifts, fair
from wardline.plans.quality import u01
from wardline.plans.registry import query
from wardline.plans.scoring import FLAT, auc_sql
from wardline.sources import files
from wardline.sources.tables import stored

# ------------------------------------------------------------------ J
# One evidence row per model version; versions are the order priorities.

POLICY = ev.PromotionPolicy(minimum_roc_auc=0.49, minimum_pr_auc=0.31, maximum_brier_score=0.28, minimum_artifacts=5)
#: What a candidate's batch must look like: the application contract with the tables' own ranges.
_LIMITS = {"annual_income": (0, 1_000_000), "delinquencies_2y": (0, 7), "inquiries_6m": (0, 50), "credit_utilization": (0, 1), "credit_history_years": (0, 45)}
PROMOTION_CONTRACT = dataclasses.replace(
    b.CONTRACT, minimum_rows=5,
    columns=tuple(
        dataclasses.replace(
            r, **({"min": _LIMITS[r.name][0], "max": _LIMITS[r.name][1]} if r.name in _LIMITS else {}),
            **({"allowed_values": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")} if r.name == "region" else {}),
        )
        for r in b.CONTRACT.columns
    ),
)
GOVERNED, GROUP_SIZE = ("synthetic_demographic_group", "sex"), 100


def quality_sql(rows: str, key: str, contract=PROMOTION_CONTRACT) -> str:
    """Whether every rule of both engines holds, per key."""
    ok = [f"count(*) >= {contract.minimum_rows}"]
    for r in contract.columns:
        if r.max_null_rate is not None:
            ok += [f"avg(({r.name} IS NULL)::INT) <= {r.max_null_rate}::DOUBLE + 1e-12", f"count({r.name})::DOUBLE / count(*) >= 1.0 - {r.max_null_rate}::DOUBLE"]
        if r.unique:
            ok.append(f"count(DISTINCT {r.name}) = count({r.name}) AND count(*) - count({r.name}) < 2")
        if r.has_range:
            ok.append(f"count(*) FILTER (WHERE {r.name} < {float(r.min)}::DOUBLE OR {r.name} > {float(r.max)}::DOUBLE) = 0")
        if r.allowed_values:
            ok.append(f"count(*) FILTER (WHERE {r.name} NOT IN ({', '.join(repr(v) for v in r.allowed_values)})) = 0")
    return f"SELECT {key}, CASE WHEN {' AND '.join(ok)} THEN 'PASS' ELSE 'BLOCK' END AS quality_decision FROM {rows} GROUP BY 1"


def evidence_sql(key: str, sensitive, group_size: int) -> str:
    """CTEs from ``keyed``: q, auc, flat, drift, fs by key. Cut points are per key: the key is put before the feature's name."""
    long = " UNION ALL ".join(f"SELECT {key} || '~{c}' AS feature, batch, {c}::DOUBLE AS value FROM keyed" for c in drifts.FEATURES)
    report = drifts._REPORT_CTE.split(drifts._BASE, 1)[1].lstrip(",")
    groups = " UNION ALL ".join(f"SELECT {key} AS batch, '{c}' AS sensitive_feature, coalesce({c}, 'nan') AS grp, risk_probability AS p, default_30d AS y FROM now" for c in sensitive)
    fair_sql = fair._F12.split("f8 AS (", 1)[1].replace(f">= {fair.MIN} ", f">= {group_size} ").replace("FROM long", "FROM people")
    return f"""now AS (SELECT * FROM keyed WHERE batch = 'current'), q AS ({quality_sql('now', key)}), {auc_sql('now', key)}, {FLAT.format(by=key, rows='now')},
 long AS ({long}), {report}, drift AS (SELECT split_part(feature, '~', 1) AS {key}, CASE WHEN bool_or(status = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'STABLE' END AS drift_status FROM rep GROUP BY 1),
 people AS ({groups}), f8 AS ({fair_sql}, fs AS (SELECT batch AS {key}, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS fairness_status FROM f12 GROUP BY 1)"""


_EV = f"""WITH {b.CANDIDATES_SQL}, {evidence_sql('model_version', GOVERNED, GROUP_SIZE)},
 art AS (SELECT model_version, region, CASE WHEN model_version = '2-HIGH' AND region = 'ASIA' THEN '' ELSE sha256(model_version || region) END AS sha256, count(*) AS size_bytes FROM keyed GROUP BY 1, 2),
 ac AS (SELECT model_version, count(*) AS total_artifacts, count(*) FILTER (WHERE length(sha256) > 0 AND size_bytes > 0) AS valid_artifacts FROM art GROUP BY 1),
 ev AS (SELECT q.model_version, quality_decision, roc_auc, pr_auc, brier_score, drift_status, fairness_status, total_artifacts, valid_artifacts
   FROM q JOIN fs USING (model_version) JOIN ac USING (model_version) JOIN drift USING (model_version) JOIN auc ON auc.k = q.model_version JOIN flat ON flat.k = q.model_version)"""
_GATES = _EV + """, g AS (
 SELECT model_version, 0 AS gate_position, 'data_quality' AS name, quality_decision = 'PASS' AS passed, 'PASS' AS expected FROM ev
 UNION ALL SELECT model_version, 1, 'performance', roc_auc >= 0.49 AND pr_auc >= 0.31, 'roc_auc>=0.49,pr_auc>=0.31' FROM ev
 UNION ALL SELECT model_version, 2, 'calibration', brier_score <= 0.28, '<=0.28' FROM ev
 UNION ALL SELECT model_version, 3, 'drift', drift_status <> 'CRITICAL', 'not in ["CRITICAL"]' FROM ev
 UNION ALL SELECT model_version, 4, 'fairness', fairness_status <> 'FAIL', 'not in ["FAIL"]' FROM ev
 UNION ALL SELECT model_version, 5, 'evidence_integrity', valid_artifacts >= 5 AND valid_artifacts = total_artifacts, '>=5, all hashed' FROM ev),
 gate AS (SELECT model_version, gate_position, name, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, passed, true AS blocking, name || CASE WHEN passed THEN ' meets ' ELSE ' misses ' END || expected AS reason FROM g),
 dec0 AS (SELECT model_version, CASE WHEN bool_and(passed) THEN 'APPROVE' ELSE 'REJECT' END AS decision, coalesce(string_agg(name || ': ' || reason, '; ' ORDER BY gate_position) FILTER (WHERE NOT passed), '') AS blocking_reasons,
   string_agg(name || '=' || status, ',' ORDER BY gate_position) AS gates FROM gate GROUP BY 1),
 dec AS (SELECT model_version, decision, blocking_reasons, substr(sha256(model_version || '|' || decision || '|STAGING|promotion_policy|1.0.0|' || gates), 1, 20) AS decision_id FROM dec0)"""


def artifacts(rows):
    sha = F.when((F.col("model_version") == "2-HIGH") & (F.col("region") == "ASIA"), "").otherwise(F.sha2(F.concat("model_version", "region"), 256))
    return rows.groupBy("model_version", "region").agg(F.count(F.lit(1)).alias("size_bytes")).withColumn("sha256", sha)


def candidates(spark, d, keep=False):
    """``keep`` stores the joined applications once; all parts of the evidence then read them instead of joining again."""
    rows = b.candidates(stored(b.apps(spark, d), "apps") if keep else b.apps(spark, d))
    return ev.Candidates(rows, PROMOTION_CONTRACT, tuple(b.MONITORED), GOVERNED, minimum_group_size=GROUP_SIZE, artifacts=artifacts(rows))


def gates(spark, d):
    return ev.gates(candidates(spark, d, keep=True).evidence(), POLICY)


def _gate(name):
    def run(spark, d):
        found = ev.gates(candidates(spark, d).part(ev.GATE_PARTS[name]), POLICY, only=(name,))
        return found.select("model_version", "name", "status", "passed", "blocking", "reason")

    return run


for _id, _name in (
    ("j1_gate_data_quality", "data_quality"), ("j2_gate_performance", "performance"), ("j3_gate_calibration", "calibration"),
    ("j4_gate_drift", "drift"), ("j5_gate_fairness", "fairness"), ("j6_gate_evidence_integrity", "evidence_integrity"),
):
    query(_id, _GATES + f" SELECT model_version, name, status, passed, blocking, reason FROM gate WHERE name = '{_name}'")(_gate(_name))


@query("j7_decisions", _GATES + " SELECT model_version, decision, blocking_reasons FROM dec")
def j7(spark, d):
    found = ev.decide(gates(spark, d), POLICY)
    return found.select("model_version", "decision", F.array_join("blocking_reasons", "; ").alias("blocking_reasons"))


@query("j8_decision_id", _GATES + " SELECT model_version, decision_id FROM dec")
def j8(spark, d):
    return ev.decide(gates(spark, d), POLICY).select("model_version", "decision_id")


@query("j9_manifest")
def j9(spark, d):
    return ev.manifest(spark, d, "*.parquet").select("name", "sha256", "size_bytes")


_FILES = [f"{t}.parquet" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()]
_STATES = {"nation.parquet": "HASH", "region.parquet": "SIZE", "ghost.parquet": "MISSING"}
_STATE_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, '{_STATES.get(n, 'OK')}' AS state FROM region GROUP BY 1" for n in [*_FILES, "ghost.parquet"])


@query("j10_verify_manifest", _STATE_SQL)
def j10(spark, d):
    fresh = ev.manifest(spark, d, "*.parquet")
    name = F.col("name")
    edited = fresh.withColumns(
        {
            "sha256": F.when(name == "nation.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")),
            "size_bytes": F.when(name == "region.parquet", F.col("size_bytes") + 1).otherwise(F.col("size_bytes")),
        }
    )
    ghost = fresh.where(name == "orders.parquet").withColumns(
        {"name": F.lit("ghost.parquet"), "path": F.concat("path", F.lit(".ghost"))}
    )
    return ev.verify_manifest(edited.unionByName(ghost), fresh).select("name", "state")


_STAGE_OF = {"signup": "REGISTERED", "view": "CANDIDATE", "click": "STAGING", "purchase": "SHADOW", "error": "CANARY"}
_STAGE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGE_OF.items()) + " END"
_EDGES = ", ".join(f"'{a}>{t}'" for a, ts in ev.STAGE_EDGES.items() for t in ts)
_HIST = f"""WITH hist AS (SELECT user_id AS model, event_id AS seq, ts, {_STAGE_CASE} AS stage, lag({_STAGE_CASE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_stage FROM events)"""


def history(spark, d):
    rows = b.table(spark, d, "events")
    stage = F.create_map(*[F.lit(x) for kv in _STAGE_OF.items() for x in kv])[F.col("event_type")]
    return rows.select(F.col("user_id").alias("model"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), stage.alias("stage"), "event_type")


@query("j11_stage_transitions", _HIST + f" SELECT model, seq, stage, previous_stage, CASE WHEN previous_stage IS NULL THEN stage = 'REGISTERED' ELSE previous_stage || '>' || stage IN ({_EDGES}) END AS is_legal FROM hist")
def j11(spark, d):
    found = ev.transitions_audit(history(spark, d), ["model"], ["ts", "seq"], F.date_trunc("day", "ts"))
    return found.select("model", "seq", "stage", "previous_stage", "is_legal")


@query("j12_current_stage", _HIST + " SELECT model, arg_max(stage, (ts, seq)) AS stage, arg_max('d' || seq, (ts, seq)) FILTER (WHERE stage = 'CANARY') AS last_decision_id, count(*) AS event_count FROM hist GROUP BY 1")
def j12(spark, d):
    rows = history(spark, d).withColumn("decision_id", F.when(F.col("stage") == "CANARY", F.concat(F.lit("d"), F.col("seq").cast("string"))))
    return ev.current_stage(rows, ["model"], ["ts", "seq"], decision="decision_id")


@query("j13_first_registration", _HIST + " SELECT model, min(seq) AS seq, count(*) AS attempts FROM hist WHERE stage = 'REGISTERED' GROUP BY 1")
def j13(spark, d):
    return ev.first_registration(history(spark, d).where("stage = 'REGISTERED'"), ["model"], ["ts", "seq"], ["seq"])


_EVENTS2 = _GATES + """, ap AS (SELECT *, CASE WHEN decision = 'APPROVE' THEN 'STAGING' ELSE 'REJECTED' END AS target_stage FROM dec),
 e2 AS (SELECT model_version, 0 AS event_order, 'GOVERNANCE_EVALUATED' AS event_type, decision, decision_id, target_stage FROM ap UNION ALL SELECT model_version, 1, 'REGISTRY_TRANSITION', decision, decision_id, target_stage FROM ap)"""


def decision_events(spark, d):
    return ev.decision_events(ev.apply_decisions(ev.decide(gates(spark, d), POLICY), POLICY))


@query("j14_decision_events", _EVENTS2 + """ SELECT model_version, event_order, event_type, '{"decision":"' || decision || '","decision_id":"' || decision_id || '","model_version":"' || model_version || '","target_stage":"' || target_stage || '"}' AS payload FROM e2""")
def j14(spark, d):
    return decision_events(spark, d)


@query("j15_audit_counts", _EVENTS2 + " SELECT event_type, count(*) AS event_count, count(*) >= 5 AS enough FROM e2 GROUP BY 1")
def j15(spark, d):
    return ev.event_counts(decision_events(spark, d), minimum=5)


@query(
    "j16_scenario_evidence",
    f"WITH {b.SCENARIOS_SQL}, {evidence_sql('scenario', [b.INTERSECTION], GROUP_SIZE)} SELECT q.scenario, quality_decision, roc_auc, pr_auc, brier_score, drift_status, fairness_status"
    " FROM q JOIN fs USING (scenario) JOIN drift USING (scenario) JOIN auc ON auc.k = q.scenario JOIN flat ON flat.k = q.scenario",
    ["roc_auc", "pr_auc", "brier_score"],
)
def j16(spark, d):
    """Three scenarios over the same applications, stored once and judged together."""
    rows = b.scenarios(stored(b.apps(spark, d), "apps"))
    found = ev.Candidates(rows, PROMOTION_CONTRACT, tuple(b.MONITORED), (b.INTERSECTION,), ("scenario",), GROUP_SIZE)
    return found.evidence(("quality", "performance", "drift", "fairness")).drop("critical_features", "warning_features")


# ------------------------------------------------------------------ K
# Requests are events: five versions, five checkpoints of six days.

_REQ = """WITH req AS (SELECT 'v' || user_id % 5 AS version, 1 + (day(ts) - 1) // 6 AS seq, event_type = 'error' AND value > 95 + user_id % 5 AS is_error, value AS latency, (value - 49) / 400 AS delta FROM events),
 snap AS (SELECT version, seq, count(*) AS request_count, avg(is_error::INT) AS error_rate, quantile_cont(latency, 0.95::DOUBLE) AS p95_latency_ms, avg(delta) AS mean_risk_delta FROM req GROUP BY 1, 2),
 lim AS (SELECT *, CASE WHEN seq = 1 THEN 50 ELSE 100 END AS ln, CASE WHEN seq = 1 THEN 0.02 ELSE 0.03 END::DOUBLE AS le, CASE WHEN seq = 1 THEN 250 ELSE 300 END AS lp, CASE WHEN seq = 1 THEN 0.05 ELSE 0.06 END::DOUBLE AS ld FROM snap),
 gt AS (SELECT version, seq, 'minimum_request_count' AS name, request_count >= ln AS passed, request_count::DOUBLE AS observed, ln::DOUBLE AS expected FROM lim UNION ALL SELECT version, seq, 'error_rate', error_rate <= le, error_rate, le FROM lim
   UNION ALL SELECT version, seq, 'p95_latency_ms', p95_latency_ms <= lp, p95_latency_ms, lp FROM lim UNION ALL SELECT version, seq, 'mean_risk_delta', abs(mean_risk_delta) <= ld, abs(mean_risk_delta), ld FROM lim),
 cp AS (SELECT version, seq, bool_and(passed) AS passed, CASE WHEN bool_and(passed) THEN 'manual rollback' ELSE 'release gates failed: ' || string_agg(name, ', ' ORDER BY name) FILTER (WHERE NOT passed) END AS reason FROM gt GROUP BY 1, 2),
 fa AS (SELECT version, min(seq) FILTER (WHERE NOT passed) AS fail, max(seq) AS seen, arg_min(reason, seq) FILTER (WHERE NOT passed) AS reason FROM cp GROUP BY 1),
 ro AS (SELECT version, fail, coalesce(fail - 1, seen) AS done, reason FROM fa),
 outc AS (SELECT version, CASE WHEN fail IS NOT NULL THEN 'STAGING' WHEN done >= 5 THEN 'PRODUCTION' ELSE 'CANARY' END AS stage, CASE WHEN fail IS NOT NULL THEN 0.0 WHEN done >= 5 THEN 1.0 ELSE ([0.1, 0.25, 0.5, 1.0])[greatest(done, 1)] END::DOUBLE AS canary_share,
   greatest(done - 1, 0)::INTEGER AS completed_shares, CASE WHEN fail IS NOT NULL THEN reason END AS rollback_reason FROM ro)"""


def requests(spark, d):
    n, v = F.col("user_id") % 5, F.col("value")
    return b.table(spark, d, "events").select(
        F.concat(F.lit("v"), n.cast("string")).alias("version"),
        (1 + F.floor((F.dayofmonth("ts") - 1) / 6)).cast("bigint").alias("seq"),
        ((F.col("event_type") == "error") & (v > 95 + n)).alias("is_error"),
        v.alias("latency"),
        ((v - 49) / 400).alias("delta"),
    )


def snapshots(spark, d):
    return rel.health_snapshot(requests(spark, d), ["version", "seq"], is_error=F.col("is_error"), latency="latency", risk_delta=F.col("delta"))


@query("k1_health_snapshot", _REQ + " SELECT * FROM snap", ["error_rate", "p95_latency_ms", "mean_risk_delta"])
def k1(spark, d):
    return snapshots(spark, d)


@query("k2_shadow_score_difference", f"WITH {b.DRIFTED_SQL} SELECT max(abs(a.risk_probability - m.risk_probability)) AS max_abs_difference, avg(abs(a.risk_probability - m.risk_probability)) AS mean_abs_difference FROM apps a JOIN drifted m USING (application_id)", ["max_abs_difference", "mean_abs_difference"])
def k2(spark, d):
    rows = b.apps(spark, d)
    return impact.max_score_difference(rows, b.drifted(rows))


def release_gates(spark, d):
    staged = snapshots(spark, d).withColumn("phase", F.when(F.col("seq") == 1, "shadow").otherwise("canary"))
    return rel.release_gates(staged, ["version", "seq"], "phase")


@query("k3_release_gates", _REQ + " SELECT * FROM gt", ["observed", "expected"])
def k3(spark, d):
    return release_gates(spark, d)


@query("k4_rollback_reason", _REQ + " SELECT * FROM cp")
def k4(spark, d):
    return rel.checkpoint_results(release_gates(spark, d), ["version", "seq"])


@query("k5_rollout_replay", _REQ + " SELECT * FROM outc", ["canary_share"])
def k5(spark, d):
    return rel.replay_rollout(rel.checkpoint_results(release_gates(spark, d), ["version", "seq"]))


@query(
    "k6_rollout_plans",
    """SELECT l_orderkey AS plan, count(*) FILTER (WHERE s <= 0 OR s > 1) = 0 AND max(s) = 1 AND bool_and(p IS NULL OR p <= s) AND arg_max(s, n) = 1 AS plan_valid
    FROM (SELECT *, lag(s) OVER (PARTITION BY l_orderkey ORDER BY n) AS p FROM (SELECT l_orderkey, l_linenumber * 100 + l_suppkey % 97 AS n, max(l_quantity) / 50 AS s FROM lineitem GROUP BY 1, 2)) GROUP BY 1""",
)
def k6(spark, d):
    order = (F.col("l_linenumber") * 100 + F.col("l_suppkey") % 97).alias("n")
    steps = b.table(spark, d, "lineitem").groupBy("l_orderkey", order).agg((F.max("l_quantity") / 50).alias("s"))
    shares = F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"])
    plans = steps.groupBy(F.col("l_orderkey").alias("plan")).agg(shares.alias("shares"))
    return plans.select("plan", rel.plan_valid(F.col("shares")).alias("plan_valid"))


@query(
    "k7_routing_accuracy",
    f"""WITH s(share) AS (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)), o AS (SELECT share, count(*) AS n_keys, avg((share >= 1 OR {u01("event_id::VARCHAR")} < share)::INT) AS observed FROM events, s GROUP BY 1)
    SELECT *, abs(observed - share) <= 0.03 AS within FROM o""",
    ["share", "observed"],
)
def k7(spark, d):
    return rel.routing_accuracy(b.table(spark, d, "events"), "event_id")


# ------------------------------------------------------------------ L


def served(spark, d):
    return b.table(spark, d, "events").select(
        F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.col("event_type").alias("route"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("http_status"), (F.col("value") / 1000).alias("seconds"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


_SRV = "srv AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, event_type AS route, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS http_status, value / 1000 AS seconds, ts FROM events)"


def hist_sql(rows: str, keys: str, value: str, bounds) -> str:
    les = ", ".join(f"({x}::DOUBLE)" for x in bounds)
    return f"SELECT {keys}, le, count(*) FILTER (WHERE {value} <= le) AS bucket_count FROM {rows}, (VALUES {les}, ('Infinity'::DOUBLE)) t(le) GROUP BY {keys}, le"


@query("l1_request_counter", f"WITH {_SRV} SELECT method, route, http_status, count(*) AS total FROM srv GROUP BY 1, 2, 3")
def l1(spark, d):
    return telemetry.counters(served(spark, d), ["method", "route", "http_status"])


def finite(df):
    return df.withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query("l2_latency_histogram", f"WITH {_SRV} SELECT route, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, bucket_count FROM ({hist_sql('srv', 'route', 'seconds', telemetry.LATENCY_BUCKETS)})", ["le"])
def l2(spark, d):
    return finite(telemetry.histogram(served(spark, d), "seconds", telemetry.LATENCY_BUCKETS, ["route"]))


@query("l3_prediction_counter", f"WITH {b.APPS_SQL} SELECT (risk_probability >= 0.5)::INT::VARCHAR AS predicted_default, CASE WHEN risk_probability >= 0.5 THEN 'false' ELSE 'true' END AS approved, count(*) AS total FROM apps GROUP BY 1, 2")
def l3(spark, d):
    return telemetry.prediction_counter(b.apps(spark, d))


@query("l4_risk_histogram", f"WITH {b.APPS_SQL} SELECT batch, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, bucket_count FROM ({hist_sql('apps', 'batch', 'risk_probability', telemetry.RISK_BUCKETS)})", ["le"])
def l4(spark, d):
    return finite(telemetry.histogram(b.apps(spark, d), "risk_probability", telemetry.RISK_BUCKETS, ["batch"]))


@query("l5_request_rate", f"WITH {_SRV} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, route, count(*) AS request_count, count(*) / 60.0::DOUBLE AS per_second FROM srv GROUP BY 1, 2", ["per_second"])
def l5(spark, d):
    found = telemetry.request_rate(served(spark, d), "ts", ["route"])
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "route", "request_count", "per_second")


def quantile_sql(hist: str, keys: str, q: float) -> str:
    return f"""h AS ({hist}), r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(bucket_count) OVER w, 0) AS before, max(bucket_count) OVER (PARTITION BY {keys}) AS total FROM h WINDOW w AS (PARTITION BY {keys} ORDER BY le)),
    hit AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY le) AS rn FROM r WHERE total > 0 AND bucket_count >= total * {q}::DOUBLE),
    est AS (SELECT {keys}, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * coalesce((total * {q}::DOUBLE - before) / nullif(bucket_count - before, 0), 0) END AS estimate FROM hit WHERE rn = 1)"""


_SLIDE = "sl AS (SELECT route, seconds, date_trunc('minute', ts) - to_minutes(k::INT) AS ws FROM srv, range(0, 5) t(k))"


@query("l6_windowed_p95", f"WITH {_SRV}, {_SLIDE}, {quantile_sql(hist_sql('sl', 'ws, route', 'seconds', telemetry.LATENCY_BUCKETS), 'ws, route', 0.95)} SELECT strftime(ws, '%Y-%m-%d %H:%M') AS minute, route, estimate FROM est", ["estimate"])
def l6(spark, d):
    found = telemetry.windowed_quantile(served(spark, d), "ts", "seconds", telemetry.LATENCY_BUCKETS, 0.95, ["route"])
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "route", "estimate")


@query(
    "l7_windowed_median_risk",
    f"WITH {b.APPS_SQL}, {quantile_sql(hist_sql('apps', 'order_date', 'risk_probability', telemetry.RISK_BUCKETS), 'order_date', 0.5)} SELECT strftime(order_date, '%Y-%m-%d') AS day, estimate FROM est",
    ["estimate"],
)
def l7(spark, d):
    rows = b.apps(spark, d).withColumn("ts", F.col("order_date").cast("timestamp"))
    found = telemetry.windowed_quantile(rows, "ts", "risk_probability", telemetry.RISK_BUCKETS, 0.5, width="1 day", slide=None)
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "estimate")


_GAUGES = ", ".join(f"('{s}')" for s in telemetry.STAGES)


@query("l8_stage_gauge", _HIST + f", cur AS (SELECT model, arg_max(stage, (ts, seq)) AS stage FROM hist GROUP BY 1), g(gauge_stage) AS (VALUES {_GAUGES}) SELECT model, gauge_stage, (stage = gauge_stage)::INT::DOUBLE AS gauge_value FROM cur, g", ["gauge_value"])
def l8(spark, d):
    return telemetry.stage_gauge(ev.current_stage(history(spark, d), ["model"], ["ts", "seq"]), ["model"])


@query("l9_rollback_events", "SELECT count(*) AS rollback_events FROM events WHERE event_type = 'error' AND value > 100")
def l9(spark, d):
    bad = (F.col("event_type") == "error") & (F.col("value") > 100)
    rows = b.table(spark, d, "events").select(F.when(bad, "RELEASE_ROLLED_BACK").otherwise("SHADOW_EVALUATED").alias("event_type"))
    return telemetry.rollback_events(rows)


# ------------------------------------------------------------------ M

_TYPE_OF = {"signup": "INCIDENT_STARTED", "view": "INCIDENT_DETECTED", "click": "ALERT_CREATED", "purchase": "GOVERNANCE_BLOCKED", "error": "TRIAGE_STARTED"}
_TYPES = [*_TYPE_OF.values(), "ROOT_CAUSE_COMPLETED"]
_TYPE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPE_OF.items()) + " END"
_INC = f"inc AS (SELECT user_id AS incident_id, event_id, event_id % 977 AS id2, ts AS occurred_at, {_TYPE_CASE} AS event_type FROM events)"
_TIMES = "tm AS (SELECT incident_id, " + ", ".join(f"min(occurred_at) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES) + " FROM inc GROUP BY 1)"
_SLA = "sla AS (" + " UNION ALL ".join(
    f"SELECT incident_id, '{n}' AS name, '{s}' AS start_event, '{e}' AS end_event, ((epoch_us({e}) - epoch_us({s})) / 60000000)::DOUBLE AS m, {t}::BIGINT AS target_minutes, CASE WHEN {s} IS NULL OR {e} IS NULL THEN 'MISSING' WHEN {e} < {s} THEN 'INVALID' WHEN trunc((epoch_us({e}) - epoch_us({s})) / 60000000.0) <= {t} THEN 'PASS' ELSE 'FAIL' END AS status FROM tm"
    for n, s, e, t in incidents.SLAS
) + ")"


def timeline(spark, d):
    kind = F.create_map(*[F.lit(x) for kv in _TYPE_OF.items() for x in kv])[F.col("event_type")]
    return b.table(spark, d, "events").select(
        F.col("user_id").alias("incident_id"), "event_id", (F.col("event_id") % 977).alias("id2"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("occurred_at"), kind.alias("event_type"),
    )


def times(spark, d):
    return incidents.event_times(timeline(spark, d), _TYPES)


@query(
    "m1_timeline_checks",
    f"""WITH {_INC}, st AS (SELECT *, lag(occurred_at) OVER (PARTITION BY incident_id ORDER BY (event_id * 7919) % 10007, event_id) AS p FROM inc), i AS (SELECT incident_id, count(*) FILTER (WHERE n > 1) AS repeated_ids FROM (SELECT incident_id, id2, count(*) AS n FROM inc GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT incident_id, count(*) FILTER (WHERE n > 1) AS repeated_types FROM (SELECT incident_id, event_type, count(*) AS n FROM inc GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT incident_id, count(*) AS event_count, 0::BIGINT AS bad_timestamps, count(*) FILTER (WHERE occurred_at < p) AS steps_back FROM st GROUP BY 1)
    SELECT *, repeated_ids + repeated_types + bad_timestamps + steps_back = 0 AS valid FROM s JOIN i USING (incident_id) JOIN t USING (incident_id)""",
)
def m1(spark, d):
    # A shuffled sequence number, so that steps back in time occur.
    seq = (F.col("event_id") * 7919) % 10007 * 100_000_000 + F.col("event_id")
    rows = timeline(spark, d).withColumn("seq", seq)
    return incidents.timeline_checks(rows, event_id="id2", block=F.floor(F.col("seq") / 100_000_000_000))


_REQUIRED = ["ALERT_CREATED", "ROOT_CAUSE_COMPLETED", "TRIAGE_STARTED"]


@query(
    "m2_required_types",
    f"WITH {_INC}, seen AS (SELECT incident_id, list_sort(list_filter({_REQUIRED}, lambda x: NOT list_contains(list(event_type), x))) AS gone FROM inc GROUP BY 1)"
    " SELECT incident_id, array_to_string(gone, ',') AS missing, len(gone) = 0 AS complete FROM seen",
)
def m2(spark, d):
    found = incidents.missing_types(timeline(spark, d), _REQUIRED)
    return found.withColumn("missing", F.array_join("missing", ","))


@query("m3_sla_metrics", f"WITH {_INC}, {_TIMES}, {_SLA} SELECT incident_id, name, start_event, end_event, trunc(m)::BIGINT AS observed_minutes, target_minutes, status FROM sla")
def m3(spark, d):
    return incidents.sla(times(spark, d)).drop("aligned")


@query("m4_all_slas_met", f"WITH {_INC}, {_TIMES}, {_SLA} SELECT incident_id, bool_and(status = 'PASS') AS all_slas_pass, count(*) FILTER (WHERE status <> 'PASS') AS not_passed FROM sla GROUP BY 1")
def m4(spark, d):
    return incidents.all_slas_met(incidents.sla(times(spark, d)))


@query(
    "m5_alerts",
    f"""WITH {_INC}, {_TIMES}, sg AS (SELECT incident_id, avg((event_type = 'TRIAGE_STARTED')::INT) AS observed FROM inc GROUP BY 1)
    SELECT incident_id, observed, 0.22::DOUBLE AS expected_max, epoch_us(ALERT_CREATED) AS created_us, 'HIGH' AS severity, 'OPEN' AS status, 'BLOCK_AND_QUARANTINE' AS action FROM sg JOIN tm USING (incident_id) WHERE observed > 0.22 AND ALERT_CREATED IS NOT NULL""",
    ["observed", "expected_max"],
)
def m5(spark, d):
    share = F.avg((F.col("event_type") == "TRIAGE_STARTED").cast("double")).alias("observed")
    signals = timeline(spark, d).groupBy("incident_id").agg(share).withColumn("expected_max", F.lit(0.22))
    found = incidents.alerts(signals, times(spark, d))
    return found.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


_CHECKS = [("alert_after_detection", "INCIDENT_DETECTED", "ALERT_CREATED"), ("block_after_detection", "INCIDENT_DETECTED", "GOVERNANCE_BLOCKED"), ("triage_after_detection", "INCIDENT_DETECTED", "TRIAGE_STARTED"), ("root_cause_after_triage", "TRIAGE_STARTED", "ROOT_CAUSE_COMPLETED")]


@query("m6_ordering_checks", f"WITH {_INC}, {_TIMES} " + " UNION ALL ".join(f"SELECT incident_id, '{n}' AS check_name, coalesce({a} <= {c}, false) AS passed FROM tm" for n, a, c in _CHECKS))
def m6(spark, d):
    return incidents.ordering_checks(times(spark, d), _CHECKS)


#: Range of an event's value, share of values outside that blocks, and share of errors that raises an alert.
_LO, _HI, _BLOCK_ABOVE, _SIGNAL_MAX = 0.0, 150.0, 0.1, 0.22


@query(
    "m7_incident_report",
    f"""WITH {_INC}, {_TIMES}, {_SLA},
    s AS (SELECT incident_id, bool_and(status = 'PASS') AS all_slas_pass, string_agg(name || ':' || status, ',' ORDER BY name) AS slas FROM sla GROUP BY 1),
    q AS (SELECT user_id AS incident_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS triages, count(*) FILTER (WHERE value IS NULL OR value < {_LO} OR value > {_HI}) AS bad_values FROM events GROUP BY 1),
    i AS (SELECT e.user_id AS incident_id, sum(CASE WHEN ts < TRIAGE_STARTED THEN value::DECIMAL(18, 2) ELSE 0 END)::DOUBLE AS sold_before, sum(CASE WHEN ts >= TRIAGE_STARTED THEN value::DECIMAL(18, 2) ELSE 0 END)::DOUBLE AS sold_after
          FROM events e JOIN tm ON tm.incident_id = e.user_id WHERE event_type = 'purchase' GROUP BY 1),
    o AS (SELECT incident_id, {" || ".join(f"CASE WHEN coalesce({a} <= {c}, false) THEN '' ELSE ',{n}' END" for n, a, c in sorted(_CHECKS))} AS failed FROM tm)
    SELECT incident_id, n_events, triages, bad_values, CASE WHEN bad_values > {_BLOCK_ABOVE} * n_events THEN 'BLOCK' ELSE 'ALLOW' END AS decision,
      CASE WHEN triages / n_events > {_SIGNAL_MAX} AND ALERT_CREATED IS NOT NULL THEN 'HIGH' END AS alert_severity, all_slas_pass, slas, sold_before, sold_after,
      failed = '' AS in_order, ltrim(failed, ',') AS failed_checks, ROOT_CAUSE_COMPLETED IS NOT NULL AND ALERT_CREATED IS NOT NULL AND TRIAGE_STARTED IS NOT NULL AS complete
    FROM q JOIN s USING (incident_id) JOIN tm USING (incident_id) JOIN o USING (incident_id) LEFT JOIN i USING (incident_id)""",
    ["sold_before", "sold_after"],
)
def m7(spark, d):
    raw = b.table(spark, d, "events").withColumnRenamed("user_id", "incident_id")
    bad = F.coalesce(~F.col("value").between(_LO, _HI), F.lit(True))
    quality = raw.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("triages"), F.count_if(bad).alias("bad_values")
    )
    quality = quality.withColumn("decision", F.when(F.col("bad_values") > _BLOCK_ABOVE * F.col("n_events"), "BLOCK").otherwise("ALLOW"))
    sold = raw.where("event_type = 'purchase'").join(times(spark, d).select("incident_id", "TRIAGE_STARTED"), "incident_id")
    amount, begun = F.col("value").cast("decimal(18,2)"), F.col("TRIAGE_STARTED")
    part = lambda when: F.sum(F.when(when, amount).otherwise(F.lit(0))).cast("double")
    impact = sold.groupBy("incident_id").agg(part(F.col("ts") < begun).alias("sold_before"), part(F.col("ts") >= begun).alias("sold_after"))
    signals = quality.select("incident_id", (F.col("triages") / F.col("n_events")).alias("observed"), F.lit(_SIGNAL_MAX).alias("expected_max"))
    response = incidents.response_parts(timeline(spark, d), signals, _TYPES, _REQUIRED, _CHECKS)
    report = incidents.incident_report({"quality": quality, "impact": impact, **response})
    named = F.array_join(F.transform("sla.metrics", lambda m: F.concat(m["name"], F.lit(":"), m["status"])), ",")
    return report.select(
        "incident_id", "quality.*", F.col("alert.severity").alias("alert_severity"), F.col("sla.all_met").alias("all_slas_pass"), named.alias("slas"),
        "impact.sold_before", "impact.sold_after", "root_cause.in_order", F.array_join("root_cause.failed_checks", ",").alias("failed_checks"), "timeline.complete",
    )


# ------------------------------------------------------------------ N

_ACC = [("approval_rate", 0.5, 0.9), ("null_rate", 0.0, 0.01), ("default_rate", None, 0.4), ("absent", 0.0, 1.0)]
_ACC_SQL = ", ".join(f"('{n}', {'NULL' if lo is None else lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in _ACC)


@query(
    "n1_acceptance_gates",
    f"""WITH {b.APPS_SQL}, mt AS (SELECT 'approval_rate' AS name, avg((risk_probability < 0.5)::INT) AS value FROM apps UNION ALL SELECT 'null_rate', avg((device_risk_score IS NULL)::INT) FROM apps UNION ALL SELECT 'default_rate', avg(default_30d) FROM apps), gt(name, minimum, maximum) AS (VALUES {_ACC_SQL})
    SELECT name, value, minimum, maximum, value IS NOT NULL AND coalesce(value >= minimum, true) AND coalesce(value <= maximum, true) AS passed FROM gt LEFT JOIN mt USING (name)""",
    ["value", "minimum", "maximum"],
)
def n1(spark, d):
    one = b.apps(spark, d).agg(
        F.avg((F.col("risk_probability") < 0.5).cast("double")).alias("approval_rate"),
        F.avg(F.col("device_risk_score").isNull().cast("double")).alias("null_rate"), F.avg(F.col("default_30d").cast("double")).alias("default_rate"),
    )
    values = one.unpivot([], ["approval_rate", "null_rate", "default_rate"], "name", "value")
    return ev.acceptance(values, spark.createDataFrame(_ACC, "name string, minimum double, maximum double"))


@query(
    "n2_evidence_complete",
    """WITH rec AS (SELECT DISTINCT lang || '/' || source AS name, CASE WHEN lang = 'en' THEN 'short' ELSE sha256(lang || source) END AS sha256 FROM documents), ex AS (SELECT DISTINCT lang || '/' || source AS name FROM documents WHERE source <> 'web' UNION SELECT 'ghost/' || r_name FROM region)
    SELECT name, 'MISSING' AS problem FROM ex WHERE name NOT IN (SELECT name FROM rec) UNION ALL SELECT name, 'UNEXPECTED' FROM rec WHERE name NOT IN (SELECT name FROM ex) UNION ALL SELECT name, 'BAD_HASH' FROM rec WHERE NOT regexp_full_match(sha256, '[0-9a-f]{64}')""",
)
def n2(spark, d):
    docs = b.table(spark, d, "documents")
    name = F.concat_ws("/", "lang", "source").alias("name")
    sha = F.when(F.col("lang") == "en", "short").otherwise(F.sha2(F.concat("lang", "source"), 256)).alias("sha256")
    recorded = docs.select(name, sha).distinct()
    ghosts = b.table(spark, d, "region").select(F.concat(F.lit("ghost/"), "r_name").alias("name"))
    expected = docs.where("source <> 'web'").select(name).unionByName(ghosts).distinct()
    return ev.evidence_complete(recorded, expected)


@query("n3_files_present", " UNION ALL ".join(f"SELECT '{n}' AS name, {'false' if n.startswith('ghost') else 'true'} AS present FROM region GROUP BY 1" for n in ["orders.parquet", "lineitem.parquet", "ghost.parquet"]))
def n3(spark, d):
    expected = spark.createDataFrame([(n,) for n in ("orders.parquet", "lineitem.parquet", "ghost.parquet")], "name string")
    return ev.files_present(expected, ev.manifest(spark, d, "*.parquet"))


@query(
    "n4_policies_agree",
    f"""WITH {b.APPS_SQL}, l AS (SELECT region AS policy, employment_type AS key, (sum(default_30d) + 0)::DOUBLE AS x FROM apps GROUP BY 1, 2) SELECT policy, key, NOT (policy = 'ASIA' AND key = '5-LOW') AND NOT (policy = 'EUROPE' AND key = '1-URGENT') AND policy <> 'AFRICA' AS agrees FROM l""",
)
def n4(spark, d):
    rows = b.apps(spark, d).groupBy(F.col("region").alias("policy"), F.col("employment_type").alias("key")).agg(
        F.sum("default_30d").cast("double").alias("number"), F.array_sort(F.collect_set("sex")).alias("members")
    )
    bump = F.when((F.col("policy") == "ASIA") & (F.col("key") == "5-LOW"), 1e-6).otherwise(1e-13)
    other = rows.where("NOT (policy = 'EUROPE' AND key = '1-URGENT')").withColumns(
        {"number": F.col("number") + bump, "members": F.when(F.col("policy") == "AFRICA", F.array(F.lit("male"))).otherwise(F.col("members"))}
    )
    return ev.policies_agree(rows, other)


# Runs are orders, tasks their line numbers; a task depends on the one at half its number.
_TASK = """WITH t AS (SELECT l_orderkey AS run_id, l_linenumber AS task_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'FAIL' ELSE 'PASS' END AS s FROM lineitem GROUP BY 1, 2),
 a AS (SELECT t.run_id, t.task_id, t.s, p.s AS s1, g.s AS s2, p.task_id AS p1 FROM t LEFT JOIN t p ON p.run_id = t.run_id AND p.task_id = t.task_id // 2 LEFT JOIN t g ON g.run_id = t.run_id AND g.task_id = t.task_id // 4 AND p.task_id IS NOT NULL),
 r AS (SELECT run_id, task_id, CASE WHEN s1 = 'FAIL' OR s2 = 'FAIL' THEN 'SKIPPED' ELSE s END AS status FROM a)"""


def rolled(spark, d):
    lines = b.table(spark, d, "lineitem")
    tasks = lines.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("task_id")).agg(
        F.when(F.bool_or(F.col("l_returnflag") == "R"), "FAIL").otherwise("PASS").alias("own_status")
    )
    # line numbers have gaps: a task whose half is not in its order depends on nothing
    there = tasks.select("run_id", F.col("task_id").alias("parent"))
    half = F.floor(F.col("task_id") / 2).cast("int")
    tasks = tasks.withColumn("parent", F.when(F.col("task_id") > 1, half)).join(there.withColumn("_in", F.lit(True)), ["run_id", "parent"], "left")
    depends = F.when(F.col("_in"), F.array("parent")).otherwise(F.array().cast("array<int>"))
    return ev.run_rollup(tasks.select("run_id", "task_id", "own_status", depends.alias("depends_on")))


@query("n5_run_rollup", _TASK + " SELECT run_id, CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS run_status, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped FROM r GROUP BY 1")
def n5(spark, d):
    return ev.run_status(rolled(spark, d))


@query("n6_logs_equal", "SELECT 1::BIGINT AS only_left, count(*) FILTER (WHERE event_id % 1000 = 0) AS only_right, false AS equal FROM events")
def n6(spark, d):
    rows = b.table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = files.work_dir(spark, "log")
    files.append_events(files.event_rows(rows, at="ts"), path)
    log = files.read_events(spark, path).select(F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"), "event_type", F.col("timestamp_utc").alias("ts"))
    lost = log.where("event_id % 1000 <> 0").unionByName(log.where("event_id = 1").withColumn("event_type", F.lit("invented")))
    return ev.logs_equal(lost, rows, ["event_id", "event_type"])

