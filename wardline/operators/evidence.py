"""Promotion evidence: manifests, gates, decisions, the stage registry, acceptance checks."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.operators import contract, drift, fairness, metrics
from wardline.operators.contract import Contract
from wardline.sources.files import file_hashes
from wardline.sources.tables import stored

# Legal stage moves, audit event names.
STAGE_EDGES = {
    "REGISTERED": ["CANDIDATE"],
    "CANDIDATE": ["STAGING", "REJECTED"],
    "STAGING": ["SHADOW"],
    "SHADOW": ["CANARY", "STAGING"],
    "CANARY": ["PRODUCTION", "STAGING"],
    "PRODUCTION": [],
    "REJECTED": [],
}


@dataclass(frozen=True)
class PromotionPolicy:
    name: str = "promotion_policy"
    version: str = "1.0.0"
    requested_stage: str = "STAGING"
    required_decision: str = "PASS"
    minimum_roc_auc: float = 0.75
    minimum_pr_auc: float = 0.60
    maximum_brier_score: float = 0.20
    blocked_drift: tuple[str, ...] = ("CRITICAL",)
    blocked_fairness: tuple[str, ...] = ("FAIL",)
    minimum_artifacts: int = 6
    non_blocking: tuple[str, ...] = ()
    approved_stage: str = "STAGING"
    rejected_stage: str = "REJECTED"


# ---------------------------------------------------------------- artifacts


def manifest(spark: SparkSession, paths: Sequence[str] | str, glob: str | None = None) -> DataFrame:
    """(name, path, sha256, size_bytes) of artifacts, files or folders, hashed on the executors (see :func:`files.file_hashes`)."""
    return file_hashes(spark, paths, glob).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "sha256", "size_bytes")


def verify_manifest(recorded: DataFrame, fresh: DataFrame) -> DataFrame:
    """State of every recorded artifact: OK, MISSING, SIZE or HASH."""
    now = fresh.select("path", F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    state = (
        F.when(F.col("_sha").isNull(), "MISSING")
        .when(F.col("_size") != F.col("size_bytes"), "SIZE")
        .when(F.col("_sha") != F.col("sha256"), "HASH")
        .otherwise("OK")
    )
    return recorded.join(now, "path", "left").select("name", "path", state.alias("state"))


def artifact_counts(artifacts: DataFrame, key: str = "model_version") -> DataFrame:
    valid = (F.length("sha256") > 0) & (F.col("size_bytes") > 0)
    return artifacts.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_artifacts"), F.count_if(F.coalesce(valid, F.lit(False))).alias("valid_artifacts")
    )


# ---------------------------------------------------------------- gates


def _status_ok(c: str, blocked: Sequence[str]) -> Column:
    return ~F.array_contains(F.array(*[F.lit(b) for b in blocked]), F.col(c)) if blocked else F.lit(True)


#: The evidence columns that each gate reads.
GATE_PARTS = {
    "data_quality": "quality", "performance": "performance", "calibration": "performance", "drift": "drift", "fairness": "fairness",
    "evidence_integrity": "artifacts",
}


@dataclass(frozen=True)
class Candidates:
    """Scored rows of every candidate (``keys``) with a ``batch`` column, and what they are judged by.

    ``evidence`` judges all keys together: contract and both rule engines on the current batch, metrics of the current
    batch, drift with cut points per key, fairness per key. Only the parts asked for are made.
    """

    rows: DataFrame
    contract: Contract
    features: tuple[str, ...]
    sensitive: tuple[str, ...]
    keys: tuple[str, ...] = ("model_version",)
    minimum_group_size: int = 30
    artifacts: DataFrame | None = None
    drift_policy: drift.DriftPolicy = drift.DriftPolicy()
    label: str = "default_30d"
    score: str = "risk_probability"

    def part(self, name: str) -> DataFrame:
        by, current = list(self.keys), self.rows.where(F.col("batch") == drift.CURRENT)
        if name == "quality":
            judged = contract.gate(contract.both_engines(current, self.contract, by=by), by)
            return judged.select(*by, F.col("decision").alias("quality_decision"))
        if name == "performance":
            found = metrics.classification_metrics(current, by, self.label, self.score)
            return found.select(*by, "roc_auc", "pr_auc", "brier_score")
        if name == "drift":
            report = drift.drift_report(self.rows, self.features, self.score, policy=self.drift_policy, by=by)
            return drift.overall_status(report, by).select(
                *by, F.col("overall_status").alias("drift_status"), "critical_features", "warning_features"
            )
        if name == "fairness":
            counts = fairness.group_counts(current, self.sensitive, label=self.label, score=self.score, by=by)
            judged = fairness.expanded_assess(fairness.expanded_group_metrics(counts, self.minimum_group_size, by=by), by=by)
            return fairness.overall_status(judged, self.sensitive, by=by).withColumnRenamed("overall_status", "fairness_status")
        if self.artifacts is None:
            raise ValueError("no artifacts given")
        return artifact_counts(self.artifacts, *by)

    def evidence(self, parts: Sequence[str] = ("quality", "performance", "drift", "fairness", "artifacts")) -> DataFrame:
        """One row per key that occurs in any part; a part without rows for a key leaves its columns NULL."""
        out = self.part(parts[0])
        for name in parts[1:]:
            out = out.join(self.part(name), list(self.keys), "full")
        return out


def gates(
    evidence: DataFrame, policy: PromotionPolicy = PromotionPolicy(), keys: Sequence[str] = ("model_version",), only: Sequence[str] | None = None
) -> DataFrame:
    """Six gate rows per evidence row, or those named in ``only``.

    ``evidence`` has quality_decision, roc_auc, pr_auc, brier_score, drift_status, fairness_status,
    total_artifacts and valid_artifacts, or the columns of the gates asked for. Absent evidence fails its gate.
    """
    for name in {"quality_decision", "roc_auc", "pr_auc", "brier_score", "drift_status", "fairness_status", "total_artifacts", "valid_artifacts"}.difference(evidence.columns):
        evidence = evidence.withColumn(name, F.lit(None))
    c, p = F.col, policy
    num = lambda x: F.coalesce(x.cast("string"), F.lit("null"))

    # name, condition, what was seen, limit
    specs = [
        ("data_quality", c("quality_decision") == p.required_decision, c("quality_decision"), p.required_decision),
        (
            "performance", (c("roc_auc") >= p.minimum_roc_auc) & (c("pr_auc") >= p.minimum_pr_auc),
            F.concat(F.lit("roc_auc="), num(c("roc_auc")), F.lit(",pr_auc="), num(c("pr_auc"))),
            f"roc_auc>={p.minimum_roc_auc},pr_auc>={p.minimum_pr_auc}",
        ),
        ("calibration", c("brier_score") <= p.maximum_brier_score, c("brier_score"), f"<={p.maximum_brier_score}"),
        ("drift", _status_ok("drift_status", p.blocked_drift), c("drift_status"), "not in " + json.dumps(sorted(p.blocked_drift))),
        ("fairness", _status_ok("fairness_status", p.blocked_fairness), c("fairness_status"), "not in " + json.dumps(sorted(p.blocked_fairness))),
        (
            "evidence_integrity", (c("valid_artifacts") >= p.minimum_artifacts) & (c("valid_artifacts") == c("total_artifacts")),
            F.concat(num(c("valid_artifacts")), F.lit("/"), num(c("total_artifacts"))), f">={p.minimum_artifacts}, all hashed",
        ),
    ]
    specs = [(name, F.coalesce(ok, F.lit(False)), seen.cast("string"), limit) for name, ok, seen, limit in specs]
    rows = [
        F.struct(
            F.lit(i).alias("gate_position"),
            F.lit(name).alias("name"),
            F.when(passed, "PASS").otherwise("FAIL").alias("status"),
            passed.alias("passed"),
            F.lit(name not in p.non_blocking).alias("blocking"),
            F.concat(F.lit(name), F.when(passed, " meets ").otherwise(" misses "), F.lit(expected)).alias("reason"),
            observed.alias("observed"),
            F.lit(expected).alias("expected"),
        )
        for i, (name, passed, observed, expected) in enumerate(specs)
        if only is None or name in only
    ]
    return evidence.select(*keys, F.inline(F.array(*rows)))


def decide(gate_rows: DataFrame, policy: PromotionPolicy = PromotionPolicy(), keys: Sequence[str] = ("model_version",)) -> DataFrame:
    """APPROVE unless a blocking gate fails; reasons in gate order; a deterministic decision id.

    Six rows per key are folded, so the lists are bounded.
    """
    failed = F.collect_list(
        F.when(~F.col("passed") & F.col("blocking"), F.struct("gate_position", F.concat("name", F.lit(": "), "reason").alias("text")))
    )
    outcome = F.collect_list(F.struct("gate_position", F.concat_ws("=", "name", "status").alias("text")))
    text = lambda a: F.transform(F.array_sort(a), lambda s: s["text"])
    folded = gate_rows.groupBy(*keys).agg(
        F.when(F.bool_and(F.col("passed") | ~F.col("blocking")), "APPROVE").otherwise("REJECT").alias("decision"),
        text(failed).alias("blocking_reasons"),
        F.array_join(text(outcome), ",").alias("_gates"),
    )
    identity = F.concat_ws(
        "|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys], "decision",
        F.lit(policy.requested_stage), F.lit(policy.name), F.lit(policy.version), "_gates",
    )
    return folded.select(*keys, "decision", "blocking_reasons", F.substring(F.sha2(identity, 256), 1, 20).alias("decision_id"))


def apply_decisions(decisions: DataFrame, policy: PromotionPolicy = PromotionPolicy()) -> DataFrame:
    approved = F.col("decision") == "APPROVE"
    return decisions.withColumn("target_stage", F.when(approved, policy.approved_stage).otherwise(policy.rejected_stage))


def decision_events(applied: DataFrame, keys: Sequence[str] = ("model_version",)) -> DataFrame:
    """The two audit rows of every decision."""
    body = F.to_json(F.struct(*sorted([*keys, "decision", "decision_id", "target_stage"])))
    kinds = F.array(*[F.struct(F.lit(i).alias("event_order"), F.lit(t).alias("event_type")) for i, t in enumerate(["GOVERNANCE_EVALUATED", "REGISTRY_TRANSITION"])])
    return applied.select(*keys, F.inline(kinds), body.alias("payload"))


# ---------------------------------------------------------------- registry


def previous_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, output: str
) -> DataFrame:
    """``lag(value)`` per key, safe for a key with very many rows.

    ``block`` must not decrease along ``order`` (an hour, a day, a range of ids). Rows are ordered within
    (key, block); the last value of every block is passed on through a table of one row per block. Rows with a NULL key
    form a key of their own; rows with a NULL order value come first.
    """
    keys, order = list(keys), list(order)
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    last = blocked.groupBy(*keys, "_block").agg(F.max_by(F.struct(value), F.struct(*order))[value].alias("_last"))
    carried = last.select(
        *keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry")
    )
    here = blocked.withColumns({"_lag": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
    at = [*keys, "_block"]
    carried = carried.withColumnsRenamed({k: f"_at_{k}" for k in at})
    same = reduce(lambda x, y: x & y, [here[k].eqNullSafe(carried[f"_at_{k}"]) for k in at])
    joined = here.join(carried, same, "left").withColumn(output, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
    return joined.drop("_block", "_lag", "_first", "_carry", *[f"_at_{k}" for k in at])


def legal_move(before: Column, after: Column) -> Column:
    """A first stage must be REGISTERED; later ones must follow an edge; an unknown stage is illegal."""
    edges = [f"{a}>{b}" for a, targets in STAGE_EDGES.items() for b in targets]
    step = F.concat_ws(">", before, after)
    return F.when(before.isNull(), after == "REGISTERED").otherwise(step.isin(*edges))


def transitions_audit(history: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, stage: str = "stage") -> DataFrame:
    """Stage history with ``previous_stage`` and ``is_legal``."""
    staged = previous_in_order(history, keys, order, block, stage, "previous_stage")
    return staged.withColumn("is_legal", legal_move(F.col("previous_stage"), F.col(stage)))


def current_stage(history: DataFrame, keys: Sequence[str], order: Sequence[str], stage: str = "stage", decision: str | None = None) -> DataFrame:
    at = F.struct(*order)
    extra = [F.max_by(decision, F.when(F.col(decision).isNotNull(), at)).alias("last_decision_id")] if decision else []
    return history.groupBy(*keys).agg(
        F.max_by(stage, at).alias("stage"), *extra, F.count(F.lit(1)).alias("event_count")
    )


def first_registration(events: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first registration of a key wins; later ones are ignored."""
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(*keys).agg(first.alias("_f"), F.count(F.lit(1)).alias("attempts")).select(*keys, "_f.*", "attempts")


def event_counts(events: DataFrame, by: Sequence[str] = ("event_type",), minimum: int = 0) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("event_count")).withColumn(
        "enough", F.col("event_count") >= minimum
    )


# ---------------------------------------------------------------- acceptance


def acceptance(metric_rows: DataFrame, gate_rows: DataFrame) -> DataFrame:
    """(name, value, passed) for gates (name, minimum, maximum); an absent metric fails.

    The gate table is a short configured list.
    """
    joined = gate_rows.join(metric_rows, "name", "left")
    v = F.col("value")
    ok = v.isNotNull() & F.coalesce(v >= F.col("minimum"), F.lit(True)) & F.coalesce(v <= F.col("maximum"), F.lit(True))
    return joined.select("name", "value", "minimum", "maximum", ok.alias("passed"))


def evidence_complete(recorded: DataFrame, expected: DataFrame) -> DataFrame:
    """Problems only: names missing, unexpected, or with a hash that is not 64 hex digits."""
    lost = expected.join(recorded, "name", "left_anti").select("name", F.lit("MISSING").alias("problem"))
    extra = recorded.join(expected, "name", "left_anti").select("name", F.lit("UNEXPECTED").alias("problem"))
    bad = recorded.where(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).select(
        "name", F.lit("BAD_HASH").alias("problem")
    )
    return lost.unionByName(extra).unionByName(bad)


def files_present(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """(name, present)."""
    seen = listing.select("name").distinct().withColumn("_here", F.lit(True))
    return expected.select("name").join(seen, "name", "left").select("name", F.coalesce("_here", F.lit(False)).alias("present"))


def policies_agree(left: DataFrame, right: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(policy, key, agrees) over two tables (policy, key, number, members).

    Numbers must match within the tolerance; members of the right must contain those of the left.
    """
    a = left.select("policy", "key", F.col("number").alias("_x"), F.col("members").alias("_m"), F.lit(True).alias("_l"))
    b = right.select("policy", "key", F.col("number").alias("_y"), F.col("members").alias("_n"), F.lit(True).alias("_r"))
    close = (F.col("_x").isNull() & F.col("_y").isNull()) | F.coalesce(F.abs(F.col("_x") - F.col("_y")) <= tolerance, F.lit(False))
    held = F.size(F.array_except(F.coalesce("_m", F.array().cast("array<string>")), F.coalesce("_n", F.array().cast("array<string>")))) == 0
    joined = a.join(b, ["policy", "key"], "full_outer")
    return joined.select("policy", "key", F.coalesce(F.col("_l") & F.col("_r") & close & held, F.lit(False)).alias("agrees"))


def _reject_cycles(edges: DataFrame, run: str) -> None:
    """Raise if a task depends on itself through others: edges to tasks without dependencies are dropped until none is left."""
    left = edges.count()
    while left:
        holders = edges.select(run, F.col("task_id").alias("_dep")).distinct()
        edges = stored(edges.join(holders, [run, "_dep"], "left_semi"), "edges")
        now = edges.count()
        if now == left:
            raise ValueError(f"{now} dependencies lie on or behind a cycle")
        left = now


def run_rollup(tasks: DataFrame, run: str = "run_id") -> DataFrame:
    """Final status per task: SKIPPED behind a task that did not pass, else its own status.

    ``tasks`` is (run, task_id, depends_on ARRAY, own_status). Chains may have any length: the set of blocked tasks grows by one
    level per round, each stored, until no new task is reached. Cycles and dependencies on unknown tasks raise an error. Runs jobs
    when called.
    """
    edges = stored(tasks.select(run, "task_id", F.explode("depends_on").alias("_dep")).distinct(), "edges")
    known = tasks.select(run, F.col("task_id").alias("_dep"))
    unknown = edges.join(known, [run, "_dep"], "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} dependencies name no task of their run")
    _reject_cycles(edges, run)
    frontier = tasks.where(~F.col("own_status").eqNullSafe("PASS")).select(run, F.col("task_id").alias("_dep"))
    blocked = None
    while True:
        reached = edges.join(frontier, [run, "_dep"]).select(run, "task_id").distinct()
        if blocked is not None:
            reached = reached.join(blocked, [run, "task_id"], "left_anti")
        reached = stored(reached, "reached")
        if reached.isEmpty():
            break
        blocked = reached if blocked is None else stored(blocked.unionByName(reached), "blocked")
        frontier = reached.withColumnRenamed("task_id", "_dep")
    skipped = (reached if blocked is None else blocked).withColumn("_skip", F.lit(True))
    skip = F.coalesce("_skip", F.lit(False))
    return tasks.join(skipped, [run, "task_id"], "left").select(
        run, "task_id", F.when(skip, "SKIPPED").otherwise(F.col("own_status")).alias("status")
    )


def run_status(rolled: DataFrame, run: str = "run_id") -> DataFrame:
    return rolled.groupBy(run).agg(
        F.when(F.bool_and(F.col("status") == "PASS"), "PASS").otherwise("FAIL").alias("run_status"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
    )


def logs_equal(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows only on the left, only on the right (copies counted), and the verdict."""
    a, b = left.select(*columns), right.select(*columns)
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("_s").alias("_net"))
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("_net") > 0, F.col("_net"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("_net") < 0, -F.col("_net"))), F.lit(0)).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
