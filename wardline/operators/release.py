"""Staged rollout: routing, health snapshots, gates, replay."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import route
from wardline.operators.cumulative import exact_quantiles


@dataclass(frozen=True)
class ReleasePolicy:
    maximum_error_rate: float
    maximum_p95_latency_ms: float
    maximum_mean_risk_delta: float
    minimum_request_count: int


# Limits of the two rollout phases, and the canary plan.
SHADOW = ReleasePolicy(0.02, 250.0, 0.05, 50)
CANARY = ReleasePolicy(0.03, 300.0, 0.06, 100)
SHARES = (0.10, 0.25, 0.50, 1.00)


def health_snapshot(
    requests: DataFrame,
    keys: Sequence[str],
    *,
    is_error: Column,
    latency: str,
    risk_delta: Column,
    bounded_keys: bool = False,
) -> DataFrame:
    """request_count, error_rate, exact p95 latency and mean risk delta per rollout checkpoint."""
    counted = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.avg(is_error.cast("double")).alias("error_rate"),
        F.avg(risk_delta).alias("mean_risk_delta"),
    )
    p95 = exact_quantiles(requests, keys, latency, [0.95], names=["p95_latency_ms"], bounded_keys=bounded_keys)
    return counted.join(p95.drop("row_count"), list(keys), "left").select(
        *keys, "request_count", "error_rate", "p95_latency_ms", "mean_risk_delta"
    )


def release_gates(snapshots: DataFrame, keys: Sequence[str], phase: str | None = None) -> DataFrame:
    """Four gate rows per snapshot; limits follow the ``phase`` column (shadow or canary)."""

    def limit(name: str) -> Column:
        a, b = getattr(SHADOW, name), getattr(CANARY, name)
        return F.lit(float(b)) if phase is None else F.when(F.col(phase) == "shadow", float(a)).otherwise(float(b))

    delta = F.abs("mean_risk_delta")
    specs = [
        ("minimum_request_count", F.col("request_count") >= limit("minimum_request_count"), F.col("request_count"), limit("minimum_request_count")),
        ("error_rate", F.col("error_rate") <= limit("maximum_error_rate"), F.col("error_rate"), limit("maximum_error_rate")),
        ("p95_latency_ms", F.col("p95_latency_ms") <= limit("maximum_p95_latency_ms"), F.col("p95_latency_ms"), limit("maximum_p95_latency_ms")),
        ("mean_risk_delta", delta <= limit("maximum_mean_risk_delta"), delta, limit("maximum_mean_risk_delta")),
    ]
    rows = [
        F.struct(
            F.lit(n).alias("name"),
            F.coalesce(ok, F.lit(False)).alias("passed"),
            observed.cast("double").alias("observed"),
            expected.cast("double").alias("expected"),
        )
        for n, ok, observed, expected in specs
    ]
    return snapshots.select(*keys, F.inline(F.array(*rows)))


def rollback_reason(failed_names: Column) -> Column:
    """Text from an array of failed gate names; none failed means a manual rollback."""
    return F.when(F.size(failed_names) == 0, "manual rollback").otherwise(
        F.concat(F.lit("release gates failed: "), F.array_join(F.array_sort(failed_names), ", "))
    )


def checkpoint_results(gate_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, passed, reason): four gate rows folded into one verdict per checkpoint."""
    failed = F.collect_list(F.when(~F.col("passed"), F.col("name")))
    return gate_rows.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), rollback_reason(failed).alias("reason"))


def replay_rollout(checkpoints: DataFrame, version: str = "version", seq: str = "seq", shares: Sequence[float] = SHARES) -> DataFrame:
    """Outcome per version of one shadow checkpoint followed by one per canary share.

    The first failing checkpoint rolls back to STAGING; passing all of them reaches PRODUCTION; rows after
    either end are ignored. Checkpoints are summaries, a handful per version.
    """
    steps = len(shares) + 1
    w = Window.partitionBy(version).orderBy(seq)
    placed = checkpoints.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= steps)
    fail_at = F.min(F.when(~F.col("passed"), F.col("_at")))
    folded = placed.groupBy(version).agg(
        fail_at.alias("_fail"),
        F.max("_at").alias("_seen"),
        F.min_by("reason", F.when(~F.col("passed"), F.col("_at"))).alias("_reason"),
    )
    done = F.coalesce(F.col("_fail") - 1, F.col("_seen"))
    plan = F.array(*[F.lit(float(s)) for s in shares])
    failed = F.col("_fail").isNotNull()
    return folded.select(
        version,
        F.when(failed, "STAGING").when(done >= steps, "PRODUCTION").otherwise("CANARY").alias("stage"),
        F.when(failed, 0.0).when(done >= steps, 1.0).otherwise(F.element_at(plan, F.greatest(done, F.lit(1)).cast("int"))).alias("canary_share"),
        F.greatest(done - 1, F.lit(0)).cast("int").alias("completed_shares"),
        F.when(failed, F.col("_reason")).alias("rollback_reason"),
    )


def plan_valid(shares: Column) -> Column:
    """A rollout plan: at least one share, all in (0, 1], ascending, ending at 1."""
    ok = (
        (F.size(shares) > 0)
        & F.forall(shares, lambda s: (s > 0.0) & (s <= 1.0))
        & (F.array_sort(shares) == shares)
        & (F.try_element_at(shares, F.lit(-1)) == 1.0)
    )
    return F.coalesce(ok, F.lit(False))


def routing_accuracy(keys: DataFrame, key: str, shares: Sequence[float] = SHARES, tolerance: float = 0.03) -> DataFrame:
    """Observed candidate share per configured share, and whether it is close enough."""
    each = keys.select(key, F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    return each.groupBy("share").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.avg((route(key, F.col("share")) == "candidate").cast("double")).alias("observed"),
    ).withColumn("within", F.abs(F.col("observed") - F.col("share")) <= tolerance)
