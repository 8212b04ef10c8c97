"""Incident timelines, SLAs, alerts and the incident report; many incidents at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalar import elapsed_minutes, minutes_valid
from wardline.operators.evidence import previous_in_order

# Fixed values: (name, start event, end event, target minutes).
SLAS = (
    ("time_to_detect", "INCIDENT_STARTED", "INCIDENT_DETECTED", 240),
    ("time_to_alert", "INCIDENT_STARTED", "ALERT_CREATED", 245),
    ("time_to_block", "INCIDENT_STARTED", "GOVERNANCE_BLOCKED", 250),
    ("time_to_triage", "INCIDENT_STARTED", "TRIAGE_STARTED", 480),
    ("time_to_root_cause", "INCIDENT_STARTED", "ROOT_CAUSE_COMPLETED", 2880),
)


def timeline_checks(
    events: DataFrame, incident: str = "incident_id", event_id: str = "event_id", event_type: str = "event_type",
    ts: str = "occurred_at", seq: str = "seq", block: Column | None = None,
) -> DataFrame:
    """Per incident: events, repeated ids, repeated types, steps back in time, and the verdict. An event without time or place is bad.

    ``block`` groups neighbouring sequence numbers, so one incident with very many events is ordered by
    many tasks.
    """
    block = F.floor(F.col(seq) / 100_000) if block is None else block
    stepped = previous_in_order(events, [incident], [seq], block, ts, "_before")
    per_id = events.groupBy(incident, event_id).agg(F.count(F.lit(1)).alias("_n")).groupBy(incident).agg(
        F.count_if(F.col("_n") > 1).alias("repeated_ids")
    )
    per_type = events.groupBy(incident, event_type).agg(F.count(F.lit(1)).alias("_n")).groupBy(incident).agg(
        F.count_if(F.col("_n") > 1).alias("repeated_types")
    )
    base = stepped.groupBy(incident).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col(ts).isNull() | F.col(seq).isNull()).alias("bad_timestamps"),
        F.count_if(F.col(ts) < F.col("_before")).alias("steps_back"),
    )
    bad = F.col("repeated_ids") + F.col("repeated_types") + F.col("bad_timestamps") + F.col("steps_back")
    return base.join(per_id, incident).join(per_type, incident).withColumn("valid", bad == 0)


def missing_types(events: DataFrame, required: Sequence[str], incident: str = "incident_id", event_type: str = "event_type") -> DataFrame:
    """(incident, missing): required event types that never occur; only required types are collected."""
    wanted = F.array(*[F.lit(r) for r in required])
    seen = F.collect_set(F.when(F.col(event_type).isin(*required), F.col(event_type)))
    return events.groupBy(incident).agg(F.array_sort(F.array_except(wanted, seen)).alias("missing")).withColumn(
        "complete", F.size("missing") == 0
    )


def event_times(events: DataFrame, types: Sequence[str], incident: str = "incident_id", event_type: str = "event_type", ts: str = "occurred_at") -> DataFrame:
    """One row per incident, one column per event type with its (first) time."""
    return events.groupBy(incident).agg(*[F.min(F.when(F.col(event_type) == t, F.col(ts))).alias(t) for t in types])


def sla(times: DataFrame, slas: Sequence[tuple[str, str, str, int]] = SLAS, incident: str = "incident_id") -> DataFrame:
    """Per incident and SLA: minutes, PASS or FAIL; MISSING without both events, INVALID if out of order.

    ``aligned`` tells whether the span is a whole number of minutes; otherwise minutes are truncated.
    """
    rows = []
    for name, start, end, target in slas:
        s, e = F.col(start), F.col(end)
        minutes = elapsed_minutes(s, e)
        status = (
            F.when(s.isNull() | e.isNull(), "MISSING").when(e < s, "INVALID").when(minutes <= target, "PASS").otherwise("FAIL")
        )
        rows.append(
            F.struct(
                F.lit(name).alias("name"), F.lit(start).alias("start_event"), F.lit(end).alias("end_event"),
                minutes.alias("observed_minutes"), F.lit(target).cast("long").alias("target_minutes"), status.alias("status"),
                F.coalesce(minutes_valid(s, e), F.lit(False)).alias("aligned"),
            )
        )
    return times.select(incident, F.inline(F.array(*rows)))


def all_slas_met(sla_rows: DataFrame, incident: str = "incident_id") -> DataFrame:
    return sla_rows.groupBy(incident).agg(
        F.bool_and(F.col("status") == "PASS").alias("all_slas_pass"), F.count_if(F.col("status") != "PASS").alias("not_passed")
    )


def alerts(signals: DataFrame, times: DataFrame, incident: str = "incident_id", created: str = "ALERT_CREATED") -> DataFrame:
    """Alert rows: signals above their limit joined to the incident's alert event."""
    breached = signals.where(F.col("observed") > F.col("expected_max"))
    at = times.select(incident, F.col(created).alias("created_at")).where(F.col("created_at").isNotNull())
    return breached.join(at, incident).withColumns({"severity": F.lit("HIGH"), "status": F.lit("OPEN"), "action": F.lit("BLOCK_AND_QUARANTINE")})


def ordering_checks(times: DataFrame, checks: Sequence[tuple[str, str, str]], incident: str = "incident_id") -> DataFrame:
    """(incident, check, passed) for (name, earlier, later); an absent event fails."""
    rows = [
        F.struct(F.lit(n).alias("check_name"), F.coalesce(F.col(a) <= F.col(b), F.lit(False)).alias("passed")) for n, a, b in checks
    ]
    return times.select(incident, F.inline(F.array(*rows)))


def incident_report(parts: dict[str, DataFrame], incident: str = "incident_id") -> DataFrame:
    """One nested row per incident: each part (one row per incident) becomes a struct column."""
    out = None
    for name, part in parts.items():
        fields = [c for c in part.columns if c != incident]
        nested = part.select(incident, F.struct(*fields).alias(name))
        out = nested if out is None else out.join(nested, incident, "full_outer")
    return out


def response_parts(
    events: DataFrame, signals: DataFrame, types: Sequence[str], required: Sequence[str], checks: Sequence[tuple[str, str, str]], incident: str = "incident_id"
) -> dict[str, DataFrame]:
    """The operational parts of a report, all from one table of event times: timeline, alert, sla, root_cause.

    An incident without an alert has a NULL alert; its lists hold one entry per required type, metric or check.
    """
    at = event_times(events, types, incident)
    gone = F.array_compact(F.array(*[F.when(F.col(t).isNull(), F.lit(t)) for t in sorted(required)]))
    timeline = at.select(incident, gone.alias("missing"), (F.size(gone) == 0).alias("complete"))
    metric = F.struct("name", "observed_minutes", "target_minutes", "status")
    met = sla(at).groupBy(incident).agg(F.sort_array(F.collect_list(metric)).alias("metrics"), F.bool_and(F.col("status") == "PASS").alias("all_met"))
    failed = F.collect_list(F.when(~F.col("passed"), F.col("check_name")))
    cause = ordering_checks(at, checks).groupBy(incident).agg(F.bool_and("passed").alias("in_order"), F.sort_array(failed).alias("failed_checks"))
    return {"timeline": timeline, "alert": alerts(signals, at, incident), "sla": met, "root_cause": cause}
