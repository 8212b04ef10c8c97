"""Serving counters and histograms, batch or stream: the same expressions serve both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bucket bounds (+Inf is implied) and the stages shown by the stage gauge.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
RISK_BUCKETS = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 1.0)
STAGES = ("STAGING", "SHADOW", "CANARY", "PRODUCTION", "REJECTED")


def counters(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))


def prediction_counter(df: DataFrame, score: str = "risk_probability", threshold: float = 0.5) -> DataFrame:
    flagged = F.col(score) >= threshold
    return counters(
        df, [flagged.cast("int").cast("string").alias("predicted_default"), F.when(flagged, "false").otherwise("true").alias("approved")]
    )


def _bucket_counts(value: Column, bounds: Sequence[float]) -> Column:
    return F.array(*[F.count_if(value <= b) for b in bounds], F.count(value))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str | Column] = ()) -> DataFrame:
    """(by, le, cumulative count): one aggregate, cumulative ``le`` buckets, the last one +Inf."""
    folded = df.groupBy(*by).agg(_bucket_counts(F.col(value), bounds).alias("_n"), F.sum(value).alias("value_sum"))
    labels = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    kept = [c for c in folded.columns if c not in ("_n", "value_sum")]
    return folded.select(*kept, F.inline(F.arrays_zip(labels.alias("le"), F.col("_n").alias("bucket_count"))))


def request_rate(df: DataFrame, ts: str, by: Sequence[str], width: str = "1 minute", seconds: int = 60) -> DataFrame:
    grouped = df.groupBy(F.window(ts, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("request_count"))
    return grouped.select(
        F.col("_w.start").alias("window_start"), *by, "request_count",
        (F.col("request_count") / F.lit(float(seconds))).alias("per_second"),
    )


def histogram_quantile(buckets: DataFrame, by: Sequence[str], q: float, output: str = "estimate") -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket; the +Inf bucket answers its lower bound."""
    w = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumns(
        {
            "_low": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
            "_before": F.coalesce(F.lag("bucket_count").over(w), F.lit(0)),
            "_total": F.max("bucket_count").over(Window.partitionBy(*by)),
        }
    )
    rank = F.col("_total") * F.lit(float(q))
    inside = F.try_divide(rank - F.col("_before"), F.col("bucket_count") - F.col("_before"))
    value = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(
        F.col("_low") + (F.col("le") - F.col("_low")) * F.coalesce(inside, F.lit(0.0))
    )
    hit = (F.col("_total") > 0) & (F.col("bucket_count") >= rank)
    return rows.groupBy(*by).agg(F.min_by(value, F.when(hit, F.col("le"))).alias(output))


def windowed_quantile(
    df: DataFrame, ts: str, value: str, bounds: Sequence[float], q: float, by: Sequence[str] = (),
    width: str = "5 minutes", slide: str | None = "1 minute",
) -> DataFrame:
    """Bucket quantile per (sliding) window.

    Sliding windows add up counts per ``slide``, which must divide ``width``, so a row is counted once and not once per window.
    """
    if not slide:
        win = F.window(ts, width)["start"].alias("window_start")
        return histogram_quantile(histogram(df, value, bounds, [win, *by]), ["window_start", *by], q)
    x, names = F.col(value), [f"_n{i}" for i in range(len(bounds) + 1)]
    each = [*[F.count_if(x <= limit) for limit in bounds], F.count(x)]
    steps = df.groupBy(F.window(ts, slide)["start"].alias("_at"), *by).agg(*[c.alias(n) for c, n in zip(each, names)])
    wide = steps.groupBy(F.window("_at", width, slide)["start"].alias("window_start"), *by).agg(*[F.sum(n).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(float(le)).alias("le"), F.col(n).alias("bucket_count")) for le, n in zip([*bounds, float("inf")], names)])
    return histogram_quantile(wide.select("window_start", *by, F.inline(rows)), ["window_start", *by], q)


def stage_gauge(stages: DataFrame, keys: Sequence[str], stage: str = "stage") -> DataFrame:
    """One-hot over the shown stages."""
    each = F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("gauge_stage")
    return stages.select(*keys, stage, each).select(
        *keys, "gauge_stage", (F.col(stage) == F.col("gauge_stage")).cast("double").alias("gauge_value")
    )


def rollback_events(events: DataFrame, event_type: str = "event_type") -> DataFrame:
    return events.agg(F.count_if(F.col(event_type) == "RELEASE_ROLLED_BACK").alias("rollback_events"))
