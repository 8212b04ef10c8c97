"""Streams built from the same column builders as the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.operators import drift, telemetry
from wardline.operators.contract import Contract, with_violations


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is available now into parquet; exactly once through its checkpoint."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query


def validate_stream(stream: DataFrame, contract: Contract, valid: str, quarantined: str, checkpoint: str) -> StreamingQuery:
    """Split a stream into valid and quarantined rows.

    One pass per micro-batch: the verdict is a partition column and each sink is one folder per batch id,
    overwritten on a retry, so a repeated micro-batch does not double its rows.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        checked = with_violations(batch, contract).persist()
        try:
            ok = F.size("violations") == 0
            checked.where(ok).drop("violations").write.mode("overwrite").parquet(f"{valid}/batch_id={batch_id}")
            checked.where(~ok).write.mode("overwrite").parquet(f"{quarantined}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    query = (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def windowed_counts(
    stream: DataFrame, ts: str, by: Sequence[str], width: str, slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Counts per (window, by); rows later than ``delay`` are dropped, a window is emitted once it closes."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        stream.withWatermark(ts, delay).groupBy(win.alias("_w"), *by).agg(F.count(F.lit(1)).alias("total"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, "total")
    )


def windowed_histogram(
    stream: DataFrame, ts: str, value: str, bounds: Sequence[float], by: Sequence[str], width: str = "5 minutes",
    slide: str | None = "1 minute", delay: str = "10 minutes",
) -> DataFrame:
    win = (F.window(ts, width, slide) if slide else F.window(ts, width)).alias("_w")
    return telemetry.histogram(stream.withWatermark(ts, delay), value, bounds, [win, *by])


def windowed_bins(
    stream: DataFrame, features: Sequence[str], edges: DataFrame, ts: str, width: str, delay: str
) -> DataFrame:
    """(window, feature, bin, n) against fixed edges: a stream-static join and one windowed count.

    ``edges`` has one row per monitored feature.
    """
    long = drift.melt(stream.withWatermark(ts, delay), features, [ts])
    binned = long.join(F.broadcast(edges.select("feature", "edges")), "feature").withColumn(
        "bin", drift.bin_number(F.col("value"), F.col("edges"))
    )
    grouped = binned.groupBy(F.window(ts, width).alias("_w"), "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("_w.start").alias("window_start"), "feature", "bin", "n")


def psi_of_bins(counts: DataFrame, reference: DataFrame, epsilon: float = 1e-6, minimum_rows: int = 1) -> DataFrame:
    """PSI per (window, feature) from closed windows; ``reference`` is (feature, bin, reference_share).

    A window without rows in a bin still counts that bin, at epsilon.
    """
    totals = counts.groupBy("window_start", "feature").agg(F.sum("n").alias("row_count"))
    grid = totals.join(F.broadcast(reference.select("feature", "bin", "reference_share")), "feature")
    joined = grid.join(counts, ["window_start", "feature", "bin"], "left")
    a = F.greatest(F.coalesce(F.col("n"), F.lit(0)).cast("double") / F.col("row_count"), F.lit(epsilon))
    e = F.col("reference_share")
    return joined.groupBy("window_start", "feature", "row_count").agg(F.sum((a - e) * F.ln(a / e)).alias("_psi")).select(
        "window_start", "feature", "row_count", F.when(F.col("row_count") >= minimum_rows, F.col("_psi")).alias("psi")
    )


def sessions(stream: DataFrame, ts: str, by: Sequence[str], gap: str, delay: str, sla_minutes: int) -> DataFrame:
    """Gap-separated sessions per source, emitted once closed, with an SLA verdict on their length."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("_s"), *by).agg(
        F.count(F.lit(1)).alias("event_count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    minutes = F.timestamp_diff("MINUTE", F.col("first_ts"), F.col("last_ts"))
    return grouped.select(
        *by, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), "event_count",
        minutes.alias("observed_minutes"), F.when(minutes <= sla_minutes, "PASS").otherwise("FAIL").alias("status"),
    )


def first_registrations(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Exactly one row per key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
