"""Drift between a reference and a current batch: PSI, two-sample KS, statuses, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import status as st
from wardline.functions.scalar import number
from wardline.operators.cells import Profile
from wardline.operators.cumulative import exact_quantiles, quantiles_from_hits, rank_hits

REFERENCE, CURRENT = "reference", "current"


@dataclass(frozen=True)
class DriftPolicy:
    bins: int = 10
    epsilon: float = 1e-6
    psi_warning: float = 0.10
    psi_critical: float = 0.20
    ks_warning: float = 0.05
    ks_critical: float = 0.10
    alpha: float = 0.05
    strict: bool = False


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns to monitor: {missing}")


def melt(df: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Long form (ids, feature, value) with the value coerced to a number."""
    _require(df, [*features, *ids])
    wide = df.select(*ids, *[number(c).alias(c) for c in features])
    return wide.unpivot(list(ids), list(features), "feature", "value")


def two_batches(df: DataFrame, features: Sequence[str], batch: str, by: Sequence[str] = ()) -> DataFrame:
    """Long form of the reference and current rows: (by, feature, value, is_ref)."""
    rows = melt(df.where(F.col(batch).isin(REFERENCE, CURRENT)), features, [batch, *by])
    return rows.select(*by, "feature", "value", (F.col(batch) == REFERENCE).alias("is_ref"))


def probabilities(bins: int) -> list[float]:
    """0..1 in equal steps, as multiples of the step; the last is exactly 1."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def with_inner_edges(df: DataFrame, quantiles: str, bins: int, keep: Sequence[str]) -> DataFrame:
    """Replace the array of quantiles by ``edges``, the cut points between bins (the outer ends are open).

    Duplicate quantiles merge. Fewer than three distinct ones: equal-width bins between minimum and
    maximum; a constant feature has no cut point; no reference value at all gives NULL.
    """
    found = F.col(quantiles)
    staged = df.select(*keep, F.array_distinct(found).alias("_m"), found[0].alias("_low"), found[bins].alias("_high"))
    even = F.transform(
        F.sequence(F.lit(1), F.lit(bins - 1)),
        lambda i: F.col("_low") + i.cast("double") * ((F.col("_high") - F.col("_low")) / float(bins)),
    )
    edges = (
        F.when(F.col("_low").isNull(), F.lit(None).cast("array<double>"))
        .when(F.size("_m") >= 3, F.slice("_m", 2, F.size("_m") - 2))
        .when(F.col("_low") < F.col("_high"), even)
        .otherwise(F.array().cast("array<double>"))
    )
    return staged.select(*keep, edges.alias("edges"))


def bin_number(value: Column, edges: Column) -> Column:
    """Left-closed bin from 0; a missing value goes to bin -1; without cut points (no reference value) all is bin 0."""
    return F.when(value.isNull(), F.lit(-1)).otherwise(F.coalesce(F.size(F.filter(edges, lambda e: e <= value)), F.lit(0)))


def reference_edges(
    df: DataFrame, features: Sequence[str], batch: str = "batch", bins: int = 10, accuracy: int | None = None
) -> DataFrame:
    """(feature, row_count, edges): cut points of the reference batch, one row per feature.

    Exact by default. ``accuracy`` asks for Spark's bounded quantile sketch instead, with error 1/accuracy.
    """
    probs = probabilities(bins)
    rows = melt(df.where(F.col(batch) == REFERENCE), features, [])
    if accuracy is not None:
        found = rows.groupBy("feature").agg(
            F.count("value").alias("row_count"), F.percentile_approx("value", probs, accuracy).alias("quantiles")
        )
    else:
        found = exact_quantiles(rows, ["feature"], "value", probs)
    return with_inner_edges(found, "quantiles", bins, ["feature", "row_count"])


def _per_bin(
    binned: DataFrame, keys: Sequence[str], bins: int, ref: Column, cur: Column, carry: Sequence[str] = ()
) -> DataFrame:
    """Counts per bin as arrays ``ref_bins``/``cur_bins``; slot 0 is the missing bin.

    First per (keys, bin), combined map-side in a hash table (``carry`` holds numbers), then at most bins + 1 rows per key are
    folded into arrays.
    """
    counted = binned.groupBy(*keys, "_bin").agg(
        F.sum(ref).alias("_ref"), F.sum(cur).alias("_cur"), F.any_value(F.size("edges")).alias("_cuts"),
        *[F.any_value(c).alias(c) for c in carry],
    )
    folded = counted.groupBy(*keys).agg(
        F.any_value("_cuts").alias("_cuts"),
        *[F.any_value(c).alias(c) for c in carry],
        F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("_ref", "_cur")))).alias("_map"),
    )

    def slots(name: str) -> Column:
        return F.transform(
            F.sequence(F.lit(-1), F.lit(bins - 1)),
            lambda b: F.coalesce(F.try_element_at(F.col("_map"), b)[name], F.lit(0)).cast("long"),
        )

    def total(name: str) -> Column:
        return F.aggregate(F.map_values("_map"), F.lit(0).cast("long"), lambda a, x: a + x[name])

    return folded.select(
        *keys,
        *carry,
        (F.col("_cuts") + 1).alias("bin_count"),
        slots("_ref").alias("ref_bins"),
        slots("_cur").alias("cur_bins"),
        total("_ref").alias("ref_total"),
        total("_cur").alias("cur_total"),
    )


def _shares(counts: Column, total: Column, epsilon: float) -> Column:
    return F.transform(counts, lambda n: F.greatest(F.try_divide(n.cast("double"), total), F.lit(epsilon)))


def psi_column(epsilon: float, ref: str = "ref_bins", ref_total: str = "ref_total") -> Column:
    """PSI over the missing bin and the bins in use; proportions floored at epsilon, not renormalised."""
    terms = F.zip_with(
        _shares(F.col("cur_bins"), F.col("cur_total"), epsilon),
        _shares(F.col(ref), F.col(ref_total), epsilon),
        lambda a, e: (a - e) * F.ln(a / e),
    )
    used = F.slice(terms, F.lit(1), F.col("bin_count") + 1)
    defined = (F.col(ref_total) > 0) & (F.col("cur_total") > 0) & F.col("bin_count").isNotNull()
    return F.when(defined, F.aggregate(used, F.lit(0.0), lambda acc, t: acc + t))


def bin_table(
    df: DataFrame,
    features: Sequence[str],
    edges: DataFrame,
    batch: str = "batch",
    by: Sequence[Column] = (),
    bins: int = 10,
    by_columns: Sequence[str] = (),
) -> DataFrame:
    """Rows per bin as arrays ``ref_bins``/``cur_bins`` (slot 0 = missing), per feature, ``by`` and ``by_columns``.

    One pass over the rows, combined map-side to a handful of rows per task. ``edges`` may hold ``by_columns``: cut points per key.
    """
    extra = [*by_columns, *[f"_by{i}" for i in range(len(by))]]
    wide = df.withColumns(dict(zip(extra[len(by_columns) :], by))) if by else df
    rows = melt(wide, features, [batch, *extra])
    on = [*[c for c in by_columns if c in edges.columns], "feature"]
    known = edges.select(*on, "edges")
    known = F.broadcast(known) if on == ["feature"] else known
    binned = rows.join(known, on, "left").withColumn("_bin", bin_number(F.col("value"), F.col("edges")))
    return _per_bin(
        binned, [*extra, "feature"], bins, (F.col(batch) == REFERENCE).cast("long"), (F.col(batch) == CURRENT).cast("long")
    )


def _reference_cuts(profile: Profile, keys: Sequence[str], bins: int, carry: DataFrame | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """(keys, row_count, edges) from the cells of a profile that was asked for the bins' quantiles."""
    probs = probabilities(bins)
    found = profile.leaves.where("low = high").groupBy(*keys).agg(
        F.any_value("total_ref").alias("row_count"),
        rank_hits(F.col("low"), F.col("n_ref"), F.col("before_ref") + F.col("n_ref"), F.col("total_ref"), probs).alias("_hits"),
    )
    if carry is not None:
        found = carry.join(found, list(keys), "left")
    quantiles = found.select(*keys, *kept, "row_count", quantiles_from_hits(F.col("_hits"), F.col("row_count"), probs).alias("quantiles"))
    return with_inner_edges(quantiles, "quantiles", bins, [*keys, *kept, "row_count"])


def binned_counts(
    df: DataFrame,
    features: Sequence[str],
    batch: str = "batch",
    bins: int = 10,
    accuracy: int | None = None,
    edges: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows per bin of both batches as arrays (see :func:`bin_table`), per feature and ``by``.

    One pass over the rows counts cells; a second one reads only cells that hold a cut point. Given ``edges``, or
    cut points from a sketch (``accuracy``), rows are put into bins directly.
    """
    keys = [*by, "feature"]
    if edges is None and accuracy is not None:
        if by:
            raise ValueError("sketched cut points are made over all rows; give edges, or leave accuracy out")
        edges = reference_edges(df, features, batch, bins, accuracy)
    if edges is not None:
        return bin_table(df, features, edges, batch, bins=bins, by_columns=by)
    profile = Profile(two_batches(df, features, batch, by), keys, probabilities(bins), bounded_keys=not by)
    binned = profile.binned(_reference_cuts(profile, keys, bins).select(*keys, "edges"), bin_number)
    return _per_bin(binned, keys, bins, F.col("n_ref"), F.col("n_cur"))


def psi(
    df: DataFrame,
    features: Sequence[str],
    batch: str = "batch",
    bins: int = 10,
    epsilon: float = 1e-6,
    accuracy: int | None = None,
    edges: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, feature, psi); cut points and counts come from the same cells."""
    return binned_counts(df, features, batch, bins, accuracy, edges, by).select(*by, "feature", psi_column(epsilon).alias("psi"))


def bin_proportions(
    df: DataFrame,
    features: Sequence[str],
    batch: str = "batch",
    bins: int = 10,
    epsilon: float = 1e-6,
    edges: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, feature, bin, n and floored proportion per batch), empty bins included; bin -1 is missing."""
    counted = binned_counts(df, features, batch, bins, None, edges, by)
    slots = F.posexplode(F.arrays_zip("ref_bins", "cur_bins")).alias("_slot", "_n")
    long = counted.select(*by, "feature", "bin_count", "ref_total", "cur_total", slots)
    share = lambda n, t: F.greatest(F.try_divide(F.col(n).cast("double"), t), F.lit(epsilon))
    return long.where((F.col("_slot") - 1) < F.col("bin_count")).select(
        *by,
        "feature",
        (F.col("_slot") - 1).alias("bin"),
        F.col("_n.ref_bins").alias("reference_count"),
        F.col("_n.cur_bins").alias("current_count"),
        share("_n.ref_bins", "ref_total").alias("reference_share"),
        share("_n.cur_bins", "cur_total").alias("current_share"),
    )


def ks_pvalue(statistic: Column, n: Column, m: Column) -> Column:
    """Two-sided p-value from the Kolmogorov series at sqrt(nm/(n+m)) * D."""
    effective = F.sqrt(F.try_divide(n.cast("double") * m.cast("double"), (n + m).cast("double")))
    lam = effective * statistic
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * k.cast("double") * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).when(lam.isNotNull(), F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))


def ks(df: DataFrame, features: Sequence[str], batch: str = "batch", by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, ks_statistic, ks_pvalue, reference_count, current_count); ties of a value move together.

    The statistic is exact: cells are refined until none can hold a larger gap than the one found.
    """
    keys = [*by, "feature"]
    found = Profile(two_batches(df, features, batch, by), keys, gaps=True, bounded_keys=not by).summary()
    return found.select(
        *keys,
        _statistic().alias("ks_statistic"),
        ks_pvalue(_statistic(), F.col("ref_rows"), F.col("cur_rows")).alias("ks_pvalue"),
        F.col("ref_rows").alias("reference_count"),
        F.col("cur_rows").alias("current_count"),
    )


def _statistic() -> Column:
    return F.when((F.col("ref_rows") > 0) & (F.col("cur_rows") > 0), F.col("largest_gap"))


def drift_report(
    df: DataFrame,
    features: Sequence[str],
    score: str | None = "risk_probability",
    batch: str = "batch",
    policy: DriftPolicy = DriftPolicy(),
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per ``by`` key and feature (and one for the score): PSI, KS, statuses, means, null rates, counts.

    All keys are judged together, each with its own cut points: one pass over the rows counts cells, a second one reads only
    cells that hold a cut point or may hold the largest gap. Only counts per cell are stored.
    """
    keys, monitored = [*by, "feature"], [*features, *([score] if score else [])]
    profile = Profile(two_batches(df, monitored, batch, by), keys, probabilities(policy.bins), gaps=True, bounded_keys=not by)
    kept = ["ref_rows", "cur_rows", "ks_statistic", "reference_mean", "current_mean"]
    stats = profile.summary().select(
        *keys, "ref_rows", "cur_rows", _statistic().alias("ks_statistic"),
        F.try_divide("ref_sum", "ref_rows").alias("reference_mean"), F.try_divide("cur_sum", "cur_rows").alias("current_mean"),
    )
    cuts = _reference_cuts(profile, keys, policy.bins, stats, kept).drop("row_count")
    wide = _per_bin(profile.binned(cuts, bin_number, kept), keys, policy.bins, F.col("n_ref"), F.col("n_cur"), kept)
    named = wide.select(
        *keys,
        psi_column(policy.epsilon).alias("psi"),
        "ks_statistic",
        ks_pvalue(F.col("ks_statistic"), F.col("ref_rows"), F.col("cur_rows")).alias("ks_pvalue"),
        "reference_mean",
        "current_mean",
        F.try_divide(F.col("ref_bins")[0].cast("double"), "ref_total").alias("reference_null_rate"),
        F.try_divide(F.col("cur_bins")[0].cast("double"), "cur_total").alias("current_null_rate"),
        F.coalesce("ref_rows", F.lit(0)).alias("reference_count"),
        F.coalesce("cur_rows", F.lit(0)).alias("current_count"),
    )
    p = policy
    staged = named.withColumns(
        {
            "psi_status": st.psi_status(F.col("psi"), p.psi_warning, p.psi_critical, p.strict),
            "ks_status": st.ks_status(
                F.col("ks_statistic"), F.col("ks_pvalue"), p.ks_warning, p.ks_critical, p.alpha, p.strict
            ),
        }
    )
    position = F.array_position(F.array(*[F.lit(f) for f in monitored]), F.col("feature"))
    return staged.select(
        *keys,
        "psi",
        "psi_status",
        "ks_statistic",
        "ks_pvalue",
        "ks_status",
        st.worst([F.col("psi_status"), F.col("ks_status")], st.DRIFT_LEVELS).alias("status"),
        "reference_mean",
        "current_mean",
        "reference_null_rate",
        "current_null_rate",
        "reference_count",
        "current_count",
        position.cast("int").alias("feature_position"),
        (F.col("feature") == score).alias("is_prediction") if score else F.lit(False).alias("is_prediction"),
    )


def overall_status(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per key): worst status over all rows; feature lists in feature order, the score row left out."""

    def names(status: str) -> Column:
        kept = F.collect_list(
            F.when(
                (F.col("status") == status) & ~F.col("is_prediction"), F.struct("feature_position", "feature")
            )
        )
        return F.transform(F.array_sort(kept), lambda s: s["feature"])

    return report.groupBy(*by).agg(
        st.worst_of_group(F.col("status"), st.DRIFT_LEVELS).alias("overall_status"),
        names("CRITICAL").alias("critical_features"),
        names("WARNING").alias("warning_features"),
    )


def prediction_summary(
    df: DataFrame, score: str = "risk_probability", batch: str = "batch", threshold: float = 0.5
) -> DataFrame:
    """One row: mean risk and approval rate of both batches, and their shifts."""

    def side(name: str, value: Column) -> Column:
        return F.avg(F.when(F.col(batch) == name, value))

    ok = (F.col(score) < threshold).cast("double")
    one = df.agg(
        side(REFERENCE, F.col(score)).alias("reference_mean_risk"),
        side(CURRENT, F.col(score)).alias("current_mean_risk"),
        side(REFERENCE, ok).alias("reference_approval_rate"),
        side(CURRENT, ok).alias("current_approval_rate"),
    )
    return one.withColumns(
        {
            "mean_risk_shift": F.col("current_mean_risk") - F.col("reference_mean_risk"),
            "approval_rate_shift": F.col("current_approval_rate") - F.col("reference_approval_rate"),
        }
    )


def expectation_check(report: DataFrame, expected: DataFrame) -> DataFrame:
    """Control features must stay STABLE, required ones must be CRITICAL: one row per expectation.

    ``expected`` is (feature, expected_status), a few rows fixed by configuration.
    """
    joined = expected.join(report.select("feature", "status"), "feature", "left")
    return joined.select(
        "feature",
        "expected_status",
        "status",
        F.coalesce(F.col("status") == F.col("expected_status"), F.lit(False)).alias("passed"),
    )


def reference_profile(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """row_count, mean, sample standard deviation, min, max and null rate per feature."""
    return (
        melt(df, features, list(by))
        .groupBy(*by, "feature")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg(F.col("value").isNull().cast("double")).alias("null_rate"),
        )
    )


def windowed_psi(
    df: DataFrame,
    features: Sequence[str],
    edges: DataFrame,
    reference_shares: DataFrame,
    ts: str,
    width: str = "1 day",
    slide: str | None = None,
    bins: int = 10,
    epsilon: float = 1e-6,
    minimum_rows: int = 1,
) -> DataFrame:
    """PSI of each time window against fixed reference bins; small windows are counted, not judged.

    ``reference_shares`` is (feature, ref_bins, ref_total) as made by :func:`bin_table` on the reference.
    """
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    current = bin_table(df.withColumn("_batch", F.lit(CURRENT)), features, edges, "_batch", [win], bins)
    fixed = reference_shares.select("feature", F.col("ref_bins").alias("_fixed"), F.col("ref_total").alias("_fixed_total"))
    joined = current.join(F.broadcast(fixed), "feature")
    return joined.select(
        F.col("_by0.start").alias("window_start"),
        F.col("_by0.end").alias("window_end"),
        "feature",
        F.col("cur_total").alias("row_count"),
        F.when(F.col("cur_total") >= minimum_rows, psi_column(epsilon, "_fixed", "_fixed_total")).alias("psi"),
    )
