"""What-if transforms and the 2x2 root-cause ablation.

Shifts and noise are row-wise expressions, so the four scenarios are four columns of one row: no join is
needed to align them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import affine_shift, gaussian, uniform01
from wardline.operators import metrics
from wardline.operators.cumulative import exact_quantiles, running_counts, value_cell
from wardline.sources.tables import stored

SCENARIOS = ("healthy", "semantic_only", "missingness_only", "combined")


@dataclass(frozen=True)
class Shift:
    column: str
    shift: float = 0.0
    lo: float = 0.0
    hi: float = 1.0
    center: float = 0.0
    scale: float = 1.0
    noise_std: float = 0.0


def _keyed(key: str, seed: int, salt: str) -> Column:
    return F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), F.lit(salt))


def shifted_column(s: Shift, key: str | None = None, seed: int = 42) -> Column:
    noise = None
    if s.noise_std:
        if key is None:
            raise ValueError("Noise needs a key column")
        noise = gaussian(_keyed(key, seed, s.column)) * s.noise_std
    return affine_shift(s.column, shift=s.shift, lo=s.lo, hi=s.hi, center=s.center, scale=s.scale, noise=noise)


def shift(df: DataFrame, shifts: Sequence[Shift], key: str | None = None, seed: int = 42, where: Column | None = None) -> DataFrame:
    """Shift columns of all rows, or only of the rows matching ``where``."""
    out = {s.column: shifted_column(s, key, seed) for s in shifts}
    if where is not None:
        out = {c: F.when(where, v).otherwise(F.col(c)) for c, v in out.items()}
    return df.withColumns(out)


def require_group(df: DataFrame, where: Column) -> DataFrame:
    """One row; fails the query when no row matches the stressed group."""
    n = F.count_if(where)
    return df.agg(F.when(n > 0, n).otherwise(F.raise_error(F.lit("0 rows match the condition")).cast("long")).alias("group_rows"))


def missing_weight(x: Column) -> Column:
    """0.2 + 2.8 * score^2, the score clipped to [0, 1]."""
    s = F.when(x < 0.0, 0.0).when(x > 1.0, 1.0).otherwise(x)
    return 0.20 + s * s * 2.80


def kth_smallest(df: DataFrame, keys: Sequence[str], value: str, key: str, sizes: DataFrame) -> DataFrame:
    """(keys, cut_value, cut_key): the k-th smallest value per key, ties broken by the row key's text.

    ``sizes`` is (keys, k), one row per key; k = 0 gives no row. Ranks are located from cell counts, and
    only the one cell that holds the rank is looked at again. Nothing is sorted whole, and the k rows are
    never gathered.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), F.col(key).cast("string").alias("_key")
    ).withColumn("_band", value_cell(F.col("_v"), 4096))
    upto = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)
    bands = rows.groupBy(*keys, "_band").agg(F.count(F.lit(1)).alias("_m")).withColumn("_end", F.sum("_m").over(upto))
    start = F.col("_end") - F.col("_m")
    target = bands.join(sizes, keys).where((F.col("_end") >= F.col("k")) & (start < F.col("k"))).select(
        *keys, "_band", (F.col("k") - start).alias("_need")
    )
    inside = stored(rows.join(target, [*keys, "_band"]), "cut-cell")
    counted = inside.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"), F.any_value("_need").alias("_need"))
    at = running_counts(counted, keys, "_v", ["_n"], store=False).where(
        (F.col("cum__n") >= F.col("_need")) & (F.col("cum__n") - F.col("_n") < F.col("_need"))
    ).select(*keys, "_v", (F.col("_need") - F.col("cum__n") + F.col("_n")).alias("_place"))
    # Equal values come from equal hashes, so this group is the copies of one row key.
    tied = inside.drop("_need").join(at, [*keys, "_v"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys, "_v").orderBy("_key"))
    )
    return tied.where(F.col("_r") == F.col("_place")).select(
        *keys, F.col("_v").alias("cut_value"), F.col("_key").alias("cut_key")
    )


def weighted_null_mask(
    df: DataFrame, column: str, target_rate: float, key: str = "application_id", seed: int = 42, output: str = "newly_missing"
) -> DataFrame:
    """Flag exactly ``round(n*rate) - already missing`` rows, drawn without replacement by weight.

    Each row gets the draw ``-ln(u)/w``, u a hash of its id; the k smallest draws win. The largest winning draw is found when this
    is called, so a plan that uses the mask several times does not search for it again.
    """
    draw = F.when(F.col(column).isNotNull(), -F.ln(uniform01(_keyed(key, seed, "missing"))) / missing_weight(F.col(column)))
    keyed = df.withColumns({"_draw": draw, "_all": F.lit(1)})
    wanted = F.bround(F.count(F.lit(1)) * F.lit(float(target_rate))).cast("long") - F.count_if(F.col(column).isNull())
    sizes = keyed.groupBy("_all").agg(F.greatest(wanted, F.lit(0)).alias("k"))
    cut = kth_smallest(keyed, ["_all"], "_draw", key, sizes).first()  # one row, read once
    if cut is None:
        return keyed.withColumn(output, F.lit(False)).drop("_draw", "_all")
    value, last = F.lit(cut["cut_value"]), F.lit(cut["cut_key"])
    below = F.col("_draw") < value
    tied = (F.col("_draw") == value) & (F.col(key).cast("string") <= last)
    return keyed.withColumn(output, F.coalesce(below | tied, F.lit(False))).drop("_draw", "_all")


def stratified_split(
    df: DataFrame, target: str, test_size: float = 0.30, key: str = "application_id", seed: int = 42
) -> DataFrame:
    """Add ``split``: exactly ``round(test_size * class size)`` rows of each class are ``holdout``.

    Membership is a function of the row key and the seed, so it survives repartitioning and retries.
    """
    # a NULL class is a class: it is cut under a name of its own
    keyed = df.withColumn("_u", uniform01(_keyed(key, seed, "split"))).withColumn("_class", F.coalesce(F.to_json(F.struct(target)), F.lit("null")))
    sizes = keyed.groupBy("_class").agg(F.round(F.count(F.lit(1)) * F.lit(float(test_size))).cast("long").alias("k"))
    cuts = kth_smallest(keyed, ["_class"], "_u", key, sizes)
    joined = keyed.join(cuts, "_class", "left")
    held = (F.col("_u") < F.col("cut_value")) | (
        (F.col("_u") == F.col("cut_value")) & (F.col(key).cast("string") <= F.col("cut_key"))
    )
    return joined.withColumn("split", F.when(F.coalesce(held, F.lit(False)), "holdout").otherwise("train")).drop(
        "_u", "_class", "cut_value", "cut_key"
    )


def ablation(
    df: DataFrame,
    semantic: Shift,
    *,
    target_rate: float = 0.22,
    key: str = "application_id",
    seed: int = 42,
) -> DataFrame:
    """Four rows per record: (scenario, semantic_factor, missing_factor, column replaced).

    semantic_only keeps the natural missingness; missingness_only reuses the mask of combined.
    """
    column = semantic.column
    masked = weighted_null_mask(df, column, target_rate, key, seed)
    return ablation_from_mask(masked, semantic, key=key, seed=seed, mask="newly_missing")


def ablation_from_mask(df: DataFrame, semantic: Shift, *, key: str, seed: int = 42, mask: str = "newly_missing") -> DataFrame:
    column = semantic.column
    moved = shifted_column(semantic, key, seed)
    keep = ~F.col(mask)
    cases = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), value.alias("value"))
            for name, value in zip(
                SCENARIOS, (F.col(column), moved, F.when(keep, F.col(column)), F.when(keep, moved))
            )
        ]
    )
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.col(column).alias("healthy_value"), moved.alias("semantic_value"), F.inline(cases)).withColumnRenamed(
        "value", column
    )


def transfer_mask(df: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """NULL where the other batch is NULL, by key."""
    mask = other.select(key, F.col(column).isNull().alias("_gone"))
    return df.join(mask, key, "left").withColumn(column, F.when(~F.coalesce("_gone", F.lit(False)), F.col(column))).drop("_gone")


def ablation_invariants(frames: DataFrame, key: str, column: str, label: str = "default_30d") -> DataFrame:
    """One row of verdicts: four scenarios per key, labels kept, and the two masks as designed."""
    s, gone = F.col("scenario"), F.col(column).isNull()

    def at(name: str, c: Column) -> Column:
        return F.max(F.when(s == name, c))

    per_key = frames.groupBy(key).agg(
        F.count_distinct(s).alias("scenarios"),
        F.count(F.lit(1)).alias("rows"),
        (F.min(label).eqNullSafe(F.max(label))).alias("label_kept"),
        *[at(n, gone.cast("int")).alias(n) for n in SCENARIOS],
    )
    return per_key.agg(
        F.bool_and((F.col("scenarios") == 4) & (F.col("rows") == 4)).alias("same_population"),
        F.bool_and("label_kept").alias("same_labels"),
        F.bool_and(F.col("semantic_only") == F.col("healthy")).alias("semantic_keeps_missingness"),
        F.bool_and(F.col("missingness_only") == F.col("combined")).alias("mask_shared"),
    )


def root_cause_metrics(
    frames: DataFrame,
    *,
    key: str = "application_id",
    scenario: str = "scenario",
    baseline_score: str = "healthy_probability",
    label: str = "default_30d",
    score: str = "risk_probability",
    watched: str = "device_risk_score",
    threshold: float = 0.5,
) -> DataFrame:
    """Thirteen fields per scenario: ranking and decision metrics, and flips against the healthy score.

    ``baseline_score`` is a column of the same row, so flips need no join. One pass over the rows makes
    counts per (scenario, distinct score); every field comes from those.
    """
    was, now = F.col(baseline_score) < threshold, F.col(score) < threshold
    counts = metrics.score_counts(
        frames, [scenario], label, score,
        [
            F.count_if(F.col(watched).isNull()).alias("gone"),
            F.count_if(~was & now).alias("fresh"),
            F.count_if(was & ~now).alias("lost"),
        ],
    )
    running = running_counts(counts, [scenario], "_score", ["pos", "neg"])
    p, pos, neg = F.col("_score"), F.col("pos"), F.col("neg")
    rows, ok = F.sum(pos + neg), p < threshold
    found = running.groupBy(scenario).agg(
        rows.alias("sample_count"),
        (F.sum(pos * (p - 1.0) * (p - 1.0) + neg * p * p) / rows).alias("brier_score"),
        (F.coalesce(F.sum(F.when(ok, pos + neg)), F.lit(0)) / rows).alias("approval_rate"),
        F.try_divide(F.sum(F.when(ok, pos)).cast("double"), F.sum(F.when(ok, pos + neg))).alias("approved_default_rate"),
        (F.sum(p * (pos + neg)) / rows).alias("mean_predicted_risk"),
        (F.sum("gone") / rows).alias("device_risk_null_rate"),
        F.sum("fresh").alias("newly_approved_count"),
        F.sum("lost").alias("newly_rejected_count"),
        *metrics.ranking_aggregates(),
    )
    flips = F.col("newly_approved_count") + F.col("newly_rejected_count")
    return found.select(
        scenario, "sample_count", *metrics.ranking_columns(), "brier_score", "approval_rate", "approved_default_rate",
        "mean_predicted_risk", "device_risk_null_rate", flips.alias("decision_flip_count"),
        (flips / F.col("sample_count")).alias("decision_flip_rate"), "newly_approved_count", "newly_rejected_count",
    )


def factorial_effects(f00: Column, f10: Column, f01: Column, f11: Column) -> dict[str, Column]:
    """Two-factor average main effects and the interaction."""
    return {
        "semantic_main_effect": ((f10 - f00) + (f11 - f01)) / 2.0,
        "missingness_main_effect": ((f01 - f00) + (f11 - f10)) / 2.0,
        "interaction_effect": f11 - f10 - f01 + f00,
    }


def factorial_table(table: DataFrame, columns: Sequence[str], scenario: str = "scenario") -> DataFrame:
    """One row per metric from a table of four scenario rows."""
    long = table.select(scenario, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [scenario], list(columns), "metric", "value"
    )

    def at(name: str) -> Column:
        return F.max(F.when(F.col(scenario) == name, F.col("value")))

    wide = long.groupBy("metric").agg(*[at(n).alias(n) for n in SCENARIOS])
    healthy, semantic, missing, combined = (F.col(n) for n in SCENARIOS)
    return wide.select("metric", *[v.alias(n) for n, v in factorial_effects(healthy, semantic, missing, combined).items()])


def newly_missing_profile(frames: DataFrame, median: DataFrame, scenario: str = "scenario", mask: str = "newly_missing") -> DataFrame:
    """One row over the combined rows: newly missing count, mean under each semantics, gap to the fill value.

    ``median`` is one row with one column, read once when this is called.
    """
    rows = frames.where((F.col(scenario) == "combined") & F.col(mask))
    fill = F.lit(median.first()[0]).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("newly_missing_count"),
        F.avg("semantic_value").alias("semantic_reference_mean"),
        F.avg("healthy_value").alias("healthy_reference_mean"),
    ).withColumns(
        {"fitted_median": fill, "semantic_reference_minus_median": F.col("semantic_reference_mean") - fill}
    )


def fill_values(train: DataFrame, column: str, quantiles: Sequence[float]) -> DataFrame:
    """(candidate, quantile, replacement_value): exact training quantiles, one row each."""
    names = [f"training_q{round(q * 100)}" for q in quantiles]
    one = exact_quantiles(train, [], column, list(quantiles))
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("candidate"), F.lit(float(q)).alias("quantile"), F.col("quantiles")[i].alias("replacement_value"))
            for i, (n, q) in enumerate(zip(names, quantiles))
        ]
    )
    return one.select(F.inline(pairs))


def remediation_rows(
    combined: DataFrame, train: DataFrame, column: str, quantiles: Sequence[float], *,
    mask: str = "newly_missing", true_value: str = "semantic_value",
) -> DataFrame:
    """Candidates times rows: every training quantile, the median control, and the oracle restore.

    Adds ``candidate`` and ``fill``, the value a missing row is scored with; the row keeps its indicator.
    Quantiles are read once when this is called, so the fan-out is a local ``explode``, not a join.
    """
    probs = [0.5, *quantiles]
    found = exact_quantiles(train, [], column, probs, names=[f"v{i}" for i in range(len(probs))])
    row = found.first()
    values = [F.lit(row[f"v{i}"]).cast("double") for i in range(len(probs))]
    cases = [F.struct(F.lit("median_control").alias("candidate"), values[0].alias("fill"))]
    cases.append(
        F.struct(
            F.lit("oracle_semantic_restore").alias("candidate"),
            F.when(F.col(mask), F.col(true_value)).otherwise(values[0]).alias("fill"),
        )
    )
    cases += [
        F.struct(F.lit(f"training_q{round(q * 100)}").alias("candidate"), v.alias("fill"))
        for q, v in zip(quantiles, values[1:])
    ]
    return combined.select("*", F.inline(F.array(*cases)))


def delta_vs(table: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each metric minus the baseline's (one row), added as ``<metric>_delta``."""
    return table.withColumns({f"{c}_delta": F.col(c) - baseline.select(c).scalar() for c in columns})

