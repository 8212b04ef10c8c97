"""Per-row attribution of a score to features, and its roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import clean_feature_name, group_label, number


def linear_attribution(df: DataFrame, weights: Mapping[str, float], ids: Sequence[str]) -> DataFrame:
    """(ids, feature, attribution): exact additive ``w (x - mean)``; a missing value attributes nothing.

    The means are one row, read as one scalar subquery.
    """
    names = list(weights)
    means = df.agg(F.struct(*[F.avg(number(c)).alias(c) for c in names]).alias("m")).scalar()
    wide = df.select(*ids, *[number(c).alias(c) for c in names], means.alias("_m"))
    parts = wide.select(
        *ids, *[(F.coalesce(F.col(c) - F.col(f"_m.{c}"), F.lit(0.0)) * float(w)).alias(c) for c, w in weights.items()]
    )
    return parts.unpivot(list(ids), names, "feature", "attribution")


def occlusion_attribution(
    df: DataFrame,
    score_with: Callable[[DataFrame], DataFrame],
    references: Mapping[str, float | str],
    ids: Sequence[str],
    score: str = "risk_probability",
) -> DataFrame:
    """(ids, feature, attribution): change in log-odds when a feature is set to its reference value.

    All variants are scored in one pass: each row fans out to one copy per feature.
    """

    def log_odds(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0 - 1e-9))
        return F.ln(q / (1.0 - q))

    base = score_with(df).withColumn("_base", log_odds(F.col(score)))
    fanned = base.select(*df.columns, "_base", F.explode(F.array(*[F.lit(c) for c in references])).alias("feature"))
    types = dict(df.dtypes)
    replaced = fanned.withColumns(
        {c: F.when(F.col("feature") == c, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in references.items()}
    )
    again = score_with(replaced)
    return again.select(*ids, "feature", (F.col("_base") - log_odds(F.col(score))).alias("attribution"))


def stable_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """min(n, rows) rows, the same under any partitioning: the n smallest hashes of (key, seed).

    ``limit`` is the feature here; n is bounded by the caller and only n rows per task survive.
    """
    return df.orderBy(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256), key).limit(int(n))


def leaks(feature_table: DataFrame, protected: Sequence[str], model: str = "model_version") -> DataFrame:
    """(model, protected_column, feature): features whose name contains a protected column."""
    names = feature_table.select(model, clean_feature_name("feature").alias("feature")).distinct()
    each = F.explode(F.array(*[F.lit(p) for p in protected])).alias("protected_column")
    return names.select(model, each, "feature").where(F.contains(F.col("feature"), F.col("protected_column")))


def importance(attributions: DataFrame) -> DataFrame:
    """(rank, feature, mean_abs_attribution, mean_attribution); ties by feature name."""
    found = attributions.groupBy("feature").agg(
        F.avg(F.abs("attribution")).alias("mean_abs_attribution"), F.avg("attribution").alias("mean_attribution")
    ).withColumn("_scope", F.lit("features"))
    rank = F.row_number().over(Window.partitionBy("_scope").orderBy(F.desc("mean_abs_attribution"), "feature"))
    return found.select(rank.alias("rank"), "feature", "mean_abs_attribution", "mean_attribution")


def group_importance(attributions: DataFrame, group: str) -> DataFrame:
    """(group, feature, sample_count, means, rank_within_group)."""
    found = attributions.groupBy(group_label(group).alias("group"), "feature").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.abs("attribution")).alias("mean_abs_attribution"),
        F.avg("attribution").alias("mean_attribution"),
    )
    w = Window.partitionBy("group").orderBy(F.desc("mean_abs_attribution"), "feature")
    return found.withColumn("rank_within_group", F.row_number().over(w))


def group_delta(per_group: DataFrame, overall: DataFrame, primary: str) -> DataFrame:
    """Mean signed attribution of the primary group against everyone, per feature."""
    mine = per_group.where(F.col("group") == primary)
    all_rows = overall.select("feature", F.col("mean_attribution").alias("overall_mean_attribution"))
    return mine.join(all_rows, "feature").withColumn(
        "delta_mean_attribution", F.col("mean_attribution") - F.col("overall_mean_attribution")
    )


def top_positive_features(per_group: DataFrame, primary: str, k: int = 10) -> DataFrame:
    return (
        per_group.where(F.col("group") == primary)
        .orderBy(F.desc("mean_attribution"), "feature")
        .limit(int(k))
        .select("feature", "mean_attribution")
    )


def local_examples(
    df: DataFrame, attributions: DataFrame, group: str, primary: str, *, key: str = "application_id",
    score: str = "risk_probability", examples: int = 3, top_k: int = 10,
) -> DataFrame:
    """(key, score, rank, feature, attribution): top contributions of the riskiest rows of a group.

    The few example rows are picked first; only their attributions are ranked.
    """
    chosen = (
        df.where(group_label(group) == primary).orderBy(F.desc(score), key).limit(int(examples)).select(key, score)
    )
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("attribution")), "feature")
    mine = attributions.select(key, "feature", "attribution").join(F.broadcast(chosen), key)
    return mine.withColumn("contribution_rank", F.row_number().over(w)).where(F.col("contribution_rank") <= top_k)
