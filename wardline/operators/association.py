"""Association of features with protected groups, and the proxy-risk review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import group_label
from wardline.operators.drift import melt


def supported_rows(df: DataFrame, group: str, minimum: int, batch: str = "batch") -> DataFrame:
    """Rows whose group has at least ``minimum`` rows in its batch."""
    label = group_label(group)
    keep = df.groupBy(batch, label.alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return df.withColumn("_g", label).join(keep.drop("_n"), [batch, "_g"], "left_semi").drop("_g")


def eta_squared(
    df: DataFrame, features: Sequence[str], group: str, batch: str = "batch", minimum_group_size: int = 1
) -> DataFrame:
    """(batch, feature, association) in [0, 1]; 0 with fewer than two groups or no variance.

    One aggregate per (feature, group): the support rule is a filter on its own row count, not a join.
    """
    rows = melt(df.withColumn("_group", group_label(group)), features, [batch, "_group"])
    per_group = rows.groupBy(batch, "feature", "_group").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("value").alias("_n"),
        F.avg("value").alias("_mean"),
        F.var_pop("value").alias("_var"),
    ).where((F.col("_rows") >= minimum_group_size) & (F.col("_n") > 0))
    whole = Window.partitionBy(batch, "feature")
    centred = per_group.withColumn(
        "_overall", F.sum(F.col("_n") * F.col("_mean")).over(whole) / F.sum("_n").over(whole)
    )
    gap = F.col("_mean") - F.col("_overall")
    found = centred.groupBy(batch, "feature").agg(
        F.count(F.lit(1)).alias("_groups"),
        F.sum(F.col("_n") * gap * gap).alias("_between"),
        F.sum(F.col("_n") * F.col("_var")).alias("_within"),
    )
    ratio = F.try_divide(F.col("_between"), F.col("_between") + F.col("_within"))
    return found.select(
        batch, "feature",
        F.when((F.col("_groups") < 2) | ratio.isNull(), 0.0).otherwise(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).alias("association"),
    )


def cramers_v(
    df: DataFrame, features: Sequence[str], group: str, batch: str = "batch", minimum_group_size: int = 1
) -> DataFrame:
    """(batch, feature, association), no continuity or bias correction; 0 if a side has one level.

    chi2 = n (sum o^2/(r c) - 1), which also accounts for cells without rows. Rows are counted once per (group, level);
    the sums per group and per level are grouped sums over those counts, joined back: no window holds a group or a level.
    """
    wide = df.select(batch, group_label(group).alias("_group"), *[group_label(c).alias(c) for c in features])
    cells = (
        wide.unpivot([batch, "_group"], list(features), "feature", "level")
        .groupBy(batch, "feature", "_group", "level")
        .agg(F.count(F.lit(1)).alias("_o"))
    )
    by_group, by_level, whole = [batch, "feature", "_group"], [batch, "feature", "level"], [batch, "feature"]
    rows = cells.groupBy(*by_group).agg(F.sum("_o").alias("_r")).where(F.col("_r") >= minimum_group_size)
    sized = cells.join(rows, by_group)
    columns = sized.groupBy(*by_level).agg(F.sum("_o").alias("_c"))
    o = F.col("_o").cast("double")
    sums = sized.join(columns, by_level).groupBy(*whole).agg(F.sum(o * o / (F.col("_r").cast("double") * F.col("_c"))).alias("_s"))
    found = (
        sums.join(rows.groupBy(*whole).agg(F.count(F.lit(1)).alias("_rows")), whole)
        .join(columns.groupBy(*whole).agg(F.count(F.lit(1)).alias("_cols")), whole)
    )
    side = F.least("_rows", "_cols") - 1
    v = F.sqrt(F.greatest(F.col("_s") - 1.0, F.lit(0.0)) / F.when(side > 0, side))
    return found.select(batch, "feature", F.coalesce(v, F.lit(0.0)).alias("association"))


def association_pairs(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], group: str, batch: str = "batch", minimum_group_size: int = 1
) -> DataFrame:
    """(feature, feature_type, feature_position, reference/current association, delta)."""
    parts = []
    if numeric:
        parts.append(eta_squared(df, numeric, group, batch, minimum_group_size).withColumn("feature_type", F.lit("numeric")))
    if categorical:
        parts.append(cramers_v(df, categorical, group, batch, minimum_group_size).withColumn("feature_type", F.lit("categorical")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def side(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col(batch) == name, F.col("association"))), F.lit(0.0))

    order = F.array(*[F.lit(f) for f in [*numeric, *categorical]])
    return both.groupBy("feature", "feature_type").agg(
        side("reference").alias("reference_association"), side("current").alias("current_association")
    ).withColumns(
        {
            "association_delta": F.col("current_association") - F.col("reference_association"),
            "feature_position": F.array_position(order, F.col("feature")).cast("int"),
        }
    )


def raw_feature_influence(features: DataFrame, importance: DataFrame) -> DataFrame:
    """Influence of a raw feature: its own row if numeric, the sum of its one-hot columns if categorical.

    Both sides have one row per feature. A numeric feature matches exactly, so its missing indicator is
    not counted.
    """
    imp = importance.select(F.col("feature").alias("column_name"), "mean_abs_attribution")
    match = F.when(F.col("feature_type") == "numeric", F.col("column_name") == F.col("feature")).otherwise(
        F.startswith(F.col("column_name"), F.concat(F.col("feature"), F.lit("_")))
    )
    pairs = features.select("feature", "feature_type").join(imp, match, "left")
    return pairs.groupBy("feature").agg(F.coalesce(F.sum("mean_abs_attribution"), F.lit(0.0)).alias("model_influence"))


def proxy_risk(
    pairs: DataFrame, influence: DataFrame, *, minimum_delta: float = 0.001, top_influence: int = 8
) -> DataFrame:
    """One row per feature with its two ranks and the review flag; ties go by listing order."""
    joined = pairs.join(influence, "feature").withColumn("_scope", F.lit("features"))
    # One row per configured feature: the window is as small as the feature list.
    scope = Window.partitionBy("_scope")
    ranked = joined.withColumns(
        {
            "association_rank": F.row_number().over(scope.orderBy(F.desc("association_delta"), "feature_position")),
            "model_influence_rank": F.row_number().over(scope.orderBy(F.desc("model_influence"), "feature_position")),
        }
    ).drop("_scope")
    return ranked.withColumn(
        "review_priority",
        (F.col("association_delta") >= minimum_delta) & (F.col("model_influence_rank") <= top_influence),
    )


def review_lists(signals: DataFrame, top_association: int = 5) -> DataFrame:
    """One row: review-priority features and the top associations, in association order."""

    def listed(cond: Column) -> Column:
        kept = F.collect_list(F.when(cond, F.struct("association_rank", "feature")))
        return F.transform(F.array_sort(kept), lambda s: s["feature"])

    return signals.agg(
        listed(F.col("review_priority")).alias("review_priority_features"),
        listed(F.col("association_rank") <= top_association).alias("top_association_features"),
    )
