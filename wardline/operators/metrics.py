"""Classification metrics, per segment, tie-correct, from running counts over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalar import group_label, score_valid
from wardline.operators.cumulative import running_counts


def _keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df.withColumns({c: group_label(c) for c in by}), list(by)
    return df.withColumn("_all", F.lit("all")), ["_all"]


def scored_rows(df: DataFrame, label: str = "default_30d", score: str = "risk_probability", strict: bool = False) -> DataFrame:
    """Rows with a label and a finite score in [0, 1]: the only ones that rates and metrics may count.

    ``strict`` fails the job at the first other row; :func:`left_out` counts them.
    """
    good = score_valid(score) & F.col(label).isNotNull()
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.lit(f"a row has no {label} or no valid {score}")).cast("boolean"))
    return df.where(good)


def left_out(df: DataFrame, by: Sequence[str] = (), label: str = "default_30d", score: str = "risk_probability") -> DataFrame:
    """Per segment: rows, rows without a label, rows without a valid score, rows that metrics leave out."""
    keyed, keys = _keys(df, by)
    bare, unscored = F.col(label).isNull(), ~score_valid(score)
    counted = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(bare).alias("unlabelled"), F.count_if(unscored).alias("unscored"),
        F.count_if(bare | unscored).alias("left_out"),
    )
    return counted if by else counted.drop("_all")


def score_counts(df: DataFrame, by: Sequence[str], label: str, score: str, extra: Sequence[Column] = ()) -> DataFrame:
    """(segment, score, pos, neg, extra): distinct scores only, combined map-side."""
    y = F.col(label).cast("int")
    return (
        scored_rows(df, label, score)
        .groupBy(*by, F.col(score).cast("double").alias("_score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), *extra)
    )


def ranking_aggregates() -> list[Column]:
    """Aggregates over running counts of ``pos`` and ``neg``, finished by :func:`ranking_columns`.

    AUC counts half of each tie; average precision is the step sum over distinct scores, from the top.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    below = F.col("cum_neg").cast("double") - neg
    top_pos = (F.col("total_pos") - F.col("cum_pos") + F.col("pos")).cast("double")
    top_neg = (F.col("total_neg") - F.col("cum_neg") + F.col("neg")).cast("double")
    return [
        F.sum(pos * (below + neg / 2.0)).alias("_wins"),
        F.sum(F.try_divide(pos * top_pos, top_pos + top_neg)).alias("_steps"),
        F.any_value("total_pos").alias("_p"),
        F.any_value("total_neg").alias("_n"),
    ]


def ranking_columns() -> list[Column]:
    return [
        F.try_divide(F.col("_wins"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        F.try_divide(F.col("_steps"), F.col("_p")).alias("pr_auc"),
    ]


def ranking_metrics(
    df: DataFrame, by: Sequence[str] = (), label: str = "default_30d", score: str = "risk_probability", bounded: bool = False
) -> DataFrame:
    """ROC-AUC and average precision per segment."""
    keyed, keys = _keys(df, by)
    running = running_counts(
        score_counts(keyed, keys, label, score), keys, "_score", ["pos", "neg"], bounded_keys=bounded or not by
    )
    return running.groupBy(*keys).agg(*ranking_aggregates()).select(*by, *ranking_columns())


def threshold_aggregates(label: str = "default_30d", score: str = "risk_probability", threshold: float = 0.5) -> list[Column]:
    y, p = F.col(label).cast("int"), F.col(score).cast("double")
    flag = p >= threshold
    return [
        F.count_if(~flag & (y == 0)).alias("tn"),
        F.count_if(flag & (y == 0)).alias("fp"),
        F.count_if(~flag & (y == 1)).alias("fn"),
        F.count_if(flag & (y == 1)).alias("tp"),
        F.count(F.lit(1)).alias("n_samples"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg(flag.cast("double")).alias("predicted_positive_rate"),
        F.avg(y.cast("double")).alias("target_rate"),
    ]


def _ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def threshold_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "default_30d",
    score: str = "risk_probability",
    threshold: float = 0.5,
    watched: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Confusion counts, precision, recall, F1 (0 when undefined), Brier, rates: one aggregate over :func:`scored_rows`."""
    keyed, keys = _keys(scored_rows(df, label, score, strict), by)
    extra = [F.avg(F.col(watched).isNull().cast("double")).alias("watched_null_rate")] if watched else []
    counted = keyed.groupBy(*keys).agg(*threshold_aggregates(label, score, threshold), *extra)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns(
        {
            "precision": _ratio0(tp, tp + fp),
            "recall": _ratio0(tp, tp + fn),
            "f1": _ratio0(2 * tp, 2 * tp + fp + fn),
        }
    ).drop(*([] if by else ["_all"]))


def classification_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "default_30d",
    score: str = "risk_probability",
    threshold: float = 0.5,
    watched: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """All metrics per segment (or one row), from one pass over the rows.

    Rows without a score or label are left out. Counts per distinct score carry everything the threshold
    metrics need, so they are the only table the rest works on.
    """
    keyed, keys = _keys(df, by)
    gone = [F.count_if(F.col(watched).isNull()).alias("gone")] if watched else []
    running = running_counts(
        score_counts(keyed, keys, label, score, gone), keys, "_score", ["pos", "neg"], bounded_keys=bounded or not by
    )
    p, pos, neg = F.col("_score"), F.col("pos"), F.col("neg")
    flag, rows = p >= threshold, F.sum(pos + neg)

    def total(cond: Column, n: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    counted = running.groupBy(*keys).agg(
        total(~flag, neg).alias("tn"),
        total(flag, neg).alias("fp"),
        total(~flag, pos).alias("fn"),
        total(flag, pos).alias("tp"),
        rows.alias("n_samples"),
        (F.sum(pos * (p - 1.0) * (p - 1.0) + neg * p * p) / rows).alias("brier_score"),
        *([(F.sum("gone").cast("double") / rows).alias("watched_null_rate")] if watched else []),
        *ranking_aggregates(),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    n = F.col("n_samples")
    return counted.select(
        *by, "tn", "fp", "fn", "tp", "n_samples", "brier_score",
        ((tp + fp).cast("double") / n).alias("predicted_positive_rate"),
        ((tp + fn).cast("double") / n).alias("target_rate"),
        *(["watched_null_rate"] if watched else []),
        _ratio0(tp, tp + fp).alias("precision"),
        _ratio0(tp, tp + fn).alias("recall"),
        _ratio0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        *ranking_columns(),
        F.lit(float(threshold)).alias("decision_threshold"),
    )


def prediction_table(df: DataFrame, key: str = "application_id", label: str = "default_30d", score: str = "risk_probability") -> DataFrame:
    return df.select(key, F.col(label).cast("int").alias("y_true"), F.col(score).alias("probability"))


def roc_points(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "default_30d",
    score: str = "risk_probability",
    points: int | None = None,
) -> DataFrame:
    """(threshold, fpr, tpr) from the top score down, whole; ``points`` asks for a curve thinned by false-positive rate.

    Thinning keeps, per segment and slice of fpr, the lowest threshold: a map-side aggregate, not a sort.
    """
    keyed, keys = _keys(df, by)
    running = running_counts(score_counts(keyed, keys, label, score), keys, "_score", ["pos", "neg"], bounded_keys=not by)
    tpr = F.try_divide((F.col("total_pos") - F.col("cum_pos") + F.col("pos")).cast("double"), F.col("total_pos"))
    fpr = F.try_divide((F.col("total_neg") - F.col("cum_neg") + F.col("neg")).cast("double"), F.col("total_neg"))
    curve = running.select(*keys, F.col("_score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    if points is not None:
        slot = F.floor(F.col("fpr") * points)
        curve = (
            curve.groupBy(*keys, slot.alias("_slot"))
            .agg(F.min_by(F.struct("threshold", "fpr", "tpr"), "threshold").alias("_p"))
            .select(*keys, "_p.*")
        )
    return curve if by else curve.drop("_all")


def compare_scenarios(metrics: DataFrame, scenario: str, before: str, after: str, columns: Sequence[str]) -> DataFrame:
    """One row: before, after and change of every metric."""

    def at(c: str, name: str) -> Column:
        return F.max(F.when(F.col(scenario) == name, F.col(c)))

    wide = metrics.agg(*[at(c, n).alias(f"{c}_{k}") for c in columns for k, n in (("before", before), ("after", after))])
    return wide.withColumns({f"{c}_change": F.col(f"{c}_after") - F.col(f"{c}_before") for c in columns})


def missingness_by_scenario(df: DataFrame, scenario: str, columns: Sequence[str]) -> DataFrame:
    wide = df.groupBy(scenario).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([scenario], list(columns), "column_name", "null_rate")


