"""Imputation, encoding, gradient-boosted scoring and counterfactual rescoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.scalar import decide, engineered_features, number
from wardline.operators import boosting
from wardline.operators.cumulative import exact_quantiles
from wardline.sources.tables import stored

ENGINEERED = ("utilization_x_dti", "income_per_open_account", "history_to_age_ratio")


@dataclass(frozen=True)
class Preprocess:
    """Fitted fill values: small maps, one entry per feature."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    indicators: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [f"{c}_filled" for c in self.numeric] + [f"{c}_missing" for c in self.indicators]

    def apply(self, df: DataFrame, override: dict[str, Column] | None = None) -> DataFrame:
        """Filled values and missing indicators as columns.

        ``override`` replaces the filled value on missing rows only; the indicator stays.
        """
        override = override or {}
        out: dict[str, Column] = {}
        for c in self.numeric:
            x = number(c)
            fill = F.coalesce(override[c].cast("double"), F.lit(self.medians[c])) if c in override else F.lit(self.medians[c])
            out[f"{c}_filled"] = F.coalesce(x, fill)
            if c in self.indicators:
                out[f"{c}_missing"] = x.isNull().cast("double")
        for c in self.categorical:
            out[f"{c}_filled"] = F.coalesce(F.col(c), F.lit(self.modes[c]))
        return df.withColumns(out)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, row_count, median): exact, interpolated."""
    long = df.select(*[number(c).alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    return exact_quantiles(long, ["feature"], "value", [0.5], names=["median"])


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mode): most frequent level, ties to the smallest text."""
    long = df.select(*columns).unpivot([], list(columns), "feature", "level").where(F.col("level").isNotNull())
    counted = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy("feature").agg(F.max("n").alias("n"))
    return counted.join(top, ["feature", "n"]).groupBy("feature").agg(F.min("level").alias("mode"))


def fit_preprocess(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preprocess:
    """Fitting reads back one number per feature; the rows stay in Spark."""
    filled = {r["feature"]: r["median"] for r in medians(df, numeric).collect()}
    common = {r["feature"]: r["mode"] for r in modes(df, categorical).collect()} if categorical else {}
    gone = df.agg(*[F.count_if(number(c).isNull()).alias(c) for c in numeric]).first()
    return Preprocess(
        tuple(numeric), tuple(categorical), {c: float(filled[c]) for c in numeric}, common,
        tuple(c for c in numeric if gone[c] > 0),
    )


@dataclass(frozen=True)
class Scorer:
    preprocess: Preprocess
    levels: tuple[tuple[str, str], ...]
    trees: boosting.Trees
    engineered: bool = True
    name: str = "default_risk"
    version: str = "1"

    def score(self, df: DataFrame, threshold: float = 0.5, override: dict[str, Column] | None = None) -> DataFrame:
        """Add risk_probability, predicted_default, approved, and the model's name and version."""
        drop = {*self.preprocess.columns, *(f"{c}_filled" for c in self.preprocess.categorical), *(ENGINEERED if self.engineered else ())}
        ready = self.preprocess.apply(engineered_features(df) if self.engineered else df, override)
        inputs = [F.col(c) for c in self.preprocess.columns] + list(_hot(self.levels).values())
        scored = ready.withColumn("risk_probability", self.trees.probability(inputs))
        keep = [c for c in df.columns if c not in ("risk_probability", "model_name", "model_version") and c not in drop]
        named = {"model_name": F.lit(self.name), "model_version": F.lit(self.version)}
        return decide(scored.select(*keep, "risk_probability"), threshold=threshold).withColumns(named)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        p, t = self.preprocess, self.trees

        def write(rows: list[tuple], schema: str, part: str) -> None:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}")

        rows = [("numeric", c, float(p.medians[c]), None, c in p.indicators, i) for i, c in enumerate(p.numeric)]
        rows += [("categorical", c, None, p.modes[c], False, i) for i, c in enumerate(p.categorical)]
        write(rows, "kind string, name string, median double, mode string, indicator boolean, position int", "preprocess")
        write([(self.name, self.version, self.engineered)], "name string, version string, engineered boolean", "head")
        write([(i, *level) for i, level in enumerate(self.levels)], "position int, column string, level string", "levels")
        write([(i, e.tolist()) for i, e in enumerate(t.edges)], "position int, edges array<double>", "edges")
        trees = [(i, *(x.tolist() for x in tree)) for i, tree in enumerate(zip(t.feature, t.cut, t.value))]
        write(trees, "position int, feature array<int>, cut array<int>, value array<double>", "trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        preprocess, levels, edges, trees = (
            sorted(spark.read.parquet(f"{path}/{part}").collect(), key=lambda r: r["position"]) for part in ("preprocess", "levels", "edges", "trees")
        )
        num = [r for r in preprocess if r["kind"] == "numeric"]
        cat = [r for r in preprocess if r["kind"] == "categorical"]
        prep = Preprocess(
            tuple(r["name"] for r in num), tuple(r["name"] for r in cat), {r["name"]: r["median"] for r in num},
            {r["name"]: r["mode"] for r in cat}, tuple(r["name"] for r in num if r["indicator"]),
        )
        head = spark.read.parquet(f"{path}/head").first()
        fitted = boosting.Trees(tuple(np.array(r["edges"]) for r in edges), *[np.array([r[c] for r in trees]) for c in ("feature", "cut", "value")])
        return cls(prep, tuple((r["column"], r["level"]) for r in levels), fitted, head["engineered"], head["name"], head["version"])


def _hot(levels: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """One 0/1 column per level of the filled categories; an unknown level has none."""
    return {f"_hot_{i}": (F.col(f"{c}_filled") == level).cast("double") for i, (c, level) in enumerate(levels)}


def fit_score_pipeline(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = "default_30d", *,
    trees: int = 280, depth: int = 4, rate: float = 0.04, subsample: float = 0.9, seed: int = 42, engineered: bool = True,
) -> Scorer:
    """Gradient-boosted trees over filled numerics, missing indicators and one-hot levels; an unknown level gets all zeros."""
    numeric = [*numeric, *(ENGINEERED if engineered else ())]
    wide = engineered_features(train) if engineered else train
    prep = fit_preprocess(wide, numeric, categorical)
    filled = prep.apply(wide)
    levels = tuple((c, r["level"]) for c in categorical for r in sorted(filled.select(F.col(f"{c}_filled").alias("level")).distinct().collect()))
    hot = _hot(levels)
    ready = stored(filled.withColumns(hot).select(F.col(label).alias("_label"), F.xxhash64(*sorted(train.columns)).alias("_row"), *prep.columns, *hot), "ready")
    inputs = [f"{c}_filled" for c in prep.numeric]
    flags = [*(f"{c}_missing" for c in prep.indicators), *hot]
    return Scorer(prep, levels, boosting.fit(ready, inputs, flags, "_label", trees=trees, depth=depth, rate=rate, subsample=subsample, seed=seed), engineered)
