"""Statistics against NumPy and closed forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import association, drift, metrics, whatif
from wardline.operators.cumulative import exact_quantiles, running_counts


def two_batches(spark, ref, cur, name="x"):
    rows = [("reference", None if v is None else float(v)) for v in ref] + [("current", None if v is None else float(v)) for v in cur]
    return spark.createDataFrame(rows, f"batch string, {name} double")


def numpy_psi(ref, cur, bins=10, eps=1e-6):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    edges[0], edges[-1] = -np.inf, np.inf
    e = np.clip(np.histogram(ref, edges)[0] / len(ref), eps, None)
    a = np.clip(np.histogram(cur, edges)[0] / len(cur), eps, None)
    return float(np.sum((a - e) * np.log(a / e)))


def numpy_ks(a, b):
    grid = np.unique(np.concatenate([a, b]))
    return float(np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b))))


def test_drift_identical_and_shifted(spark):
    same = np.linspace(0, 1, 1000)
    wide = np.linspace(0, 1, 2000)
    shifted = np.clip(wide + 0.2, 0, 1)
    df = two_batches(spark, same, same)
    assert abs(drift.psi(df, ["x"]).first()["psi"]) < 1e-12
    row = drift.ks(df, ["x"]).first()
    assert row["ks_statistic"] == 0.0 and row["ks_pvalue"] == 1.0
    moved = two_batches(spark, wide, shifted)
    report = drift.drift_report(moved, ["x"], score=None).first()
    assert report["psi"] == pytest.approx(numpy_psi(wide, shifted), abs=1e-9) and report["psi"] >= 0.20
    assert report["ks_statistic"] == pytest.approx(numpy_ks(wide, shifted), abs=1e-12)
    assert report["ks_pvalue"] < 0.05 and report["status"] == "CRITICAL"


@pytest.mark.parametrize("seed", [1, 2])
def test_drift_ties_missing_and_heavy_tails(spark, seed):
    rng = np.random.default_rng(seed)
    ref = np.round(np.exp(rng.normal(0, 4, 700)), 1) * rng.choice([-1, 1], 700)
    cur = np.round(np.exp(rng.normal(0.5, 4, 500)), 1) * rng.choice([-1, 1], 500)
    row = drift.drift_report(two_batches(spark, ref, cur), ["x"], score=None).first()
    assert row["psi"] == pytest.approx(numpy_psi(ref, cur), abs=1e-9)
    assert row["ks_statistic"] == pytest.approx(numpy_ks(ref, cur), abs=1e-12)
    gone = two_batches(spark, [*ref, None], [*cur, None, float("nan")])
    other = drift.drift_report(gone, ["x"], score=None).first()
    assert other["reference_count"] == 700 and other["current_count"] == 500
    assert other["current_null_rate"] == pytest.approx(2 / 502)


def test_constant_and_two_valued_reference(spark):
    assert drift.psi(two_batches(spark, [3.0] * 50, [3.0] * 20 + [4.0] * 5), ["x"]).first()["psi"] == 0.0
    # 50 rows: one quantile falls between the two values, so three distinct edges remain and no fallback applies.
    between = [0.0] * 30 + [1.0] * 20
    edges = drift.reference_edges(two_batches(spark, between, [0.0]), ["x"]).first()["edges"]
    assert edges == pytest.approx(list(np.unique(np.quantile(between, np.linspace(0, 1, 11)))[1:-1]))
    # 51 rows: every quantile is one of the two values, so the bins are of equal width.
    edges = drift.reference_edges(two_batches(spark, [0.0] * 30 + [1.0] * 21, [0.0]), ["x"]).first()["edges"]
    assert edges == pytest.approx([i / 10 for i in range(1, 10)])


def test_quantiles_match_numpy_with_hot_value(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(4000, 7.25), rng.normal(0, 1, 4000), rng.exponential(1e6, 3000), -rng.exponential(1e-6, 1000)])
    probs = [0.0, 0.05, 0.25, 0.5, 0.6, 0.75, 0.9, 0.95, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = exact_quantiles(df, [], "x", probs).first()["quantiles"]
    assert found == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_running_counts_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(9)
    values = np.unique(np.concatenate([1e9 + rng.uniform(0, 1, 3000), rng.normal(0, 1, 500), [0.0, -0.5]]))
    n = rng.integers(0, 5, len(values))
    df = spark.createDataFrame([("k", float(v), int(c)) for v, c in zip(values, n)], "k string, v double, n long")
    for block_rows in (50, 10**6):
        rows = running_counts(df, ["k"], "v", ["n"], block_rows=block_rows).orderBy("v").collect()
        assert [r["cum_n"] for r in rows] == list(np.cumsum(n)) and rows[0]["total_n"] == int(n.sum())


def test_auc_and_average_precision(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.7), (1, 0.9)], "default_30d int, risk_probability double")
    row = metrics.classification_metrics(df).first()
    assert row["roc_auc"] == 1.0 and row["pr_auc"] == 1.0 and (row["tn"], row["tp"]) == (2, 2)
    rng = np.random.default_rng(3)
    p, y = np.round(rng.uniform(0, 1, 400), 1), rng.integers(0, 2, 400)
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    ap, seen = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        recall = (pos >= t).sum() / len(pos)
        ap, seen = ap + (recall - seen) * (pos >= t).sum() / (p >= t).sum(), recall
    tied = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "default_30d int, risk_probability double")
    row = metrics.classification_metrics(tied).first()
    assert row["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg))) and row["pr_auc"] == pytest.approx(ap)
    mirrored = metrics.ranking_metrics(tied.withColumn("risk_probability", 1 - F.col("risk_probability"))).first()
    assert row["roc_auc"] + mirrored["roc_auc"] == pytest.approx(1.0)


def test_association_closed_forms(spark):
    rows = [("current", g, x, c) for g, x, c in zip("aaabbb", [0.0, 0.1, 0.2, 0.8, 0.9, 1.0], "xxxyyy")]
    df = spark.createDataFrame(rows, "batch string, g string, v double, c string")
    assert association.eta_squared(df, ["v"], "g").first()["association"] > 0.80
    assert association.cramers_v(df, ["c"], "g").first()["association"] == pytest.approx(1.0)
    assert association.cramers_v(df.withColumn("c", F.lit("x")), ["c"], "g").first()["association"] == 0.0


def test_exact_masks_and_splits_survive_repartitioning(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("APP-"), "id").alias("application_id"), (F.col("id") % 3).cast("int").alias("y"),
        F.when(F.col("id") % 20 != 0, (F.col("id") % 101) / 100.0).alias("x"),
    )
    one = whatif.weighted_null_mask(df, "x", 0.22)
    two = whatif.weighted_null_mask(df.repartition(7), "x", 0.22)
    kept = lambda d: {r[0] for r in d.where("newly_missing").select("application_id").collect()}
    assert len(kept(one)) == 660 - 150 and kept(one) == kept(two)
    split = {(r["y"], r["split"]): r["count"] for r in whatif.stratified_split(df, "y", 0.3).groupBy("y", "split").count().collect()}
    assert all(split[(y, "holdout")] == 300 and split[(y, "train")] == 700 for y in range(3))
