"""Cell profiles against NumPy: exact gaps, exact cut points, counts per bin, for many shapes of data and any refinement size."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import cells, contract, drift, evidence, fairness


def gap(a, b):
    points = np.unique(np.concatenate([a, b]))
    return max(abs(np.searchsorted(np.sort(a), points, side="right") / len(a) - np.searchsorted(np.sort(b), points, side="right") / len(b)))


def shapes(rng):
    n = 4000
    ties = rng.integers(0, 6, n).astype(float)
    hot = np.where(rng.random(n) < 0.4, 0.25, rng.random(n))
    wide = rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n)
    ends = np.where(rng.random(n) < 0.1, math.inf, np.where(rng.random(n) < 0.1, -math.inf, rng.normal(size=n)))
    near = 1.0 + rng.integers(0, 4000, n) * 2.0**-52
    return {
        "same": (rng.random(n), rng.random(n)), "moved": (rng.normal(size=n), rng.normal(0.3, 1, n)), "ties": (ties, ties[::-1][: n // 2]), "hot": (hot, hot[: n // 3] * 1.5),
        "wide": (wide, -wide[::2]), "ends": (ends, ends[::3]), "near": (near, near[1000:] + 2.0**-51), "one": (np.ones(50), np.ones(7)), "zero": (np.zeros(30), -np.zeros(40)),
        "apart": (np.arange(10.0), np.arange(100.0, 110.0)),
    }


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(k, side, float(x)) for k, (a, b) in shapes(rng).items() for side, xs in (("reference", a), ("current", b)) for x in xs]
    rows += [("ties", "reference", None), ("ties", "current", float("nan")), ("hot", "other", 5.0), ("empty", "current", 1.0), ("gone", "reference", None), ("gone", "current", None)]
    return spark.createDataFrame(rows, "model string, batch string, x double").repartition(6).cache()


def values(table):
    out = {}
    for r in table.where("batch <> 'other'").collect():
        side = out.setdefault(r["model"], {"reference": [], "current": []})[r["batch"]]
        side.append(None if r["x"] is None or math.isnan(r["x"]) else r["x"])
    return {k: {s: np.array([x for x in xs if x is not None]) for s, xs in v.items()} for k, v in out.items()}


@pytest.mark.parametrize("leaf_rows,parts", [(20_000, 256), (25, 4), (1, 2)])
def test_statistic_per_key_is_exact(table, monkeypatch, leaf_rows, parts):
    monkeypatch.setattr(cells, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(cells, "PARTS", parts)
    found = {r["model"]: r for r in drift.ks(table, ["x"], by=["model"]).collect()}
    for key, sides in values(table).items():
        a, b = sides["reference"], sides["current"]
        assert (found[key]["reference_count"], found[key]["current_count"]) == (len(a), len(b))
        if len(a) and len(b):
            assert found[key]["ks_statistic"] == pytest.approx(gap(a, b), abs=1e-12), key
        else:
            assert found[key]["ks_statistic"] is None


@pytest.mark.parametrize("leaf_rows,parts", [(20_000, 256), (25, 4)])
def test_bins_per_key_are_those_of_the_key_alone(table, monkeypatch, leaf_rows, parts):
    monkeypatch.setattr(cells, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(cells, "PARTS", parts)
    keyed = {}
    for r in drift.bin_proportions(table, ["x"], by=["model"]).collect():
        keyed.setdefault(r["model"], {})[r["bin"]] = (r["reference_count"], r["current_count"])
    for key, sides in values(table).items():
        one = table.where(F.col("model") == key)
        edges = drift.reference_edges(one, ["x"]).select("edges").collect()
        if key in ("empty", "gone"):
            continue
        cuts = np.array(edges[0]["edges"])
        for b, counts in keyed[key].items():
            if b >= 0:
                assert counts == tuple(int((np.searchsorted(cuts, sides[s], side="right") == b).sum()) for s in ("reference", "current")), (key, b)
        assert sum(n for b, (n, _) in keyed[key].items() if b >= 0) == len(sides["reference"])


def test_equal_width_cuts_inside_cells_are_counted_again(spark):
    rows = [("reference", 0.0)] * 90 + [("reference", 1.0)] * 5 + [("current", x / 997) for x in range(998)]
    df = spark.createDataFrame(rows, "batch string, x double")
    got = {r["bin"]: (r["reference_count"], r["current_count"]) for r in drift.bin_proportions(df, ["x"]).collect()}
    cuts = [i * 0.1 for i in range(1, 10)]
    edges = drift.reference_edges(df, ["x"]).first()["edges"]
    assert edges == pytest.approx(cuts)
    expected = np.bincount(np.searchsorted(np.array(edges), [x / 997 for x in range(998)], side="right"), minlength=10)
    assert [got[b][1] for b in range(10)] == expected.tolist() and got[0][0] == 90 and got[9][0] == 5


def test_report_per_key_equals_the_report_of_each_key(table):
    keyed = {(r["model"], r["feature"]): r for r in drift.drift_report(table, ["x"], None, by=["model"]).collect()}
    for key in ("same", "moved", "ties", "hot", "apart"):
        alone = drift.drift_report(table.where(F.col("model") == key), ["x"], None).first()
        for name in ("psi", "ks_statistic", "ks_pvalue", "status", "reference_mean", "current_mean", "current_null_rate", "reference_count"):
            a, b = keyed[key, "x"][name], alone[name]
            assert a == pytest.approx(b) if isinstance(b, float) else a == b, (key, name)


def test_nothing_but_cells_is_stored(spark, monkeypatch):
    sizes, kept = [], cells.stored
    monkeypatch.setattr(cells, "stored", lambda df, name: sizes.append(kept(df, name)) or sizes[-1])
    df = spark.range(200_000).selectExpr("if(id % 2 = 0, 'reference', 'current') batch", "rand(3) + if(id % 2 = 0, 0, 0.02) x")
    found = drift.drift_report(df, ["x"], None).first()
    assert found["ks_statistic"] == pytest.approx(0.02, abs=0.01)
    assert len(sizes) <= 3 and sum(s.count() for s in sizes) < 20_000  # of 200,000 values


def test_candidates_are_judged_together(spark):
    rng = np.random.default_rng(5)
    rows = []
    for version, shift, strange, bias in (("good", 0.0, False, 0.0), ("moved", 0.3, False, 0.0), ("broken", 0.0, True, 0.0), ("unfair", 0.0, False, 0.5)):
        for k in range(1200):
            now, group = k % 2 == 0, "ab"[k // 2 % 2]
            risk = float(rng.random()) * 0.8
            risk = min(1.0, risk + (shift if now else 0) + (bias * (1 - risk) if now and group == "b" else 0))
            rows.append((version, "current" if now else "reference", f"{version}{k}", "odd" if strange and now and k < 10 else "ok", group, risk, risk, int(rng.random() < risk)))
    df = spark.createDataFrame(rows, "model_version string, batch string, id string, kind string, grp string, x double, risk_probability double, default_30d int")
    rules = contract.Contract("c", "1", columns=(contract.ColumnRule("id", "string", unique=True), contract.ColumnRule("kind", "string", allowed_values=("ok",)), contract.ColumnRule("x", "number", min=0, max=1, max_null_rate=0.0)))
    found = {r["model_version"]: r for r in evidence.Candidates(df, rules, ("x",), ("grp",)).evidence(("quality", "performance", "drift", "fairness")).collect()}
    assert {k: r["quality_decision"] for k, r in found.items()} == {"good": "PASS", "moved": "PASS", "broken": "BLOCK", "unfair": "PASS"}
    assert found["moved"]["drift_status"] == "CRITICAL" and "CRITICAL" not in (found["good"]["drift_status"], found["broken"]["drift_status"])
    assert found["unfair"]["fairness_status"] == "FAIL" and found["good"]["fairness_status"] == "PASS"
    for key, r in found.items():
        alone = df.where(F.col("model_version") == key)
        one = contract.gate(contract.both_engines(alone.where("batch = 'current'"), rules)).first()
        assert one["decision"] == r["quality_decision"]
        counts = fairness.group_counts(alone.where("batch = 'current'"), ["grp"])
        judged = fairness.expanded_assess(fairness.expanded_group_metrics(counts, 30))
        assert fairness.overall_status(judged, ["grp"]).first()[0] == r["fairness_status"]
    drifted = evidence.gates(evidence.Candidates(df, rules, ("x",), ("grp",)).part("drift"), only=("drift",))
    assert {r["model_version"]: r["passed"] for r in drifted.collect()} == {"good": True, "moved": False, "broken": True, "unfair": found["unfair"]["drift_status"] != "CRITICAL"}


def test_rows_are_counted_without_being_sorted(spark):
    rows = [("reference", 0.0)] * 90 + [("reference", 1.0)] * 5 + [("current", x / 997) for x in range(998)]
    df = spark.createDataFrame(rows, "batch string, x double")
    edges = drift.reference_edges(df, ["x"])
    for found in (drift.drift_report(df, ["x"], None), drift.psi(df, ["x"]), drift.psi(df, ["x"], edges=edges.select("feature", "edges"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
