from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import op_mixing as M

SF = "/root/testdata/sf0.01"


def vectors(spark, seed, n=400, k=3):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3] * k, n)
    t = rng.integers(1, 500, n).astype(float)
    rows = [(i, float(t[i]), [float(x) for x in p[i]]) for i in range(n)]
    return p, t, spark.createDataFrame(rows, "doc_id long, n_tokens double, p array<double>")


def brute_rates(p, t, goal):
    """The same least squares by a plain loop over all rates."""
    gram = (t[:, None] * p).T @ p
    rate = np.full(len(t), goal.sum() / t.sum())
    for _ in range(M.MAX_STEPS):
        gap = (t * rate) @ p - goal
        if np.abs(gap).max() <= M.TOLERANCE * goal.sum():
            break
        rate = np.maximum(0, rate - p @ np.linalg.solve(gram, gap))
    return rate


@pytest.mark.parametrize("shares", [[0.5, 0.3, 0.2], [0.7, 0.2, 0.1], [0.2, 0.2, 0.6]])
def test_rates_meet_the_targets(spark, shares):
    p, t, df = vectors(spark, 1)
    start, steps = M.fit_rates(df, np.array(shares))
    got = np.array([r["rate"] for r in df.withColumn("rate", M.rate_column(start, steps)).orderBy("doc_id").collect()])
    goal = np.array(shares) * t.sum()
    assert got.min() >= 0
    assert np.abs((t * got) @ p - goal).max() <= 1e-3 * t.sum()
    assert np.allclose(got, brute_rates(p, t, goal), atol=1e-6) and np.allclose(got, M.rates_of(p, start, steps))


def test_targets_out_of_reach_are_approached(spark):
    p, t, df = vectors(spark, 1)
    goal = np.array([0.98, 0.02, 0.0]) * t.sum()  # every posterior has some of each domain
    start, steps = M.fit_rates(df, goal / t.sum())
    rate = M.rates_of(p, start, steps)
    assert rate.min() >= 0 and np.allclose(rate, brute_rates(p, t, goal), atol=1e-6)
    assert np.abs((t * rate) @ p - goal).sum() < 0.3 * np.abs(t @ p - goal).sum()


def test_budget_scales_the_totals(spark):
    p, t, df = vectors(spark, 2)
    start, steps = M.fit_rates(df, np.array([0.4, 0.3, 0.3]), budget=1000.0)
    rate = M.rates_of(p, start, steps)
    assert (t * rate).sum() == pytest.approx(1000, rel=1e-3)


def test_posteriors_separate_labelled_domains(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = M.fit(docs, M.label_domains(labels))
    low = model.domains.index("low") + 1
    rows = M.memberships(docs, model).join(M.label_domains(labels), "doc_id").select("domain", F.element_at("p", low).alias("low"), "p").collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in rows)
    mean = {d: np.mean([r["low"] for r in rows if r["domain"] == d]) for d in ("low", "plain")}
    assert mean["low"] > 0.6 and mean["plain"] < 0.1


def test_copies_follow_rates_and_plain_text_stays_whole(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    quality = labels.select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "plain").alias("domain"))
    out = M.mixed(docs, quality, {"plain": 0.97, "low": 0.03}, whole="plain")
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    model = M.fit(docs, quality)
    plain = model.domains.index("plain")
    likely = [r["doc_id"] for r in M.memberships(docs, model).collect() if int(np.argmax(r["p"])) == plain]
    assert all(counts.get(i, 0) >= 1 for i in likely)
    assert out.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("NOT text <=> t").count() == 0


def test_plain_text_stays_whole_when_targets_are_out_of_reach(spark, monkeypatch, caplog):
    rng = np.random.default_rng(5)
    n = 1500
    low = np.where(rng.random(n) < 0.05, 0.9, rng.beta(1, 19, n))  # plain texts are about 5 per cent low on average
    p = np.stack([low, 1 - low], 1)
    model = M.Classifier(["low", "plain"], None, None, None, None)
    monkeypatch.setattr(M, "fit", lambda docs, domains: model)
    monkeypatch.setattr(M, "memberships", lambda docs, _: docs.select("doc_id", F.lit(100.0).alias("n_tokens"), "p"))
    seen = {}
    fit_rates = M.fit_rates

    def kept(*a, **b):
        seen["rates"] = fit_rates(*a, **b)
        return seen["rates"]

    monkeypatch.setattr(M, "fit_rates", kept)
    docs = spark.createDataFrame([(i, "t", [float(x) for x in p[i]]) for i in range(n)], "doc_id long, text string, p array<double>")
    with caplog.at_level("WARNING"):
        M.mixed(docs, docs, {"plain": 0.97, "low": 0.03}, whole="plain")
    start, steps = seen["rates"]
    rate = M.rates_of(p, start, steps, whole=1)
    own = p[:, 1] >= p[:, 0]
    assert rate[own].min() >= 1 and rate.min() >= 0
    assert M.rates_of(p, start, steps)[own].min() == 0  # without protection some are lost
    column = docs.select("doc_id", "p", M.rate_column(start, steps, M.least_rate(model, "plain")).alias("r")).orderBy("doc_id").collect()
    assert np.allclose([r["r"] for r in column], rate)
    got = rate @ p
    assert got[0] / got.sum() < p[:, 0].mean() and "low +0." in caplog.text


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "a b c", 5.0), (3, "a b c", 5.0), (None, "d", 5.0)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([(None, "x"), (9, None)], "doc_id long, domain string")
    model = M.fit(docs, none)
    assert model.domains == ["all"]
    out = M.mixed(docs, none, {"x": 1.0})
    assert out.columns == docs.columns and out.count() == 5  # every rate is one
    assert M.mixed(docs.where("false"), none, {"x": 1.0}).count() == 0
    assert M.wanted(M.Classifier(["a", "b"], None, None, None, None), {"a": 1, "zzz": 3}).tolist() == [1.0, 0.0]


def test_own_columns_may_clash(spark):
    docs = spark.createDataFrame([(k, "one two three", k, "d") for k in range(4)], "doc_id long, text string, draw int, domain string")
    out = M.mixed(docs, docs.select("doc_id", "domain"), {"d": 1.0})
    assert out.columns == docs.columns and out.where("draw <> doc_id").count() == 0
