"""Drift queries (family D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import drift
from wardline.plans import bridge as b
from wardline.plans.registry import query

FEATURES = [*b.MONITORED, "risk_probability"]


def drifted(spark, d):
    return b.drifted(b.apps(spark, d))


def long_sql(table: str, features) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, batch, {c}::DOUBLE AS value FROM {table}" for c in features)


def edges_sql(rows: str, bins: int = 10) -> str:
    """CTEs from ``long`` (feature, batch, value): ranks, quantiles with the nearest-end rule, merged edges."""
    step = f"(1.0::DOUBLE / {bins})"
    q = f"CASE WHEN i = {bins} THEN 1.0::DOUBLE ELSE i * {step} END"
    return f"""
ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS rk, count(*) OVER (PARTITION BY feature) AS n
  FROM {rows} WHERE batch = 'reference' AND value IS NOT NULL),
pos AS (SELECT feature, n, i, (n - 1)::DOUBLE * ({q}) AS at FROM (SELECT feature, max(n) AS n FROM ranked GROUP BY 1), range(0, {bins + 1}) t(i)),
quant AS (SELECT p.feature, p.n, p.i, CASE WHEN lo.value = hi.value THEN lo.value
    WHEN p.at - floor(p.at) >= 0.5 THEN hi.value - (hi.value - lo.value) * (1.0::DOUBLE - (p.at - floor(p.at)))
    ELSE lo.value + (hi.value - lo.value) * (p.at - floor(p.at)) END AS q
  FROM pos p JOIN ranked lo ON lo.feature = p.feature AND lo.rk = floor(p.at)::BIGINT JOIN ranked hi ON hi.feature = p.feature AND hi.rk = ceil(p.at)::BIGINT),
merged AS (SELECT feature, max(n) AS n, list_sort(list(DISTINCT q)) AS m, min(q) AS low, max(q) AS high FROM quant GROUP BY 1),
edges AS (SELECT feature, n AS row_count, CASE WHEN len(m) >= 3 THEN m[2:len(m)-1]
    WHEN low < high THEN list_transform(range(1, {bins}), lambda i: low + i::DOUBLE * ((high - low) / {float(bins)}::DOUBLE)) ELSE []::DOUBLE[] END AS e FROM merged)"""


BINS_SQL = """
binned AS (SELECT l.feature, l.batch, CASE WHEN l.value IS NULL THEN -1 ELSE len(list_filter(e, lambda x: x <= l.value)) END AS bin FROM long l JOIN edges USING (feature)),
bincount AS (SELECT feature, bin, count(*) FILTER (WHERE batch = 'reference') AS nr, count(*) FILTER (WHERE batch = 'current') AS nc FROM binned GROUP BY 1, 2),
grid AS (SELECT feature, unnest(range(-1, len(e) + 1)) AS bin FROM edges),
tot AS (SELECT feature, count(*) FILTER (WHERE batch = 'reference') AS tr, count(*) FILTER (WHERE batch = 'current') AS tc FROM long GROUP BY 1),
share AS (SELECT g.feature, g.bin, coalesce(nr, 0) AS nr, coalesce(nc, 0) AS nc, greatest(coalesce(nr, 0)::DOUBLE / tr, 1e-6) AS e, greatest(coalesce(nc, 0)::DOUBLE / tc, 1e-6) AS a
  FROM grid g JOIN tot USING (feature) LEFT JOIN bincount b ON b.feature = g.feature AND b.bin = g.bin),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM share GROUP BY 1)"""

KS_SQL = """
vc AS (SELECT feature, value, count(*) FILTER (WHERE batch = 'reference') AS nr, count(*) FILTER (WHERE batch = 'current') AS nc FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
cum AS (SELECT feature, sum(nr) OVER w AS cr, sum(nc) OVER w AS cc, sum(nr) OVER (PARTITION BY feature) AS tr, sum(nc) OVER (PARTITION BY feature) AS tc FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks0 AS (SELECT feature, max(abs(cr::DOUBLE / tr - cc::DOUBLE / tc)) AS d, max(tr)::BIGINT AS nr, max(tc)::BIGINT AS nc FROM cum GROUP BY 1),
ks1 AS (SELECT *, sqrt(nr::DOUBLE * nc::DOUBLE / (nr + nc)::DOUBLE) * d AS lam FROM ks0),
ks AS (SELECT feature, d AS ks_statistic, nr AS reference_count, nc AS current_count, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest(2.0 * list_sum(list_transform(range(1, 101),
   lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE * exp(-2.0::DOUBLE * k::DOUBLE * k::DOUBLE * lam * lam))), 0.0), 1.0) END AS ks_pvalue FROM ks1)"""

_BASE = f"WITH {b.DRIFTED_SQL}, long AS ({long_sql('drifted', FEATURES)})"
_EDGES = _BASE + "," + edges_sql("long")
_PSI = _EDGES + "," + BINS_SQL


@query("d1_bin_edges", _EDGES + " SELECT feature, row_count, idx, e[idx] AS edge FROM (SELECT feature, row_count, e, unnest(range(1, len(e) + 1)) AS idx FROM edges)", ["edge"])
def d1(spark, d):
    edges = drift.reference_edges(drifted(spark, d), FEATURES)
    return edges.select("feature", "row_count", F.posexplode("edges").alias("idx", "edge")).withColumn("idx", F.col("idx").cast("bigint") + 1)


# Features with few distinct values: equal-width bins, one bin, and merged quantiles.
_FEW = {"two_values": "(default_30d)", "constant": "1", "skewed": "CASE WHEN inquiries_6m < 6 THEN 2 ELSE inquiries_6m END"}
_FEW_LONG = " UNION ALL ".join(f"SELECT '{k}' AS feature, batch, ({v})::DOUBLE AS value FROM apps" for k, v in _FEW.items())


def few(spark, d):
    return b.apps(spark, d).select("batch", *[F.expr(v).cast("double").alias(k) for k, v in _FEW.items()])


@query(
    "d2_edge_fallback",
    f"WITH {b.APPS_SQL}, long AS ({_FEW_LONG}), {edges_sql('long')} SELECT feature, len(e) + 1 AS bin_count, coalesce(list_sum(e), 0) AS edge_sum FROM edges",
    ["edge_sum"],
)
def d2(spark, d):
    edges = drift.reference_edges(few(spark, d), list(_FEW))
    return edges.select(
        "feature", (F.size("edges") + 1).cast("bigint").alias("bin_count"), F.aggregate("edges", F.lit(0.0), lambda a, x: a + x).alias("edge_sum")
    )


@query("d3_bin_proportions", _PSI + " SELECT feature, bin::BIGINT AS bin, nr AS reference_count, nc AS current_count, e AS reference_share, a AS current_share FROM share", ["reference_share", "current_share"])
def d3(spark, d):
    return drift.bin_proportions(drifted(spark, d), FEATURES).withColumn("bin", F.col("bin").cast("bigint"))


@query("d4_missing_bin", _PSI + " SELECT feature, nr AS reference_count, nc AS current_count FROM share WHERE bin = -1")
def d4(spark, d):
    return drift.bin_proportions(drifted(spark, d), FEATURES).where("bin = -1").select("feature", "reference_count", "current_count")


@query("d5_share_floor", _PSI + " SELECT feature, bin::BIGINT AS bin, a * 1e6 AS share_ppm FROM share WHERE nc = 0", ["share_ppm"])
def d5(spark, d):
    empty = drift.bin_proportions(drifted(spark, d), FEATURES).where("current_count = 0")
    return empty.select("feature", F.col("bin").cast("bigint").alias("bin"), (F.col("current_share") * 1e6).alias("share_ppm"))


@query("d6_psi", _PSI + " SELECT feature, psi FROM psi", ["psi"])
def d6(spark, d):
    return drift.psi(drifted(spark, d), FEATURES)


@query("d7_ks_statistic", f"{_BASE}, {KS_SQL} SELECT feature, ks_statistic, reference_count, current_count FROM ks", ["ks_statistic"])
def d7(spark, d):
    return drift.ks(drifted(spark, d), FEATURES).drop("ks_pvalue")


@query("d8_ks_pvalue", f"{_BASE}, {KS_SQL} SELECT feature, ks_pvalue FROM ks", ["ks_pvalue"])
def d8(spark, d):
    return drift.ks(drifted(spark, d), FEATURES).select("feature", "ks_pvalue")


_REPORT_CTE = _PSI + "," + KS_SQL + """,
means AS (SELECT feature, avg(value) FILTER (WHERE batch = 'reference') AS reference_mean, avg(value) FILTER (WHERE batch = 'current') AS current_mean,
   avg((value IS NULL)::INT) FILTER (WHERE batch = 'reference') AS reference_null_rate, avg((value IS NULL)::INT) FILTER (WHERE batch = 'current') AS current_null_rate FROM long GROUP BY 1),
rep0 AS (SELECT feature, psi, CASE WHEN psi >= 0.2 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'STABLE' END AS psi_status, ks_statistic, ks_pvalue,
   CASE WHEN ks_pvalue >= 0.05 THEN 'STABLE' WHEN ks_statistic >= 0.1 THEN 'CRITICAL' WHEN ks_statistic >= 0.05 THEN 'WARNING' ELSE 'STABLE' END AS ks_status,
   reference_mean, current_mean, reference_null_rate, current_null_rate, reference_count, current_count FROM psi JOIN ks USING (feature) JOIN means USING (feature)),
rep AS (SELECT *, CASE WHEN 'CRITICAL' IN (psi_status, ks_status) THEN 'CRITICAL' WHEN 'WARNING' IN (psi_status, ks_status) THEN 'WARNING' ELSE 'STABLE' END AS status FROM rep0)"""
_REPORT_DOUBLES = ["psi", "ks_statistic", "ks_pvalue", "reference_mean", "current_mean", "reference_null_rate", "current_null_rate"]


def report(spark, d):
    return drift.drift_report(drifted(spark, d), b.MONITORED)


@query("d9_drift_report", _REPORT_CTE + " SELECT * FROM rep", _REPORT_DOUBLES)
def d9(spark, d):
    return report(spark, d).drop("feature_position", "is_prediction")


@query("d10_feature_statuses", _REPORT_CTE + " SELECT feature, status FROM rep WHERE feature <> 'risk_probability'")
def d10(spark, d):
    return drift.drift_report(drifted(spark, d), b.MONITORED, score=None).select("feature", "status")


@query("d11_prediction_drift", _REPORT_CTE + " SELECT feature, psi, ks_statistic, status FROM rep WHERE feature = 'risk_probability'", ["psi", "ks_statistic"])
def d11(spark, d):
    return report(spark, d).where("is_prediction").select("feature", "psi", "ks_statistic", "status")


_POSITION = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(FEATURES)) + " END"


@query(
    "d12_overall_status",
    _REPORT_CTE + f""" SELECT CASE WHEN bool_or(status = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'STABLE' END AS overall_status,
    coalesce(string_agg(feature, ',' ORDER BY {_POSITION}) FILTER (WHERE status = 'CRITICAL' AND feature <> 'risk_probability'), '') AS critical_features,
    coalesce(string_agg(feature, ',' ORDER BY {_POSITION}) FILTER (WHERE status = 'WARNING' AND feature <> 'risk_probability'), '') AS warning_features FROM rep""",
)
def d12(spark, d):
    found = drift.overall_status(report(spark, d))
    return found.select("overall_status", *[F.array_join(c, ",").alias(c) for c in ("critical_features", "warning_features")])


@query(
    "d13_prediction_summary",
    f"""WITH {b.DRIFTED_SQL}, a AS (SELECT avg(risk_probability) FILTER (WHERE batch = 'reference') AS reference_mean_risk, avg(risk_probability) FILTER (WHERE batch = 'current') AS current_mean_risk,
      avg((risk_probability < 0.5)::INT) FILTER (WHERE batch = 'reference') AS reference_approval_rate, avg((risk_probability < 0.5)::INT) FILTER (WHERE batch = 'current') AS current_approval_rate FROM drifted)
    SELECT *, current_mean_risk - reference_mean_risk AS mean_risk_shift, current_approval_rate - reference_approval_rate AS approval_rate_shift FROM a""",
    ["reference_mean_risk", "current_mean_risk", "reference_approval_rate", "current_approval_rate", "mean_risk_shift", "approval_rate_shift"],
)
def d13(spark, d):
    return drift.prediction_summary(drifted(spark, d))


_EXPECTED = [("annual_income", "STABLE"), ("employment_length_years", "STABLE"), ("device_risk_score", "CRITICAL"), ("bank_transaction_risk", "CRITICAL")]


@query(
    "d14_expectation_check",
    _REPORT_CTE + f", want(feature, expected_status) AS (VALUES {', '.join(map(str, _EXPECTED))}) SELECT feature, expected_status, status, status = expected_status AS passed FROM want LEFT JOIN rep USING (feature)",
)
def d14(spark, d):
    expected = spark.createDataFrame(_EXPECTED, "feature string, expected_status string")
    return drift.expectation_check(report(spark, d), expected)


# Event values by month against cut points of the first ten days.
def event_batches(spark, d):
    ev = b.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = F.col("ts") < F.lit("2024-01-11").cast("timestamp")
    return ev.withColumn("batch", F.when(first, "reference").otherwise("current"))


EVENT_LONG = "long AS (SELECT 'value' AS feature, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'reference' ELSE 'current' END AS batch, value, ts FROM events)"


def windowed_sql(where: str = "true") -> str:
    return f"""WITH {EVENT_LONG}, {edges_sql('long')},
    b0 AS (SELECT date_trunc('day', ts) AS w, batch, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(e, lambda x: x <= value)) END AS bin FROM long JOIN edges USING (feature)),
    grid AS (SELECT unnest(range(-1, len(e) + 1)) AS bin FROM edges),
    ref AS (SELECT g.bin, greatest(count(b0.bin)::DOUBLE / (SELECT count(*) FROM b0 WHERE batch = 'reference'), 1e-6) AS e FROM grid g LEFT JOIN b0 ON b0.bin = g.bin AND b0.batch = 'reference' GROUP BY 1),
    win AS (SELECT w, count(*) AS row_count FROM b0 WHERE batch = 'current' GROUP BY 1),
    cell AS (SELECT w, bin, count(*) AS n FROM b0 WHERE batch = 'current' GROUP BY 1, 2),
    s AS (SELECT win.w, win.row_count, ref.e, greatest(coalesce(cell.n, 0)::DOUBLE / win.row_count, 1e-6) AS a FROM win JOIN ref ON true LEFT JOIN cell ON cell.w = win.w AND cell.bin = ref.bin)
    SELECT strftime(w, '%Y-%m-%d') AS day, 'value' AS feature, row_count, sum((a - e) * ln(a / e)) AS psi FROM s WHERE {where} GROUP BY w, row_count"""


@query("d15_windowed_psi", windowed_sql(), ["psi"])
def d15(spark, d):
    rows = event_batches(spark, d)
    edges = drift.reference_edges(rows, ["value"])
    fixed = drift.bin_table(rows.where("batch = 'reference'"), ["value"], edges)
    found = drift.windowed_psi(rows.where("batch = 'current'"), ["value"], edges, fixed, "ts", "1 day")
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "feature", "row_count", "psi")


