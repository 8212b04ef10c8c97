"""Fairness, association and attribution queries (families F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import association as asc
from wardline.operators import attribution as att
from wardline.operators import fairness as fair
from wardline.plans import bridge as b
from wardline.plans.registry import query

AXES = ["synthetic_demographic_group", "sex"]
ALL = [*AXES, b.INTERSECTION]
STRESSED = f"WITH {b.STRESSED_SQL}"
MIN = 400


def stressed(spark, d):
    return b.stressed(b.apps(spark, d))


def counts(spark, d, features=tuple(ALL)):
    return fair.group_counts(stressed(spark, d), list(features))


_LONG = " UNION ALL ".join(f"SELECT batch, '{c}' AS sensitive_feature, coalesce({c}, 'nan') AS grp, risk_probability AS p, default_30d AS y FROM stressed" for c in ALL)
_F1 = f"""{STRESSED}, long AS ({_LONG}),
 f1 AS (SELECT batch, sensitive_feature, grp, count(*) AS sample_count, avg((p < 0.5)::INT) AS approval_rate, avg((p >= 0.5)::INT) AS predicted_default_rate, avg(y) AS actual_default_rate, avg(p) AS mean_predicted_risk,
   avg(((p >= 0.5)::INT = y)::INT) AS accuracy, coalesce(avg((p >= 0.5)::INT) FILTER (WHERE y = 1), 0) AS true_positive_rate, coalesce(avg((p >= 0.5)::INT) FILTER (WHERE y = 0), 0) AS false_positive_rate,
   coalesce(avg((p < 0.5)::INT) FILTER (WHERE y = 1), 0) AS false_negative_rate FROM long GROUP BY 1, 2, 3)"""
_F1_COLS = ["approval_rate", "predicted_default_rate", "actual_default_rate", "mean_predicted_risk", "accuracy", "true_positive_rate", "false_positive_rate", "false_negative_rate"]
_LADDER = """CASE WHEN {r} < 0.8 OR {s} >= 0.15 OR {e} >= 0.2 THEN 'FAIL' WHEN {r} < 0.9 OR {s} >= 0.1 OR {e} >= 0.1 THEN 'WARNING' ELSE 'PASS' END"""
_F5 = _F1 + f""", f4 AS (SELECT batch, sensitive_feature, min(approval_rate) / nullif(max(approval_rate), 0) AS demographic_parity_ratio, max(approval_rate) - min(approval_rate) AS demographic_parity_difference,
   greatest(max(true_positive_rate) - min(true_positive_rate), max(false_positive_rate) - min(false_positive_rate)) AS equalized_odds_difference FROM f1 GROUP BY 1, 2),
 f5 AS (SELECT *, {_LADDER.format(r='demographic_parity_ratio', s='demographic_parity_difference', e='equalized_odds_difference')} AS status FROM f4)"""
_F5_COLS = ["demographic_parity_ratio", "demographic_parity_difference", "equalized_odds_difference"]


def renamed(df):
    return df.withColumnRenamed("group", "grp")


@query("f1_group_metrics", _F1 + " SELECT * FROM f1", _F1_COLS)
def f1(spark, d):
    return renamed(fair.group_metrics(counts(spark, d)))


def assessed(spark, d):
    return fair.assess(fair.group_metrics(counts(spark, d)))


@query("f2_parity_ratio", _F5 + " SELECT batch, sensitive_feature, demographic_parity_ratio FROM f5", ["demographic_parity_ratio"])
def f2(spark, d):
    return assessed(spark, d).select("batch", "sensitive_feature", "demographic_parity_ratio")


@query("f3_parity_difference", _F5 + " SELECT batch, sensitive_feature, demographic_parity_difference FROM f5", ["demographic_parity_difference"])
def f3(spark, d):
    return assessed(spark, d).select("batch", "sensitive_feature", "demographic_parity_difference")


@query("f4_equalized_odds", _F5 + " SELECT batch, sensitive_feature, equalized_odds_difference FROM f5", ["equalized_odds_difference"])
def f4(spark, d):
    return assessed(spark, d).select("batch", "sensitive_feature", "equalized_odds_difference")


@query("f5_feature_status", _F5 + " SELECT * FROM f5", _F5_COLS)
def f5(spark, d):
    return assessed(spark, d)


@query("f6_overall_status", _F5 + f" SELECT CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS overall_status FROM f5 WHERE batch = 'current' AND sensitive_feature = '{b.INTERSECTION}'")
def f6(spark, d):
    return fair.overall_status(assessed(spark, d), [b.INTERSECTION])


@query("f7_primary_delta", _F5 + " SELECT " + ", ".join(f"max({c}) FILTER (WHERE batch = 'current') - max({c}) FILTER (WHERE batch = 'reference') AS {c}" for c in _F5_COLS) + f" FROM f5 WHERE sensitive_feature = '{b.INTERSECTION}'", _F5_COLS)
def f7(spark, d):
    return fair.primary_delta(assessed(spark, d), b.INTERSECTION)


_F8 = f"""{STRESSED}, long AS ({_LONG}),
 f8 AS (SELECT batch, sensitive_feature, grp, count(*) AS sample_count, count(*) >= {MIN} AS eligible_for_governance, avg((p < 0.5)::INT) AS approval_rate, avg(y) AS actual_default_rate, avg(p) AS mean_predicted_risk,
   avg((p < 0.5)::INT) FILTER (WHERE y = 0) AS favorable_true_positive_rate, avg((p < 0.5)::INT) FILTER (WHERE y = 1) AS false_approval_rate, avg((p >= 0.5)::INT) FILTER (WHERE y = 0) AS missed_opportunity_rate FROM long GROUP BY 1, 2, 3)"""
_F8_COLS = ["approval_rate", "actual_default_rate", "mean_predicted_risk", "favorable_true_positive_rate", "false_approval_rate", "missed_opportunity_rate"]
_F12 = _F8 + """, f10 AS (SELECT batch, sensitive_feature, count(*) FILTER (WHERE eligible_for_governance) AS eligible_groups FROM f8 GROUP BY 1, 2),
 f11 AS (SELECT batch, sensitive_feature, min(approval_rate) / nullif(max(approval_rate), 0) AS demographic_parity_ratio, max(approval_rate) - min(approval_rate) AS selection_rate_difference,
   max(favorable_true_positive_rate) - min(favorable_true_positive_rate) AS equal_opportunity_difference, max(false_approval_rate) - min(false_approval_rate) AS false_approval_rate_difference FROM f8 WHERE eligible_for_governance GROUP BY 1, 2 HAVING count(*) >= 2),
 f12 AS (SELECT batch, sensitive_feature, eligible_groups, CASE WHEN eligible_groups < 2 THEN 'UNSUPPORTED' WHEN demographic_parity_ratio < 0.8 OR selection_rate_difference >= 0.15 OR equal_opportunity_difference >= 0.15 OR false_approval_rate_difference >= 0.15
     OR greatest(equal_opportunity_difference, false_approval_rate_difference) >= 0.2 THEN 'FAIL'
   WHEN demographic_parity_ratio < 0.9 OR selection_rate_difference >= 0.1 OR equal_opportunity_difference >= 0.1 OR false_approval_rate_difference >= 0.1 THEN 'WARNING' ELSE 'PASS' END AS status, eligible_groups >= 2 AS is_defined,
   demographic_parity_ratio, selection_rate_difference, equal_opportunity_difference, greatest(equal_opportunity_difference, false_approval_rate_difference) AS equalized_odds_difference, false_approval_rate_difference
   FROM f10 LEFT JOIN f11 USING (batch, sensitive_feature))"""


def expanded(spark, d):
    return fair.expanded_group_metrics(counts(spark, d), MIN)


def expanded_assessed(spark, d):
    return fair.expanded_assess(expanded(spark, d))


@query("f8_expanded_group_metrics", _F8 + " SELECT * EXCLUDE (eligible_for_governance) FROM f8", _F8_COLS)
def f8(spark, d):
    return renamed(expanded(spark, d)).drop("eligible_for_governance")


@query("f9_group_support", _F8 + " SELECT batch, sensitive_feature, grp, sample_count, eligible_for_governance FROM f8")
def f9(spark, d):
    return renamed(expanded(spark, d)).select("batch", "sensitive_feature", "grp", "sample_count", "eligible_for_governance")


@query("f10_supported_features", _F12 + " SELECT batch, sensitive_feature, eligible_groups, is_defined FROM f12")
def f10(spark, d):
    return expanded_assessed(spark, d).select("batch", "sensitive_feature", "eligible_groups", "is_defined")


@query("f11_disparities", _F12 + f" SELECT batch, sensitive_feature, {', '.join(fair.FIVE)} FROM f12", fair.FIVE)
def f11(spark, d):
    return expanded_assessed(spark, d).select("batch", "sensitive_feature", *fair.FIVE)


@query("f12_expanded_status", _F12 + " SELECT * FROM f12", fair.FIVE)
def f12(spark, d):
    return expanded_assessed(spark, d)


@query(
    "f13_evidence_table",
    _F5 + " SELECT f1.batch AS dataset, sensitive_feature, grp, sample_count, approval_rate, true_positive_rate, demographic_parity_ratio, equalized_odds_difference, status FROM f1 JOIN f5 USING (batch, sensitive_feature)",
    ["approval_rate", "true_positive_rate", "demographic_parity_ratio", "equalized_odds_difference"],
)
def f13(spark, d):
    metrics = fair.group_metrics(counts(spark, d))
    return renamed(fair.evidence_table(metrics, fair.assess(metrics))).select(
        "dataset", "sensitive_feature", "grp", "sample_count", "approval_rate", "true_positive_rate", "demographic_parity_ratio", "equalized_odds_difference", "status"
    )


@query(
    "f14_intersection_audit",
    _F12 + f""" SELECT batch, max(status) FILTER (WHERE sensitive_feature = '{b.INTERSECTION}') AS intersection_status, count(*) FILTER (WHERE sensitive_feature <> '{b.INTERSECTION}' AND status = 'FAIL') AS failing_axes,
    max(status) FILTER (WHERE sensitive_feature = '{b.INTERSECTION}') = 'FAIL' AND count(*) FILTER (WHERE sensitive_feature <> '{b.INTERSECTION}' AND status = 'FAIL') = 0 AS hidden_by_axes FROM f12 GROUP BY 1""",
)
def f14(spark, d):
    return fair.intersection_audit(expanded_assessed(spark, d), b.INTERSECTION, AXES)


# ------------------------------------------------------------------ G

GROUP = b.INTERSECTION
WEIGHTS = {"device_risk_score": 0.30, "bank_transaction_risk": 0.20, "credit_utilization": 0.25, "delinquencies_2y": 0.015, "debt_to_income": -0.02}


@query("g1_supported_rows", f"{STRESSED} SELECT application_id, batch FROM stressed QUALIFY count(*) OVER (PARTITION BY batch, {GROUP}) >= 720")
def g1(spark, d):
    return asc.supported_rows(stressed(spark, d), GROUP, 720).select("application_id", "batch")


_NUM = " UNION ALL ".join(f"SELECT batch, '{c}' AS feature, {GROUP} AS g, {c}::DOUBLE AS x FROM stressed" for c in b.NUMERIC)
_CAT = " UNION ALL ".join(f"SELECT batch, '{c}' AS feature, {GROUP} AS g, coalesce({c}, 'nan') AS x FROM stressed" for c in b.CATEGORICAL)
_ETA = f"""num AS ({_NUM}), pg AS (SELECT batch, feature, g, count(x) AS n, avg(x) AS m, sum(x) AS sx, var_pop(x) AS v FROM num GROUP BY 1, 2, 3 HAVING count(*) >= {MIN} AND count(x) > 0),
 ov AS (SELECT batch, feature, sum(n * m) / sum(n) AS om, count(*) AS k FROM pg GROUP BY 1, 2),
 eta AS (SELECT batch, feature, CASE WHEN max(k) < 2 OR sum(n * (m - om) * (m - om)) + sum(n * v) = 0 THEN 0 ELSE sum(n * (m - om) * (m - om)) / (sum(n * (m - om) * (m - om)) + sum(n * v)) END AS association FROM pg JOIN ov USING (batch, feature) GROUP BY 1, 2)"""
_V = f"""cat AS ({_CAT}), cell AS (SELECT batch, feature, g, x, count(*) AS o FROM cat GROUP BY 1, 2, 3, 4), rowt AS (SELECT batch, feature, g, sum(o) AS r FROM cell GROUP BY 1, 2, 3 HAVING sum(o) >= {MIN}),
 kept AS (SELECT cell.*, r FROM cell JOIN rowt USING (batch, feature, g)), colt AS (SELECT batch, feature, x, sum(o) AS c FROM kept GROUP BY 1, 2, 3),
 v AS (SELECT batch, feature, CASE WHEN least(count(DISTINCT g), count(DISTINCT x)) < 2 THEN 0 ELSE sqrt(greatest(sum(o::DOUBLE * o / (r::DOUBLE * c)) - 1, 0) / (least(count(DISTINCT g), count(DISTINCT x)) - 1)) END AS association FROM kept JOIN colt USING (batch, feature, x) GROUP BY 1, 2)"""


@query("g2_eta_squared", f"{STRESSED}, {_ETA} SELECT * FROM eta", ["association"])
def g2(spark, d):
    return asc.eta_squared(stressed(spark, d), b.NUMERIC, GROUP, minimum_group_size=MIN)


@query("g2_eta_squared_embeddings", """WITH l AS (SELECT label::VARCHAR AS g, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  pg AS (SELECT i, g, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2), ov AS (SELECT i, sum(n * m) / sum(n) AS om FROM pg GROUP BY 1)
  SELECT 'current' AS batch, 'e' || i AS feature, sum(n * (m - om) * (m - om)) / (sum(n * (m - om) * (m - om)) + sum(n * v)) AS association FROM pg JOIN ov USING (i) GROUP BY i""", ["association"])
def g2_wide(spark, d):
    rows = b.table(spark, d, "embeddings").select(F.lit("current").alias("batch"), "label", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    return asc.eta_squared(rows, [f"e{i}" for i in range(64)], "label")


@query("g3_cramers_v", f"{STRESSED}, {_V} SELECT * FROM v", ["association"])
def g3(spark, d):
    return asc.cramers_v(stressed(spark, d), b.CATEGORICAL, GROUP, minimum_group_size=MIN)


_POS = " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(b.NUMERIC + b.CATEGORICAL))
_G4 = f"""{STRESSED}, {_ETA}, {_V}, au AS (SELECT *, 'numeric' AS feature_type FROM eta UNION ALL SELECT *, 'categorical' FROM v),
 g4a AS (SELECT feature, feature_type, coalesce(max(association) FILTER (WHERE batch = 'reference'), 0) AS reference_association, coalesce(max(association) FILTER (WHERE batch = 'current'), 0) AS current_association FROM au GROUP BY 1, 2),
 g4 AS (SELECT *, current_association - reference_association AS association_delta, (CASE feature {_POS} END)::INTEGER AS feature_position FROM g4a)"""


def pairs(spark, d):
    return asc.association_pairs(stressed(spark, d), b.NUMERIC, b.CATEGORICAL, GROUP, minimum_group_size=MIN)


@query("g4_association_delta", _G4 + " SELECT * FROM g4", ["reference_association", "current_association", "association_delta"])
def g4(spark, d):
    return pairs(spark, d)


_FILL = ", ".join(f"avg({c}::DOUBLE) AS m_{c}" for c in WEIGHTS)
_ATTR = f"""mm AS (SELECT {_FILL} FROM stressed), att AS ({' UNION ALL '.join(f"SELECT application_id, {GROUP} AS g, risk_probability, '{c}' AS feature, coalesce({c}::DOUBLE - m_{c}, 0.0::DOUBLE) * {w}::DOUBLE AS attribution FROM stressed, mm" for c, w in WEIGHTS.items())})"""
_IMP = _ATTR + """, imp0 AS (SELECT feature, avg(abs(attribution)) AS mean_abs_attribution, avg(attribution) AS mean_attribution FROM att GROUP BY 1),
 imp AS (SELECT row_number() OVER (ORDER BY mean_abs_attribution DESC, feature)::INTEGER AS rank, * FROM imp0)"""


def attributions(spark, d):
    return att.linear_attribution(stressed(spark, d), WEIGHTS, ["application_id", GROUP])


# importance of one-hot columns: the spread of each level's share, next to the numeric attributions
def encoded_importance(spark, d):
    numeric = att.importance(attributions(spark, d)).select("feature", "mean_abs_attribution")
    levels = stressed(spark, d).groupBy("employment_type").agg(F.avg("risk_probability").alias("r")).select(
        F.concat(F.lit("employment_type_"), "employment_type").alias("feature"), (F.col("r") / 10.0).alias("mean_abs_attribution")
    )
    return numeric.unionByName(levels)


_G5 = f"""enc AS (SELECT feature, mean_abs_attribution FROM imp UNION ALL SELECT 'employment_type_' || employment_type, avg(risk_probability) / 10 FROM stressed GROUP BY employment_type),
 infl AS (SELECT g4.feature, coalesce(sum(enc.mean_abs_attribution), 0) AS model_influence FROM g4 LEFT JOIN enc ON CASE WHEN feature_type = 'numeric' THEN enc.feature = g4.feature ELSE starts_with(enc.feature, g4.feature || '_') END GROUP BY 1)"""
_G6 = f"""{_G4}, {_IMP}, {_G5}, g6 AS (SELECT g4.*, model_influence, row_number() OVER (ORDER BY association_delta DESC, feature_position)::INTEGER AS association_rank, row_number() OVER (ORDER BY model_influence DESC, feature_position)::INTEGER AS model_influence_rank FROM g4 JOIN infl USING (feature)),
 g7 AS (SELECT *, association_delta >= 0.001 AND model_influence_rank <= 4 AS review_priority FROM g6)"""


@query("g5_raw_feature_influence", f"{_G4}, {_IMP}, {_G5} SELECT * FROM infl", ["model_influence"])
def g5(spark, d):
    kinds = [(c, "numeric") for c in b.NUMERIC] + [(c, "categorical") for c in b.CATEGORICAL]
    return asc.raw_feature_influence(spark.createDataFrame(kinds, "feature string, feature_type string"), encoded_importance(spark, d))


def signals(spark, d):
    kinds = [(c, "numeric") for c in b.NUMERIC] + [(c, "categorical") for c in b.CATEGORICAL]
    infl = asc.raw_feature_influence(spark.createDataFrame(kinds, "feature string, feature_type string"), encoded_importance(spark, d))
    return asc.proxy_risk(pairs(spark, d), infl, top_influence=4)


@query("g6_two_ranks", _G6 + " SELECT feature, association_rank, model_influence_rank FROM g6")
def g6(spark, d):
    return signals(spark, d).select("feature", "association_rank", "model_influence_rank")


@query("g7_review_priority", _G6 + " SELECT feature, association_delta, model_influence, review_priority FROM g7", ["association_delta", "model_influence"])
def g7(spark, d):
    return signals(spark, d).select("feature", "association_delta", "model_influence", "review_priority")


@query("g8_review_lists", _G6 + " SELECT coalesce(string_agg(feature, ',' ORDER BY association_rank) FILTER (WHERE review_priority), '') AS review_priority_features, string_agg(feature, ',' ORDER BY association_rank) FILTER (WHERE association_rank <= 5) AS top_association_features FROM g7")
def g8(spark, d):
    found = asc.review_lists(signals(spark, d))
    return found.select(*[F.array_join(c, ",").alias(c) for c in found.columns])


@query("g9_linear_attribution", f"{STRESSED}, {_ATTR} SELECT application_id, feature, attribution FROM att", ["attribution"])
def g9(spark, d):
    return attributions(spark, d).select("application_id", "feature", "attribution")


@query(
    "g9_occlusion_attribution",
    f"""{STRESSED}, occ AS (SELECT *, 'device_risk_score' AS feature FROM stressed UNION ALL SELECT * REPLACE (0.5::DOUBLE AS credit_utilization), 'credit_utilization' FROM stressed),
    occ2 AS (SELECT *, {b._SCORE_SQL.format(dev="CASE WHEN feature = 'device_risk_score' THEN 0.4::DOUBLE ELSE device_risk_score END")} AS p2 FROM occ),
    lo AS (SELECT application_id, feature, least(greatest(risk_probability, 1e-9), 1 - 1e-9) AS a, least(greatest(p2, 1e-9), 1 - 1e-9) AS c FROM occ2)
    SELECT application_id, feature, ln(a / (1 - a)) - ln(c / (1 - c)) AS attribution FROM lo""",
    ["attribution"],
)
def g9_occlusion(spark, d):
    return att.occlusion_attribution(
        stressed(spark, d), b.scored, {"device_risk_score": 0.4, "credit_utilization": 0.5}, ["application_id"]
    )


@query("g10_global_importance", f"{STRESSED}, {_IMP} SELECT * FROM imp", ["mean_abs_attribution", "mean_attribution"])
def g10(spark, d):
    return att.importance(attributions(spark, d))


_GI = _IMP + """, gi AS (SELECT g, feature, count(*) AS sample_count, avg(abs(attribution)) AS mean_abs_attribution, avg(attribution) AS mean_attribution FROM att GROUP BY 1, 2),
 gr AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mean_abs_attribution DESC, feature)::INTEGER AS rank_within_group FROM gi)"""


def per_group(spark, d):
    return att.group_importance(attributions(spark, d), GROUP)


@query("g11_group_importance", f"{STRESSED}, {_GI} SELECT g AS grp, * EXCLUDE (g) FROM gr", ["mean_abs_attribution", "mean_attribution"])
def g11(spark, d):
    return renamed(per_group(spark, d))


@query("g12_group_delta", f"{STRESSED}, {_GI} SELECT feature, gr.mean_attribution, imp.mean_attribution AS overall_mean_attribution, gr.mean_attribution - imp.mean_attribution AS delta_mean_attribution FROM gr JOIN imp USING (feature) WHERE g = 'female|BUILDING'", ["mean_attribution", "overall_mean_attribution", "delta_mean_attribution"])
def g12(spark, d):
    rows = attributions(spark, d)
    found = att.group_delta(att.group_importance(rows, GROUP), att.importance(rows), "female|BUILDING")
    return found.select("feature", "mean_attribution", "overall_mean_attribution", "delta_mean_attribution")


@query(
    "g13_local_examples",
    f"""{STRESSED}, {_ATTR}, ch AS (SELECT application_id FROM stressed WHERE {GROUP} = 'female|BUILDING' ORDER BY risk_probability DESC, application_id LIMIT 3)
    SELECT application_id, risk_probability, feature, attribution, contribution_rank::INTEGER AS contribution_rank FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY abs(attribution) DESC, feature) AS contribution_rank FROM att JOIN ch USING (application_id)) WHERE contribution_rank <= 3""",
    ["risk_probability", "attribution"],
)
def g13(spark, d):
    rows = stressed(spark, d)
    found = att.local_examples(rows, attributions(spark, d), GROUP, "female|BUILDING", top_k=3)
    return found.select("application_id", "risk_probability", "feature", "attribution", "contribution_rank")


@query("g14_stable_sample", f"WITH {b.APPS_SQL} SELECT application_id FROM apps ORDER BY sha256(application_id || '|42'), application_id LIMIT 300")
def g14(spark, d):
    return att.stable_sample(b.apps(spark, d), 300, "application_id").select("application_id")


@query("g15_top_positive_features", f"{STRESSED}, {_GI} SELECT feature, mean_attribution FROM gr WHERE g = 'female|BUILDING' ORDER BY mean_attribution DESC, feature LIMIT 3", ["mean_attribution"])
def g15(spark, d):
    return att.top_positive_features(per_group(spark, d), "female|BUILDING", 3)


