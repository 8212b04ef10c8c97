"""Model, metrics, decision impact and root cause (families E, H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import impact, metrics, model, whatif
from wardline.operators.cumulative import exact_quantiles
from wardline.plans import bridge as b
from wardline.plans.quality import u01
from wardline.plans.registry import query
from wardline.sources import files
from wardline.sources.tables import stored

APPS = f"WITH {b.APPS_SQL} "
DRIFTED = f"WITH {b.DRIFTED_SQL} "


def apps(spark, d):
    return b.apps(spark, d)


# ------------------------------------------------------------------ E


@query(
    "e1_median_imputation",
    APPS + ", long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM apps" for c in b.NUMERIC) + """)
    SELECT feature, count(value) AS row_count, median(value) AS median, count(*) FILTER (WHERE value IS NULL) AS missing FROM long GROUP BY 1""",
    ["median"],
)
def e1(spark, d):
    rows = apps(spark, d)
    gone = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in b.NUMERIC]).unpivot([], b.NUMERIC, "feature", "missing")
    return model.medians(rows, b.NUMERIC).join(gone, "feature")


@query(
    "e2_mode_imputation",
    APPS + """, l AS (SELECT 'region' AS feature, region AS level FROM apps UNION ALL SELECT 'employment_type', employment_type FROM apps UNION ALL SELECT 'tie', CASE WHEN age % 2 = 0 THEN NULL ELSE 'z' END FROM apps),
    c AS (SELECT feature, level, count(*) AS n FROM l WHERE level IS NOT NULL GROUP BY 1, 2)
    SELECT feature, min(level) AS mode FROM c JOIN (SELECT feature, max(n) AS n FROM c GROUP BY 1) USING (feature, n) GROUP BY 1""",
)
def e2(spark, d):
    rows = apps(spark, d).withColumn("tie", F.when(F.col("age") % 2 != 0, "z"))
    return model.modes(rows, ["region", "employment_type", "tie"])


_LEVELS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("e3_one_hot", APPS + "SELECT application_id, " + ", ".join(f"(region = '{v}' AND batch = 'reference')::DOUBLE AS hot_{i}" for i, v in enumerate(_LEVELS)) + " FROM apps", [f"hot_{i}" for i in range(5)])
def e3(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array

    rows = apps(spark, d).withColumn("level", F.when(F.col("batch") == "reference", F.col("region")).otherwise("unseen"))
    index = StringIndexer(inputCol="level", outputCol="i", handleInvalid="keep", stringOrderType="alphabetAsc")
    fitted = Pipeline(stages=[index, OneHotEncoder(inputCol="i", outputCol="v", dropLast=True)]).fit(rows.where("batch = 'reference'"))
    hot = vector_to_array("v")
    return fitted.transform(rows).select("application_id", *[hot[i].alias(f"hot_{i}") for i in range(5)])


@query("e4_assembled_columns", APPS + "SELECT application_id, 15::BIGINT AS n_features, age + annual_income + coalesce(device_risk_score, m) AS spot FROM apps, (SELECT median(device_risk_score) AS m FROM apps)", ["spot"])
def e4(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from wardline.functions.scalar import engineered_features

    rows = engineered_features(apps(spark, d))
    names = [*b.NUMERIC, *model.ENGINEERED]
    prep = model.fit_preprocess(rows, names, [])
    ready = prep.apply(rows)
    vector = VectorAssembler(inputCols=[f"{c}_filled" for c in names], outputCol="v").transform(ready)
    a = vector_to_array("v")
    spot = a[names.index("age")] + a[names.index("annual_income")] + a[names.index("device_risk_score")]
    return vector.select("application_id", F.size(a).cast("bigint").alias("n_features"), spot.alias("spot"))


_MODELS: dict[tuple[str, str], tuple[model.Scorer, str]] = {}


def fitted(spark, d):
    """The whole model (280 trees), fitted once per application and input and saved: (as fitted, its folder)."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        train = stored(apps(spark, d).where("batch = 'reference'"), "train")
        scorer = model.fit_score_pipeline(train, b.NUMERIC, b.CATEGORICAL)
        path = files.work_dir(spark, "model")
        scorer.save(path)
        _MODELS[key] = scorer, path
    return _MODELS[key]


@query("e5_boosted_trees")
def e5(spark, d):
    scored = fitted(spark, d)[0].score(apps(spark, d))
    return metrics.ranking_metrics(scored, ["batch"])


@query("e5_better_than_chance", APPS + "SELECT batch, count(*) AS n_samples, true AS better FROM apps GROUP BY 1")
def e5_band(spark, d):
    found = metrics.classification_metrics(fitted(spark, d)[0].score(apps(spark, d)), ["batch"])
    return found.select("batch", "n_samples", F.col("roc_auc").between(0.5, 1.0).alias("better"))


@query("e6_score_batch")
def e6(spark, d):
    found = fitted(spark, d)[0].score(apps(spark, d))
    return found.select("application_id", "model_name", "model_version", "risk_probability", "predicted_default", "approved")


@query(
    "e6_score_checks",
    APPS + "SELECT 'default_risk' AS model_name, count(*) AS row_count, count(DISTINCT application_id) AS keys, count(*) AS in_range, count(*) AS decisions_agree FROM apps",
)
def e6_checks(spark, d):
    p = F.col("risk_probability")
    agree = (F.col("predicted_default") == (p >= 0.5).cast("int")) & (F.col("approved") == 1 - F.col("predicted_default"))
    return e6(spark, d).groupBy("model_name").agg(
        F.count("*").alias("row_count"), F.count_distinct("application_id").alias("keys"), F.count_if(p.between(0, 1)).alias("in_range"), F.count_if(agree).alias("decisions_agree")
    )


@query("a9_save_load_model", APPS + "SELECT count(*) AS row_count, count(*) AS equal_scores, 0.0::DOUBLE AS max_abs_difference FROM apps", ["max_abs_difference"])
def a9(spark, d):
    """The model as fitted and as read back score every row alike; the counts are of rows that both have."""
    fresh, path = fitted(spark, d)
    rows = apps(spark, d)
    a = fresh.score(rows).select("application_id", F.col("risk_probability").alias("a"))
    both = a.join(model.Scorer.load(spark, path).score(rows).select("application_id", F.col("risk_probability").alias("b")), "application_id")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("row_count"), F.count_if(gap == 0).alias("equal_scores"), F.max(gap).alias("max_abs_difference"))


def auc_sql(rows: str, by: str) -> str:
    return f"""sc AS (SELECT {by} AS k, risk_probability AS p, count(*) FILTER (WHERE default_30d = 1)::DOUBLE AS pos, count(*) FILTER (WHERE default_30d = 0)::DOUBLE AS neg FROM {rows} GROUP BY 1, 2),
    cm AS (SELECT *, sum(neg) OVER w - neg AS below, sum(pos) OVER v AS top_pos, sum(neg) OVER v AS top_neg, sum(pos) OVER (PARTITION BY k) AS tp, sum(neg) OVER (PARTITION BY k) AS tn FROM sc
      WINDOW w AS (PARTITION BY k ORDER BY p), v AS (PARTITION BY k ORDER BY p DESC)),
    auc AS (SELECT k, sum(pos * (below + neg / 2)) / (max(tp) * max(tn)) AS roc_auc, sum(pos * top_pos / (top_pos + top_neg)) / max(tp) AS pr_auc FROM cm GROUP BY 1)"""


@query("e7_roc_auc", APPS + "," + auc_sql("apps", "region") + " SELECT k AS region, roc_auc FROM auc", ["roc_auc"])
def e7(spark, d):
    return metrics.ranking_metrics(apps(spark, d), ["region"]).select("region", "roc_auc")


@query("e8_average_precision", APPS + "," + auc_sql("apps", "region") + " SELECT k AS region, pr_auc FROM auc", ["pr_auc"])
def e8(spark, d):
    return metrics.ranking_metrics(apps(spark, d), ["region"]).select("region", "pr_auc")


FLAT = """tn AS (SELECT {by} AS k, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp,
  count(*) AS n_samples, avg((p - y) * (p - y)) AS brier_score, avg((p >= 0.5)::INT) AS predicted_positive_rate, avg(y) AS target_rate, avg((device_risk_score IS NULL)::INT) AS watched_null_rate
  FROM (SELECT *, risk_probability AS p, default_30d AS y FROM {rows}) GROUP BY 1),
flat AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM tn)"""


@query("e9_precision_recall", APPS + "," + FLAT.format(by="region", rows="apps") + " SELECT k AS region, precision, recall, f1 FROM flat", ["precision", "recall", "f1"])
def e9(spark, d):
    return metrics.threshold_metrics(apps(spark, d), ["region"]).select("region", "precision", "recall", "f1")


@query("e10_brier", APPS + "," + FLAT.format(by="region", rows="apps") + " SELECT k AS region, brier_score FROM flat", ["brier_score"])
def e10(spark, d):
    return metrics.threshold_metrics(apps(spark, d), ["region"]).select("region", "brier_score")


@query("e11_confusion_matrix", APPS + "," + FLAT.format(by="region", rows="apps") + " SELECT k AS region, tn, fp, fn, tp FROM flat")
def e11(spark, d):
    return metrics.threshold_metrics(apps(spark, d), ["region"]).select("region", "tn", "fp", "fn", "tp")


@query(
    "e12_rates",
    APPS + "," + FLAT.format(by="batch", rows="apps") + " SELECT k AS batch, n_samples, predicted_positive_rate, target_rate, watched_null_rate FROM flat",
    ["predicted_positive_rate", "target_rate", "watched_null_rate"],
)
def e12(spark, d):
    found = metrics.threshold_metrics(apps(spark, d), ["batch"], watched="device_risk_score")
    return found.select("batch", "n_samples", "predicted_positive_rate", "target_rate", "watched_null_rate")


@query("e13_prediction_table", APPS + "SELECT application_id, default_30d AS y_true, risk_probability AS probability FROM apps", ["probability"])
def e13(spark, d):
    return metrics.prediction_table(apps(spark, d))


@query(
    "e14_roc_points",
    APPS + "," + auc_sql("apps", "region") + """, pts AS (SELECT k AS region, p AS threshold, top_neg / tn AS fpr, top_pos / tp AS tpr FROM cm)
    SELECT region, threshold, fpr, tpr FROM (SELECT *, row_number() OVER (PARTITION BY region, floor(fpr * 50) ORDER BY threshold) AS r FROM pts) WHERE r = 1""",
    ["threshold", "fpr", "tpr"],
)
def e14(spark, d):
    return metrics.roc_points(apps(spark, d), ["region"], points=50)


@query(
    "e14_roc_whole",
    APPS + "," + auc_sql("apps", "region") + " SELECT k AS region, p AS threshold, top_neg / tn AS fpr, top_pos / tp AS tpr FROM cm",
    ["threshold", "fpr", "tpr"],
)
def e14_whole(spark, d):
    return metrics.roc_points(apps(spark, d), ["region"])


_CMP = ["roc_auc", "watched_null_rate", "brier_score"]


@query(
    "e15_before_after",
    DRIFTED + "," + auc_sql("drifted", "batch") + "," + FLAT.format(by="batch", rows="drifted") + ", m AS (SELECT k, roc_auc, watched_null_rate, brier_score FROM auc JOIN flat USING (k)), w AS (SELECT "
    + ", ".join(f"max({c}) FILTER (WHERE k = 'reference') AS {c}_before, max({c}) FILTER (WHERE k = 'current') AS {c}_after" for c in _CMP)
    + " FROM m) SELECT *, " + ", ".join(f"{c}_after - {c}_before AS {c}_change" for c in _CMP) + " FROM w",
    [f"{c}_{s}" for c in _CMP for s in ("before", "after", "change")],
)
def e15(spark, d):
    found = metrics.classification_metrics(b.drifted(apps(spark, d)), ["batch"], watched="device_risk_score", bounded=True)
    return metrics.compare_scenarios(found, "batch", "reference", "current", _CMP)


_SLICE = ["roc_auc", "pr_auc", "precision", "recall", "f1", "brier_score", "predicted_positive_rate", "target_rate"]


@query(
    "e16_slice_metrics",
    APPS + ", keyed AS (SELECT *, employment_type || '/' || region AS segment FROM apps), " + auc_sql("keyed", "segment") + "," + FLAT.format(by="segment", rows="keyed")
    + f" SELECT k AS segment, n_samples, tn, fp, fn, tp, {', '.join(_SLICE)} FROM auc JOIN flat USING (k)",
    _SLICE,
)
def e16(spark, d):
    rows = apps(spark, d).withColumn("segment", F.concat_ws("/", "employment_type", "region"))
    return metrics.classification_metrics(rows, ["segment"]).select("segment", "n_samples", "tn", "fp", "fn", "tp", *_SLICE)


# labelled documents: a score from the text length, with many ties
@query(
    "e7_roc_auc_labels",
    "WITH apps AS (SELECT lang AS region, quality AS default_30d, least(n_chars // 500, 20)::DOUBLE / 20 AS risk_probability FROM labels JOIN documents USING (doc_id)), "
    + auc_sql("apps", "region") + " SELECT k AS lang, roc_auc, pr_auc FROM auc",
    ["roc_auc", "pr_auc"],
)
def e7_labels(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "lang", (F.least(F.floor(F.col("n_chars") / 500), F.lit(20)).cast("double") / 20).alias("s"))
    return metrics.ranking_metrics(b.table(spark, d, "labels").join(docs, "doc_id"), ["lang"], "quality", "s")


# ------------------------------------------------------------------ H
# Two versions of the same population: every order before and after the what-if shift.

_PAIR = f"""WITH {b.APPS_SQL}, moved0 AS (SELECT * REPLACE (CASE WHEN device_risk_score IS NULL THEN NULL ELSE least(greatest(0.5::DOUBLE + 0.42::DOUBLE * (device_risk_score - 0.5::DOUBLE) + (-0.04)::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END AS device_risk_score) FROM apps),
 moved AS (SELECT * REPLACE ({b._SCORE_SQL.format(dev='device_risk_score')} AS risk_probability) FROM moved0),
 duo AS (SELECT 'healthy' AS scenario, * FROM apps UNION ALL SELECT 'incident', * FROM moved)"""
SEMANTIC = whatif.Shift("device_risk_score", shift=-0.04, center=0.5, scale=0.42)


def pair(spark, d):
    before = apps(spark, d)
    return before, b.scored(whatif.shift(before, [SEMANTIC]))


def both(spark, d):
    before, after = pair(spark, d)
    return before.withColumn("scenario", F.lit("healthy")).unionByName(after.withColumn("scenario", F.lit("incident")))


_H1 = """h1 AS (SELECT scenario, count(*) AS sample_count, count(*) FILTER (WHERE p < 0.5) AS approval_count, avg((p < 0.5)::INT) AS approval_rate, avg(y) AS overall_default_rate,
  avg(y) FILTER (WHERE p < 0.5) AS approved_default_rate, avg(p) AS mean_predicted_risk, avg(p) FILTER (WHERE p < 0.5) AS approved_mean_predicted_risk,
  avg((device_risk_score IS NULL)::INT) AS device_risk_null_rate, avg(device_risk_score) AS device_risk_observed_mean FROM (SELECT *, risk_probability AS p, default_30d AS y FROM duo) GROUP BY 1)"""
_H_DOUBLES = impact.METRICS[2:]
_J = """j AS (SELECT a.application_id, a.region AS segment, a.default_30d AS y, a.risk_probability < 0.5 AS was, m.risk_probability < 0.5 AS now FROM apps a JOIN moved m USING (application_id))"""
_TR = """count(*) FILTER (WHERE NOT was AND now) AS newly_approved_count, count(*) FILTER (WHERE was AND NOT now) AS newly_rejected_count, count(*) FILTER (WHERE was <> now) AS decision_flip_count,
  avg((was <> now)::INT) AS decision_flip_rate, avg(y) FILTER (WHERE NOT was AND now) AS newly_approved_default_rate"""


@query("h1_scenario_metrics", f"{_PAIR}, {_H1} SELECT * FROM h1", _H_DOUBLES)
def h1(spark, d):
    return impact.scenario_metrics(both(spark, d))


@query(
    "h2_same_population",
    f"""{_PAIR}, c AS (SELECT * FROM moved WHERE sex <> 'male' OR age > 25) SELECT (SELECT count(*) FROM apps WHERE application_id NOT IN (SELECT application_id FROM c)) AS only_before, 0::BIGINT AS only_after, 0::BIGINT AS repeated_keys, false AS same_population""",
)
def h2(spark, d):
    before, after = pair(spark, d)
    cut = after.where("sex <> 'male' OR age > 25")
    return impact.population_check(before, cut).select("only_before", "only_after", "repeated_keys", "same_population")


@query(
    "h3_same_labels",
    f"""{_PAIR} SELECT count(*) FILTER (WHERE default_30d = 1 AND age = 30) AS changed_labels, count(*) FILTER (WHERE default_30d = 1 AND age = 30) = 0 AS same_labels FROM apps""",
)
def h3(spark, d):
    before, after = pair(spark, d)
    edited = after.withColumn("default_30d", F.when(F.col("age") == 30, 0).otherwise(F.col("default_30d")))
    return impact.population_check(before, edited).select("changed_labels", "same_labels")


@query("h4_transitions", f"{_PAIR}, {_J} SELECT {_TR} FROM j", ["decision_flip_rate", "newly_approved_default_rate"])
def h4(spark, d):
    return impact.transitions(impact.aligned(*pair(spark, d)))


@query("h5_new_approval_default_rate", f"{_PAIR}, {_J} SELECT segment, avg(y) FILTER (WHERE NOT was AND now) AS newly_approved_default_rate FROM j GROUP BY 1", ["newly_approved_default_rate"])
def h5(spark, d):
    j = impact.aligned(*pair(spark, d), extra=["region"])
    fresh = (F.col("p_0") >= 0.5) & (F.col("p_1") < 0.5)
    return j.groupBy(F.col("region_0").alias("segment")).agg(F.avg(F.when(fresh, F.col("y_0").cast("double"))).alias("newly_approved_default_rate"))


_DELTA_SQL = ", ".join(f"max({m}) FILTER (WHERE scenario = 'incident') - max({m}) FILTER (WHERE scenario = 'healthy') AS {n}" for n, m in impact.DELTAS.items())


@query("h6_scenario_deltas", f"{_PAIR}, {_H1} SELECT {_DELTA_SQL} FROM h1", list(impact.DELTAS))
def h6(spark, d):
    return impact.scenario_deltas(impact.scenario_metrics(both(spark, d)), "healthy", "incident")


@query("h7_cohort_table", f"{_PAIR}, {_H1} SELECT scenario, sample_count, approval_count, approval_rate, approved_default_rate, mean_predicted_risk FROM h1", ["approval_rate", "approved_default_rate", "mean_predicted_risk"])
def h7(spark, d):
    return impact.scenario_metrics(both(spark, d)).select("scenario", "sample_count", "approval_count", "approval_rate", "approved_default_rate", "mean_predicted_risk")


@query(
    "h8_impact_comparison",
    f"{_PAIR}, {_H1}, {_J}, t AS (SELECT {_TR} FROM j), dl AS (SELECT {_DELTA_SQL} FROM h1) SELECT dl.*, t.*, true AS same_population, true AS same_labels FROM dl, t",
    [*impact.DELTAS, "decision_flip_rate", "newly_approved_default_rate"],
)
def h8(spark, d):
    return impact.compare(*pair(spark, d))


@query(
    "h9_transition_matrix",
    f"""{_PAIR}, {_J}, l AS (SELECT segment, CASE WHEN was THEN 'approved' ELSE 'rejected' END AS decision_before, CASE WHEN now THEN 'approved' ELSE 'rejected' END AS decision_after, y FROM j)
    SELECT segment, decision_before, decision_after, count(*) AS n, sum(y)::BIGINT AS defaults FROM l GROUP BY 1, 2, 3 UNION ALL SELECT 'ALL', decision_before, decision_after, count(*), sum(y)::BIGINT FROM l GROUP BY 2, 3""",
)
def h9(spark, d):
    return impact.transition_matrix(impact.aligned(*pair(spark, d), extra=["region"]), "region")


# ------------------------------------------------------------------ I


@query("i1_affine_shift", f"{_PAIR} SELECT application_id, device_risk_score, risk_probability FROM moved", ["device_risk_score", "risk_probability"])
def i1(spark, d):
    return pair(spark, d)[1].select("application_id", "device_risk_score", "risk_probability")


@query("i2_group_shift", f"WITH {b.STRESSED_SQL} SELECT application_id, device_risk_score, credit_utilization, bank_transaction_risk FROM stressed", ["device_risk_score", "credit_utilization", "bank_transaction_risk"])
def i2(spark, d):
    hit = (F.col("batch") == "current") & (F.col(b.INTERSECTION) == "female|BUILDING")
    shifts = [whatif.Shift("device_risk_score", 0.12), whatif.Shift("credit_utilization", 0.06, 0.01, 0.99), whatif.Shift("bank_transaction_risk", 0.05)]
    return whatif.shift(apps(spark, d), shifts, where=hit).select("application_id", *[s.column for s in shifts])


def gauss_sql(key: str) -> str:
    pieces = " + ".join(f"('0x' || substr(h, {4 * i + 1}, 4))::UINTEGER::BIGINT" for i in range(12))
    return f"(SELECT *, ({pieces} + 6)::DOUBLE / 65536.0::DOUBLE - 6.0::DOUBLE AS g FROM (SELECT *, sha256({key}) AS h FROM apps))"


@query(
    "i3_additive_noise",
    APPS + f"SELECT application_id, CASE WHEN device_risk_score IS NULL THEN NULL ELSE least(greatest(device_risk_score + 0.06::DOUBLE + g * 0.015::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END AS device_risk_score FROM {gauss_sql(chr(39).join(['application_id || ', '|42|device_risk_score', '']))}",
    ["device_risk_score"],
)
def i3(spark, d):
    noisy = whatif.Shift("device_risk_score", 0.06, noise_std=0.015)
    return whatif.shift(apps(spark, d), [noisy], key="application_id").select("application_id", "device_risk_score")


_MASK = f"""drawn AS (SELECT *, CASE WHEN device_risk_score IS NOT NULL THEN -ln({u01("application_id || '|42|missing'")}) / (0.2::DOUBLE + device_risk_score * device_risk_score * 2.8::DOUBLE) END AS draw FROM apps),
 k AS (SELECT greatest(round_even(count(*) * 0.22::DOUBLE, 0)::BIGINT - count(*) FILTER (WHERE device_risk_score IS NULL), 0) AS k FROM apps),
 masked AS (SELECT * EXCLUDE (draw, pos), draw IS NOT NULL AND pos <= (SELECT k FROM k) AS newly_missing FROM (SELECT *, row_number() OVER (ORDER BY draw NULLS LAST, application_id) AS pos FROM drawn))"""


@query("i4_weighted_missingness", f"{APPS}, {_MASK} SELECT application_id, newly_missing FROM masked")
def i4(spark, d):
    return whatif.weighted_null_mask(stored(apps(spark, d), "apps"), "device_risk_score", 0.22).select("application_id", "newly_missing")


_MOVED_X = "CASE WHEN device_risk_score IS NULL THEN NULL ELSE least(greatest(0.5::DOUBLE + 0.42::DOUBLE * (device_risk_score - 0.5::DOUBLE) + (-0.04)::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END"
_FRAMES = f"""{APPS}, {_MASK}, vals AS (SELECT *, device_risk_score AS healthy_value, {_MOVED_X} AS semantic_value, risk_probability AS healthy_probability FROM masked),
 fr0 AS (SELECT * REPLACE (healthy_value AS device_risk_score), 'healthy' AS scenario FROM vals UNION ALL SELECT * REPLACE (semantic_value AS device_risk_score), 'semantic_only' FROM vals
   UNION ALL SELECT * REPLACE (CASE WHEN newly_missing THEN NULL ELSE healthy_value END AS device_risk_score), 'missingness_only' FROM vals UNION ALL SELECT * REPLACE (CASE WHEN newly_missing THEN NULL ELSE semantic_value END AS device_risk_score), 'combined' FROM vals),
 fr AS (SELECT * REPLACE ({b._SCORE_SQL.format(dev='device_risk_score')} AS risk_probability) FROM fr0)"""


def frames(spark, d):
    rows = stored(apps(spark, d), "apps").withColumn("healthy_probability", F.col("risk_probability"))
    return b.scored(whatif.ablation(rows, SEMANTIC))


@query("i5_ablation_frames", f"{_FRAMES} SELECT application_id, scenario, device_risk_score FROM fr", ["device_risk_score"])
def i5(spark, d):
    return frames(spark, d).select("application_id", "scenario", "device_risk_score")


@query("i6_mask_transfer", f"{APPS}, {_MASK} SELECT application_id, CASE WHEN newly_missing THEN NULL ELSE device_risk_score END AS device_risk_score FROM masked", ["device_risk_score"])
def i6(spark, d):
    rows = stored(apps(spark, d), "apps")
    masked = whatif.weighted_null_mask(rows, "device_risk_score", 0.22)
    other = masked.withColumn("device_risk_score", F.when(~F.col("newly_missing"), F.col("device_risk_score")))
    return whatif.transfer_mask(rows, other, "application_id", "device_risk_score").select("application_id", "device_risk_score")


@query("i7_ablation_invariants", "SELECT count(*) > 0 AS same_population, count(*) > 0 AS same_labels, count(*) > 0 AS semantic_keeps_missingness, count(*) > 0 AS mask_shared FROM orders")
def i7(spark, d):
    return whatif.ablation_invariants(frames(spark, d), "application_id", "device_risk_score")


_I8 = f"""{_FRAMES}, {auc_sql('fr', 'scenario')}, fm AS (SELECT scenario, count(*) AS sample_count, avg((p - y) * (p - y)) AS brier_score, avg((p < 0.5)::INT) AS approval_rate, avg(y) FILTER (WHERE p < 0.5) AS approved_default_rate,
  avg(p) AS mean_predicted_risk, avg((device_risk_score IS NULL)::INT) AS device_risk_null_rate, count(*) FILTER (WHERE (h < 0.5) <> (p < 0.5)) AS decision_flip_count, avg(((h < 0.5) <> (p < 0.5))::INT) AS decision_flip_rate,
  count(*) FILTER (WHERE h >= 0.5 AND p < 0.5) AS newly_approved_count, count(*) FILTER (WHERE h < 0.5 AND p >= 0.5) AS newly_rejected_count FROM (SELECT *, risk_probability AS p, default_30d AS y, healthy_probability AS h FROM fr) GROUP BY 1),
 i8 AS (SELECT fm.*, roc_auc, pr_auc FROM fm JOIN auc ON k = scenario)"""
_I8_DOUBLES = ["brier_score", "approval_rate", "approved_default_rate", "mean_predicted_risk", "device_risk_null_rate", "decision_flip_rate", "roc_auc", "pr_auc"]


@query("i8_root_cause_metrics", f"{_I8} SELECT * FROM i8", _I8_DOUBLES)
def i8(spark, d):
    return whatif.root_cause_metrics(frames(spark, d))


_EFFECT = ["roc_auc", "approval_rate", "approved_default_rate", "mean_predicted_risk"]


@query(
    "i9_factorial_effects",
    _I8 + ", p AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, " + ", ".join(f"max({m}) FILTER (WHERE scenario = '{s}') AS {s}" for s in whatif.SCENARIOS) + " FROM i8" for m in _EFFECT
    ) + """) SELECT metric, ((semantic_only - healthy) + (combined - missingness_only)) / 2 AS semantic_main_effect, ((missingness_only - healthy) + (combined - semantic_only)) / 2 AS missingness_main_effect,
    combined - semantic_only - missingness_only + healthy AS interaction_effect FROM p""",
    ["semantic_main_effect", "missingness_main_effect", "interaction_effect"],
)
def i9(spark, d):
    return whatif.factorial_table(whatif.root_cause_metrics(frames(spark, d)), _EFFECT)


@query(
    "i10_counterfactual_rescore",
    " UNION ALL ".join(
        f"{'' if i else APPS}SELECT '{c}' AS candidate, count(*) AS row_count, count(*) FILTER (WHERE device_risk_score IS NULL) AS overridden, 0::BIGINT AS moved_elsewhere FROM apps"
        for i, c in enumerate(["fitted_median", "training_q90"])
    ),
)
def i10(spark, d):
    """Rescore with missing device scores set to the fitted median and to a training quantile: only those rows may move."""
    scorer, _ = fitted(spark, d)
    rows = apps(spark, d)
    q90 = exact_quantiles(rows.where("batch = 'reference'"), [], "device_risk_score", [0.9], names=["q"]).first()["q"]
    base = scorer.score(rows).select("application_id", "device_risk_score", F.col("risk_probability").alias("before"))
    found = []
    for name, fill in (("fitted_median", scorer.preprocess.medians["device_risk_score"]), ("training_q90", q90)):
        after = scorer.score(rows, override={"device_risk_score": F.lit(fill)}).select("application_id", F.col("risk_probability").alias("after"))
        gone, still = F.col("device_risk_score").isNull(), F.lit(name == "fitted_median")  # the median is what is filled in anyway
        moved = (F.col("before") != F.col("after")) & (~gone | still)
        found.append(base.join(after, "application_id").agg(
            F.lit(name).alias("candidate"), F.count("*").alias("row_count"), F.count_if(gone).alias("overridden"), F.count_if(moved).alias("moved_elsewhere")
        ))
    return found[0].unionByName(found[1])


@query(
    "i11_newly_missing_profile",
    f"""{_FRAMES}, md AS (SELECT median(device_risk_score) AS m FROM apps WHERE batch = 'reference'), a AS (SELECT count(*) AS newly_missing_count, avg(semantic_value) AS semantic_reference_mean, avg(healthy_value) AS healthy_reference_mean FROM fr WHERE scenario = 'combined' AND newly_missing)
    SELECT a.*, m AS fitted_median, semantic_reference_mean - m AS semantic_reference_minus_median FROM a, md""",
    ["semantic_reference_mean", "healthy_reference_mean", "fitted_median", "semantic_reference_minus_median"],
)
def i11(spark, d):
    train = apps(spark, d).where("batch = 'reference'")
    median = exact_quantiles(train, [], "device_risk_score", [0.5], names=["median"]).select("median")
    return whatif.newly_missing_profile(frames(spark, d), median)


_QS = [0.60, 0.75, 0.90]
_FILLS = "fills AS (SELECT " + ", ".join(f"quantile_cont(device_risk_score, {q}::DOUBLE) AS q{round(q * 100)}" for q in [0.5, *_QS]) + " FROM apps WHERE batch = 'reference')"
_CAND = f"""{_FRAMES}, {_FILLS}, comb AS (SELECT * FROM fr WHERE scenario = 'combined'),
 cand0 AS (SELECT comb.*, 'median_control' AS candidate, q50 AS fill FROM comb, fills UNION ALL SELECT comb.*, 'oracle_semantic_restore', CASE WHEN newly_missing THEN semantic_value ELSE q50 END FROM comb, fills
   UNION ALL SELECT comb.*, 'training_q60', q60 FROM comb, fills UNION ALL SELECT comb.*, 'training_q75', q75 FROM comb, fills UNION ALL SELECT comb.*, 'training_q90', q90 FROM comb, fills),
 cand AS (SELECT * REPLACE ({b._SCORE_SQL.format(dev='coalesce(device_risk_score, fill)')} AS risk_probability) FROM cand0), {auc_sql('cand', 'candidate')},
 cm2 AS (SELECT candidate, count(*) AS sample_count, avg((p < 0.5)::INT) AS approval_rate, avg(y) FILTER (WHERE p < 0.5) AS approved_default_rate, avg(p) AS mean_predicted_risk, count(*) FILTER (WHERE (h < 0.5) <> (p < 0.5)) AS decision_flip_count
   FROM (SELECT *, risk_probability AS p, default_30d AS y, healthy_probability AS h FROM cand) GROUP BY 1),
 sweep AS (SELECT cm2.*, roc_auc FROM cm2 JOIN auc ON k = candidate)"""
_SWEEP = ["approval_rate", "approved_default_rate", "mean_predicted_risk", "roc_auc"]


def sweep(spark, d):
    rows = apps(spark, d)
    train = rows.where("batch = 'reference'")
    combined = frames(spark, d).where("scenario = 'combined'")
    cases = whatif.remediation_rows(combined, train, "device_risk_score", _QS)
    points = b.score_points(F.coalesce("device_risk_score", "fill"))
    scored = cases.withColumn("risk_probability", points.cast("double") / 10000.0)
    found = whatif.root_cause_metrics(scored, scenario="candidate")
    return found.select("candidate", "sample_count", *_SWEEP, "decision_flip_count")


@query(
    "i12_remediation_deltas",
    f"""{_CAND} SELECT s.candidate, s.roc_auc - m.roc_auc AS roc_auc_delta, s.approval_rate - m.approval_rate AS approval_rate_delta,
      CASE s.candidate WHEN 'training_q60' THEN q60 WHEN 'training_q75' THEN q75 ELSE q90 END AS replacement_value
      FROM sweep s, fills, (SELECT * FROM sweep WHERE candidate = 'median_control') m WHERE s.candidate LIKE 'training%'""",
    ["roc_auc_delta", "approval_rate_delta", "replacement_value"],
)
def i12_deltas(spark, d):
    """Candidates against combined as it was scored, with missing rows at the median."""
    found = stored(sweep(spark, d), "sweep")
    fills = whatif.fill_values(apps(spark, d).where("batch = 'reference'"), "device_risk_score", _QS)
    deltas = whatif.delta_vs(found, found.where("candidate = 'median_control'"), ["roc_auc", "approval_rate"])
    return deltas.join(fills, "candidate").select("candidate", "roc_auc_delta", "approval_rate_delta", "replacement_value")


@query("i12_remediation_sweep", f"{_CAND} SELECT * FROM sweep WHERE candidate LIKE 'training%'", _SWEEP)
def i12(spark, d):
    return sweep(spark, d).where(F.startswith("candidate", F.lit("training")))


@query("i13_oracle_restore", f"{_CAND} SELECT * FROM sweep WHERE candidate = 'oracle_semantic_restore'", _SWEEP)
def i13(spark, d):
    return sweep(spark, d).where("candidate = 'oracle_semantic_restore'")


@query(
    "i14_max_score_difference",
    f"{_PAIR} SELECT max(abs(a.risk_probability - m.risk_probability)) AS max_abs_difference, avg(abs(a.risk_probability - m.risk_probability)) AS mean_abs_difference FROM apps a JOIN moved m USING (application_id)",
    ["max_abs_difference", "mean_abs_difference"],
)
def i14(spark, d):
    return impact.max_score_difference(*pair(spark, d))


@query(
    "i15_frames_equal",
    f"""{_PAIR} SELECT 'device_risk_score' AS column_name, count(*) FILTER (WHERE abs(a.device_risk_score - m.device_risk_score) > 1e-12) AS mismatched_rows, false AS equal FROM apps a JOIN moved m USING (application_id)
    UNION ALL SELECT 'sex', 0, true FROM orders GROUP BY 1""",
)
def i15(spark, d):
    return impact.frames_equal(*pair(spark, d), "application_id", ["device_risk_score", "sex"])


@query(
    "i16_reports_agree",
    f"{_PAIR}, {_H1} SELECT scenario, 'approval_rate' AS metric, approval_rate AS left_value, approval_rate AS right_value, true AS agrees FROM h1 UNION ALL SELECT scenario, 'mean_predicted_risk', mean_predicted_risk, mean_predicted_risk + (scenario = 'incident')::INT, scenario <> 'incident' FROM h1",
    ["left_value", "right_value"],
)
def i16(spark, d):
    table = impact.scenario_metrics(both(spark, d))
    left = table.select("scenario", "approval_rate", "mean_predicted_risk").unpivot(["scenario"], ["approval_rate", "mean_predicted_risk"], "metric", "value")
    bump = F.when((F.col("metric") == "mean_predicted_risk") & (F.col("scenario") == "incident"), 1.0).otherwise(0.0)
    return impact.reports_agree(left, left.withColumn("value", F.col("value") + bump), ["scenario", "metric"])
