"""Sources, row expressions and the data contract (families A, B, C)."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from wardline.functions import scalar as s
from wardline.functions import status as st
from wardline.operators import attribution, contract as ct, drift, metrics, whatif
from wardline.plans import bridge as b
from wardline.plans.registry import query
from wardline.sources import files

APPS = f"WITH {b.APPS_SQL} "
DRIFTED = f"WITH {b.DRIFTED_SQL} "


def current(spark, d):
    return b.apps(spark, d)


# ------------------------------------------------------------------ A


@query("a1_read_batch", "SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY 1")
def a1(spark, d):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    return files.read_batch(spark, f"{d}/orders.parquet", schema).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


@query("a2_write_table", "SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY 1, 2")
def a2(spark, d):
    out = b.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"))
    path = files.work_dir(spark, "table")
    files.write_table(out, path)
    return files.read_batch(spark, path, "l_returnflag string, l_linestatus string, n_rows bigint", "csv")


@query(
    "a3_sorted_json",
    """SELECT '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders""",
)
def a3(spark, d):
    return files.sorted_json(b.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"))


@query("a4_event_log", "SELECT event_type, count(*) AS n_events, sum(user_id)::BIGINT AS user_sum FROM events GROUP BY 1")
def a4(spark, d):
    path = files.work_dir(spark, "log")
    rows = b.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    even = F.col("event_id") % 2 == 0
    files.append_events(files.event_rows(rows.where(even), at="ts"), path)
    files.append_events(files.event_rows(rows.where(~even), at="ts"), path)
    user = F.get_json_object("payload", "$.user_id").cast("bigint")
    return files.read_events(spark, path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(user).alias("user_sum")
    )


@query(
    "a5_quarantine",
    APPS + """, ranked AS (SELECT employment_type, avg((device_risk_score IS NULL)::INT) > 0.0175 AS bad FROM apps GROUP BY 1)
    SELECT employment_type AS batch_name, count(*) AS n_rows FROM apps JOIN ranked USING (employment_type) WHERE bad GROUP BY 1""",
)
def a5(spark, d):
    rows = current(spark, d).withColumn("batch_name", F.col("employment_type"))
    rate = F.avg(F.col("device_risk_score").isNull().cast("double"))
    verdicts = rows.groupBy("batch_name").agg(F.when(rate > 0.0175, "BLOCK").otherwise("PASS").alias("decision"))
    path = files.work_dir(spark, "quarantine")
    # A first, empty append fixes the schema for a run in which nothing is blocked.
    rows.limit(0).write.mode("append").parquet(path)
    files.quarantine(rows, verdicts, path)
    read = spark.read.schema(rows.schema).parquet(path)
    return read.groupBy("batch_name").agg(F.count(F.lit(1)).alias("n_rows"))


_RANGED = [r for r in b.CONTRACT.columns if r.has_range]
_RULE_VALUES = ", ".join(f"('{r.name}', {float(r.min)}::DOUBLE, {float(r.max)}::DOUBLE)" for r in _RANGED)
_UNION_RANGED = " UNION ALL ".join(f"SELECT '{r.name}' AS column_name, {r.name}::DOUBLE AS value FROM apps" for r in _RANGED)


@query(
    "a6_rules_table",
    APPS + f""", rules(column_name, lo, hi) AS (VALUES {_RULE_VALUES}), long AS ({_UNION_RANGED})
    SELECT column_name, count(*) AS n_rows, count(*) FILTER (WHERE value < lo OR value > hi) AS out_of_range
    FROM long JOIN rules USING (column_name) GROUP BY 1""",
)
def a6(spark, d):
    rules = ct.rules_table(spark, b.CONTRACT).where("min_value IS NOT NULL OR max_value IS NOT NULL")
    long = drift.melt(current(spark, d), [r.name for r in _RANGED], []).withColumnRenamed("feature", "column_name")
    outside = (F.col("value") < F.col("min_value")) | (F.col("value") > F.col("max_value"))
    return long.join(rules, "column_name").groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(outside).alias("out_of_range")
    )


@query("a7_file_hash")
def a7(spark, d):
    return files.file_hashes(spark, d, "*.parquet").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "sha256", "size_bytes"
    )


def u01(expr: str) -> str:
    return f"(('0x' || substr(sha256({expr}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


@query(
    "a8_stratified_split",
    APPS + f""", r AS (SELECT application_id, default_30d, row_number() OVER (PARTITION BY default_30d ORDER BY {u01("application_id || '|42|split'")}, application_id) AS pos,
      count(*) OVER (PARTITION BY default_30d) AS n FROM apps)
    SELECT application_id, default_30d, CASE WHEN pos <= round(n * 0.3::DOUBLE) THEN 'holdout' ELSE 'train' END AS split FROM r""",
)
def a8(spark, d):
    return whatif.stratified_split(current(spark, d), "default_30d", 0.3).select("application_id", "default_30d", "split")


_LONG_MONITORED = " UNION ALL ".join(f"SELECT '{c}' AS feature, batch, {c}::DOUBLE AS value FROM {{t}}" for c in b.MONITORED)


@query(
    "a10_reference_profile",
    APPS + f""", long AS ({_LONG_MONITORED.format(t="apps")})
    SELECT batch, feature, count(*) AS row_count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
      avg((value IS NULL)::INT) AS null_rate FROM long GROUP BY 1, 2""",
    ["mean", "std", "min", "max", "null_rate"],
)
def a10(spark, d):
    return drift.reference_profile(current(spark, d), b.MONITORED, ["batch"])


@query(
    "a11_missingness_table",
    APPS + """SELECT batch, 'device_risk_score' AS column_name, avg((device_risk_score IS NULL)::INT) AS null_rate FROM apps GROUP BY 1
    UNION ALL SELECT batch, 'annual_income', avg((annual_income IS NULL)::INT) FROM apps GROUP BY 1""",
    ["null_rate"],
)
def a11(spark, d):
    return metrics.missingness_by_scenario(current(spark, d), "batch", ["device_risk_score", "annual_income"])


# ------------------------------------------------------------------ B


@query(
    "b1_engineered_features",
    APPS + """SELECT application_id, credit_utilization * debt_to_income AS utilization_x_dti,
      annual_income / greatest(open_credit_accounts, 1) AS income_per_open_account, credit_history_years / greatest(age, 1) AS history_to_age_ratio FROM apps""",
    ["utilization_x_dti", "income_per_open_account", "history_to_age_ratio"],
)
def b1(spark, d):
    return s.engineered_features(current(spark, d)).select(
        "application_id", "utilization_x_dti", "income_per_open_account", "history_to_age_ratio"
    )


@query(
    "b2_clip",
    APPS + """SELECT application_id, CASE WHEN device_risk_score IS NULL THEN NULL ELSE least(greatest(device_risk_score, 0.2::DOUBLE), 0.8::DOUBLE) END AS clipped FROM apps""",
    ["clipped"],
)
def b2(spark, d):
    return current(spark, d).select("application_id", s.clip("device_risk_score", 0.2, 0.8).alias("clipped"))


@query(
    "b3_coerce_number",
    "SELECT event_id, TRY_CAST(substr(props, 7, 2) AS DOUBLE) AS number FROM events",
    ["number"],
)
def b3(spark, d):
    return b.table(spark, d, "events").select("event_id", s.number(F.substring("props", 7, 2)).alias("number"))


@query(
    "b4_band",
    APPS + "SELECT application_id, age_group FROM apps",
)
def b4(spark, d):
    return current(spark, d).select(
        "application_id", s.band("age", [20, 29, 44, 59, 70], ["21-29", "30-44", "45-59", "60-70"]).alias("age_group")
    )


@query(
    "b5_intersection_key",
    APPS + """SELECT coalesce(sex, 'nan') || '~' || coalesce(age_group, 'nan') || '~' || coalesce(CASE WHEN device_risk_score > 0.9::DOUBLE THEN 'hot' END, 'nan') AS key,
      count(*) AS n_rows FROM apps GROUP BY 1""",
)
def b5(spark, d):
    rows = current(spark, d).withColumn("hot", F.when(F.col("device_risk_score") > 0.9, "hot"))
    return s.intersection_key(rows, ["sex", "age_group", "hot"], "key", "~").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "b6_decision",
    APPS + "SELECT application_id, (risk_probability >= 0.5::DOUBLE)::INT AS predicted_default, (risk_probability < 0.5::DOUBLE)::INT AS approved FROM apps",
)
def b6(spark, d):
    return s.decide(current(spark, d)).select("application_id", "predicted_default", "approved")


@query(
    "b7_select_inputs",
    APPS + f"SELECT {', '.join(b.NUMERIC + b.CATEGORICAL)} FROM apps",
    [c for c in b.NUMERIC if c not in ("age", "delinquencies_2y", "inquiries_6m", "open_credit_accounts")],
)
def b7(spark, d):
    return s.select_inputs(current(spark, d), b.NUMERIC + b.CATEGORICAL)


@query(
    "b8_protected_leaks",
    APPS + """, f AS (SELECT DISTINCT region AS model_version, 'employment_type_' || employment_type AS feature FROM apps
      UNION SELECT DISTINCT region, CASE WHEN default_30d = 1 THEN 'sex_' || sex ELSE 'x' END FROM apps)
    SELECT model_version, 'sex' AS protected_column, feature FROM f WHERE contains(feature, 'sex')
    UNION ALL SELECT model_version, 'age_group', feature FROM f WHERE contains(feature, 'age_group')""",
)
def b8(spark, d):
    rows = current(spark, d)
    one = rows.select(F.col("region").alias("model_version"), F.concat(F.lit("categorical__employment_type_"), "employment_type").alias("feature"))
    two = rows.select(
        F.col("region").alias("model_version"),
        F.when(F.col("default_30d") == 1, F.concat(F.lit("categorical__sex_"), "sex")).otherwise("numeric__x").alias("feature"),
    )
    return attribution.leaks(one.unionByName(two), ["sex", "age_group"])


_LADDERS = """CASE WHEN debt_to_income >= 0.2::DOUBLE THEN 'CRITICAL' WHEN debt_to_income >= 0.1::DOUBLE THEN 'WARNING' ELSE 'STABLE' END AS psi_status,
  CASE WHEN credit_utilization >= 0.5::DOUBLE THEN 'STABLE' WHEN device_risk_score >= 0.1::DOUBLE THEN 'CRITICAL' WHEN device_risk_score >= 0.05::DOUBLE THEN 'WARNING' ELSE 'STABLE' END AS ks_status,
  CASE WHEN device_risk_score < 0.8::DOUBLE THEN 'FAIL' WHEN device_risk_score < 0.9::DOUBLE THEN 'WARNING' ELSE 'PASS' END AS ratio_status,
  CASE WHEN device_risk_score >= 0.15::DOUBLE THEN 'FAIL' WHEN device_risk_score >= 0.1::DOUBLE THEN 'WARNING' ELSE 'PASS' END AS difference_status"""


def _ladder_columns():
    x = F.col("device_risk_score")
    return {
        "psi_status": st.psi_status(F.col("debt_to_income")),
        "ks_status": st.ks_status(x, F.col("credit_utilization"), alpha=0.5),
        "ratio_status": st.ratio_status(x),
        "difference_status": st.difference_status(x, 0.10, 0.15),
    }


@query("b9_status_ladder", APPS + f"SELECT application_id, {_LADDERS} FROM apps")
def b9(spark, d):
    cols = _ladder_columns()
    return current(spark, d).withColumns(cols).select("application_id", *cols)


@query(
    "b10_worst_status",
    APPS + f""", l AS (SELECT region, {_LADDERS} FROM apps), sev AS (SELECT region,
      greatest(CASE ratio_status WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END, CASE difference_status WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS row_sev,
      CASE psi_status WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END AS psi_sev FROM l)
    SELECT region, (['PASS','WARNING','FAIL'])[row_sev + 1] AS row_worst, count(*) AS n_rows, (['STABLE','WARNING','CRITICAL'])[max(psi_sev) + 1] AS group_worst FROM sev GROUP BY region, row_sev""",
)
def b10(spark, d):
    rows = current(spark, d).withColumns(_ladder_columns())
    worst = st.worst([F.col("ratio_status"), F.col("difference_status")], st.FAIRNESS_LEVELS)
    return rows.groupBy("region", worst.alias("row_worst")).agg(
        F.count(F.lit(1)).alias("n_rows"), st.worst_of_group(F.col("psi_status"), st.DRIFT_LEVELS).alias("group_worst")
    )


@query(
    "b11_parse_timestamp",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(date_trunc('second', ts)) - 7200000000 END AS micros FROM events",
)
def b11(spark, d):
    text = F.date_format(F.date_trunc("second", F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "Z").otherwise("+02:00")
    return b.table(spark, d, "events").select(
        "event_id", F.unix_micros(s.parse_timestamp(F.concat(text, tail))).alias("micros")
    )


@query(
    "b12_elapsed_minutes",
    """SELECT event_id, ((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 60000000)::BIGINT AS minutes,
      (epoch_us(ts) - epoch_us(date_trunc('day', ts))) % 60000000 = 0 AS is_valid FROM events""",
)
def b12(spark, d):
    t = F.col("ts").cast("timestamp")
    start = F.date_trunc("day", t)
    return b.table(spark, d, "events").select("event_id", s.elapsed_minutes(start, t).alias("minutes"), s.minutes_valid(start, t).alias("is_valid"))


@query("b13_hash_bucket", f"SELECT event_id, {u01('event_id::VARCHAR')} AS bucket FROM events", ["bucket"])
def b13(spark, d):
    return b.table(spark, d, "events").select("event_id", s.uniform01("event_id").alias("bucket"))


@query(
    "b14_route",
    f"SELECT event_id, CASE WHEN {u01('event_id::VARCHAR')} < 0.25::DOUBLE THEN 'candidate' ELSE 'baseline' END AS quarter, 'candidate' AS whole FROM events",
)
def b14(spark, d):
    return b.table(spark, d, "events").select("event_id", s.route("event_id", 0.25).alias("quarter"), s.route("event_id", 1.0).alias("whole"))


@query(
    "b15_clean_feature_name",
    APPS + """SELECT DISTINCT CASE WHEN default_30d = 1 THEN 'employment_type_' || employment_type ELSE 'device__' || region END AS feature,
      default_30d = 1 AS of_employment FROM apps""",
)
def b15(spark, d):
    name = F.when(F.col("default_30d") == 1, F.concat(F.lit("categorical__employment_type_"), "employment_type")).otherwise(
        F.concat(F.lit("numeric__device__"), "region")
    )
    clean = s.clean_feature_name(name)
    return current(spark, d).select(clean.alias("feature"), F.startswith(clean, F.lit("employment_type_")).alias("of_employment")).distinct()


@query(
    "b16_score_valid",
    APPS + """SELECT region, count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(device_risk_score * 1.2::DOUBLE BETWEEN 0 AND 1, false)) AS invalid FROM apps GROUP BY 1""",
)
def b16(spark, d):
    bad = ~s.score_valid(F.col("device_risk_score") * 1.2)
    return current(spark, d).groupBy("region").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("invalid"))


# ------------------------------------------------------------------ C

RULE_COLUMNS = ["rule_id", "passed", "observed_value"]


def rules(spark, d, suffix, contract=b.CONTRACT, df=None):
    df = current(spark, d) if df is None else df
    return ct.validate_batch(df, contract, "apps").where(F.col("rule_id").endswith(suffix)).select(*RULE_COLUMNS)


def _only(*names, **changes):
    kept = tuple(r for r in b.CONTRACT.columns if not names or r.name in names)
    return dataclasses.replace(b.CONTRACT, columns=kept, **changes)


@query("c1_minimum_rows", "SELECT 'table.minimum_rows' AS rule_id, count(*) >= 100 AS passed, count(*)::DOUBLE AS observed_value FROM orders", ["observed_value"])
def c1(spark, d):
    return rules(spark, d, "minimum_rows", _only("age"))


@query(
    "c2_required_columns",
    "SELECT 'schema.required_columns' AS rule_id, false AS passed, 2.0::DOUBLE AS observed_value, count(*) AS n_rows FROM orders",
    ["observed_value"],
)
def c2(spark, d):
    df = current(spark, d).drop("age", "region")
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    found = rules(spark, d, "required_columns", df=df)
    return found.withColumn("n_rows", n.scalar())


@query(
    "c3_extra_columns",
    "SELECT 'schema.extra_columns' AS rule_id, false AS passed, 8.0::DOUBLE AS observed_value, count(*) AS n_rows FROM orders",
    ["observed_value"],
)
def c3(spark, d):
    df = current(spark, d)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rules(spark, d, "extra_columns", dataclasses.replace(b.CONTRACT, allow_extra_columns=False), df).withColumn("n_rows", n.scalar())


_TYPES = " UNION ALL ".join(
    f"SELECT '{r.name}.type' AS rule_id, {'false' if r.name == 'age' else 'true'} AS passed, count(*) AS n_rows FROM orders" for r in b.CONTRACT.columns
)


@query("c4_type", _TYPES)
def c4(spark, d):
    df = current(spark, d).withColumn("age", F.col("age").cast("string"))
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rules(spark, d, ".type", df=df).drop("observed_value").withColumn("n_rows", n.scalar())


_NULLS = " UNION ALL ".join(
    f"SELECT '{r.name}.null_rate' AS rule_id, avg(({r.name} IS NULL)::INT) <= {r.max_null_rate}::DOUBLE + 1e-12 AS passed, avg(({r.name} IS NULL)::INT) AS observed_value FROM apps"
    for r in b.CONTRACT.columns
)


@query("c5_null_rate", APPS + _NULLS, ["observed_value"])
def c5(spark, d):
    return rules(spark, d, ".null_rate")


@query(
    "c6_unique",
    """WITH k AS (SELECT l_orderkey * 100 + l_linenumber AS line_key FROM lineitem), g AS (SELECT count(*) AS n FROM k GROUP BY line_key)
    SELECT 'line_key.unique' AS rule_id, coalesce(sum(n) FILTER (WHERE n > 1), 0) = 0 AS passed, coalesce(sum(n) FILTER (WHERE n > 1), 0)::DOUBLE AS observed_value FROM g""",
    ["observed_value"],
)
def c6(spark, d):
    df = b.table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_key"))
    only = ct.Contract("lines", "1", columns=(ct.ColumnRule("line_key", "integer", unique=True),))
    return rules(spark, d, ".unique", only, df)


_RANGES = " UNION ALL ".join(
    f"SELECT '{r.name}.range' AS rule_id, NOT coalesce(min({r.name}) < {float(r.min)}::DOUBLE OR max({r.name}) > {float(r.max)}::DOUBLE, false) AS passed, min({r.name})::DOUBLE AS low, max({r.name})::DOUBLE AS high FROM apps"
    for r in _RANGED
)


@query("c7_range", APPS + _RANGES, ["low", "high"])
def c7(spark, d):
    found = ct.validate_batch(current(spark, d), b.CONTRACT, "apps").where(F.col("rule_id").endswith(".range"))
    get = lambda k: F.get_json_object("observed", f"$.{k}").cast("double")
    return found.select("rule_id", "passed", get("min").alias("low"), get("max").alias("high"))


_DOC_CONTRACT = ct.Contract(
    "documents", "1", minimum_rows=10,
    columns=(
        ct.ColumnRule("text", "string", unique=True, max_null_rate=0.0),
        ct.ColumnRule("lang", "string", allowed_values=("en", "de")),
        ct.ColumnRule("source", "string", allowed_values=("web", "books")),
        ct.ColumnRule("n_chars", "integer", min=10, max=100_000),
    ),
)


@query(
    "c8_allowed_values",
    """SELECT 'lang.allowed_values' AS rule_id, count(DISTINCT lang) = 0 AS passed, count(DISTINCT lang)::VARCHAR AS observed FROM documents WHERE lang NOT IN ('en','de')
    UNION ALL SELECT 'source.allowed_values', count(DISTINCT source) = 0, count(DISTINCT source)::VARCHAR FROM documents WHERE source NOT IN ('web','books')""",
)
def c8(spark, d):
    found = ct.validate_batch(b.table(spark, d, "documents"), _DOC_CONTRACT, "documents")
    return found.where(F.col("rule_id").endswith(".allowed_values")).select("rule_id", "passed", "observed")


@query(
    "c8_unexpected_values",
    """SELECT 'lang' AS column_name, lang AS value, count(*) AS row_count FROM documents WHERE lang NOT IN ('en','de') GROUP BY lang
    UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source NOT IN ('web','books') GROUP BY source""",
)
def c8_values(spark, d):
    return ct.unexpected_values(b.table(spark, d, "documents"), _DOC_CONTRACT)


@query(
    "c9_contract_report",
    APPS + f""", checks AS (
      {" UNION ALL ".join(f"SELECT {i} AS pos, '{r.name}.range' AS rule_id, coalesce(min({r.name}) < {float(r.min)}::DOUBLE OR max({r.name}) > {float(r.max)}::DOUBLE, false) AS failed FROM apps" for i, r in enumerate(_RANGED))}
      UNION ALL {" UNION ALL ".join(f"SELECT {100 + i}, '{r.name}.allowed_values', count(*) > 0 FROM apps WHERE {r.name} NOT IN ({', '.join(repr(v) for v in r.allowed_values)})" for i, r in enumerate(b.CONTRACT.columns) if r.allowed_values)}
      UNION ALL {" UNION ALL ".join(f"SELECT {200 + i}, '{r.name}.null_rate', avg(({r.name} IS NULL)::INT) > {r.max_null_rate}::DOUBLE + 1e-12 FROM apps" for i, r in enumerate(b.CONTRACT.columns))})
    SELECT 'apps' AS batch_name, 'contract' AS engine, bool_and(NOT failed) AS passed, 47::BIGINT AS rule_count,
      coalesce(string_agg(rule_id, ',' ORDER BY pos) FILTER (WHERE failed), '') AS failed_rule_ids,
      'credit_application_scoring_v1' AS contract_name, '1.0.0' AS contract_version FROM checks""",
)
def c9(spark, d):
    found = ct.report(ct.validate_batch(current(spark, d), b.CONTRACT, "apps"), b.CONTRACT)
    return found.withColumn("failed_rule_ids", F.array_join("failed_rule_ids", ","))


def _gx(kind: str, kept, passed: str, unexpected: str, base: str) -> str:
    return " UNION ALL ".join(
        f"SELECT 'gx.{r.name}.{kind}' AS rule_id, {passed.format(r=r)} AS passed, count(*) AS element_count, {unexpected.format(r=r, lo=r.min, hi=r.max, vals=', '.join(repr(v) for v in (r.allowed_values or ())))} AS unexpected_count, "
        f"({unexpected.format(r=r, lo=r.min, hi=r.max, vals=', '.join(repr(v) for v in (r.allowed_values or ())))})::DOUBLE * 100 / nullif({base.format(r=r)}, 0) AS unexpected_percent FROM apps"
        for r in kept
    )


def expect(spark, d, suffix, contract=b.CONTRACT, df=None):
    found = ct.expectations(current(spark, d) if df is None else df, contract, "apps")
    return found.where(F.col("rule_id").endswith(suffix)).select("rule_id", "passed", "element_count", "unexpected_count", "unexpected_percent")


@query("c10_expect_columns", "SELECT 'gx.expect_table_columns_to_match_set' AS rule_id, false AS passed, count(*) AS n_rows FROM orders")
def c10(spark, d):
    df = current(spark, d).drop("age")
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return ct.expectations(df, b.CONTRACT).where(F.col("rule_id").endswith("match_set")).select("rule_id", "passed").withColumn("n_rows", n.scalar())


_NOT_NULL = " UNION ALL ".join(
    f"SELECT 'gx.{r.name}.expect_column_values_to_not_be_null' AS rule_id, count({r.name})::DOUBLE / count(*) >= 1.0 - {r.max_null_rate}::DOUBLE AS passed, count(*) AS element_count, count(*) - count({r.name}) AS unexpected_count, (count(*) - count({r.name}))::DOUBLE * 100 / count(*) AS unexpected_percent FROM apps"
    for r in b.CONTRACT.columns
)
_BETWEEN = " UNION ALL ".join(
    f"SELECT 'gx.{r.name}.expect_column_values_to_be_between' AS rule_id, count(*) FILTER (WHERE {r.name} < {float(r.min)}::DOUBLE OR {r.name} > {float(r.max)}::DOUBLE) = 0 AS passed, count(*) AS element_count, count(*) FILTER (WHERE {r.name} < {float(r.min)}::DOUBLE OR {r.name} > {float(r.max)}::DOUBLE) AS unexpected_count, (count(*) FILTER (WHERE {r.name} < {float(r.min)}::DOUBLE OR {r.name} > {float(r.max)}::DOUBLE))::DOUBLE * 100 / nullif(count({r.name}), 0) AS unexpected_percent FROM apps"
    for r in _RANGED
)
_IN_SET = " UNION ALL ".join(
    f"SELECT 'gx.{r.name}.expect_column_values_to_be_in_set' AS rule_id, count(*) FILTER (WHERE {r.name} NOT IN ({', '.join(repr(v) for v in r.allowed_values)})) = 0 AS passed, count(*) AS element_count, count(*) FILTER (WHERE {r.name} NOT IN ({', '.join(repr(v) for v in r.allowed_values)})) AS unexpected_count, (count(*) FILTER (WHERE {r.name} NOT IN ({', '.join(repr(v) for v in r.allowed_values)})))::DOUBLE * 100 / nullif(count({r.name}), 0) AS unexpected_percent FROM apps"
    for r in b.CONTRACT.columns if r.allowed_values
)
_UNIQUE = """SELECT 'gx.line_key.expect_column_values_to_be_unique' AS rule_id, coalesce(sum(n) FILTER (WHERE n > 1), 0) = 0 AS passed, NULL::BIGINT AS element_count,
  coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS unexpected_count, coalesce(sum(n) FILTER (WHERE n > 1), 0)::DOUBLE * 100 / sum(n) AS unexpected_percent
  FROM (SELECT count(*) AS n FROM (SELECT CASE WHEN l_linenumber < 7 THEN l_orderkey * 100 + l_linenumber END AS line_key FROM lineitem) WHERE line_key IS NOT NULL GROUP BY line_key)"""


def _line_keys(spark, d):
    key = F.when(F.col("l_linenumber") < 7, F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return b.table(spark, d, "lineitem").select(key.alias("line_key"))


_LINES = ct.Contract("lines", "1", columns=(ct.ColumnRule("line_key", "integer", unique=True),))


@query("c11_expect_not_null", APPS + _NOT_NULL, ["unexpected_percent"])
def c11(spark, d):
    return expect(spark, d, "not_be_null")


@query("c12_expect_unique", _UNIQUE, ["unexpected_percent"])
def c12(spark, d):
    return expect(spark, d, "be_unique", _LINES, _line_keys(spark, d))


@query("c13_expect_between", APPS + _BETWEEN, ["unexpected_percent"])
def c13(spark, d):
    return expect(spark, d, "be_between")


@query("c14_expect_in_set", APPS + _IN_SET, ["unexpected_percent"])
def c14(spark, d):
    return expect(spark, d, "be_in_set")


@query("c15_expectation_rows", APPS + f"{_NOT_NULL} UNION ALL {_BETWEEN} UNION ALL {_IN_SET}", ["unexpected_percent"])
def c15(spark, d):
    no_keys = dataclasses.replace(
        b.CONTRACT, columns=tuple(dataclasses.replace(r, unique=False) for r in b.CONTRACT.columns)
    )
    found = ct.expectations(current(spark, d), no_keys, "apps").where(~F.col("rule_id").endswith("match_set"))
    return found.select("rule_id", "passed", "element_count", "unexpected_count", "unexpected_percent")


@query(
    "c16_gate",
    APPS + f""", gx AS ({_NOT_NULL} UNION ALL {_BETWEEN} UNION ALL {_IN_SET}), mine AS ({_NULLS} ), ranges AS ({_RANGES}),
    failed AS (SELECT rule_id FROM gx WHERE NOT passed UNION SELECT rule_id FROM mine WHERE NOT passed UNION SELECT rule_id FROM ranges WHERE NOT passed
      UNION SELECT replace(replace(rule_id, 'gx.', ''), 'expect_column_values_to_be_in_set', 'allowed_values') FROM ({_IN_SET}) WHERE NOT passed)
    SELECT 'apps' AS batch_name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'BLOCK' END AS decision, count(*) FILTER (WHERE rule_id NOT LIKE 'gx.%') = 0 AS contract_passed,
      count(*) FILTER (WHERE rule_id LIKE 'gx.%') = 0 AS expectations_passed, string_agg(rule_id, ',' ORDER BY rule_id) AS failed_rule_ids FROM failed""",
)
def c16(spark, d):
    found = ct.gate(ct.both_engines(current(spark, d), b.CONTRACT, "apps"))
    return found.withColumn("failed_rule_ids", F.array_join("failed_rule_ids", ","))


_LANES = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT::HUGEINT)::VARCHAR AS l{i}" for i in range(8))


@query(
    "c17_fingerprint",
    f"""WITH h AS (SELECT sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders),
    t AS (SELECT count(*) AS row_count, {_LANES} FROM h)
    SELECT row_count, sha256('o_custkey,o_orderkey,o_orderstatus|' || row_count || '|' || l0 || '|' || l1 || '|' || l2 || '|' || l3 || '|' || l4 || '|' || l5 || '|' || l6 || '|' || l7) AS fingerprint FROM t""",
)
def c17(spark, d):
    return ct.fingerprint(b.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


# Row rules on text: orders read as text columns, some with values no number can be made of.
_ROW_CONTRACT = ct.Contract(
    "orders_as_text", "1", allow_extra_columns=True,
    columns=(
        ct.ColumnRule("key_text", "integer", min=100, max=40_000),
        ct.ColumnRule("price_text", "number", min=20_000, max=450_000),
        ct.ColumnRule("o_orderpriority", "string", allowed_values=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),
        ct.ColumnRule("optional", "number", min=0.0, max=0.9, max_null_rate=0.1),
        ct.ColumnRule("status", "string"),
    ),
)
_TEXT_SQL = """t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'k' || o_orderkey ELSE o_orderkey::VARCHAR END AS key_text,
  o_orderkey AS k, o_totalprice AS price, o_orderkey % 13 = 0 AS bad_price, o_orderpriority,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 10)::DOUBLE / 10 + 0.05::DOUBLE END AS optional,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status FROM orders),
v AS (
  SELECT o_orderkey, 'key_text.type' AS rule_id FROM t WHERE k % 11 = 0
  UNION ALL SELECT o_orderkey, 'key_text.range' FROM t WHERE k % 11 <> 0 AND (k < 100 OR k > 40000)
  UNION ALL SELECT o_orderkey, 'price_text.type' FROM t WHERE bad_price
  UNION ALL SELECT o_orderkey, 'price_text.range' FROM t WHERE NOT bad_price AND (price < 20000 OR price > 450000)
  UNION ALL SELECT o_orderkey, 'o_orderpriority.allowed_values' FROM t WHERE o_orderpriority = '4-NOT SPECIFIED'
  UNION ALL SELECT o_orderkey, 'optional.range' FROM t WHERE optional > 0.9::DOUBLE
  UNION ALL SELECT o_orderkey, 'status.null' FROM t WHERE status IS NULL
  UNION ALL SELECT o_orderkey, 'ghost.required' FROM t)"""
_GHOST = dataclasses.replace(_ROW_CONTRACT, columns=_ROW_CONTRACT.columns + (ct.ColumnRule("ghost", "string"),))


def text_orders(spark, d):
    return as_text(b.table(spark, d, "orders"))


def as_text(orders):
    k = F.col("o_orderkey")
    return orders.select(
        "o_orderkey",
        F.when(k % 11 == 0, F.concat(F.lit("k"), k.cast("string"))).otherwise(k.cast("string")).alias("key_text"),
        F.when(k % 13 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price_text"),
        "o_orderpriority",
        F.when(k % 7 != 0, (k % 10).cast("double") / 10 + 0.05).alias("optional"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
    )


@query(
    "c18_row_violations",
    f"WITH {_TEXT_SQL} SELECT t.o_orderkey, count(v.rule_id) AS n_violations FROM t LEFT JOIN v USING (o_orderkey) GROUP BY 1",
)
def c18(spark, d):
    return ct.with_violations(text_orders(spark, d), _GHOST).select("o_orderkey", F.size("violations").cast("bigint").alias("n_violations"))


@query("c19_violation_rows", f"WITH {_TEXT_SQL} SELECT o_orderkey, rule_id FROM v")
def c19(spark, d):
    return ct.violation_rows(text_orders(spark, d), _GHOST, "o_orderkey").select("o_orderkey", "rule_id")


@query(
    "c20_split_rows",
    f"""WITH {_TEXT_SQL}, bad AS (SELECT DISTINCT o_orderkey FROM v WHERE rule_id <> 'ghost.required')
    SELECT CASE WHEN b.o_orderkey IS NULL THEN 'valid' ELSE 'quarantined' END AS sink, t.o_orderkey FROM t LEFT JOIN bad b USING (o_orderkey)""",
)
def c20(spark, d):
    valid, held = ct.split_rows(text_orders(spark, d), _ROW_CONTRACT)
    return valid.select(F.lit("valid").alias("sink"), "o_orderkey").unionByName(held.select(F.lit("quarantined").alias("sink"), "o_orderkey"))


@query(
    "c21_batches_aligned",
    APPS + "SELECT batch, count(*) AS row_count, count(DISTINCT application_id) AS key_count FROM apps GROUP BY 1",
)
def c21(spark, d):
    left, right = current(spark, d), b.drifted(current(spark, d))
    if not ct.schema_preserved(left.drop("risk_probability"), right.drop("risk_probability")):
        raise ValueError("schema changed")
    return ct.batches_aligned(right, "batch", "application_id")


@query(
    "c22_columns_unchanged",
    DRIFTED + """SELECT 'sex' AS column_name, 0::BIGINT AS changed_rows FROM apps GROUP BY 1
    UNION ALL SELECT 'default_30d', 0 FROM apps GROUP BY 1
    UNION ALL SELECT 'device_risk_score', count(*) FILTER (WHERE a.device_risk_score IS DISTINCT FROM d.device_risk_score) FROM apps a JOIN drifted d USING (application_id)""",
)
def c22(spark, d):
    rows = current(spark, d)
    return ct.columns_unchanged(rows, b.drifted(rows), "application_id", ["sex", "default_30d", "device_risk_score"])
