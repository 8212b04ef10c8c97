"""Views that give the operators natural inputs on the star-schema tables.

``apps`` is one scored application per order. Sums are taken over integers (hundredths), so the result
does not depend on summation order. Every view has a DataFrame form and an equivalent SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.scalar import affine_shift, band, intersection_key
from wardline.operators.contract import Contract

SENSITIVE = ["synthetic_demographic_group", "sex", "age_group"]
INTERSECTION = "sex_demographic_intersection"
NUMERIC = [
    "age", "annual_income", "employment_length_years", "debt_to_income", "credit_utilization",
    "credit_history_years", "delinquencies_2y", "inquiries_6m", "open_credit_accounts",
    "device_risk_score", "bank_transaction_risk", "employment_verification_score",
]
CATEGORICAL = ["region", "employment_type"]
MONITORED = [
    "annual_income", "employment_length_years", "debt_to_income", "credit_utilization",
    "credit_history_years", "device_risk_score", "bank_transaction_risk", "employment_verification_score",
]
BATCH_CUT = "1998-06-01"
HISTORY_END = "2001-08-02"

# Contract limits of the application batch.
CONTRACT = Contract.from_dict(
    {
        "contract": {
            "name": "credit_application_scoring_v1", "version": "1.0.0",
            "allow_extra_columns": True, "minimum_rows": 100,
        },
        "columns": {
            "application_id": {"type": "string", "unique": True, "max_null_rate": 0.0},
            "age": {"type": "integer", "min": 21, "max": 70, "max_null_rate": 0.0},
            "annual_income": {"type": "number", "min": 16000, "max": 320000, "max_null_rate": 0.0},
            "employment_length_years": {"type": "number", "min": 0, "max": 35, "max_null_rate": 0.0},
            "debt_to_income": {"type": "number", "min": 0.02, "max": 0.90, "max_null_rate": 0.0},
            "credit_utilization": {"type": "number", "min": 0.01, "max": 0.99, "max_null_rate": 0.0},
            "credit_history_years": {"type": "number", "min": 0.5, "max": 45, "max_null_rate": 0.0},
            "delinquencies_2y": {"type": "integer", "min": 0, "max": 7, "max_null_rate": 0.0},
            "inquiries_6m": {"type": "integer", "min": 0, "max": 8, "max_null_rate": 0.0},
            "open_credit_accounts": {"type": "integer", "min": 1, "max": 20, "max_null_rate": 0.0},
            "device_risk_score": {"type": "number", "min": 0.0, "max": 1.0, "max_null_rate": 0.05},
            "bank_transaction_risk": {"type": "number", "min": 0.0, "max": 1.0, "max_null_rate": 0.0},
            "employment_verification_score": {"type": "number", "min": 0.0, "max": 1.0, "max_null_rate": 0.0},
            "region": {
                "type": "string", "allowed_values": ["AFRICA", "AMERICA", "ASIA", "EUROPE"], "max_null_rate": 0.0,
            },
            "employment_type": {
                "type": "string", "allowed_values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "max_null_rate": 0.0,
            },
        },
    }
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _share(part: Column, per_line: float) -> Column:
    return part.cast("double") / (F.col("n") * F.lit(per_line))


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: features, protected columns, label, score, batch name."""
    hundredths = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(hundredths("l_discount")).alias("disc"),
            F.sum(hundredths("l_tax")).alias("tax"),
            F.sum(F.col("l_quantity").cast("long")).alias("qty"),
            F.count_if(F.col("l_returnflag") == "R").alias("ret"),
            F.count_if(F.col("l_linestatus") == "O").alias("opn"),
            F.max("l_linenumber").alias("maxline"),
        )
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # nation and region have a fixed number of rows; customer grows, so its join is left to Spark.
    people = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey", "r_name")
    )
    joined = (
        table(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    days = F.datediff(F.lit(HISTORY_END).cast("date"), F.col("o_orderdate").cast("date"))
    features = joined.select(
        F.concat(F.lit("APP-"), F.col("o_orderkey").cast("string")).alias("application_id"),
        (21 + F.col("o_custkey") % 50).cast("int").alias("age"),
        F.col("o_totalprice").alias("annual_income"),
        (F.floor((F.col("c_acctbal") + 1000.0) / 11000.0 * 350.0).cast("double") / 10.0).alias("employment_length_years"),
        ((2 + (zero("disc") * 7 + zero("qty")) % 89).cast("double") / 100.0).alias("debt_to_income"),
        F.coalesce(_share(F.col("qty"), 50.0), F.lit(0.5)).alias("credit_utilization"),
        (F.floor(days / 36.5).cast("double") / 10.0).alias("credit_history_years"),
        zero("ret").cast("int").alias("delinquencies_2y"),
        zero("n").cast("int").alias("inquiries_6m"),
        F.greatest(zero("maxline"), F.lit(1)).cast("int").alias("open_credit_accounts"),
        _share(F.col("disc"), 10.0).alias("device_risk_score"),
        F.coalesce(_share(F.col("tax"), 8.0), F.lit(0.0)).alias("bank_transaction_risk"),
        F.coalesce(_share(F.col("opn"), 1.0), F.lit(0.0)).alias("employment_verification_score"),
        F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("employment_type"),
        F.when(F.col("c_nationkey") % 2 == 0, "female").otherwise("male").alias("sex"),
        F.col("c_mktsegment").alias("synthetic_demographic_group"),
        (F.col("o_orderstatus") == "F").cast("int").alias("default_30d"),
        F.col("o_orderdate").alias("order_date"),
        F.when(F.col("o_orderdate") < F.lit(BATCH_CUT).cast("timestamp_ntz"), "reference").otherwise("current").alias("batch"),
    )
    banded = features.withColumn(
        "age_group", band("age", [20, 29, 44, 59, 70], ["21-29", "30-44", "45-59", "60-70"])
    )
    return intersection_key(scored(banded), ["sex", "synthetic_demographic_group"], INTERSECTION)


def score_points(device: Column) -> Column:
    """The fixed score, in 1/10000: an additive rule over features, clipped to [0, 10000]."""
    raw = (
        F.lit(500.0)
        + 3000.0 * F.coalesce(device, F.lit(0.4))
        + 2000.0 * F.col("bank_transaction_risk")
        + 2500.0 * F.col("credit_utilization")
        + 150.0 * F.col("delinquencies_2y")
        + 20.0 * (F.col("age") % 10)
    )
    return F.least(F.greatest(F.floor(raw).cast("long"), F.lit(0)), F.lit(10000))


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_probability", score_points(F.col("device_risk_score")).cast("double") / 10000.0)


_DRIFTED = {
    "device_risk_score": dict(center=0.5, scale=0.85, shift=0.06, lo=0.0, hi=1.0),
    "credit_utilization": dict(shift=0.05, lo=0.01, hi=0.99),
    "debt_to_income": dict(shift=0.035, lo=0.02, hi=0.90),
    "bank_transaction_risk": dict(shift=0.06, lo=0.0, hi=1.0),
}
_STRESSED = {
    "device_risk_score": dict(shift=0.12, lo=0.0, hi=1.0),
    "credit_utilization": dict(shift=0.06, lo=0.01, hi=0.99),
    "bank_transaction_risk": dict(shift=0.05, lo=0.0, hi=1.0),
}


def moved(df: DataFrame, *cases: tuple[Column, dict[str, dict]]) -> DataFrame:
    """Features moved in the rows of the first condition that holds, then scored again; other rows untouched."""
    changed: dict[str, Column] = {}
    for name in dict.fromkeys(c for _, moves in cases for c in moves):
        value = F
        for cond, moves in cases:
            if name in moves:
                value = value.when(cond, affine_shift(name, **moves[name]))
        changed[name] = value.otherwise(F.col(name))
    return scored(df.withColumns(changed))


def _stressed_group() -> Column:
    return (F.col("batch") == "current") & (F.col(INTERSECTION) == "female|BUILDING")


def drifted(df: DataFrame) -> DataFrame:
    """The current batch with four features moved, then scored again; the reference untouched."""
    return moved(df, (F.col("batch") == "current", _DRIFTED))


def stressed(df: DataFrame) -> DataFrame:
    """The current batch with three features moved for one intersection only, then scored again."""
    return moved(df, (_stressed_group(), _STRESSED))


_SCORE_SQL = """
  least(greatest(cast(floor(500.0::DOUBLE + 3000.0::DOUBLE * coalesce({dev}, 0.4::DOUBLE) + 2000.0::DOUBLE * bank_transaction_risk
    + 2500.0::DOUBLE * credit_utilization + 150.0::DOUBLE * delinquencies_2y + 20.0::DOUBLE * (age % 10)) AS BIGINT), 0), 10000)::DOUBLE
    / 10000.0::DOUBLE"""

APPS_SQL = f"""
li AS (
  SELECT l_orderkey, count(*) AS n,
    sum(cast(floor(l_discount * 100 + 0.5::DOUBLE) AS BIGINT))::BIGINT AS disc, sum(cast(floor(l_tax * 100 + 0.5::DOUBLE) AS BIGINT))::BIGINT AS tax,
    sum(cast(l_quantity AS BIGINT))::BIGINT AS qty, count(*) FILTER (WHERE l_returnflag = 'R') AS ret,
    count(*) FILTER (WHERE l_linestatus = 'O') AS opn, max(l_linenumber) AS maxline
  FROM lineitem GROUP BY l_orderkey),
apps0 AS (
  SELECT 'APP-' || o_orderkey AS application_id,
    (21 + o_custkey % 50)::INTEGER AS age,
    o_totalprice AS annual_income,
    floor((c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE * 350.0::DOUBLE) / 10.0::DOUBLE AS employment_length_years,
    (2 + (coalesce(disc, 0) * 7 + coalesce(qty, 0)) % 89)::DOUBLE / 100.0::DOUBLE AS debt_to_income,
    coalesce(qty::DOUBLE / (n * 50.0::DOUBLE), 0.5::DOUBLE) AS credit_utilization,
    floor(date_diff('day', o_orderdate::DATE, DATE '{HISTORY_END}')::DOUBLE / 36.5::DOUBLE) / 10.0::DOUBLE AS credit_history_years,
    coalesce(ret, 0)::INTEGER AS delinquencies_2y, coalesce(n, 0)::INTEGER AS inquiries_6m,
    greatest(coalesce(maxline, 0), 1)::INTEGER AS open_credit_accounts,
    disc::DOUBLE / (n * 10.0::DOUBLE) AS device_risk_score,
    coalesce(tax::DOUBLE / (n * 8.0::DOUBLE), 0.0::DOUBLE) AS bank_transaction_risk,
    coalesce(opn::DOUBLE / (n * 1.0::DOUBLE), 0.0::DOUBLE) AS employment_verification_score,
    r_name AS region, o_orderpriority AS employment_type,
    CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex,
    c_mktsegment AS synthetic_demographic_group,
    (o_orderstatus = 'F')::INTEGER AS default_30d,
    o_orderdate AS order_date,
    CASE WHEN o_orderdate < TIMESTAMP '{BATCH_CUT}' THEN 'reference' ELSE 'current' END AS batch
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
apps AS (
  SELECT *, CASE WHEN age <= 29 THEN '21-29' WHEN age <= 44 THEN '30-44' WHEN age <= 59 THEN '45-59' ELSE '60-70' END AS age_group,
    sex || '|' || synthetic_demographic_group AS {INTERSECTION},
    {_SCORE_SQL.format(dev="device_risk_score")} AS risk_probability
  FROM apps0)"""


def _clip_sql(expr: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE least(greatest({expr}, {lo}::DOUBLE), {hi}::DOUBLE) END"


def _when_current(col: str, expr: str, lo: float, hi: float, cond: str) -> str:
    return f"CASE WHEN {cond} THEN {_clip_sql(expr, lo, hi)} ELSE {col} END AS {col}"


def moved_sql(name: str, cond: str, moves: dict[str, tuple[str, float, float]], source: str = "apps") -> str:
    cols = ", ".join(_when_current(c, e, lo, hi, cond) for c, (e, lo, hi) in moves.items())
    return f"""
{name}0 AS (SELECT * REPLACE ({cols}) FROM {source}),
{name} AS (SELECT * REPLACE ({_SCORE_SQL.format(dev="device_risk_score")} AS risk_probability) FROM {name}0)"""


_DRIFT_MOVES = {
    "device_risk_score": ("(0.5::DOUBLE + 0.85::DOUBLE * (device_risk_score - 0.5::DOUBLE) + 0.06::DOUBLE)", 0.0, 1.0),
    "credit_utilization": ("(credit_utilization + 0.05::DOUBLE)", 0.01, 0.99),
    "debt_to_income": ("(debt_to_income + 0.035::DOUBLE)", 0.02, 0.90),
    "bank_transaction_risk": ("(bank_transaction_risk + 0.06::DOUBLE)", 0.0, 1.0),
}
_STRESS_MOVES = {
    "device_risk_score": ("(device_risk_score + 0.12::DOUBLE)", 0.0, 1.0),
    "credit_utilization": ("(credit_utilization + 0.06::DOUBLE)", 0.01, 0.99),
    "bank_transaction_risk": ("(bank_transaction_risk + 0.05::DOUBLE)", 0.0, 1.0),
}
_STRESSED_GROUP = f"batch = 'current' AND {INTERSECTION} = 'female|BUILDING'"
DRIFTED_SQL = APPS_SQL + "," + moved_sql("drifted", "batch = 'current'", _DRIFT_MOVES)
STRESSED_SQL = APPS_SQL + "," + moved_sql("stressed", _STRESSED_GROUP, _STRESS_MOVES)

# Candidates: one model version per order priority; every fifth applicant (by age) is scored by the candidate. One version's
# vendor moved for everybody, one's for a single group.
DRIFTED_VERSION, STRESSED_VERSION = "1-URGENT", "2-HIGH"


def _split(df: DataFrame) -> DataFrame:
    return df.withColumn("batch", F.when(F.col("age") % 5 == 0, "current").otherwise("reference"))


def candidates(df: DataFrame) -> DataFrame:
    version = F.col("employment_type")
    rows = _split(df)
    drift = (F.col("batch") == "current") & (version == DRIFTED_VERSION)
    return moved(rows, (drift, _DRIFTED), (_stressed_group() & (version == STRESSED_VERSION), _STRESSED)).withColumn("model_version", version)


CANDIDATES_SQL = (
    APPS_SQL + ", split AS (SELECT * REPLACE (CASE WHEN age % 5 = 0 THEN 'current' ELSE 'reference' END AS batch) FROM apps),"
    + moved_sql("moved1", f"batch = 'current' AND employment_type = '{DRIFTED_VERSION}'", _DRIFT_MOVES, "split") + ","
    + moved_sql("moved2", f"{_STRESSED_GROUP} AND employment_type = '{STRESSED_VERSION}'", _STRESS_MOVES, "moved1")
    + ", keyed AS (SELECT *, employment_type AS model_version FROM moved2)"
)

# Scenarios over the same applications: untouched, moved for everybody, moved for a single group.
SCENARIOS = ("healthy", "drifted", "stressed")


def scenarios(df: DataFrame) -> DataFrame:
    rows = _split(df).withColumn("scenario", F.explode(F.lit(list(SCENARIOS))))
    drift = (F.col("batch") == "current") & (F.col("scenario") == "drifted")
    return moved(rows, (drift, _DRIFTED), (_stressed_group() & (F.col("scenario") == "stressed"), _STRESSED))


SCENARIOS_SQL = (
    APPS_SQL + f", split AS (SELECT * REPLACE (CASE WHEN age % 5 = 0 THEN 'current' ELSE 'reference' END AS batch), unnest({list(SCENARIOS)}) AS scenario FROM apps),"
    + moved_sql("moved1", "batch = 'current' AND scenario = 'drifted'", _DRIFT_MOVES, "split") + ","
    + moved_sql("moved2", f"{_STRESSED_GROUP} AND scenario = 'stressed'", _STRESS_MOVES, "moved1")
    + ", keyed AS (SELECT * FROM moved2)"
)


def r6(expr: str) -> str:
    """SQL twin of ``floor6``."""
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"
