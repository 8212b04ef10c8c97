"""Row-level expressions. Everything here stays inside whole-stage codegen: no Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_64 = float(2**64)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Coerce to DOUBLE; text that is not a number, and NaN, become NULL."""
    return F.nullif(as_col(c).try_cast("double"), F.lit(float("nan")))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]. NULL stays NULL (``greatest``/``least`` would skip it)."""
    x = as_col(c)
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def affine_shift(
    c: Column | str, *, shift: float, lo: float, hi: float, center: float = 0.0, scale: float = 1.0, noise: Column | None = None
) -> Column:
    """``center + scale*(x-center) + shift (+ noise)``, clipped; NULL stays NULL."""
    x = as_col(c)
    moved = x + shift if (center == 0.0 and scale == 1.0) else F.lit(center) + scale * (x - center) + shift
    if noise is not None:
        moved = moved + noise
    return clip(moved, lo, hi)


def band(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands (e0,e1], (e1,e2], ...; outside every band gives NULL."""
    if len(edges) != len(labels) + 1:
        raise ValueError("band needs one more edge than labels")
    x = as_col(c)
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def group_label(c: Column | str) -> Column:
    """Group label as text; a missing label forms its own group named ``nan``."""
    return F.coalesce(as_col(c).cast("string"), F.lit("nan"))


def intersection_key(df: DataFrame, components: Sequence[str], output: str, separator: str = "|") -> DataFrame:
    missing = [c for c in components if c not in df.columns]
    if missing:
        raise ValueError(f"cannot build {output}: no column {missing}")
    return df.withColumn(output, F.concat_ws(separator, *[group_label(c) for c in components]))


def predicted_default(p: Column | str, threshold: float) -> Column:
    return (as_col(p) >= threshold).cast("int")


def approved(p: Column | str, threshold: float) -> Column:
    """Approval is strictly below the threshold."""
    return (as_col(p) < threshold).cast("int")


def decide(df: DataFrame, score: str = "risk_probability", threshold: float = 0.5) -> DataFrame:
    return df.withColumns(
        {"predicted_default": predicted_default(score, threshold), "approved": approved(score, threshold)}
    )


def engineered_features(df: DataFrame) -> DataFrame:
    """Interaction and ratio features; a denominator below one counts as one, NULL stays NULL."""

    def at_least_one(c: str) -> Column:
        return F.when(F.col(c) < 1, F.lit(1)).otherwise(F.col(c))

    return df.withColumns(
        {
            "utilization_x_dti": F.col("credit_utilization") * F.col("debt_to_income"),
            "income_per_open_account": F.try_divide(F.col("annual_income"), at_least_one("open_credit_accounts")),
            "history_to_age_ratio": F.try_divide(F.col("credit_history_years"), at_least_one("age")),
        }
    )


def select_inputs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such input columns: {missing}")
    return df.select(*columns)


def uniform01(key: Column | str) -> Column:
    """Hash bucket in [0,1): first 8 bytes of SHA-256, big-endian, over 2^64."""
    head = F.substring(F.sha2(as_col(key).cast("string"), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / TWO_64


def gaussian(key: Column | str) -> Column:
    """Repeatable noise, mean 0 and variance 1: twelve 16-bit pieces of one SHA-256, summed.

    A function of the key alone, so it does not depend on partitioning or retries.
    """
    digest = F.sha2(as_col(key).cast("string"), 256)
    total = None
    for i in range(12):
        piece = F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long")
        total = piece if total is None else total + piece
    return (total + 6) / F.lit(65536.0) - 6.0


def route(key: Column | str, share: Column | float) -> Column:
    """``candidate`` when the key's bucket is below the share; a share of one or more takes every key."""
    s = F.lit(float(share)) if isinstance(share, (int, float)) else share
    return F.when((s >= 1.0) | (uniform01(key) < s), "candidate").otherwise("baseline")


def parse_timestamp(text: Column | str) -> Column:
    """ISO text with an offset -> TIMESTAMP; text without one is rejected (NULL)."""
    t = as_col(text)
    return F.when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(t))


def elapsed_minutes(start: Column | str, end: Column | str) -> Column:
    """Whole minutes from start to end, floored towards zero."""
    return F.timestamp_diff("MINUTE", as_col(start), as_col(end))


def minutes_valid(start: Column | str, end: Column | str) -> Column:
    """False when the end precedes the start or the span is not a whole number of minutes."""
    micros = F.timestamp_diff("MICROSECOND", as_col(start), as_col(end))
    return (micros >= 0) & (micros % 60_000_000 == 0)


def clean_feature_name(c: Column | str) -> Column:
    """Drop the transformer prefix (``numeric__x`` -> ``x``); fixed values: numeric__, categorical__."""
    return F.regexp_replace(as_col(c), "^(numeric|categorical)__", "")


def score_valid(p: Column | str) -> Column:
    """True for a finite score in [0, 1]."""
    x = number(p)
    return F.coalesce((x >= 0.0) & (x <= 1.0), F.lit(False))


def floor6(c: Column | str) -> Column:
    """Cut a double to six decimals with plain arithmetic, so any engine gives the same digits.

    NaN, infinities and values whose millionths do not fit a BIGINT stay as they are.
    """
    x = as_col(c)
    return F.when(F.isnan(x) | (F.abs(x) >= 9e12), x).otherwise(F.floor(x * 1e6 + 0.5).cast("double") / 1e6)
