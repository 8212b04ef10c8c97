"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_class(column: str, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def smallest_hashes(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows, those whose key has the smallest hash: the same rows on every run and layout."""
    return rows.orderBy(F.xxhash64(key), key).limit(limit)
