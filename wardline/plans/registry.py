"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wardline.functions.scalar import floor6
from wardline.plans.bridge import r6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query. ``doubles`` are cut to six decimals in the SQL; the DataFrame side cuts all DOUBLEs."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = cut_sql(sql, doubles)
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: floor6(c) for c in names}) if names else df


def cut_sql(sql: str, doubles: Sequence[str]) -> str:
    if not doubles:
        return sql
    cols = ", ".join(f"{r6(c)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({cols}) FROM ({sql}) AS q"
