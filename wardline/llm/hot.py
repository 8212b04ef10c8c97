"""Joins of many rows to one row per key where a few keys may hold a large part of the rows, and names for a join's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least one in ``SHARE`` of the rows is hot; there are at most ``SHARE`` of them.
SHARE = 1000


def join_to_one(rows: DataFrame, one: DataFrame, key: list[str], share: int = SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has at most one row per key. Rows with a null key are dropped.

    The rows of ``one`` for hot keys, at most ``share`` of them, go to every task; the others meet in a join that no key
    dominates. Both tables are read several times: give stored or cheap ones.
    """
    counts = rows.groupBy(*key).agg(F.count("*").alias("_rows"))
    total = rows.count()
    hot = one.join(counts.where(F.col("_rows") * share >= total).drop("_rows"), key, "left_semi")
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(one, key))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind them as none of ``docs``'s columns has (names are the same in any case)."""
    taken, end = {c.lower() for c in docs.columns}, ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]
