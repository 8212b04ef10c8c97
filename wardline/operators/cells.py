"""Counts of two batches along a value axis, refined only where an answer depends on it.

One pass over the rows counts them per cell (``value_cell``), combined map-side. From the counts before and in a cell follow
the cells that hold a wanted rank of the reference, and bounds of the gap between the two distribution functions inside
each cell: if all reference rows of the cell came first, or all current rows. Only cells that hold a wanted rank, or whose
bound exceeds the largest gap known at any cell's end, are looked at again: another pass counts their rows by value (at most
``LEAF_ROWS`` rows) or in ``PARTS`` finer cells, until nothing is open. Everything stored is counts per cell; no row-level
or value-level copy of the input is kept, and a value held by a third of the rows is one cell from the first pass on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.cumulative import value_cell
from wardline.sources.tables import stored

#: Cells between powers of two.
PER_OCTAVE = 512
#: An open cell with at most this many rows is counted by value, a larger one in so many parts.
LEAF_ROWS, PARTS = 20_000, 256
_MISSING = -(1 << 41)
_COUNTS = ("n_ref", "n_cur")


def _gap(ref: Column, cur: Column) -> Column:
    """Difference of the two distribution functions after so many rows; 0 while a batch has no rows."""
    share = lambda n, total: F.try_divide(n.cast("double"), F.col(total))
    return F.coalesce(share(ref, "total_ref") - share(cur, "total_cur"), F.lit(0.0))


def _judged(leaves: DataFrame, keys: Sequence[str], probs: Sequence[float], gaps: bool) -> DataFrame:
    """Add ``gap`` (after the cell), ``best`` (the largest known) and ``open``."""
    before_ref, before_cur, n_ref, n_cur = (F.col(c) for c in ("before_ref", "before_cur", *_COUNTS))
    seen = F.col("low").isNotNull()
    out = leaves.withColumn("gap", F.when(seen, F.abs(_gap(before_ref + n_ref, before_cur + n_cur))))
    best = F.max("gap").over(Window.partitionBy(*keys))
    out = out.withColumn("best", F.greatest(best, F.col("best")) if "best" in leaves.columns else best)
    last = (F.col("total_ref") - 1).cast("double")
    wanted = F.lit(False)
    if probs:
        wanted = F.exists(
            F.array(*[F.lit(float(q)) for q in sorted(set(probs))]), lambda q: (before_ref + n_ref > F.floor(last * q)) & (before_ref <= F.ceil(last * q))
        )
    if gaps:
        reach = F.greatest(F.abs(_gap(before_ref + n_ref, before_cur)), F.abs(_gap(before_ref, before_cur + n_cur)))
        wanted = wanted | ((n_ref > 0) & (n_cur > 0) & (reach > F.col("best") - 1e-12))
    return out.withColumn("open", F.coalesce(seen & (F.col("low") < F.col("high")) & wanted, F.lit(False)))


def _within(rows: DataFrame, leaves: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    """Rows joined with the cell among ``leaves`` that holds their value."""
    at = [*keys, "_cell"]
    leaves = F.broadcast(leaves) if bounded else leaves
    return rows.join(leaves, at).where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))


class Profile:
    """Counts of the reference and the current batch per key and cell.

    ``rows`` has the keys, ``value`` (DOUBLE, NULL when missing) and ``is_ref``; it is read once for the cells and once per
    refinement. ``leaves`` are the cells that nothing finer replaced, ``all_leaves`` also the replaced ones; both have
    n_ref, n_cur, low, high, before_ref, before_cur, total_ref, total_cur, gap. Missing values are the cells with NULL ``low``.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], probs: Sequence[float] = (), gaps: bool = False, bounded_keys: bool = True):
        self.keys, self.bounded = list(keys), bounded_keys
        self.rows = rows.withColumn("_cell", F.coalesce(value_cell(F.col("value"), PER_OCTAVE), F.lit(_MISSING)))
        self.first = self._cells(probs, gaps)
        self.levels = [self.first]
        while not self.levels[-1].where("open").isEmpty():
            self.levels.append(self._refined(self.levels[-1].where("open"), probs, gaps))

    def _cells(self, probs: Sequence[float], gaps: bool) -> DataFrame:
        ref = F.col("is_ref")
        counted = self.rows.groupBy(*self.keys, "_cell").agg(
            F.count_if(ref).alias("n_ref"), F.count_if(~ref).alias("n_cur"), F.min("value").alias("low"), F.max("value").alias("high"),
            F.sum(F.when(ref, F.col("value"))).alias("sum_ref"), F.sum(F.when(~ref, F.col("value"))).alias("sum_cur"),
        )
        in_key = Window.partitionBy(*self.keys)
        before = in_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        seen = lambda c: F.when(F.col("low").isNotNull(), F.col(c)).otherwise(F.lit(0))
        placed = counted.select(
            "*", *[F.coalesce(F.sum(seen(f"n_{s}")).over(before), F.lit(0)).alias(f"before_{s}") for s in ("ref", "cur")],
            *[F.sum(seen(f"n_{s}")).over(in_key).alias(f"total_{s}") for s in ("ref", "cur")],
        )
        return stored(_judged(placed, self.keys, probs, gaps), "cells")

    def _refined(self, leaves: DataFrame, probs: Sequence[float], gaps: bool) -> DataFrame:
        value, low, high = F.col("value"), F.col("low"), F.col("high")
        parent = [*self.keys, "_cell", "_parent"]
        kept = ["low", "high", *_COUNTS, "before_ref", "before_cur", "total_ref", "total_cur", "best"]
        inside = _within(self.rows, leaves.select(*self.keys, "_cell", *kept), self.keys, self.bounded)
        span = high / 2 - low / 2  # halves, so that the widest range has a width
        by_value = (F.col("n_ref") + F.col("n_cur") <= LEAF_ROWS) | (span <= 0)
        part = F.least(F.floor(F.try_divide(value / 2 - low / 2, span) * PARTS), F.lit(PARTS - 1)).cast("double")
        counted = inside.groupBy(*self.keys, "_cell", low.alias("_parent"), F.when(by_value, value).otherwise(part).alias("_part")).agg(
            F.count_if("is_ref").alias("n_ref"), F.count_if(~F.col("is_ref")).alias("n_cur"), F.min("value").alias("low"), F.max("value").alias("high"),
            *[F.any_value(c).alias(c) for c in kept[4:]],
        )
        before = Window.partitionBy(*parent).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumns(
            {f"before_{s}": F.col(f"before_{s}") + F.coalesce(F.sum(f"n_{s}").over(before), F.lit(0)) for s in ("ref", "cur")}
        ).drop("_parent", "_part")
        return stored(_judged(placed, self.keys, probs, gaps), "cells")

    def _union(self, open_too: bool) -> DataFrame:
        names = [*self.keys, "_cell", "low", "high", *_COUNTS, "before_ref", "before_cur", "total_ref", "total_cur", "gap", "open"]
        parts = [level.select(*names) for level in self.levels]
        together = reduce(DataFrame.unionByName, parts)
        return together if open_too else together.where("NOT open")

    @property
    def leaves(self) -> DataFrame:
        return self._union(False)

    @property
    def all_leaves(self) -> DataFrame:
        return self._union(True)

    def summary(self) -> DataFrame:
        """Per key: rows with a value, rows without, sums, and the largest gap (exact when asked for)."""
        gone = F.col("low").isNull()
        sums = self.first.groupBy(*self.keys).agg(
            *[F.coalesce(F.sum(F.when(~gone, F.col(f"n_{s}"))), F.lit(0)).alias(f"{s}_rows") for s in ("ref", "cur")],
            *[F.coalesce(F.sum(F.when(gone, F.col(f"n_{s}"))), F.lit(0)).alias(f"{s}_missing") for s in ("ref", "cur")],
            *[F.sum(f"sum_{s}").alias(f"{s}_sum") for s in ("ref", "cur")],
        )
        gaps = self.all_leaves.groupBy(*self.keys).agg(F.max("gap").alias("largest_gap"))
        return sums.join(gaps, self.keys)

    def binned(self, edges: DataFrame, bin_of, carry: Sequence[str] = ()) -> DataFrame:
        """Cells with ``edges``, ``carry`` and ``_bin``; the rows of a cell that an edge cuts are counted again, by bin.

        ``edges`` has one row per key; ``bin_of(value, edges)`` gives the bin and never decreases with the value.
        """
        edges = F.broadcast(edges) if self.bounded else edges
        placed = self.leaves.join(edges, self.keys, "left").withColumns(
            {"_bin": bin_of(F.col("low"), F.col("edges")), "_high_bin": bin_of(F.col("high"), F.col("edges"))}
        )
        names = [*self.keys, *_COUNTS, "edges", *carry, "_bin"]
        cut = F.col("_bin") < F.col("_high_bin")
        whole = placed.where(~F.coalesce(cut, F.lit(False))).select(*names)
        split = placed.where(cut).select(*self.keys, "_cell", "low", "high", "edges", *carry)
        if split.isEmpty():
            return whole
        inside = _within(self.rows, split.drop(*carry), self.keys, self.bounded)
        # Numbers only, so that tasks keep one row per bin; cut points are arrays, which Spark would sort all rows to combine.
        counted = inside.groupBy(*self.keys, bin_of(F.col("value"), F.col("edges")).alias("_bin")).agg(
            F.count_if("is_ref").alias("n_ref"), F.count_if(~F.col("is_ref")).alias("n_cur")
        )
        return whole.unionByName(counted.join(edges.select(*self.keys, "edges", *carry), self.keys).select(*names))
