"""Running counts in value order, and exact quantiles, without a one-task sort.

A running sum over a sorted value normally needs one global window. Here the value axis is cut into
blocks by rules that depend on the data only through exact counts, minima and maxima, so every
evaluation (a retry on another executor included) cuts at the same place:

* *cell*: sign, binary exponent and the leading bits of the mantissa; monotone in the value;
* *part*: a cell with many distinct values is split evenly between its own minimum and maximum.

Equal values are collapsed before that, so a value held by a third of all rows is one row here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.sources.tables import stored

BLOCK_ROWS = 250_000
_INFINITE_CELL = 1 << 40


def value_cell(value: Column, per_octave: int = 64) -> Column:
    """Monotone map from DOUBLE to an integer cell; ``per_octave`` cells between powers of two.

    A key therefore has at most about 2 * 2100 * per_octave cells, whatever the row count.
    """
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    mantissa = size / F.pow(F.lit(2.0), exponent.cast("double"))
    magnitude = (exponent + 1100) * per_octave + F.floor((mantissa - 1.0) * per_octave)
    cell = F.when(size == float("inf"), F.lit(_INFINITE_CELL)).otherwise(magnitude)
    return F.when(value == 0.0, F.lit(0)).when(value < 0.0, -cell).otherwise(cell).cast("long")


def _bounded(df: DataFrame, bounded: bool) -> DataFrame:
    # Only tables bounded by (fixed key list) x (cells per key) get here with bounded=True.
    return F.broadcast(df) if bounded else df


def running_counts(
    values: DataFrame,
    keys: Sequence[str],
    value: str,
    counts: Sequence[str],
    *,
    bounded_keys: bool = False,
    block_rows: int = BLOCK_ROWS,
    store: bool = True,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in value order) and ``total_<c>`` per key.

    ``values`` has one row per (keys, value); keys are not NULL, and a NULL value sorts first (give it
    count 0 to leave it out). ``bounded_keys`` says the key list is fixed by the caller's schema
    (features, batches), so a table of cells per key may be broadcast; with data-dependent keys
    (segments) leave it False and Spark chooses the join.

    ``values`` is read three times, so it is stored first (one job); ``store=False`` says it already is.
    """
    keys = list(keys)
    values = stored(values, "values") if store else values
    x = F.col(value)
    celled = values.withColumn("_cell", F.coalesce(value_cell(x), F.lit(-(1 << 41))))
    cell_sums = celled.groupBy(*keys, "_cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_parts"),
        F.min(x).alias("_low"),
        F.max(x).alias("_high"),
        *[F.sum(c).alias(f"_sum_{c}") for c in counts],
    )
    in_key = Window.partitionBy(*keys)
    before = in_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cell_sums.select(
        *keys, "_cell", "_parts", "_low", "_high",
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_cell_{c}") for c in counts],
        *[F.sum(f"_sum_{c}").over(in_key).alias(f"total_{c}") for c in counts],
    )
    position = F.floor((x / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * F.col("_parts"))
    part = F.when(
        (F.col("_parts") > 1) & (F.col("_high") > F.col("_low")), F.least(position, F.col("_parts") - 1)
    ).otherwise(F.lit(0))
    placed = celled.join(_bounded(cells, bounded_keys), [*keys, "_cell"]).withColumn("_part", part.cast("long"))
    block = [*keys, "_cell", "_part"]
    in_cell = Window.partitionBy(*keys, "_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy(*block)
        .agg(*[F.sum(c).alias(f"_sum_{c}") for c in counts])
        .select(*block, *[F.coalesce(F.sum(f"_sum_{c}").over(in_cell), F.lit(0)).alias(f"_part_{c}") for c in counts])
    )
    upto = Window.partitionBy(*block).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(parts, block).select(
        *values.columns,
        *[(F.sum(c).over(upto) + F.col(f"_cell_{c}") + F.col(f"_part_{c}")).alias(f"cum_{c}") for c in counts],
        *[f"total_{c}" for c in counts],
    )


def lerp(low: Column, high: Column, fraction: Column) -> Column:
    """Linear interpolation taken from the nearer end, exact when both ends agree."""
    span = high - low
    inner = F.when(fraction >= 0.5, high - span * (1.0 - fraction)).otherwise(low + span * fraction)
    return F.when(low == high, low).otherwise(inner)


def rank_hits(value: Column, count: Column, cum: Column, total: Column, probs: Sequence[float]) -> Column:
    """Aggregate: the rows of a running count that hold an order statistic some quantile needs.

    At most two rows per quantile survive per key, so the list is bounded by the number of quantiles.
    """
    start = cum - count
    last = (total - 1).cast("double")
    wanted = F.exists(
        F.array(*[F.lit(float(q)) for q in sorted(set(probs))]),
        lambda q: (F.floor(last * q) < cum) & (F.ceil(last * q) >= start),
    )
    hit = F.struct(start.alias("start"), cum.alias("stop"), value.alias("value"))
    return F.collect_list(F.when((count > 0) & wanted, hit))


def quantiles_from_hits(hits: Column, total: Column, probs: Sequence[float]) -> Column:
    """ARRAY<DOUBLE> of linear-interpolated quantiles, in the order of ``probs``."""

    def at_rank(rank: Column) -> Column:
        return F.try_element_at(F.filter(hits, lambda h: (h["start"] <= rank) & (rank < h["stop"])), F.lit(1))["value"]

    def one(q: Column) -> Column:
        at = (total - 1).cast("double") * q
        return lerp(at_rank(F.floor(at)), at_rank(F.ceil(at)), at - F.floor(at).cast("double"))

    return F.transform(F.array(*[F.lit(float(q)) for q in probs]), one)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    names: Sequence[str] | None = None,
    bounded_keys: bool = False,
    per_octave: int = 1024,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, shuffling only the cells that hold a wanted rank.

    Columns: keys, row_count, then one column per name, or one array ``quantiles`` without names.

    Pass 1 counts rows per cell (combined map-side). Pass 2 keeps the rows of the few cells where a wanted
    rank falls, collapses equal values and runs inside those cells. ``percentile`` would instead hold every
    distinct value of a key in one task.
    """
    keys = list(keys)
    constant = not keys
    if constant:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_x")
    ).withColumn("_band", value_cell(F.col("_x"), per_octave))
    in_key = Window.partitionBy(*keys)
    bands = (
        rows.groupBy(*keys, "_band")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(in_key.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(in_key))
    )
    start = F.col("_end") - F.col("_n")
    last = (F.col("_total") - 1).cast("double")
    wanted = F.exists(
        F.array(*[F.lit(float(q)) for q in sorted(set(probs))]),
        lambda q: ((F.floor(last * q) >= start) & (F.floor(last * q) < F.col("_end")))
        | ((F.ceil(last * q) >= start) & (F.ceil(last * q) < F.col("_end"))),
    )
    targets = bands.where(wanted).select(*keys, "_band", start.alias("_start"), "_total")
    picked = (
        rows.join(_bounded(targets, bounded_keys), [*keys, "_band"])
        .groupBy(*keys, "_band", "_start", "_total", "_x")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_counts(
        picked, [*keys, "_band"], "_x", ["_n"], bounded_keys=bounded_keys
    ).withColumn("_cum", F.col("cum__n") + F.col("_start"))
    found = ranked.groupBy(*keys).agg(
        F.any_value("_total").alias("row_count"),
        rank_hits(F.col("_x"), F.col("_n"), F.col("_cum"), F.col("_total"), probs).alias("_hits"),
    )
    values = found.select(
        *([] if constant else keys), "row_count", quantiles_from_hits(F.col("_hits"), F.col("row_count"), probs).alias("_v")
    )
    if names is None:
        return values.withColumnRenamed("_v", "quantiles")
    return values.select(
        *([] if constant else keys), "row_count", *[F.col("_v")[i].alias(n) for i, n in enumerate(names)]
    )
