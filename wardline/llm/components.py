"""Connected components of a link table, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sources.tables import stored


def _stars(pairs: DataFrame) -> bool:
    """Whether every upper node hangs on one lower node only and no lower node hangs on another."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 OR up = 1 AND low = 1").count()


def components(links: DataFrame, kept: bool = False) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. ``links`` has two long columns, x and y; with ``kept`` it
    is cheap to read twice, as stored tables are.

    Alternates two steps until only stars are left: every neighbour above a node is hung on the smallest neighbour, then every
    neighbour below it is. The number of rounds grows with the logarithm of the longest path; only a count reaches the driver.
    """
    pairs = links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    if not kept:
        pairs = stored(pairs.distinct(), "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = down.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = stored(down, "links")
        if _stars(pairs):
            break
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
