from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import boosting

SETTINGS = dict(trees=6, depth=3, rate=0.3, seed=7)


def _rows(spark, parts: int):
    wide = spark.range(900).select(
        F.col("id"), (F.xxhash64("id") % 97).cast("double").alias("a"), (F.xxhash64("id", F.lit(1)) % 11).cast("double").alias("b"), (F.col("id") % 3 == 0).cast("double").alias("f")
    )
    return wide.withColumn("y", (F.col("a") + 30 * F.col("f") + F.xxhash64("id", F.lit(2)) % 40 > 10).cast("double")).repartition(parts, "id")


def _plain(x: np.ndarray, y: np.ndarray, edges, trees: int, depth: int, rate: float) -> np.ndarray:
    """Margins of the same trees by a loop over every node, feature and cut."""
    cells = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1)
    margin = np.zeros(len(y))
    for number in range(trees):
        gradient = 4 * y / (1 + np.exp(2 * y * margin)) if number else y.astype(float)
        gradient = np.rint(gradient * boosting.SCALE) / boosting.SCALE
        leaves = [np.arange(len(y))]
        for _ in range(depth):
            below = []
            for rows in leaves:
                g = gradient[rows]
                best, cut = g.sum() ** 2 / max(len(g), 1) * (1 + 1e-12), None
                for f in range(len(edges)):
                    for c in range(len(edges[f])):
                        left = cells[rows, f] <= c
                        if left.any() and not left.all() and (gain := g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum()) > best * (1 + 1e-9):
                            best, cut = gain, left
                below += [rows, rows[:0]] if cut is None else [rows[cut], rows[~cut]]
            leaves = below
        for rows in leaves:
            if len(rows):
                margin[rows] += gradient[rows].mean() * (rate if number else 1.0)
    return margin


def test_trees_equal_a_plain_loop_over_all_rows(spark):
    rows = _rows(spark, 5)
    trees = boosting.fit(rows, ["a", "b"], ["f"], "y", subsample=1.0, **SETTINGS)
    got = rows.withColumn("p", trees.probability([F.col("a"), F.col("b"), F.col("f")])).toPandas()
    x, y = got[["a", "b", "f"]].to_numpy(), 2 * got["y"].to_numpy() - 1
    want = 1 / (1 + np.exp(-2 * _plain(x, y, trees.edges, SETTINGS["trees"], SETTINGS["depth"], SETTINGS["rate"])))
    assert np.allclose(got["p"], want, atol=1e-6)


def test_trees_do_not_depend_on_partitions_or_blocks(spark, monkeypatch):
    one = boosting.fit(_rows(spark, 1), ["a", "b"], ["f"], "y", subsample=0.8, **SETTINGS)
    monkeypatch.setattr(boosting, "BLOCK", 50)
    many = boosting.fit(_rows(spark, 7), ["a", "b"], ["f"], "y", subsample=0.8, edges=one.edges, **SETTINGS)
    for name in ("feature", "cut", "value"):
        assert np.array_equal(getattr(one, name), getattr(many, name))


def test_other_labels_fail(spark):
    with pytest.raises(Exception, match="Labels have to be 0 or 1"):
        boosting.fit(_rows(spark, 2).withColumn("y", F.lit(2.0)), ["a"], [], "y", subsample=1.0, **SETTINGS)
