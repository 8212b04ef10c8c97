"""Gradient-boosted trees by histograms: rows are binned once, a pass over them sums gradients per node and bin.

The rows are kept as blocks of packed bin numbers with their margin and gradient. Each level of a tree is one pass: every task sums its
blocks per node, feature and bin, the sums meet by node in a shuffle, and each node's best cut is found where its sums are. The
driver sees the cuts only. After a tree the blocks are carried on with new margins; every ten trees they are checkpointed.

Loss and steps are those of Spark ML's classifier (labels -1 and 1, logarithmic loss, the mean gradient as a leaf's value, the
first tree of weight 1, a cut wherever it lessens the variance). Gradients are rounded to 1/``SCALE`` and summed as whole numbers, and a row is drawn by its own hash, so for
given bins the trees do not depend on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.sources.tables import shared_folder, stored

BINS, GROUP_BITS = 32, 10
#: Rows of a block, parts of a gradient of 1, and what a row's count weighs beside its gradient: sums of a block stay below 2**53.
BLOCK, SCALE, COUNT = 1 << 15, 1 << 19, float(1 << 37)
#: Rows of a partition at most, and trees between two checkpoints.
PART_ROWS, CHECKPOINT = 1 << 21, 10


@dataclass(frozen=True)
class Trees:
    """``edges``: the upper limits of each feature's bins but the last. Per tree: ``feature`` (-1: none) and ``cut`` of every inner node
    in level order, ``value`` of every leaf; a row goes left if its bin is not above the cut or if there is none."""

    edges: tuple[np.ndarray, ...]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def probability(self, inputs: Sequence[Column]) -> Column:
        """The chance of label 1 for the inputs, in the order of ``edges``."""
        trees = self

        def score(rows: pa.Array) -> pa.Array:
            values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            cells = [np.searchsorted(e, values[:, i]).astype(np.uint8) for i, e in enumerate(trees.edges)]
            margin = np.zeros(len(rows))
            for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
                margin += value[_node(cells.__getitem__, len(rows), feature, cut)]
            return pa.array(1.0 / (1.0 + np.exp(-2.0 * margin)))

        return F.arrow_udf(score, "double", F.ArrowUDFType.SCALAR)(F.array(*inputs))


def _node(cell: Callable[[int], np.ndarray], n: int, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node, or leaf, below the given inner nodes that each row falls into, counted within its level."""
    node, first, width = np.zeros(n, np.uint8), 0, 1
    while first < len(feature):
        right = np.zeros(n, np.uint8)
        for k in range(width):
            if feature[first + k] >= 0:
                right |= (node == k) & (cell(feature[first + k]) > cut[first + k])
        node = node * np.uint8(2) + right
        first, width = first + width, 2 * width
    return node


def bin_edges(rows: DataFrame, inputs: Sequence[str], flags: Sequence[str]) -> tuple[np.ndarray, ...]:
    """Edges of ``inputs`` from all rows' quantiles by Spark's sketch (every value if there are few), and of the 0/1 columns ``flags``."""
    steps = 8 * BINS
    probs = [i / steps for i in range(steps)]
    found = rows.agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in inputs]).first()
    edges = []
    for c in inputs:
        fine = np.array(found[c] or [0.0])
        few = np.unique(fine)
        edges.append(few if len(few) < BINS else np.unique(fine[8::8]))
    return (*edges, *[np.array([0.5])] * len(flags))


def _layout(edges: Sequence[np.ndarray]) -> list[tuple[int, int, int]]:
    """Group, shift and bits of each feature: groups of ``GROUP_BITS`` bits share one number and one histogram."""
    out, used = [(0, 0, 0)] * len(edges), []
    bits = [len(e).bit_length() for e in edges]
    for f in sorted(range(len(edges)), key=lambda f: -bits[f]):
        g = next((g for g, u in enumerate(used) if u + bits[f] <= GROUP_BITS), len(used))
        used += [0] * (g == len(used))
        out[f] = (g, used[g], bits[f])
        used[g] += bits[f]
    return out


def _blocks(rows: DataFrame, names: Sequence[str], label: str, edges: Sequence[np.ndarray]) -> RDD:
    """The rows as blocks: (codes per group, draw, label of -1 or 1)."""
    layout = _layout(edges)
    groups = 1 + max(g for g, _, _ in layout)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            columns = pa.Table.from_batches(held).columns
            x = [c.to_numpy() for c in columns]
            if not np.isin(x[0], (0.0, 1.0)).all():
                raise ValueError("Labels have to be 0 or 1")
            codes = np.zeros((groups, len(x[0])), np.uint16)
            for (g, shift, _), e, values in zip(layout, edges, x[2:]):
                codes[g] |= (np.searchsorted(e, values) << shift).astype(np.uint16)
            out = [codes.tobytes(), x[1].astype(np.int32).tobytes(), (2 * x[0] - 1).astype(np.int8).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in out], names=["codes", "draw", "label"])

        for whole in batches:
            while whole.num_rows:
                part = whole.slice(0, BLOCK - sum(h.num_rows for h in held))
                held.append(part)
                whole = whole.slice(part.num_rows)
                if sum(h.num_rows for h in held) == BLOCK:
                    yield block()
                    held = []
        if held:
            yield block()

    draw = F.xxhash64(*sorted(rows.columns)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    columns = rows.select(F.col(label).cast("double").alias("label"), draw.alias("draw"), *[F.col(c).cast("double") for c in names])
    packed = stored(columns.mapInArrow(pack, "codes binary, draw binary, label binary"), "blocks")
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    blocks = packed.count()
    waves = -(-blocks * BLOCK // (PART_ROWS * tasks))

    def unpack(r) -> tuple[np.ndarray, ...]:
        draw, y = np.frombuffer(r["draw"], np.uint32), np.frombuffer(r["label"], np.int8)
        return np.frombuffer(r["codes"], np.uint16).reshape(groups, -1), draw, y, np.zeros(len(y)), np.zeros(len(y))

    return packed.repartition(max(1, min(blocks, max(1, waves) * tasks))).rdd.map(unpack)


def _drawn(draw: np.ndarray, number: int, share: float) -> np.ndarray:
    """The rows that a tree is fitted on."""
    x = draw * np.uint32(0x9E3779B1) + np.uint32(number * 0x85EBCA6B & 0xFFFFFFFF)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return (x ^ (x >> np.uint32(16))) < share * 2.0**32


def _cells(codes: np.ndarray, layout: list[tuple[int, int, int]]) -> Callable[[int], np.ndarray]:
    return lambda f: (codes[layout[f][0]] >> np.uint16(layout[f][1])) & np.uint16((1 << layout[f][2]) - 1)


def _moved(layout: list, last: tuple | None, number: int, share: float) -> Callable[[tuple], tuple]:
    """A block after the tree ``last``, with the gradients of the rows that tree ``number`` is fitted on (0 for the others)."""

    def move(block: tuple) -> tuple:
        codes, draw, y, margin, _ = block
        gradient = y.astype(np.float64)
        if last is not None:
            feature, cut, value = last
            margin = margin + value[_node(_cells(codes, layout), len(y), feature, cut)]
            gradient = 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700.0)))
        whole = np.clip(np.rint(gradient * SCALE), 1 - 4 * SCALE, 4 * SCALE - 1)
        return codes, draw, y, margin, np.where(_drawn(draw, number, share), whole + COUNT, 0.0)

    return move


def _sums(layout: list, feature: np.ndarray, cut: np.ndarray) -> Callable[[Iterator[tuple]], Iterator[tuple[int, np.ndarray]]]:
    """(node, counts and gradients per feature and bin) of a partition, for the level below the given inner nodes."""
    nodes, groups = len(feature) + 1, 1 + max(g for g, _, _ in layout)
    size = 1 << GROUP_BITS

    def add(blocks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros((2, groups, nodes * size), np.int64)
        for codes, _, y, _, weight in blocks:
            node = _node(_cells(codes, layout), len(y), feature, cut).astype(np.uint16) << np.uint16(GROUP_BITS)
            for g in range(groups):
                both = np.bincount(codes[g] + node, weights=weight, minlength=nodes * size)
                count = np.floor(both / COUNT + 0.5)
                total[0, g] += count.astype(np.int64)
                total[1, g] += (both - count * COUNT).astype(np.int64)
        out = np.zeros((nodes, 2, len(layout), BINS), np.int64)
        for f, (g, shift, bits) in enumerate(layout):
            one = total[:, g].reshape(2, nodes, -1, 1 << bits, 1 << shift).sum((2, 4))
            out[:, :, f, : 1 << bits] = one.swapaxes(0, 1)
        yield from ((k, out[k]) for k in range(nodes) if out[k, 0, 0].any())

    return add


def _best(sums: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The cut that lessens the variance most, the first one of equals: feature (-1: none), cut, and (count, gradient) on both sides."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :1, -1:]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1].astype(float) ** 2 / left[0] + right[1].astype(float) ** 2 / right[0]
    gain = np.where((left[0] > 0) & (right[0] > 0), gain, -1.0)
    f, c = np.unravel_index(np.argmax(gain), gain.shape)
    none = float(whole[1, 0, 0]) ** 2 / whole[0, 0, 0]
    if gain[f, c] <= none * (1 + 1e-12):
        return -1, 0, whole[:, 0, 0], np.zeros(2, np.int64)
    return int(f), int(c), left[:, f, c], right[:, f, c]


def fit(
    rows: DataFrame, inputs: Sequence[str], flags: Sequence[str], label: str, *,
    trees: int, depth: int, rate: float, subsample: float, seed: int, edges: Sequence[np.ndarray] | None = None,
) -> Trees:
    """Trees over the columns ``inputs`` and the 0/1 columns ``flags`` of ``rows``, none of them null. Runs its jobs when called."""
    if not 1 <= depth <= 6:
        raise ValueError("Trees may have 1 to 6 levels")
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    names = [*inputs, *flags]
    edges = tuple(edges or bin_edges(rows, inputs, flags))
    layout = _layout(edges)
    done: list[tuple] = []
    before = state = _blocks(rows, names, label, edges)
    checkpoint = None
    for number in range(trees):
        state = before.map(_moved(layout, done[-1] if done else None, seed + number, subsample)).persist(StorageLevel.MEMORY_AND_DISK)
        marked = number % CHECKPOINT == CHECKPOINT - 1
        if marked:
            state.checkpoint()
        feature, cut = np.zeros(0, np.int64), np.zeros(0, np.int64)
        value = np.zeros(1)
        for level in range(depth):
            found = state.mapPartitions(_sums(layout, feature, cut)).reduceByKey(np.add, 1 << level).mapValues(_best).collectAsMap()
            if level == 0:
                before.unpersist()
            nodes = [found.get(k, (-1, 0, (0, 0), (0, 0))) for k in range(1 << level)]
            feature, cut = np.append(feature, [n[0] for n in nodes]), np.append(cut, [n[1] for n in nodes])
            sides = [(s, mean) for n, mean in zip(nodes, value) for s in (n[2], n[3])]
            value = np.array([s[1] / s[0] / SCALE if s[0] else mean for s, mean in sides])
        done.append((feature, cut, value * (rate if number else 1.0)))
        if marked:
            if checkpoint:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            checkpoint = state.getCheckpointFile()
        before = state
    state.unpersist()
    return Trees(edges, *[np.array(x) for x in zip(*done)])
