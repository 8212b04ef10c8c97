"""Embedding near-duplicates by small-world graphs.

Vectors are compared within a label (and a length). Equal vectors are one node with a number of copies. The nodes of a label
are dealt by hash to shards of about ``SHARD_ROWS``; each shard's graph (``small_world``) is built in one task and stored.
Every node then queries every shard of its label, in blocks of ``QUERY_ROWS``. A beam that ends inside the linked range is
doubled for that query until it reaches past the range, so groups of any size are found whole. Audits compare a sample of
queries with all vectors of the shard, when a shard is built and again for each block of queries; while the share of links
found is below ``RECALL``, beams double, up to the width of the shard, where the search is exact. Candidates are verified
by their cosine in double precision.

A block sends on, per node, the number of its links and one link of a spanning forest, never the pairs of a group;
components are united over all blocks by ``components``.

The graph search is approximate: a link may be missed at either of its ends, none below the threshold is ever counted.
Work grows with the nodes of a label times its shards, as every shard is queried.

Nulls and edge cases: a vector that is null, empty, zero or holds a null or non-finite component, or whose label is null,
has no links and is its own component; vectors of different lengths are not compared; repeated rows are vectors of their
own; with a null ``vec_id`` a row counts as a vector, its component is the smallest id it reaches (null if none) and it is
kept if there is none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import small_world
from wardline.llm.components import components
from wardline.llm.hot import join_to_one
from wardline.llm.registry import query, table
from wardline.llm.words import mix
from wardline.sources.tables import stored

THRESHOLD = 0.93
#: Nodes of a shard and queries of a block, on average.
SHARD_ROWS, QUERY_ROWS = 16_384, 4_096
#: Width of a beam to begin with.
BEAM = 48
#: Audited queries per shard and per block, and the share of their links that has to be found.
AUDIT_ROWS, RECALL = 128, 0.995
#: Single precision is read this much below the threshold before the exact check.
SLACK = 1e-4


def units(lists: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of a column of equally long arrays."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    rows = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def hashes_of(nodes: np.ndarray) -> np.ndarray:
    return mix(nodes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def linked(graph: small_world.Graph, exact: np.ndarray, queries: np.ndarray, width: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, place) of the links found, for a run of queries at a time. ``exact`` are the shard's vectors in double precision."""
    n, dim = exact.shape
    waiting, low = np.arange(len(queries)), np.float32(threshold - SLACK)
    while len(waiting):
        width = min(width, n)
        rows, again = small_world.search_rows(n, dim, width), []
        for at in range(0, len(waiting), rows):
            mine = waiting[at : at + rows]
            ids, sims = small_world.search(graph, queries[mine].astype(np.float32), width)
            full = (sims[:, -1] >= low) & (width < n)  # the range may go on beyond the beam
            again.append(mine[full])
            row, column = np.nonzero((sims >= low) & ~full[:, None])
            place = ids[row, column]
            good = np.einsum("nd,nd->n", queries[mine[row]], exact[place]) >= threshold
            yield mine[row[good]], place[good]
        waiting, width = np.concatenate(again), width * 2


def audited_width(graph: small_world.Graph, exact: np.ndarray, queries: np.ndarray, width: int, threshold: float, recall: float = RECALL) -> int:
    """The first doubling of ``width`` that finds the wanted share of the links of ``queries``."""
    true = int((queries @ exact.T >= threshold).sum())
    while width < len(exact) and sum(len(q) for q, _ in linked(graph, exact, queries, width, threshold)) < recall * true:
        width *= 2
    return min(width, len(exact))


class Forest:
    """Spanning forest of links that come in runs: the smallest node of each tree met so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.root[x], self.root[y]
            if (a == b).all():
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _index(threshold: float, beam: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        nodes, exact = rows["node"].to_numpy(), units(rows["embedding"])
        hashes = hashes_of(nodes)
        graph = small_world.build(exact, hashes)
        sample = np.argsort(hashes, kind="stable")[:AUDIT_ROWS]
        width = audited_width(graph, exact, exact[sample], beam, threshold)
        values = [
            key[0].as_py(), key[1].as_py(), nodes.tolist(), rows["copies"].to_pylist(), exact.astype("<f8").tobytes(), graph.pack(), graph.entry, width,
        ]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, _INDEX)], schema=_INDEX)

    return run


_INDEX = pa.schema([
    ("space", pa.int64()), ("shard", pa.int64()), ("nodes", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("vectors", pa.binary()),
    ("graph", pa.list_(pa.binary())), ("entry", pa.int32()), ("width", pa.int32()),
])
INDEX_SCHEMA = "space long, shard long, nodes array<long>, weights array<long>, vectors binary, graph array<binary>, entry int, width int"
FOUND_SCHEMA = "node long, links long, root long"


def _query(threshold: float):
    def run(index: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["node", "links", "root"]
        if not index.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        index = index.slice(0, 1).to_pylist()[0]
        rows = rows.sort_by("node")
        shard, own = np.array(index["nodes"]), rows["node"].to_numpy()
        exact = np.frombuffer(index["vectors"], "<f8").reshape(len(shard), -1)
        graph = small_world.Graph.unpack(exact, index["graph"], index["entry"])
        queries, weights = units(rows["embedding"]), np.array(index["weights"])
        sample = np.argsort(hashes_of(own), kind="stable")[:AUDIT_ROWS]
        width = audited_width(graph, exact, queries[sample], index["width"], threshold)
        nodes = np.union1d(own, shard)
        at_own, at_shard = np.searchsorted(nodes, own), np.searchsorted(nodes, shard)
        links, forest = np.zeros(len(nodes), np.int64), Forest(len(nodes))
        for q, place in linked(graph, exact, queries, width, threshold):
            x, y = at_own[q], at_shard[place]
            other = x != y
            np.add.at(links, x[other], weights[place[other]])
            forest.add(x[other], y[other])
        told = np.flatnonzero((links > 0) | (forest.root != np.arange(len(nodes))))
        return pa.table([nodes[told], links[told], nodes[forest.root[told]]], names=names)

    return run


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: no null, no non-finite component, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, beam: int = BEAM
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    read = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
        F.col("embedding").cast("array<float>" if kind == "float" else "array<double>").alias("embedding"),
    )
    good = F.col("label").isNotNull() & usable(F.col("embedding"))
    valid = read.where(good)
    # Nodes in the order of their smallest id, so that the smallest node of a component has its smallest id.
    nodes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = nodes.repartitionByRange(F.asc_nulls_last("vec_id")).sortWithinPartitions(F.asc_nulls_last("vec_id"), "label")
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "*", F.size("embedding").alias("dim")), "nodes")
    spaces = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    spaces = stored(spaces.select(F.monotonically_increasing_id().alias("space"), "*"), "spaces")
    parts = lambda rows: F.ceil(F.col("n") / rows)
    dealt = nodes.join(spaces, ["label", "dim"]).select(
        "space", "node", "copies", "embedding", parts(shard_rows).alias("shards"), F.pmod(F.xxhash64("node"), parts(shard_rows)).alias("shard"),
        F.pmod(F.xxhash64("node", F.lit(1)), parts(query_rows)).alias("block"), parts(query_rows).alias("blocks"),
    )
    index = dealt.groupBy("space", "shard").applyInArrow(_index(threshold, beam), INDEX_SCHEMA)
    index = stored(index, "graphs").join(spaces, "space").withColumn("block", F.explode(F.sequence(F.lit(0), parts(query_rows) - 1)))
    index = index.select(*_INDEX.names, "block")
    asked = dealt.select("space", "node", "embedding", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    key = ["space", "shard", "block"]
    found = stored(index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_query(threshold), FOUND_SCHEMA), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("others"))
    united = components(found.where("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y")))
    rows = nodes.join(links, "node", "left").select("node", "label", "embedding", "vec_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    grouped = stored(united.join(rows, "node"), "grouped")
    heads = nodes.select(F.col("node").alias("component"), F.col("vec_id").alias("component_id"))
    grouped = join_to_one(grouped, heads, ["component"])
    alone = rows.join(united.select("node"), "node", "left_anti").withColumn("component_id", F.col("vec_id"))
    names = ["label", "embedding", "vec_id", "copies", "n_links", "component_id"]
    judged = stored(grouped.select(*names).unionByName(alone.select(*names)), "judged")
    copies = judged.where("copies > 1").select("label", "embedding", "n_links", "component_id")
    out = (
        judged.where("copies = 1").select("vec_id", "n_links", "component_id")
        .unionByName(join_to_one(valid, copies, ["label", "embedding"]).select("vec_id", "n_links", "component_id"))
        .unionByName(read.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    )
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
heads AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN heads h ON vec_id = h.x LEFT JOIN counts c ON vec_id = c.x
"""


@query("op13_embedding_graph", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
