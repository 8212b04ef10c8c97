from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import op_embedding_graph as E
from wardline.llm import small_world as W
from wardline.llm.hot import join_to_one


def clustered(rng, n, dim, groups, spread):
    centres = rng.normal(size=(groups, dim))
    out = rng.normal(size=(n, dim))
    members = rng.integers(0, groups * 2, n)
    near = members < groups
    out[near] = centres[members[near]] + spread * rng.normal(size=(int(near.sum()), dim))
    return out.astype(np.float32)


def brute(rows, threshold=0.93):
    """Links and components by comparing everything."""
    n = len(rows)
    usable = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, lab in rows]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = [0] * n
    spaces = {}
    for i, (_, v, lab) in enumerate(rows):
        if usable[i]:
            spaces.setdefault((lab, len(v)), []).append(i)
    for members in spaces.values():
        m = np.array([rows[i][1] for i in members], np.float64)
        m = m / np.abs(m).max(1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, row in zip(members, m @ m.T >= threshold):
            for b in np.array(members)[row].tolist():
                if a != b:
                    links[a] += 1
                    parent[find(a)] = find(b)
    smallest = {}
    for i in range(n):
        if rows[i][0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], smallest.get(find(i)), rows[i][0] == smallest.get(find(i))) for i in range(n)]


@pytest.mark.parametrize("dim,spread", [(16, 0.1), (64, 0.15)])
def test_graph_finds_the_links(dim, spread):
    rng = np.random.default_rng(dim)
    x = E.units(pa.array(clustered(rng, 3000, dim, 60, spread).tolist()))
    graph = W.build(x, E.hashes_of(np.arange(len(x))))
    assert all(((g < len(x)) & (g >= -1)).all() for g in graph.links)
    again = W.Graph.unpack(x, graph.pack(), graph.entry)
    truth = x @ x.T >= 0.93
    found = np.zeros_like(truth)
    for q, p in E.linked(again, x, x, E.BEAM, 0.93):
        found[q, p] = True
    assert not (found & ~truth).any()
    assert found.sum() >= 0.99 * truth.sum() and truth.sum() > 20_000
    ids, sims = W.search(again, x[:20].astype(np.float32), len(x))
    assert np.allclose(np.sort(sims, 1), np.sort(x[:20] @ x.T, 1), atol=1e-5) and (np.sort(ids, 1) == np.arange(len(x))).all()


def test_links_of_a_node_are_not_repeated():
    rng = np.random.default_rng(1)
    x = E.units(pa.array(clustered(rng, 1500, 24, 10, 0.1).tolist()))
    graph = W.build(x, E.hashes_of(np.arange(len(x))))
    for level in graph.links:
        for node, row in enumerate(level):
            row = row[row >= 0]
            assert len(set(row.tolist())) == len(row) and node not in row


def odd_rows():
    rng = np.random.default_rng(13)
    rows, k = [], 0
    for label in (1, 2):
        for v in clustered(rng, 500, 12, 25, 0.12).tolist():
            rows.append((k, v, label))
            k += 1
    hot = rows[0][1]
    rows += [(10_000 + j, hot, 1) for j in range(150)] + [(20_000, [2 * x for x in hot], 1), (20_001, hot, 2), (20_002, hot, None)]
    rows += [(30_000, None, 1), (30_001, [], 1), (30_002, [0.0] * 12, 1), (30_003, [float("nan")] + [1.0] * 11, 1), (30_004, [None] + [1.0] * 11, 1)]
    rows += [(30_005, [float("inf")] + [1.0] * 11, 1), (30_006, hot[:5], 1), (30_007, hot[:5], 1), (7, rows[7][1], 2), (7, rows[7][1], 1)]
    rows += [(None, hot, 1), (None, [1.0] + [0.0] * 11, 3), (40_000, [3e38] * 12, 4), (40_001, [1e-38] * 12, 4), (None, [0.0, -1.0], 5), (None, [-0.0, -1.0], 5)]
    return rows


def test_rows_equal_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, space string").repartition(5)
    got = E.near_duplicates(df, shard_rows=150, query_rows=90)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]), key=key)


def test_narrow_beams_are_widened_by_the_audit():
    rng = np.random.default_rng(4)
    x = E.units(pa.array(clustered(rng, 800, 32, 8, 0.12).tolist()))
    graph = W.build(x, E.hashes_of(np.arange(len(x))))
    graph.links[0][:] = -1  # no way from one vector to another: only the widest beam finds anything
    assert E.audited_width(graph, x, x[:40], 4, 0.93) == len(x)
    assert sum(len(q) for q, _ in E.linked(graph, x, x[:40], len(x), 0.93)) == (x[:40] @ x.T >= 0.93).sum()


def test_forest_joins_runs_of_links():
    f = E.Forest(9)
    f.add(np.array([5, 7]), np.array([6, 8]))
    f.add(np.array([8, 1]), np.array([5, 1]))
    assert f.root.tolist() == [0, 1, 2, 3, 4, 5, 5, 5, 5]


def test_join_to_one_with_a_hot_key(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id) key").unionByName(spark.sql("select -1L id, cast(null as bigint) key"))
    one = spark.range(0, 1000, 2).selectExpr("id key", "id * 10 value")
    got = {(r["id"], r["value"]) for r in join_to_one(rows, one, ["key"], share=10).collect()}
    assert got == {(i, (0 if i % 3 == 0 else i) * 10) for i in range(1000) if i % 3 == 0 or i % 2 == 0}


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    one = spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<double>, label string")
    assert [tuple(r) for r in E.near_duplicates(one).collect()] == [(1, 0, 1, True)]
