"""Hierarchical navigable small-world graphs over one shard of unit vectors, built and searched for many vectors at once.

Every vector lies on level 0, one in ``LINKS`` of them also on level 1, and so on. Vectors are inserted from the highest
level down, in batches that never outgrow what is inserted already: the batch is searched in the graph, its own members
are compared with each other, and each vector is linked to candidates that are nearer to it than to one another, so that
links also lead out of dense groups. Back links are kept by the same rule.

A search keeps, per query, a beam of the nearest vectors seen; it opens the nearest unopened ones until none is left. A
beam as wide as the shard starts from every vector, which makes it exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links that a new vector gets per level; level 0 keeps twice as many.
LINKS = 16
#: Width of the beam while building, and vectors inserted at once.
BUILD_BEAM, BATCH = 64, 256
#: Entries passed from one level to the next.
ENTRIES = 8
#: Numbers of the gathered neighbours' vectors held at a time.
GATHERED = 1 << 22


@dataclass
class Graph:
    vectors: np.ndarray  # float32 unit vectors
    links: list[np.ndarray]  # per level: (n, links) places, -1 where there is none; only rows on that level are used
    entry: int

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(x, "<i4").tobytes() for x in self.links]

    @classmethod
    def unpack(cls, vectors: np.ndarray, links: list[bytes], entry: int) -> "Graph":
        return cls(vectors.astype(np.float32), [np.frombuffer(x, "<i4").reshape(len(vectors), -1) for x in links], entry)


def levels_of(hashes: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Level of each vector from its hash: level k or more with probability ``links`` ** -k."""
    share = ((hashes >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.floor(-np.log(share) / np.log(links)).astype(np.int64)


def _merge(ids: np.ndarray, sims: np.ndarray, opened: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``width`` nearest of each row, nearest first."""
    if ids.shape[1] > width:
        top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims, opened = (np.take_along_axis(x, top, 1) for x in (ids, sims, opened))
    order = np.argsort(-sims, axis=1, kind="stable")
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, sims, opened))


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of the ``width`` nearest vectors met per query, nearest first; -1 and -inf where there are fewer."""
    n, q = len(vectors), len(queries)
    steps = max(4, width // 16)
    if entries.shape[1] >= n:
        sims = queries @ vectors.T
        ids = np.broadcast_to(np.arange(n), sims.shape)
        ids, sims, _ = _merge(ids, sims, np.zeros(sims.shape, bool), width)
        return ids, sims
    seen = np.zeros((q, n + 1), bool)  # the last column stands for no vector
    seen[:, n] = True
    rows = np.arange(q)[:, None]
    near = np.sort(np.where(entries < 0, n, entries), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = n
    sims = np.where(near < n, np.einsum("qed,qd->qe", vectors[np.minimum(near, n - 1)], queries), -np.inf).astype(np.float32)
    seen[rows, near] = True
    pad = max(0, width - near.shape[1])
    ids = np.pad(near, ((0, 0), (0, pad)), constant_values=n)
    sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
    ids, sims, opened = _merge(ids, sims, ids == n, width)
    going = np.arange(q)
    while len(going):
        mine = np.where(opened[going], -np.inf, sims[going])
        k = min(steps, width)
        pick = np.argpartition(-mine, k - 1, axis=1)[:, :k] if k < width else np.broadcast_to(np.arange(width), mine.shape)
        live = np.take_along_axis(mine, pick, 1) > -np.inf
        some = live.any(1)
        going, pick, live = going[some], pick[some], live[some]
        if not len(going):
            break
        at = going[:, None]
        from_ids = np.where(live, ids[at, pick], n)
        opened[at, pick] = True
        near = links[np.minimum(from_ids, n - 1)]
        near = np.where((near < 0) | (from_ids == n)[:, :, None], n, near).reshape(len(going), -1)
        near[seen[at, near]] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        used = int((near < n).sum(1).max())  # the unused ones sort last, but for repeated ones in between
        near.sort(axis=1)
        near = near[:, :used]
        if not used:
            continue
        seen[at, near] = True
        new = np.where(near < n, np.matmul(vectors[np.minimum(near, n - 1)], queries[going][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        ids[going], sims[going], opened[going] = _merge(
            np.concatenate([ids[going], near], 1), np.concatenate([sims[going], new], 1), np.concatenate([opened[going], near == n], 1), width
        )
    return np.where(ids == n, -1, ids), sims


def _choose(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """At most ``keep`` of each row's candidates (nearest first): those nearer to the row's vector than to any chosen one, then the nearest others."""
    valid = ids >= 0
    group = vectors[np.maximum(ids, 0)]
    between = np.matmul(group, group.transpose(0, 2, 1))
    chosen, count = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
    nearest = np.full(ids.shape, -np.inf, np.float32)
    for c in range(ids.shape[1]):
        ok = valid[:, c] & (sims[:, c] > nearest[:, c]) & (count < keep)
        chosen[ok, c] = True
        count += ok
        nearest[ok] = np.maximum(nearest[ok], between[ok, c])
    order = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def _link_back(vectors: np.ndarray, links: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Add the links target to source; a full list keeps what ``_choose`` takes."""
    room = links.shape[1]
    sims = np.einsum("nd,nd->n", vectors[sources], vectors[targets])
    order = np.lexsort((-sims, targets))
    sources, targets = sources[order], targets[order]
    nodes, first, counts = np.unique(targets, return_index=True, return_counts=True)
    place = np.arange(len(targets)) - np.repeat(first, counts)
    near = place < room  # of very many new neighbours the nearest
    sources, row, place, counts = sources[near], np.repeat(np.arange(len(nodes)), counts)[near], place[near], np.minimum(counts, room)
    new = np.full((len(nodes), int(counts.max())), -1, np.int64)
    new[row, place] = sources
    held = (links[nodes] >= 0).sum(1)
    fits = held + counts <= room
    inside = fits[row]
    links[nodes[row[inside]], held[row[inside]] + place[inside]] = sources[inside]
    for at in np.array_split(np.flatnonzero(~fits), max(1, -(-int((~fits).sum()) // 512))):
        if not len(at):
            continue
        ids = np.concatenate([links[nodes[at]], new[at]], 1)
        near_sims = np.where(ids >= 0, np.matmul(vectors[np.maximum(ids, 0)], vectors[nodes[at]][:, :, None])[:, :, 0], -np.inf)
        ids, near_sims, _ = _merge(ids, near_sims, ids < 0, ids.shape[1])
        links[nodes[at]] = _choose(vectors, ids, near_sims, room)


def build(vectors: np.ndarray, hashes: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
    """The graph of unit vectors; ``hashes`` (one per vector) decide levels and order, so a repeated task builds the same graph."""
    vectors = np.ascontiguousarray(vectors, np.float32)
    n, level = len(vectors), levels_of(hashes, links)
    order = np.lexsort((hashes, -level))
    top = int(level[order[0]])
    graph = Graph(vectors, [np.full((n, links * (1 + (k == 0))), -1, np.int32) for k in range(top + 1)], int(order[0]))
    done = 1
    while done < n:
        batch = order[done : done + min(BATCH, done)]
        queries = vectors[batch]
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        entries = np.full((len(batch), 1), graph.entry)
        for k in range(top, -1, -1):
            here = level[batch] >= k
            ids, sims = beam_search(vectors, graph.links[k], queries, entries, beam if here.any() else ENTRIES)
            entries = ids[:, :ENTRIES]
            if not here.any():
                continue
            mates = np.where(here[None, :], among, -np.inf)[here]
            new_ids, new_sims, _ = _merge(
                np.concatenate([ids[here], np.where(mates > -np.inf, batch[None, :], -1)], 1), np.concatenate([sims[here], mates], 1),
                np.zeros((int(here.sum()), ids.shape[1] + len(batch)), bool), beam,
            )
            chosen = _choose(vectors, new_ids, new_sims, links)
            mine = batch[here]
            graph.links[k][mine, :links] = chosen
            row, column = np.nonzero(chosen >= 0)
            to = chosen[row, column]
            mutual = np.zeros(n, np.int64) - 1  # two new vectors that chose each other are linked already
            mutual[mine] = np.arange(len(mine))
            other = mutual[to]
            both = (other >= 0) & (chosen[np.maximum(other, 0)] == mine[row][:, None]).any(1)
            if (~both).any():
                _link_back(vectors, graph.links[k], mine[row][~both], to[~both])
        done += len(batch)
    return graph


def search(graph: Graph, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities in single precision) of the nearest vectors found, ``width`` per query."""
    n = len(graph.vectors)
    if width >= n:
        return beam_search(graph.vectors, graph.links[0], queries, np.broadcast_to(np.arange(n), (len(queries), n)), n)
    entries = np.full((len(queries), 1), graph.entry)
    for k in range(len(graph.links) - 1, 0, -1):
        entries = beam_search(graph.vectors, graph.links[k], queries, entries, ENTRIES)[0]
    return beam_search(graph.vectors, graph.links[0], queries, entries, width)


def search_rows(n: int, dim: int, width: int, links: int = 2 * LINKS) -> int:
    """Queries that can be searched at once within ``GATHERED`` numbers."""
    return max(1, min(1024, GATHERED // max(1, max(4, width // 16) * links * dim if width < n else n)))
