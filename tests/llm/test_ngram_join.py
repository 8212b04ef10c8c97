from __future__ import annotations

import random
import re

import numpy as np
import pytest

from wardline.llm import components as C
from wardline.llm import op_ngram_join as J
from wardline.llm.components import components
from wardline.sources.tables import stored


def brute(rows, n=3, num=9, den=10):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.setdefault(doc_id, []).append(grams)
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            for s in sets[ids[a]]:
                for t in sets[ids[b]]:
                    k = len(s & t)
                    if k and k * den >= num * (len(s) + len(t) - k):
                        x, y = find(ids[a]), find(ids[b])
                        root[max(x, y)] = min(x, y)
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else -1) for i, ss in sets.items() for s in ss)


def result(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, key string, n long")
    got = J.link_classes(docs, **kw).collect()
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got)


def cloud(rnd, base, steps, first_id):
    """A chain of texts, each with a word of the last one changed, and strays further away."""
    rows, now = [], list(base)
    for k in range(steps):
        now = list(now)
        for _ in range(rnd.choice([1, 1, 1, 4])):
            now[rnd.randrange(len(now))] = f"w{rnd.randrange(10**6)}"
        rows.append((first_id + k, " ".join(now)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_classes_as_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    common = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows, at = [], 0
    for size in (4, 8, 12, 13, 19, 20, 30, 45, 60, 90, 140, 300):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        part = cloud(rnd, base, 14, at)
        at += len(part)
        rows += part
    rows += [(at + k, common + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 40])))) for k in range(40)]
    at += 40
    rows += [(at + k, rows[7 * k][1].upper() if k % 2 else rows[7 * k][1] + "\n") for k in range(12)]
    at += 12
    rows += [(at, None), (at + 1, ""), (at + 2, " \t "), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "one two"), (None, "one two"), (at + 6, "é É")]
    rnd.shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_chain_of_small_steps_is_one_class(spark):
    rnd = random.Random(9)
    rows = cloud(rnd, [f"b{k}" for k in range(120)], 60, 100)
    assert result(spark, rows) == brute(rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (9, "a b c d e"), (7, "x y z")]
    assert result(spark, rows) == [(5, 3, 5), (5, 3, 5), (7, 1, 7), (9, 3, 5)]


def test_other_threshold_and_length(spark):
    rnd = random.Random(4)
    rows = cloud(rnd, [f"b{k}" for k in range(50)], 40, 0)
    assert result(spark, rows, n=5, num=8, den=10) == brute(rows, 5, 8, 10)


def test_empty_table(spark):
    assert result(spark, []) == []


def first_keys(s, at, classes):
    """The keys that suffice, the lowest first: any order that both sets share will do."""
    posted = [J.postings(s, a, classes.difference(a)) for a in at if classes.difference(a)]
    return {int(v) for keys, _, enough in posted for v in np.sort(keys)[:enough]}


def test_linking_sets_share_a_posting_key():
    rng = np.random.default_rng(3)
    classes = J.Classes()
    for _ in range(3000):
        n = int(rng.integers(10, 150))
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        drop, add = rng.integers(0, n // 15 + 2, 2)
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 64, add, dtype=np.uint64)]))
        k = len(np.intersect1d(x, y))
        if k * 10 < 9 * (len(x) + len(y) - k) or k == len(x) == len(y):
            continue
        keys = []
        for s in (x, y):
            c = classes.of(len(s))
            at = [c, c + 1] if classes.next_too(len(s), c) else [c]
            keys.append(first_keys(s, at, classes))
        assert keys[0] & keys[1]


def test_linking_sets_share_a_key_at_a_low_threshold_without_many_keys():
    rng = np.random.default_rng(4)
    classes = J.Classes(4, 5)
    for n in [*rng.integers(10, 400, 1500).tolist(), 20_000]:
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        drop, add = rng.integers(0, n // 7 + 2, 2)
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 64, add, dtype=np.uint64)]))
        k, keys = len(np.intersect1d(x, y)), []
        for s in (x, y):
            c = classes.of(len(s))
            at = [c, c + 1] if classes.next_too(len(s), c) else [c]
            keys.append(first_keys(s, at, classes))
        if k * 5 >= 4 * (len(x) + len(y) - k) and k != max(len(x), len(y)):
            assert keys[0] & keys[1]
        assert n < 400 or max(map(len, keys)) < 2 * n


def test_components_of_a_long_path(spark):
    links = spark.range(300).selectExpr("id x", "id + 1 y")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert len(got) == 301 and set(got.values()) == {0}


@pytest.mark.parametrize("kept", [False, True])
def test_components_of_a_random_graph_end_with_the_first_stars(spark, kept, monkeypatch):
    rnd = random.Random(21)
    edges = [(a, rnd.randrange(a)) for a in range(1, 300) if rnd.random() < 0.9] + [(rnd.randrange(300), rnd.randrange(300)) for _ in range(5)]
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]] + [(7, 7), (999, 999)]
    root = {i: i for e in edges for i in e}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    links = spark.createDataFrame(edges, "x long, y long")
    got = {r["node"]: r["component"] for r in components(links, kept).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}
    rounds = []
    monkeypatch.setattr(C, "stored", lambda df, name="stage": rounds.append(name) or stored(df, name))
    star = spark.createDataFrame([(5, i) for i in range(6, 60)], "x long, y long")
    assert {r["component"] for r in components(star, kept).collect()} == {5} and len(rounds) == 2 - kept
    assert components(star.where("false"), kept).count() == 0


def test_ids_beyond_a_broadcast_are_joined(spark, monkeypatch):
    rnd = random.Random(22)
    base = [f"b{k}" for k in range(60)]
    rows = cloud(rnd, base, 40, 0) + cloud(rnd, base, 40, 100)
    monkeypatch.setattr(J, "BROADCAST_IDS", -1)
    assert result(spark, rows) == brute(rows)
