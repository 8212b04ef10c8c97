from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.llm import op_decontamination as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    met |= wins[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((-1 if doc_id is None else doc_id, len(w), len(hit), len(met), digest, bool(hit)))
    return sorted(out)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog, and then some more words follow here."), (2, "Ünder the Ähren 42 öfter gehen wir."),
    (3, "single"), (4, "two Words"), (5, None), (6, ""), (7, "..."), (None, "a null item id has words too, as many as any other"),
    (1, "same item id, other text of ten words or even a little more"), (10, "two words"), (11, "go go go go go go go go go go go go"),
]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, n long"),
        spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string"),
    )


def sample():
    rnd = random.Random(3)
    texts = [t for _, t in ITEMS if t]
    docs = [(1, None), (2, ""), (3, "nothing to see"), (3, "nothing to see"), (None, ITEMS[0][1]), (4, "SINGLE; two\twords"), (5, "go " * 40), (6, "...")]
    for k in range(60):
        filler = [rnd.choice(["alpha", "the", "fox", "words", "single", "go", "É", "x1"]) for _ in range(rnd.randint(0, 60))]
        piece = words(rnd.choice(texts))
        low = rnd.randint(0, max(0, len(piece) - 1))
        at = rnd.randint(0, len(filler))
        filler[at:at] = piece[low if k % 3 else 0 :]
        docs.append((100 + k, rnd.choice([" ", ", ", "\n"]).join(filler)))
    return docs


@pytest.mark.parametrize("limit", [D.BROADCAST_WINDOWS, 0])
def test_report_equals_brute_force_with_and_without_broadcast(spark, limit, monkeypatch):
    monkeypatch.setattr(D.hits, "__defaults__", (D.WINDOW, limit))
    docs, bench = frames(spark, sample(), ITEMS)
    got = [(-1 if r["doc_id"] is None else r["doc_id"], *list(r)[1:]) for r in D.report(docs, bench).collect()]
    assert sorted(got) == brute(sample(), ITEMS)


def test_plan_is_native(spark):
    docs, bench = frames(spark, sample(), ITEMS[:1])
    plan = D.report(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_documents_and_spans_go(spark):
    docs, bench = frames(spark, [(1, "Keep this. " + ITEMS[0][1] + " And THIS, too!"), (2, "clean\ttext"), (None, None)], ITEMS[:1])
    assert sorted(str(r["text"]) for r in D.clean_documents(docs, bench).collect()) == ["None", "clean\ttext"]
    spans = {r["doc_id"]: r["text"] for r in D.clean_spans(docs, bench).collect()}
    assert (spans[2], spans[None]) == ("clean\ttext", None)
    assert words(spans[1]) == ["keep", "this", "and", "this", "too"] and spans[1].endswith("THIS, too!")
    assert D.clean_spans(docs, bench).columns == docs.columns


def test_empty_tables(spark):
    docs, bench = frames(spark, [(1, ITEMS[0][1])], ITEMS)
    none = bench.where("false")
    assert [tuple(r)[2:4] for r in D.report(docs, none).collect()] == [(0, 0)]
    assert D.report(docs.where("false"), bench).count() == 0
    assert D.clean_documents(docs, none).count() == 1
    assert docs.select(D.words(F.lit(None).cast("string"))).first()[0] == []


def test_own_columns_may_clash(spark):
    item = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"a {item} b", 7, "x"), (2, "plain", 8, "y")], "doc_id long, text string, Hit_Doc int, hit_starts string")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    clean = D.clean_spans(docs, bench)
    assert clean.columns == docs.columns and {r["text"]: r["hit_starts"] for r in clean.collect()} == {"a b": "x", "plain": "y"}
    assert D.with_hits(docs, bench).columns == [*docs.columns, "hit_starts_", "hit_items_"] and D.clean_documents(docs, bench).count() == 1
