from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from wardline.llm import op_filter_audit as A


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs),
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r[1:] for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[0] for r in mine) - len(gone), sum(r[0] == {f} for r in mine),
                    sum(r[1] for r in gone), sum(r[2] for r in gone), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]] if isinstance(row[-1], str) else row[-1]
    return {k: tuple(v) for k, v in out.items()}


def shown(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 31, 1000, 4097])
def test_popcount_equals_a_count_per_bit(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    expected = [int((words >> np.uint32(k) & np.uint32(1)).sum()) for k in range(32)]
    assert A.positional_popcount(words).tolist() == expected


def test_survival_words():
    assert A.SURVIVAL[0] == 0xFFFFFFFF and A.SURVIVAL[31] == 1
    for failed in range(32):
        assert [bool(A.SURVIVAL[failed] >> s & 1) for s in range(32)] == [not s & failed for s in range(32)]


def corpus():
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(500)] + ["Aa", "ß", "日本", "X"]
    texts = [" ".join(rnd.choices(words[: rnd.choice([40, 504])], k=rnd.choice([3, 199, 200, 260]))) + rnd.choice(["", "", " #", " |"]) for _ in range(60)]
    texts += [None, "", " \n", "CAPS " * 300, "a " * 250, "A\x0bB\x0cC", "é" * 400, "tail\x00nul", "long text " * 60_000]
    docs = [(k, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for k in range(240)]
    docs += [(None, texts[0], "en"), (None, texts[0], None), (5, docs[5][1], "de"), docs[6], docs[6], (1000, "é", "xx")]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(0, 240, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = corpus()
    rows = [(*d, "x", True, 1) for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, first boolean, failed int").repartition(5)
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, good string")
    assert shown(A.audit(df, known)) == brute(docs, labels)


def test_counts_sent_early_are_the_same(spark, monkeypatch):
    docs, labels = corpus()
    rows = A.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows]) for c in ("part", "failed", "good", "toxic")], names=["part", "failed", "good", "toxic"])
    batch = batch.set_column(1, "failed", batch.column(1).cast(pa.int32()))

    def total():
        out = Counter()
        for b in A._count(iter([batch.slice(0, 100), batch.slice(100)])):
            for r in b.to_pylist():
                out.update({(r["part"], r["subset"], c): r[c] for c in ("kept", "good", "toxic")})
        return out

    whole = total()
    monkeypatch.setattr(A, "HELD_PARTS", 1)
    assert total() == whole


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    got = shown(A.audit(one, labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
