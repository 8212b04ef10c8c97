from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import automaton as A
from wardline.llm import op_toxicity as T
from wardline.llm.sampling import crc_class

SF = "/root/testdata/sf0.1"


def edits(a, b):
    """Edit distance with exchanges of neighbours (each place edited once)."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def run(auto, words):
    text = " ".join(words)
    chars = np.array([ord(c) for c in text], np.uint32)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    return auto.run(chars, starts, starts + np.array([len(w) for w in words])).tolist()


def test_automaton_is_the_edit_distance():
    rnd = random.Random(1)
    lexicon = ["idiot", "scum", "worthless", "clown", "lowei*", "böse*"]
    auto = A.build(lexicon)
    words = ["idiot", "idoit", "idiots", "idxiot", "iddiot", "idot", "scun", "scum", "wortless", "worthles", "wortles", "loweischaft", "lowe", "böses", "bösen", "clonw", "clwon"]
    for w in list(words):
        for _ in range(40):
            x = list(w)
            for _ in range(rnd.randint(1, 3)):
                k = rnd.randrange(len(x) + 1)
                rnd.choice([lambda: x.insert(k, rnd.choice("abcdiotz")), lambda: x.pop(k % len(x)) if len(x) > 1 else None, lambda: x.__setitem__(k % len(x), rnd.choice("idotwe"))])()
            words.append("".join(x))
    for w, got in zip(words, run(auto, words)):
        best = [0 for e in lexicon if e[-1] == "*" and w.startswith(e[:-1])]
        best += [k for e in lexicon if e[-1] != "*" for k in [edits(e, w)] if k <= A.allowed_edits(e)]
        assert got == min(best, default=-1), w


def test_quotation_and_context_are_told_apart():
    auto = A.build(["idiot", "scum"])
    f = T.features(pa.array(['You IDIOT, you scum!', 'He said "idiot" to them. They left.', "idiot " + "w " * 30 + "scum", "idiott", "", None]), auto)
    names = dict(zip(T.FEATURES, np.rint(np.expm1(f[:, :4])).T.tolist()))
    assert names == {"plain_exact": [2, 0, 2, 0, 0, 0], "plain_misspelled": [0, 0, 0, 1, 0, 0], "quoted": [0, 1, 0, 0, 0, 0], "clustered": [2, 0, 0, 0, 0, 0]}


def test_held_out_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = T.op8(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    usable = crc_class("doc_id", 5) != 0
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(usable, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = T.fit(docs, labels, usable), T.fit(docs, turned, usable)
    assert a.entries == b.entries and np.allclose(a.weights, b.weights)


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "x " * 200_000, 1), (None, "text", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    scores = [r["score"] for r in T.scored(docs, model).collect()]
    assert len(scores) == 4 and all(s == pytest.approx(1, abs=1e-6) for s in scores)  # only toxic labels
    empty = T.fit(docs, labels.where("false"))
    assert all(r["score"] < 1e-6 for r in T.scored(docs, empty).collect())
    assert T.passing(docs, empty).columns == docs.columns and T.passing(docs, empty).count() == 4
    assert T.scored(docs.where("false"), empty).count() == 0
