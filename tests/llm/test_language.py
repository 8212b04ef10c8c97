from __future__ import annotations

import numpy as np
import pyarrow as pa

from wardline.llm import op_language as L

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = L.op3(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_slots_are_the_grams_of_the_folded_text():
    a, b, c, none, null = (set(s.tolist()) for s in L.slots_of(pa.array(["Ab, c!", "ab c", "ab  \n c 12", "12 ;", None])))
    assert a == b == c and none == null == set()
    assert len(a) == len({p for n in range(1, 5) for p in [" ab c "[i : i + n] for i in range(7 - n)]})


def test_letters_above_the_basic_plane():
    emoji, digits, gothic, deseret, small = (set(s.tolist()) for s in L.slots_of(pa.array(["😀😀", "𝟙𝟚 😀 123", "a 𐌰𐌱", "𐐀😀𐐁", "𐐨 𐐩"])))
    assert emoji == digits == set() and gothic and deseret == small != set()
    # by hand: all n-grams of the folded text, n from 1 to 4
    assert len(gothic) == len({p for n in range(1, 5) for p in [" a 𐌰𐌱 "[i : i + n] for i in range(7 - n)]})


def test_kernel_blocks_equal_single_kernels():
    slots = [s for s in L.slots_of(pa.array(["one text here", "another text", "und noch einer", ""]))]
    used = np.unique(np.concatenate(slots))
    column = np.full(L.SLOTS, -1, np.int32)
    column[used] = np.arange(len(used))
    table = np.zeros((len(used), 3), np.float32)
    for j, s in enumerate(slots[:3]):
        table[column[s], j] = 1 / np.sqrt(len(s))
    got = L.block_kernels(slots, column, table)
    for i, s in enumerate(slots):
        for j, t in enumerate(slots[:3]):
            expected = len(np.intersect1d(s, t)) / np.sqrt(max(len(s), 1) * len(t))
            assert abs(got[i, j] - expected) < 1e-5


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", 1), (2, "", "de", 1), (3, "12 34", "en", 1), (4, "hello there", "en", 1), (5, "guten tag", "de", 1), (5, "guten tag", "de", 1), (None, "hello", "en", 1), (6, "日本 語", None, 1), (7, "😀😀", None, 1), (8, "𝟙𝟚 😀 123", "en", 1)],
        "doc_id long, text string, lang string, score int",
    )
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in L.predicted(docs, L.fit(docs)).collect())
    assert got[1:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de")] and got[0] == (0, "en") and got[-2:] == [(7, "und"), (8, "und")] and len(got) == 10
    assert {r["lang_pred"] for r in L.predicted(docs, None).collect()} == {"und"}
    assert L.fit(docs.where("false")) is None
    assert L.predicted(docs.where("false"), None).count() == 0


def test_sample_is_bounded_per_language(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "'t' text", "case when id % 10 = 0 then 'a' when id < 40 then 'b' else 'c' end lang")
    counts = {r["lang"]: r["count"] for r in L.sample_ids(docs, None, 50).groupBy("lang").count().collect()}
    assert counts == {"a": 50, "b": 36, "c": 50}
