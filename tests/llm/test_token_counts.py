from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wardline.llm import op_token_counts as C
from wardline.llm.op_tokens import tokenizer_path

CHANGES = "before struct<source:string,lang:string,tokenizer:string,n_tokens:long>, after struct<source:string,lang:string,tokenizer:string,n_tokens:long>, extra int"


def changes(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], CHANGES)


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_inserts_deletes_revisions_and_repeated_commits(spark, tmp_path):
    r = C.Rollup(spark, str(tmp_path / "rollup"))
    assert r.totals().count() == 0
    a, b, null = ("s", "en", "v1", 10), ("s", "de", "v1", 7), (None, None, "v1", None)
    assert r.commit("one", changes(spark, [(None, a), (None, a), (None, b), (None, null)]))
    assert r.commit("two", changes(spark, [(a, None), (b, ("s", "de", "v2", 9)), (None, None)]))
    expected = {("s", "en", "v1"): (1, 10), ("s", "de", "v2"): (1, 9), (None, None, "v1"): (1, 0)}
    assert totals(r) == expected
    assert not r.commit("two", changes(spark, [(a, None)])) and totals(r) == expected
    assert r.batches() == ["one", "two"]
    folded = r.compact(str(tmp_path / "folded"))
    assert totals(folded) == expected and not folded.commit("one", changes(spark, [(None, a)]))
    assert folded.commit("three", changes(spark, [(a, None)])) and ("s", "en", "v1") not in totals(folded)


def test_an_unfinished_batch_does_not_count_and_can_be_written_anew(spark, tmp_path):
    r = C.Rollup(spark, str(tmp_path / "rollup"))
    one = changes(spark, [(None, ("s", "en", "v1", 10))])
    r.commit("one", one)
    C.deltas(one).write.parquet(f"{r.folder}/batch=two")
    (tmp_path / "rollup" / "batch=two" / "_SUCCESS").unlink()
    assert totals(r) == {("s", "en", "v1"): (1, 10)}
    assert r.commit("two", one) and totals(r) == {("s", "en", "v1"): (2, 20)}
    with pytest.raises(ValueError):
        r.commit("a/b", one)


def test_query_equals_a_count_from_scratch(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    expected, seen = {}, set()
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        if r["text"] in seen:
            continue
        seen.add(r["text"])
        n, version = len(tok.encode(r["text"] or "", add_special_tokens=False).ids), "v1" if r["lang"] == "en" else "v2"
        key = (r["source"], r["lang"], f"byte_bpe_50k.{version}")
        d, t = expected.get(key, (0, 0))
        expected[key] = (d + 1, t + n + (version == "v2"))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in C.op1(spark, sf).collect()}
    assert got == expected


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "s", "en", 3), (2, "", "s", None, 3), (None, "two words", None, "en", 3)], "doc_id long, text string, source string, lang string, n_tokens long")
    assert sorted(r["n_tokens"] for r in C.counted(docs, tokenizer_path()).collect()) == [0, 0, 2]
    assert C.counted(docs.where("false"), tokenizer_path()).count() == 0
