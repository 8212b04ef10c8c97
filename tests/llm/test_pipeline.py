from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from wardline.llm import op_decontamination, op_ngram_join, op_toxicity
from wardline.llm import stages as stages_module
from wardline.llm.op_tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        from wardline.sources.tables import stored

        new = stored(stage(spark, docs, SF), name)
        out.append((name, docs, new))
        docs = new
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_in_order_keep_the_columns(stages, spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_id_output"]
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "token_id_output")


def test_toxic_documents_go(stages, spark):
    before, after = stages["toxicity"]
    model = op_toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == {r["doc_id"] for r in op_toxicity.scored(before, model).collect() if r["score"] < 0.5}


def test_one_of_each_group_stays(stages):
    from test_ngram_join import brute

    before, after = stages["ngram_jaccard_join"]
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    rule = (stages_module.NEAR_WORDS, stages_module.NEAR_NUM, stages_module.NEAR_DEN)
    assert ids(after) == {c for _, _, c in brute(rows, *rule)}
    assert all(r["doc_id"] == r["component_id"] for r in op_ngram_join.link_classes(after, *rule).collect())


def test_near_copies_are_those_of_five_words(spark):
    from test_ngram_join import brute

    base = [f"w{k}" for k in range(100)]
    longer = base + [f"x{k}" for k in range(18)]
    block = base[:40] + [f"y{k}" for k in range(5)] + base[45:]
    two = [*base[:20], "z1", *base[21:70], "z2", *base[71:]]
    far = base[:60] + [f"u{k}" for k in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate((base, longer, block, two, far))]
    after = ids(stages_module.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF))
    assert after == {0, 4} == {c for _, _, c in brute(rows, 5, 4, 5)}


def test_no_benchmark_window_is_left(stages, spark):
    before, after = stages["benchmark_decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert op_decontamination.report(after, bench).where("contaminated").count() == 0
    assert ids(before) - ids(after) == ids(op_decontamination.report(before, bench).where("contaminated"))


def test_token_file_holds_the_mixed_documents(stages):
    from tokenizers import Tokenizer

    before, after = stages["token_id_output"]
    tok = Tokenizer.from_file(tokenizer_path())
    expected, start = [], 0
    for r in before.orderBy("doc_id", "text").collect():
        tokens = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        expected.append((r["doc_id"], start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert [tuple(r) for r in after.orderBy("start").collect()] == expected


def test_pipeline_takes_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 60, "en", "s", 300), (3, "word " * 60, "en", "s", 300), (None, "no id", "en", None, 5)]
    for name, rows in (("odd", odd), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        found = corpus_pipeline.run(spark, d)
        assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert found.count() == (len(odd) if rows else 0)
