from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from wardline.llm import op_tokens as T
from wardline.llm import pieces as P


def brute(texts, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


AWKWARD = [
    "", None, " ", "  a", "a  ", "a \n b", "it's we'll  I'm", "\t\tx\t y", "tail \n", "x\x85y \xa0 z", "a b 　c", "a\x1cb !\x1c c",
    "<|endoftext|> plain", "a <|endoftext|> b", "a  <|endoftext|>,<|endoftext|>\n x<|endoftext|>y", "日本語 text\r\nnext", "é" * 50, "word " * 3000, "a​ b", "1234 5678  90", "\n\n\n", "ß ﬁ ½ ² x",
]


def test_pieces_give_the_ids_of_the_whole_text():
    path = T.tokenizer_path()
    rnd = random.Random(5)
    alphabet = list("ab'sT1 2.,!;:?é\n\t\r\x0b\x0c\x1c\x1d\x85\xa0    ​   　éß½日퟿") + [" "] * 8
    texts = AWKWARD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    got = T.Encoder(path).encode(texts)
    assert [list(g) + [0] for g in got] == brute(texts, path)


def test_encoder_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "CACHED_PIECES", 50)
    path = T.tokenizer_path()
    enc = T.Encoder(path)
    for k in range(20):
        texts = [f" w{k}x{j} shared" for j in range(30)]
        assert [list(g) + [0] for g in enc.encode(texts)] == brute(texts, path)
        assert len(enc.book.places) <= 190


@pytest.mark.parametrize("top", [1, 200, 256, 50_257, 1 << 24, 1 << 32])
def test_codes_round_trip_and_single_access(top):
    rng = np.random.default_rng(top)
    for n in (1, 7, 511, 512, 513, 5000):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        chunks, bitmaps, ranks = T.pack(ids)
        assert (T.unpack(chunks, bitmaps) == ids).all()
        for at in {0, n - 1, n // 2, *rng.integers(0, n, 40).tolist()}:
            assert T.access(chunks, bitmaps, ranks, at) == ids[at]
    with pytest.raises(IndexError):
        T.access(chunks, bitmaps, ranks, n)


def test_file_round_trip_with_odd_rows(spark, tmp_path):
    rows = [(k * 3 % 41, t, "x", 1) for k, t in enumerate(AWKWARD)] + [(7, "same id", "y", 2), (7, "same id", "y", 2), (None, "no id", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, start int")
    path, folder = T.tokenizer_path(), str(tmp_path / "tokens")
    T.write_tokens(docs, folder, path)
    order = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, before, flat = [], 0, []
    for (doc_id, _), ids in zip(order, brute([t for _, t in order], path)):
        expected.append((doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
        flat += ids
    got = [tuple(r) for r in T.read_documents(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    with_ids = T.read_documents(spark, folder, with_ids=True).orderBy("start").collect()
    assert [i for r in with_ids for i in r["ids"]] == flat
    wanted = [0, 5, len(flat) // 2, len(flat) - 1, len(flat), -1]
    found = T.tokens_at(spark, folder, spark.createDataFrame([(p,) for p in wanted], "pos long")).collect()
    assert {r["pos"]: r["id"] for r in found} == {p: flat[p] for p in wanted[:4]}


def test_small_segments_keep_global_order(spark, tmp_path):
    docs = spark.range(500).selectExpr("id doc_id", "repeat(concat('w', id, ' '), int(id % 40)) text").repartition(7)
    folder = str(tmp_path / "tokens")
    T.segments(docs, T.tokenizer_path(), segment_tokens=100).write.parquet(folder)
    assert T.read_segments(spark, folder).count() > 20
    rows = T.read_documents(spark, folder).orderBy("doc_id").collect()
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = str(tmp_path / "tokens")
    T.write_tokens(docs, folder, T.tokenizer_path())
    assert T.read_documents(spark, folder).count() == 0
