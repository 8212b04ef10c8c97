from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import op_alignment as A
from wardline.llm import pieces as P
from wardline.llm.words import chunks

AWKWARD = [
    None, "", " ", "  a", "a  ", "a \n b", "it's we'll, I'm", "\t\tx\t y", "tail \n", "x\x85y \xa0 z", "a b 　c", "crlf;\r\n{\r\n}", "a\x00b", "<s> </s> <unk>",
    "<|endoftext|> plain <|endoftext|>", "日本語 text\r\nnext", "é" * 50, "word " * 3000, "a▁b", "▁", "1234 5678  90", "\n\n\n", "ß ﬁ ½ ² x", "naïve, café.", "<0x41>",
    "é ́x", "“quoted” — dash… end", "🙂🙂 🙂", "a  b", "a  b", "über; größer: weiß!",
]


def brute_tokens(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = A.tokenizer_paths()
    tok, sp = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    tok.encode_special_tokens = True
    alphabet = A.byte_alphabet()
    out = []
    for text in texts:
        if not text:
            out.append(([], [], [], []))
            continue
        e = tok.encode(" " + text, add_special_tokens=False)
        a_bytes = [bytes(alphabet[c] for c in t) for t in e.tokens]
        ids = sp.encode(text)
        b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in [sp.id_to_piece(i)]]
        whole = (" " + text).encode()
        out.append((e.ids, ids, a_bytes, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else ([], [], [], []))
    return out


def brute(rows):
    tokens, docs, counts = brute_tokens([t for _, t in rows]), [], Counter()
    for a, b, ab, bb in tokens:
        a_end, b_end = np.cumsum([0, *map(len, ab)]), np.cumsum([0, *map(len, bb)])
        links = [(i, j) for i in range(len(a)) for j in range(max(0, int(np.searchsorted(b_end, a_end[i])) - 1), len(b)) if b_end[j] < a_end[i + 1] and b_end[j + 1] > a_end[i]] if len(a) < 400 else None
        if links is None:
            links, j0 = [], 0
            for i in range(len(a)):
                while b_end[j0 + 1] <= a_end[i]:
                    j0 += 1
                j = j0
                while j < len(b) and b_end[j] < a_end[i + 1]:
                    links.append((i, j))
                    j += 1
        common = sorted(set(a_end[1:].tolist()) & set(b_end[1:].tolist()))
        groups, pa_, pb_ = [], 0, 0
        for end in common:
            na, nb = int(np.searchsorted(a_end[1:], end)) + 1, int(np.searchsorted(b_end[1:], end)) + 1
            groups.append(",".join(map(str, a[pa_:na])) + "|" + ",".join(map(str, b[pb_:nb])))
            pa_, pb_ = na, nb
        docs.append((a, b, groups, links))
        counts.update((b[j], a[i]) for i, j in links)
    top = {}
    for (b, _), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (doc_id, _), (a, b, groups, links) in zip(rows, docs):
        got = [counts[b[j], a[i]] for i, j in links]
        best = sum(n == top[b[j]] for n, (_, j) in zip(got, links))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(got), digest))
    return out


def corpus():
    rnd = random.Random(12)
    alphabet = list("ab'sT1 2.,!;:?é\n\t\r\x0b\x85\xa0 　éß½日🙂“”") + [" "] * 8
    texts = AWKWARD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(400)]
    words = ["the", "antidisestablishment", "Straße", "don't", "x1", "naïveté", "(see", "fig.", "3)", "12,5", "http://a.b/c?d=e"]
    texts += [" ".join(rnd.choices(words, k=rnd.randint(1, 60))) for _ in range(100)]
    texts.append(" ".join(rnd.choices(words, k=30_000)))
    return [(k, t) for k, t in enumerate(texts)] + [(7, texts[-2]), (7, texts[-2]), (None, texts[-3]), (None, None)]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot_pairs", [1 << 20, 40])
def test_documents_equal_brute_force(spark, hot_pairs):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, codes int").repartition(5)
    got = [tuple(r) for r in A.alignment(df, *A.tokenizer_paths(), hot_pairs=hot_pairs).select(*NAMES).collect()]
    key = lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_groups_and_links_of_each_document(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 200]
    got = {r["doc_id"]: r for r in A.aligned(spark.createDataFrame(rows, "doc_id long, text string"), *A.tokenizer_paths()).collect()}
    for (doc_id, _), (a, b, ab, bb) in zip(rows, brute_tokens([t for _, t in rows])):
        a_end, b_end = np.cumsum([0, *map(len, ab)]), np.cumsum([0, *map(len, bb)])
        r = got[doc_id]
        if doc_id != 7:
            assert (r["a_ids"], r["b_ids"]) == (a, b)
            assert [(x["a"], x["b"]) for x in r["links"]] == [(i, j) for i in range(len(a)) for j in range(len(b)) if b_end[j] < a_end[i + 1] and b_end[j + 1] > a_end[i]] or len(a) > 300
            assert all(a_end[x["a"]] == b_end[x["b"]] for x in r["groups"])


def test_gallop_finds_what_a_plain_search_finds():
    rng = np.random.default_rng(3)
    for sizes in ([1], [5, 1, 40], [3000, 2, 33, 1100], [70_000]):
        runs, longs, base = [], [], 0
        for n in sizes:
            universe = base + np.cumsum(rng.integers(1, 9, 4 * n))
            short = np.sort(rng.choice(universe, n, replace=False))
            short[-1] = universe[-1]
            longs.append(np.unique(np.append(rng.choice(universe, 3 * n), universe[-1])))
            runs.append(np.unique(short))
            base = int(universe[-1])
        first, l_first = (np.append(0, np.cumsum([len(x) for x in y])) for y in (runs, longs))
        needles, ends = np.concatenate(runs), np.concatenate(longs)
        assert (A.gallop(needles, first, ends, l_first) == np.searchsorted(ends, needles)).all()


def test_a_model_that_spans_cuts_gets_whole_texts(monkeypatch):
    assert P.spans_cuts(["a", "b▁c"]) and P.spans_cuts(["a,"]) and not P.spans_cuts(["▁▁", "▁a", "1,", "\n\n"])
    texts = [(k, t) for k, t in enumerate(AWKWARD)]
    pair = A.TokenizerPair(*A.tokenizer_paths())
    assert pair.cuttable
    spaced = pa.array([" " + t if t else "" for _, t in texts], pa.large_string())
    _, _, data, offsets = next(chunks(spaced))
    one = A.align(pair, data, offsets)
    pair.cuttable = False
    pair.book.clear()
    two = A.align(pair, data, offsets)
    assert all((getattr(one, f) == getattr(two, f)).all() for f in ("a_ids", "b_ids", "a_first", "b_first", "a_cut", "b_cut"))


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "CACHED_PIECES", 50)
    pair = A.TokenizerPair(*A.tokenizer_paths())
    for k in range(10):
        texts = [f" w{k}x{j} shared" for j in range(30)]
        _, _, data, offsets = next(chunks(pa.array(texts)))
        x = A.align(pair, data, offsets)
        expected = brute_tokens([t[1:] for t in texts])
        assert x.a_ids.tolist() == [i for r in expected for i in r[0]] and x.b_ids.tolist() == [i for r in expected for i in r[1]]
        assert len(pair.book.places) <= 130


def test_empty_table(spark):
    assert A.alignment(spark.createDataFrame([], "doc_id long, text string"), *A.tokenizer_paths()).count() == 0
