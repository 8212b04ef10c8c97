from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from wardline.llm import op_quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " ", "\n\n", "a", "a a a a", "x y z x y z", "x\ny\nx\n y\n\nx", "é# é* ñ|", "a\x0bb\x0cc\rd\te", "a b", "one two\none two\none two three", "<b> & <b> & <b>",
]


def test_counts_equal_brute_force():
    rnd = random.Random(1)
    texts = TEXTS + [rnd.choice(["", "\n"]).join(rnd.choice(["a ", "b ", "c\n", "ß ", "\t", "#", "dd "]) for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    texts.append("long word " * 300_000)
    got = Q.text_counts(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in Q.COUNTS) == brute(t), repr(t)[:200]


def test_chunks_do_not_mix_texts(monkeypatch):
    from wardline.llm import words as W

    monkeypatch.setattr(W.chunks, "__defaults__", (7,))
    got = Q.text_counts(pa.chunked_array([pa.array(TEXTS[:5]), pa.array(TEXTS[5:])]))
    assert [tuple(int(got[c][i]) for c in Q.COUNTS) for i in range(len(TEXTS))] == [brute(t) for t in TEXTS]


def hosts(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    rows = [(k, good if k % 10 else bad, "clean.org", 9) for k in range(200)] + [(1000 + k, bad if k % 10 else good, "spam.net", 9) for k in range(200)]
    rows += [(2000, bad, "tiny.com", 9), (2001, good, "tiny.com", 9), (3000, good, None, 9), (3001, None, None, 9), (None, good, "clean.org", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, host long")


def test_host_verdicts_are_joined_back(spark):
    rows = {r["doc_id"]: r for r in Q.judged(hosts(spark)).collect()}
    assert len(rows) == 406 - 1
    assert rows[1]["kept"] and not rows[0]["kept"] and rows[0]["base_failed"]
    assert not rows[1000]["kept"] and not rows[1000]["base_failed"]  # a good text of a bad host
    assert rows[2001]["kept"] and rows[2001]["host_rate"] < 0.5  # one failure of two is no evidence
    assert rows[3000]["kept"] and not rows[3001]["kept"] and rows[None]["kept"]


def test_prior_is_the_moments_of_the_rates(spark):
    table = spark.createDataFrame([("a", 100, 10), ("b", 300, 150), ("c", 100, 0)], "host string, texts long, failed long")
    mean, strength = Q.beta_prior(table)
    rates, n = [0.1, 0.5, 0.0], [100, 300, 100]
    m = sum(r * k for r, k in zip(rates, n)) / 500
    spread = sum(k * (r - m) ** 2 for r, k in zip(rates, n)) / 500 - m * (1 - m) * 3 / 500
    assert mean == pytest.approx(m) and strength == pytest.approx(max(1.0, m * (1 - m) / spread - 1))
    assert Q.beta_prior(table.where("false")) == (0.0, Q.MAX_STRENGTH)
    assert Q.beta_prior(spark.createDataFrame([("a", 10, 0)], "host string, texts long, failed long")) == (0.0, Q.MAX_STRENGTH)


def test_empty_table(spark):
    assert Q.judged(hosts(spark).where("false")).count() == 0
