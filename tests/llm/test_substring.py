from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import pytest

from wardline.llm import op_substring as S
from wardline.sources.tables import stored


def chunks(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = S.chunk_bounds(data, np.array([0, len(data)]))
    return [data[a:b].tobytes() for a, b in zip(starts, ends)]


def sequential(text):
    """The same cuts by rolling the hash byte by byte."""
    data, out, at = text.encode(), [], 0
    while at < len(data):
        cut = len(data)
        if len(data) - at > S.MIN_CHUNK:
            for end in range(at + S.MIN_CHUNK, len(data) + 1):
                h = 0
                for b in data[max(0, end - 16) : end]:
                    h = (h * 2 + int(S._GEAR[b])) & 0xFFFF
                head = end == len(data) or data[end] & 0xC0 != 0x80
                if head and (h & S.MASK == 0 or end - at >= S.MAX_CHUNK) or end == len(data):
                    cut = end
                    break
        out.append(data[at:cut])
        at = cut
    return out


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_cuts_are_those_of_the_rolling_hash():
    rnd = random.Random(1)
    for n in (0, 1, 5, 40, 300):
        for _ in range(10):
            t = words(rnd, n)
            assert chunks(t) == sequential(t) and b"".join(chunks(t)) == t.encode()
    assert all(c.decode() is not None for c in chunks("日本" * 500))


def test_an_insertion_moves_few_chunks():
    rnd = random.Random(2)
    t = words(rnd, 2000)
    a, b = Counter(chunks(t)), Counter(chunks(t[:3000] + "INSERTED " + t[3000:]))
    assert sum((a - b).values()) <= 6


def brute(rows, min_run=S.MIN_RUN):
    where = Counter()
    first = {}
    for doc_id, text in sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0])):
        for place, c in enumerate(chunks(text) if text else []):
            where[c] += 1
            first.setdefault(c, (doc_id, place))
    out = {}
    for doc_id, text in rows:
        if doc_id is None or not text:
            continue
        run, total, gone, longest = [], 0, 0, 0
        for place, c in [*enumerate(chunks(text)), (None, b"")]:
            if c and where[c] > 1:
                run.append((place, c))
                continue
            size = sum(len(x) for _, x in run)
            if size >= min_run:
                total += size
                longest = max(longest, size)
                gone += sum(len(x) for p, x in run if first[x] != (doc_id, p))
            run = []
        if total:
            out[doc_id] = (total, gone, longest)
    return out


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(3)
    passage, line = words(rnd, 60), words(rnd, 5)
    rows = [(k, " ".join([words(rnd, rnd.randint(0, 80)), rnd.choice(["", passage, line, passage + " " + passage]), words(rnd, rnd.randint(0, 80))])) for k in range(60)]
    rows += [(100, rows[0][1]), (101, None), (102, ""), (None, rows[1][1])]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int").repartition(5)
    got = {r["doc_id"]: (r["repeat_bytes"], r["removed_bytes"], r["longest_run"]) for r in S.repeats(docs).collect()}
    assert got == brute(rows)
    holders = {i for i, t in rows if t and passage in t and i is not None}
    assert holders <= set(got)
    clean = {r["doc_id"]: r["text"] for r in S.deduplicated(docs).collect()}
    assert len(clean) == len(rows) and S.deduplicated(docs).columns == docs.columns
    for i, t in rows:
        removed = got.get(i, (0, 0, 0))[1]
        assert clean[i] == t if t is None else len(clean[i].encode()) == len(t.encode()) - removed


def test_short_passages_at_any_place_are_found_to_the_byte(spark):
    rnd = random.Random(7)
    rows, planted = [], {}
    for k in range(150):
        passage = words(rnd, 51)
        for i in (2 * k, 2 * k + 1):
            before, after = (" ".join(f"{rnd.randrange(10**9)}" for _ in range(rnd.randint(1, 40))) for _ in range(2))
            rows.append((i, f"{before} {passage} {after}"))
        planted[2 * k + 1] = passage
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["id"]: r for r in S.passages(docs).collect()}
    assert len(S.repeats(docs).collect()) < len(rows)  # whole chunks miss some
    assert set(got) == {i for i, _ in rows}
    clean = {r["doc_id"]: r["text"] for r in S.without_passages(docs).collect()}
    text = dict(rows)
    for i, passage in planted.items():
        n = len(passage.encode())
        assert n <= got[i]["removed_bytes"] <= n + 6 and got[i - 1]["repeat_bytes"] == got[i]["repeat_bytes"]
        assert got[i - 1]["removed_bytes"] == 0 and clean[i - 1] == text[i - 1]
        assert len(clean[i].encode()) == len(text[i].encode()) - got[i]["removed_bytes"] and passage[8:-8] not in clean[i]


def test_every_stretch_of_the_passage_length_holds_an_anchor():
    rnd = random.Random(6)
    for _ in range(300):
        data = [np.frombuffer((words(rnd, 30) + p + words(rnd, 30)).encode(), np.uint8) for p in [words(rnd, 60)] for _ in "ab"]
        keys = []
        for d in data:
            starts, key, first = S.windows(np.concatenate([d, d[:9], d]), np.cumsum([0, len(d), 9, len(d)]))
            assert first[1] == first[2] and np.diff(np.append(starts[: first[1]], len(d) - S.ANCHOR)).max() <= S.MIN_RUN - S.ANCHOR + 1
            keys.append(set(key.tolist()))
        assert keys[0] & keys[1]


def test_passages_take_odd_rows(spark):
    rnd = random.Random(8)
    p = words(rnd, 60)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, p), (3, p), (3, "é " + p), (None, p + " x"), (None, "y " + p)], "doc_id long, text string")
    got = S.passages(docs)
    assert got.where("id = 3").count() == 2 and S.without_passages(docs).count() == 7
    assert S.passages(docs.where("false")).count() == 0 and S.without_passages(docs.where("false")).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeats(docs).count() == 0 and S.deduplicated(docs).count() == 0


def every_stretch(rows):
    """(id, text) -> repeated bytes, bytes to remove, longest: all stretches of MIN_RUN bytes compared, and runs of shared chunks."""
    rows = [(-(1 << 63) if i is None else i, t) for i, t in rows if t]
    where, held = {}, {}
    for i, t in rows:
        data = t.encode()
        for a in range(len(data) - S.MIN_RUN + 1):
            where.setdefault(data[a : a + S.MIN_RUN], []).append((i, t, a))
        at = 0
        for c in chunks(t):
            held.setdefault(c, []).append((i, t, at))
            at += len(c)
    # the order of two texts with one id is that of their digests; these tests give such texts no passage in common
    least = {w: min(at) for w, at in where.items()}
    first = {c: min(at) for c, at in held.items()}
    out = {}
    for i, t in rows:
        data, every, gone = t.encode(), set(), set()
        head = [k == len(data) or data[k] & 0xC0 != 0x80 for k in range(len(data) + 1)]

        def take(a, b, removed):
            while not head[a]:
                a += 1
            while not head[b]:
                b -= 1
            every.update(range(a, b))
            gone.update(range(a, b) if removed else ())

        for a in range(len(data) - S.MIN_RUN + 1):
            w = data[a : a + S.MIN_RUN]
            if len(where[w]) > 1:
                take(a, a + S.MIN_RUN, least[w] != (i, t, a))
        at, run = 0, []
        for c in [*chunks(t), None]:
            if c and len(held[c]) > 1:
                run.append((at, c))
            else:
                if sum(len(x) for _, x in run) >= S.MIN_RUN:
                    for a, x in run:
                        take(a, a + len(x), first[x] != (i, t, a))
                run = []
            at += len(c or b"")
        if every:
            ordered, longest, last = sorted(every), 0, None
            for k in ordered:
                size = size + 1 if last == k - 1 else 1
                longest, last = max(longest, size), k
            out[i, t] = len(every), len(gone), longest
    return out


def test_passages_equal_all_stretches_compared(spark):
    rnd = random.Random(11)
    long, line, many = words(rnd, 90), words(rnd, 22), words(rnd, 30)
    rows = []
    for k in range(70):
        parts = [words(rnd, rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            source = rnd.choice([long, line, many])
            a, b = sorted(rnd.randrange(len(source) + 1) for _ in "ab")
            parts += [source[a:b] if rnd.random() < 0.7 else source, words(rnd, rnd.randint(0, 12))]
        rows.append((k, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1] + " x"), (202, None), (203, ""), (204, "ab" * 400), (205, "日本語" * 120), (None, rows[5][1]), (7, rows[7][1])]
    got = {(r["id"], r["text"]): (r["repeat_bytes"], r["removed_bytes"], r["longest_run"]) for r in S.passages(frame(spark, rows)).join(S._texts(frame(spark, rows)), ["id", "hash"]).collect()}
    assert got == every_stretch(rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_later_holders_count_where_earlier_ones_share_the_ends_only(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(60):
        p = words(rnd, 60).encode("ascii", "replace").decode()[:200]
        texts = [p[:136], p[-136:], p, p]
        rows += [(4 * k + j, f"{words(rnd, 20)} {t} {words(rnd, 20)}") for j, t in enumerate(texts)]
    got = {r["id"]: r["removed_bytes"] for r in S.passages(frame(spark, rows)).collect()}
    assert all(got.get(4 * k + 3, 0) >= 200 for k in range(60))


def test_own_columns_may_clash(spark):
    rnd = random.Random(13)
    p = words(rnd, 80)
    rows = [(i, f"{words(rnd, 9)} {p}", 1, "h", [2]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, HASH string, cuts array<int>")
    for clean in (S.without_passages(docs), S.deduplicated(docs)):
        assert clean.columns == docs.columns and clean.count() == 3 and clean.select("id", "HASH", "cuts").distinct().count() == 1


def test_a_hot_passage_is_found_in_every_holder(spark):
    rnd = random.Random(14)
    p = words(rnd, 60)
    rows = [(i, f"{words(rnd, 15)} {p} {words(rnd, 15)}" if i % 3 else words(rnd, 40)) for i in range(900)]
    got = {r["id"]: (r["repeat_bytes"], r["removed_bytes"], r["longest_run"]) for r in S.passages(frame(spark, rows)).collect()}
    assert set(got) == {i for i in range(900) if i % 3} and got == {i: v for (i, _), v in every_stretch(rows).items()}


@pytest.mark.parametrize("hits, ids", [(S.BROADCAST_HITS, S.BROADCAST_IDS), (-1, S.BROADCAST_IDS), (-1, -1)])
def test_steps_leave_nothing_behind_and_reading_again_is_the_same_by_any_join(spark, hits, ids, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_HITS", hits)
    monkeypatch.setattr(S, "BROADCAST_IDS", ids)
    rnd = random.Random(15)
    source = words(rnd, 120)
    rows = []
    for k in range(60):
        a = rnd.randrange(len(source) - 200)
        rows.append((k, f"{words(rnd, 12)} {source[a : a + rnd.randint(100, 400)]} {words(rnd, 12)}"))
    kept = []
    monkeypatch.setattr(S, "stored", lambda df, name="stage": kept.append((name, stored(df, name))) or kept[-1][1])
    got = {(r["id"], r["text"]): (r["repeat_bytes"], r["removed_bytes"], r["longest_run"]) for r in S.passages(frame(spark, rows)).join(S._texts(frame(spark, rows)), ["id", "hash"]).collect()}
    assert got == every_stretch(rows)
    there = {name for name, df in kept if any(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())}
    assert {"anchors", "parts", "each", "alike"} < {name for name, _ in kept} and not there & {"anchors", "parts", "each", "alike"}
