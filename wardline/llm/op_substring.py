"""Substring deduplication with content-defined chunks.

A gear hash rolls over every text's bytes; a chunk ends where certain bits of it are zero, between ``MIN_CHUNK`` and ``MAX_CHUNK``
bytes. Those bits depend on the last 16 bytes only, so an insertion moves the chunks around it and no others. Chunks meet by
the 64-bit digest of their bytes; what occurs more than once is shared. The first occurrence (smallest id, then place) is kept.
Shared chunks count where they stand in an unbroken run of ``MIN_RUN`` bytes or more, so a phrase in passing is left alone.
A passage seldom begins and ends with a chunk and may hold no whole one, so ``passages`` (what the query reports) adds what chunks
cannot see: every stretch of ``MIN_RUN`` bytes that occurs twice, wherever it begins. The smallest hash of ``ANCHOR`` bytes in a stretch is
its anchor, so equal stretches have equal anchors; the stretches around an anchor are compared by digest, first all those on one side of
it at once, then in ``PARTS`` parts, and one by one only where a part is shared but its surroundings differ, which is at a passage's ends.
No two texts are ever joined: every comparison is a grouping by digest, so all holders count and not only the first.
``repeats`` and ``deduplicated`` stay with whole chunks; ``without_passages`` cuts to the byte (to whole characters).

Occurrences are combined per batch before the shuffle (one row per digest and batch), so a passage that a third of all
texts share is a few rows per batch in its task. Only shared chunks and anchors go on; texts with a passage's end are read again there.
Groups that hold a large part of the rows meet their one-row answer by broadcast (``hot.SHARE`` of them at most).

Nulls and edge cases: a null or empty text has no chunks; repeated rows of one id are occurrences of their own (so they are shared
with each other) and are reported together; rows with a null id count as occurrences and report no repeats; extra
columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.hot import SHARE, free_names
from wardline.llm.op_ngram_join import BROADCAST_IDS, _sized
from wardline.llm.registry import query, table
from wardline.sources.tables import dropped, stored

MIN_CHUNK, MAX_CHUNK = 24, 120
#: Bytes of unbroken shared chunks from which a passage counts as repeated.
MIN_RUN = 140
#: Bytes of an anchor; one is posted of each ``MIN_RUN - ANCHOR + 1`` neighbours, the one with the smallest hash.
ANCHOR = 24
#: Bits of the gear hash that are zero at the end of a chunk: one place in 32 on average, 16 bytes deep.
MASK = 0xF800
#: Places in texts to be read again whose list is broadcast (8 bytes each); beyond it the texts are joined to theirs.
BROADCAST_HITS = 2_000_000
_GEAR = np.random.default_rng(7919).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The low 16 bits of the gear hash after each byte, by doubling the window four times."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk starts, ends, and for each text the index of its first chunk. No chunk splits a character."""
    heads = np.ones(len(data) + 1, bool)
    heads[:-1] = (data & 0xC0) != 0x80
    marks = (np.flatnonzero((gear(data) & np.uint16(MASK)) == 0) + 1) if len(data) else np.zeros(0, np.int64)
    marks = marks[heads[marks]]
    cuts: list[int] = []
    first = [0]
    places, k = marks.tolist(), 0
    n = len(places)
    for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while end - at > MIN_CHUNK:
            low = at + MIN_CHUNK
            while k < n and places[k] < low:
                k += 1
            cut = min(at + MAX_CHUNK, end)
            if k < n and places[k] < cut:
                cut = places[k]
            else:
                while cut < end and not heads[cut]:
                    cut += 1
            cuts.append(cut)
            at = cut
        if end > at:
            cuts.append(end)
        first.append(len(cuts))
    ends = np.array(cuts, np.int64)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return begins, ends, np.array(first)


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over the ``width`` values from each place on (fewer at the end)."""
    x, c = x.copy(), 1
    while 2 * c <= width:
        x[:-c] = pick(x[:-c], x[c:])
        c *= 2
    if width > c and len(x) > width - c:
        x[: c - width] = pick(x[: c - width], x[width - c :])
    return x


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and keys of the anchors in the texts, and for each text the index of its first one."""
    starts = np.arange(max(0, len(data) - ANCHOR + 1))
    if not len(starts):
        return starts, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    keys = W.mix(W.span_hashes(data, starts, starts + ANCHOR) + W.U64(1))
    rank, none = (keys >> W.U64(32)).astype(np.uint32), np.uint32(0xFFFFFFFF)
    for k in range(1, ANCHOR):  # those that would run into the next text
        at = offsets[1:-1] - k
        rank[at[(at >= 0) & (at < len(rank))]] = none
    width = MIN_RUN - ANCHOR + 1
    least = _slide(rank, width, np.minimum)
    chosen = np.flatnonzero((_slide(least[::-1], width, np.maximum)[::-1] == rank) & (rank != none))
    return chosen, keys[chosen].view(np.int64), np.searchsorted(chosen, offsets)


_NO_ID = -(1 << 63)
#: What a row stands for: a chunk, or the stretches that begin less, or more, than half their room before an anchor.
CHUNK, LATE, EARLY = 0, 1, 2
_ROOM = MIN_RUN - ANCHOR + 1
_SIDES = {LATE: (0, _ROOM // 2), EARLY: (_ROOM // 2, _ROOM)}
#: Parts of one side that are compared before single stretches; the first ``PARTS`` are of the late side.
PARTS = 4
_BORDERS = np.array([[p[0], p[-1] + 1] for side in _SIDES.values() for p in np.array_split(np.arange(*side), PARTS)])
_POST = "key long, around long, id long, hash long, kind int, at int, a int, b int"
_EACH = "w long, id long, hash long, a int, b int"


def _whole(heads: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without the characters that they cut."""
    for _ in range(3):
        a, b = a + ~heads[a], b - ~heads[b]
    return a, b


def _heads(data: np.ndarray) -> np.ndarray:
    heads = np.ones(len(data) + 1, bool)
    heads[:-1] = (data & 0xC0) != 0x80
    return heads


def _chunk_posts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    starts, ends, first = chunk_bounds(data, offsets)
    return W.span_hashes(data, starts, ends), np.zeros(len(starts), np.uint64), W.rows_of(first), np.full(len(starts), CHUNK), starts, starts, ends


def _around(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which anchors have stretches that begin ``low`` to ``high`` - 1 bytes before them, and the least and the most of that room in the text."""
    least, most = np.maximum(low, at + MIN_RUN - offsets[rows + 1]), np.minimum(high - 1, at - offsets[rows])
    some = np.flatnonzero(least <= most)
    return some, least[some], most[some]


def _side_posts(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, at: np.ndarray, kind: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor with such stretches: digest of what they all hold, digest of that and of all of them, row, kind, place, and their union."""
    some, least, most = _around(data, offsets, rows, at, *borders.T)
    rows, at, kind, (low, high) = rows[some], at[some], kind[some], borders[some].T
    key = W.mix(W.span_hashes(data, at - low, at - high + 1 + MIN_RUN) + (low * 256 + high).astype(np.uint64))
    around = W.mix(key + W.mix(W.span_hashes(data, at - most, at - least + MIN_RUN) + (least * 256 + most).astype(np.uint64)))
    return key, around, rows, kind, at, *_whole(_heads(data), at - most, at - least + MIN_RUN)


def _posted(found: list[tuple[np.ndarray, ...]], ids: np.ndarray, digests: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    key, around, rows, kind, at, a, b = (np.concatenate(x) for x in zip(*found))
    places = [pa.array((x - offsets[rows]).astype(np.int32)) for x in (at, a, b)]
    columns = [pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), pa.array(ids[rows]), pa.array(digests[rows]), pa.array(kind.astype(np.int32)), *places]
    out = pa.RecordBatch.from_arrays(columns, names=["key", "around", "id", "hash", "kind", "at", "a", "b"])
    for lo in range(0, out.num_rows, 50_000):
        yield out.slice(lo, 50_000)


def posts(docs: DataFrame, anchored: bool = True, counts: bool = False) -> DataFrame:
    """One row per chunk and, with ``anchored``, per anchor and side; with ``counts`` only (key, n) per batch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            digests = batch.column(1).to_numpy(zero_copy_only=False)
            for row, end, data, offsets in W.chunks(batch.column(2)):
                found = [_chunk_posts(data, offsets)]
                if anchored:
                    at, _, first = windows(data, offsets)
                    for kind, borders in _SIDES.items():
                        found.append(_side_posts(data, offsets, W.rows_of(first), at, np.full(len(at), kind), np.tile(borders, (len(at), 1))))
                if counts:
                    key, n = np.unique(np.concatenate([f[0] for f in found]).view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], names=["key", "n"])
                else:
                    yield from _posted(found, ids[row:end], digests[row:end], offsets)

    return _texts(docs).mapInArrow(read, "key long, n long" if counts else _POST)


_ROWS = "key long, size int, ids array<long>, texts array<long>, places array<int>, starts array<int>"


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per chunk digest and batch: (key, size, ids, texts, places, starts), the smallest (id, text digest, start) first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            digests = batch.column(2).to_numpy(zero_copy_only=False)
            key, size, who, text, place, begin = [], [], [], [], [], []
            for row, end, data, offsets in W.chunks(batch.column(1)):
                starts, ends, first = chunk_bounds(data, offsets)
                key.append(W.span_hashes(data, starts, ends).view(np.int64))
                size.append(ends - starts)
                who.append(np.repeat(ids[row:end], np.diff(first)))
                text.append(np.repeat(digests[row:end], np.diff(first)))
                begin.append(starts - np.repeat(offsets[:-1], np.diff(first)))
                place.append(np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first)))
            if not key:
                continue
            key, size, who, text, place, begin = (np.concatenate(x) for x in (key, size, who, text, place, begin))
            if not len(key):
                continue
            order = np.lexsort((begin, text, who, key))
            key, size, who, text, place, begin = (x[order] for x in (key, size, who, text, place, begin))
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            offsets = pa.array(np.append(head, len(key)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (who, text, place.astype(np.int32), begin.astype(np.int32))]
            out = pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(size[head].astype(np.int32)), *lists], names=["key", "size", "ids", "texts", "places", "starts"])
            for lo in range(0, out.num_rows, 50_000):
                yield out.slice(lo, 50_000)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(read, _ROWS)


def anchors(docs: DataFrame) -> DataFrame:
    """Every occurrence of a chunk that occurs more than once, and the first one: (id, hash, place, start, size, origin)."""
    head = [F.get(c, 0).alias(n) for c, n in (("ids", "id"), ("texts", "hash"), ("starts", "start"))]
    rows = occurrences(docs)
    lists = rows.withColumn("n", F.size("ids"))
    one = lists.groupBy("key").agg(F.sum("n").alias("total"), F.min(F.struct(*head)).alias("origin")).where("total > 1")
    shared = lists.join(one, "key")  # a batch's list is one row, so a hot key is as many rows as there are batches
    one = shared.select("size", "origin", F.explode(F.arrays_zip("ids", "texts", "places", "starts")).alias("o"))
    own = [F.col(f"o.{c}").alias(n) for c, n in (("ids", "id"), ("texts", "hash"), ("places", "place"), ("starts", "start"))]
    return one.select(*own, "size", "origin")


def _is_first() -> Column:
    return (F.col("id") == F.col("origin.id")) & (F.col("hash") == F.col("origin.hash")) & (F.col("start") == F.col("origin.start"))


def shared_chunks(docs: DataFrame) -> DataFrame:
    """Every occurrence of a chunk that occurs more than once: (doc_id, place, size, first)."""
    return anchors(docs).where(F.col("id") > _NO_ID).select(F.col("id").alias("doc_id"), "place", "size", _is_first().alias("first"))


def repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Texts with repeated passages: (doc_id, repeat_bytes, removed_bytes, longest_run, removed: chunk numbers)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, size, first = (np.array(x) for x in zip(*sorted({(c["place"], c["size"], c["first"]) for c in chunks})))
                head = np.flatnonzero(np.concatenate([[True], np.diff(place) > 1]))
                length = np.add.reduceat(size, head)
                inside = np.repeat(length >= min_run, np.diff(np.append(head, len(place))))
                if inside.any():
                    gone = inside & ~first
                    out.append((doc_id, int(size[inside].sum()), int(size[gone].sum()), int(length.max()), place[gone].tolist()))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "repeat_bytes", "removed_bytes", "longest_run", "removed"])

    grouped = shared_chunks(docs).groupBy("doc_id").agg(F.collect_list(F.struct("place", "size", "first")).alias("chunks"))  # one text's own chunks
    return grouped.mapInArrow(runs, "doc_id long, repeat_bytes long, removed_bytes long, longest_run long, removed array<int>")


def deduplicated(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with every repeated passage but its first occurrence cut out of ``text``. Runs the search when called."""
    own, cuts = free_names(docs, "id", "removed")
    gone = stored(repeats(docs, min_run).where("removed_bytes > 0").select(F.col("doc_id").alias(own), F.col("removed").alias(cuts)), "repeats")
    marked = docs.join(gone, docs["doc_id"] == gone[own], "left").drop(own)
    at, names = docs.columns.index("text"), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, removed in enumerate(batch.column(len(names)).to_pylist()):
                if removed and texts[i]:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    starts, ends, _ = chunk_bounds(data, np.array([0, len(data)]))
                    keep = np.ones(len(starts), bool)
                    keep[[r for r in removed if r < len(starts)]] = False
                    texts[i] = b"".join(data[a:b].tobytes() for a, b in zip(starts[keep], ends[keep])).decode("utf-8", "replace")
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(cut, docs.schema)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the spans as disjoint spans in order; spans that touch are one."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.zeros(0, np.int64)
    return a[head], b[np.append(head[1:] - 1, len(b) - 1)] if len(head) else b


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _meet(rows: DataFrame, one: DataFrame, key: list[str]) -> DataFrame:
    """Join of ``rows`` with ``one``, which has one row per key and in ``n`` how many of ``rows`` it meets. Both are stored tables."""
    total = one.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(one.where(F.col("n") * SHARE >= total))
    cold = rows.join(hot.select(*key), key, "left_anti").join(one.where(F.col("n") * SHARE < total), key)
    return rows.join(hot, key).unionByName(cold)


def _again(docs: DataFrame, wanted: DataFrame, each: bool) -> DataFrame:
    """Rows for the wanted (id, hash, at, kind) from their texts read again.

    Without ``each`` the ``PARTS`` of a side, their number as kind; with it every stretch of a part: (w, id, hash, a, b).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            bounds, hits = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            places, kinds = hits >> 8, hits & 0xFF
            for row, end, data, offsets in W.chunks(batch.column(2)):
                here = slice(bounds[row], bounds[end])
                rows = np.repeat(np.arange(end - row), np.diff(bounds[row : end + 1]))
                at, kind = places[here] + offsets[rows], kinds[here]
                if not each:
                    kind = ((kind - LATE)[:, None] * PARTS + np.arange(PARTS)).ravel()
                    rows, at = np.repeat(rows, PARTS), np.repeat(at, PARTS)
                    yield from _posted([_side_posts(data, offsets, rows, at, kind, _BORDERS[kind])], ids[row:end], digests[row:end], offsets)
                    continue
                some, least, most = _around(data, offsets, rows, at, *_BORDERS[kind].T)
                n = most - least + 1
                rows, begin = np.repeat(rows[some], n), np.repeat(at[some] - most - (np.cumsum(n) - n), n) + np.arange(n.sum())
                w = W.span_hashes(data, begin, begin + MIN_RUN).view(np.int64)
                a, b = (pa.array((x - offsets[rows]).astype(np.int32)) for x in _whole(_heads(data), begin, begin + MIN_RUN))
                out = pa.RecordBatch.from_arrays([pa.array(w), pa.array(ids[row:end][rows]), pa.array(digests[row:end][rows]), a, b], names=["w", "id", "hash", "a", "b"])
                for lo in range(0, out.num_rows, 50_000):
                    yield out.slice(lo, 50_000)

    hit = F.shiftleft(F.col("at").cast("long"), 8) + F.col("kind")
    wanted = stored(wanted.groupBy("id", "hash").agg(F.collect_set(hit).alias("hits")), "wanted")  # one text's own
    texts = _texts(docs)
    if (wanted.agg(F.sum(F.size("hits"))).first()[0] or 0) <= BROADCAST_HITS:
        wanted = F.broadcast(wanted)
    elif wanted.count() <= BROADCAST_IDS:  # texts that are not read again need no shuffle
        texts = texts.join(F.broadcast(wanted.select("id")), "id", "left_semi")
    texts = texts.join(wanted, ["id", "hash"]).select("id", "hash", "text", "hits")
    return texts.mapInArrow(read, _EACH if each else _POST)


def _alike(rows: DataFrame, key: str, who: Column, *more: Column) -> DataFrame:
    """Per key the number of rows and the smallest holder."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(who).alias("first"), *more)


def _per_text(rows: DataFrame) -> DataFrame:
    """Spans (id, hash, kind, a, b, gone) by text, stored: (id, hash, spans). A span is shorter than 64 KB and is one long."""
    flags = F.when(F.col("kind") == CHUNK, 2).otherwise(0) + F.col("gone").cast("int")
    packed = F.shiftleft(F.col("a").cast("long"), 18) + F.shiftleft(F.col("b") - F.col("a"), 2) + flags
    return stored(rows.groupBy("id", "hash").agg(F.sort_array(F.collect_set(packed)).alias("spans")), "spans")  # one text's own


def _open(alike: DataFrame) -> DataFrame:
    """(id, hash, at, kind): first holders of what is shared in surroundings that differ."""
    several = stored(alike.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    return _meet(alike.select("key", "kind", "first.*"), several, ["key"]).select("id", "hash", "at", "kind")


def spans(docs: DataFrame) -> DataFrame:
    """Shared chunks and shared stretches of ``MIN_RUN`` bytes by text: (id, hash, spans), each span with its place, whether it is a chunk
    and whether it is not the first one (see :func:`_per_text`). Runs jobs when called; what a step has read is removed after it."""
    shared = posts(docs, counts=True).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    found = stored(posts(docs).join(_sized(shared), "key", "left_semi"), "anchors")
    rows = found.withColumn("around", F.when(F.col("kind") == CHUNK, F.col("key")).otherwise(F.col("around")))
    who, more = F.struct("id", "hash", "at"), [F.min("key").alias("key"), F.min("kind").alias("kind")]
    late, gone = F.lit(LATE).alias("kind"), (who != F.col("first")).alias("gone")

    alike = stored(_alike(rows, "around", who, *more), "alike")
    one = alike.where("n > 1").select("around", "n", "first")
    chunks = _per_text(_meet(rows, one, ["around"]).select("id", "hash", "kind", "a", "b", gone))
    dropped(found)

    parts = stored(_again(docs, _open(alike.where(F.col("kind") > CHUNK)), each=False), "parts")
    dropped(alike)
    alike = stored(_alike(parts, "around", who, *more, F.max(who).alias("last")), "alike")
    one = alike.where("first <> last").select("around", "n", "first")
    sides = _per_text(_meet(parts, one, ["around"]).select("id", "hash", late, "a", "b", gone))
    dropped(parts)

    each = stored(_again(docs, _open(alike), each=True).distinct(), "each")
    dropped(alike)
    who = F.struct("id", "hash", "a")
    one = stored(_alike(each, "w", who).where("n > 1"), "alike")
    single = _per_text(_meet(each, one, ["w"]).select("id", "hash", late, "a", "b", (who != F.col("first")).alias("gone")))
    dropped(each, one)
    several = chunks.unionByName(sides).unionByName(single)
    return several.groupBy("id", "hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def passages(docs: DataFrame) -> DataFrame:
    """Repeated passages to the byte: (id, hash, repeat_bytes, removed_bytes, longest_run, cuts), one row per text. Runs jobs when called."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            bounds, packed = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            a, chunk, gone = packed >> 18, packed & 2 > 0, packed & 1 > 0
            b = a + (packed >> 2 & 0xFFFF)
            for k, (i, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                here = slice(bounds[k], bounds[k + 1])
                x, y, piece, late = a[here], b[here], chunk[here], gone[here]
                begins, ends = merged(x[piece], y[piece])
                at = np.searchsorted(begins, x, side="right") - 1
                kept = ~piece
                kept[piece] = (ends - begins)[at[piece]] >= MIN_RUN
                if not kept.any():
                    continue
                (begins, ends), cuts = merged(x[kept], y[kept]), merged(x[kept & late], y[kept & late])
                out.append((i, h, int((ends - begins).sum()), int((cuts[1] - cuts[0]).sum()), int((ends - begins).max()), np.stack(cuts, 1).ravel().tolist()))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            names = ["id", "hash", "repeat_bytes", "removed_bytes", "longest_run", "cuts"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return spans(docs).mapInArrow(sums, "id long, hash long, repeat_bytes long, removed_bytes long, longest_run long, cuts array<int>")


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage but its first occurrence cut out of ``text``, to the byte. Runs the search when called."""
    gone = passages(docs).where(F.col("removed_bytes") > 0).where(F.col("id") > _NO_ID)
    own, digest, cuts = free_names(docs, "id", "hash", "cuts")
    gone = stored(gone.select(F.col("id").alias(own), F.col("hash").alias(digest), F.col("cuts").alias(cuts)), "passages")
    marked = docs.join(gone, (docs["doc_id"] == gone[own]) & (F.xxhash64(docs["text"].cast("string")) == gone[digest]), "left").drop(own, digest)
    at, names = docs.columns.index("text"), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, cuts in enumerate(batch.column(len(names)).to_pylist()):
                if cuts and texts[i]:
                    data = texts[i].encode()
                    edges = [0, *cuts, len(data)]
                    texts[i] = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(cut, docs.schema)


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = passages(docs).where(F.col("id") > _NO_ID).groupBy(F.col("id").alias("found_id"))
    found = found.agg(F.sum("repeat_bytes").alias("repeat_bytes"), F.sum("removed_bytes").alias("removed_bytes"), F.max("longest_run").alias("longest_run"))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("repeat_bytes", "removed_bytes", "longest_run")]
    return sizes.join(found, sizes["doc_id"] == found["found_id"], "left").select("doc_id", "n_bytes", *zero, F.col("found_id").isNotNull().alias("has_repeat"))
