"""Exact n-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments, and every text's set with it, so
two sets can be compared fragment by fragment: their overlap is the sum of the partial overlaps. Three uses are made of this:

1. *Candidates.* Two sets that link differ in at most d n-grams, and d follows from their sizes. Cut into f > d fragments, they
   must agree in f - d fragments as a whole. So each set is posted under the digest of what it has in every f - d fragments: one
   of twice d + 1 for long texts, most of a set for short ones. Sizes are dealt to classes, and a set near the top of its class
   is posted for the next one too. (A set that is empty in some such fragments is posted under that and each choice of a second,
   independent cut, so empty fragments bring nobody together.) Of a long set's fragments more than half must agree, so one of
   its d + 1 rarest digests is among the other's d + 1 rarest: digests that many texts share bring nobody together.
2. *Bound.* Quarters of fragments are kept as 4-bit digests, sixteen to a number; the number of quarters that differ is a lower
   bound of the difference and drops most false candidates before a text is read again.
3. *Count.* For the pairs left, partial overlaps per fragment are counted one by one and summed per pair: the exact overlap.

No pair list of a group is ever made. Equal sets are one representative. In each posting group members are compared with a
leader only, first the smallest id, then, while that still joins much, leaders drawn anew, and only across different
components. What is left are pairs of a group's minority members with the rest of the group, across components; they are
compared last, all of them, with the bound inside the join. So no link that could join two components is missed, and a group of
near copies costs about its size. Postings are combined per batch before the shuffle, so a hot group is a few rows per batch.

Nulls and edge cases: a null or empty text has an empty set and links with nothing; a text of fewer words than ``n`` is one
n-gram, its whole word sequence; rows of one ``doc_id`` are one document; a null ``doc_id`` never links and has no component;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from wardline.llm import words as W
from wardline.llm.components import components
from wardline.llm.registry import query, table
from wardline.sources.tables import stored

WORDS = 3
#: The threshold as a fraction: overlap * DEN >= NUM * union.
NUM, DEN = 9, 10
#: Fragments in which the overlap of a pair is counted.
FRAGMENTS = 8
#: Ids of candidates whose list is broadcast to a second reading (8 bytes each); beyond it they are joined.
BROADCAST_IDS = 4_000_000
#: Rounds of newly drawn leaders at most, and the part of the last round's links that a round must bring to be followed by
#: another; what they leave is compared in full afterwards.
LEADER_ROUNDS, WORTH = 6, 0.05
#: Choices of fragments a short set is posted under at most (a long one is posted under its d + 1 single fragments).
MAX_CHOICES, MAX_FRAGMENTS = 48, 10
_CLASS_BITS = 7
_SECOND = W.U64(0x5851F42D4C957F2D)


class Classes:
    """Size classes for a threshold, and the fragments that their sets are cut into."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den, self.low = num, den, [1]
        #: Below the query's threshold sets may differ in much of themselves: classes are narrower.
        self.power = 1 if num * DEN < NUM * den else 3

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            at = self.low[-1]
            self.low.append(max(at + 1, -(-at * self.den**self.power // self.num**self.power)))
        return bisect_right(self.low, n) - 1

    def difference(self, c: int) -> int:
        """The largest difference of two sets of class ``c`` (or one of them just below it) that link."""
        self.of(self.low[min(c, len(self.low) - 1)])
        while len(self.low) <= c + 1:
            self.of(self.low[-1])
        return 2 * (self.low[c + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def next_too(self, n: int, c: int) -> bool:
        return n * self.den >= self.low[c + 1] * self.num


def gram_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted hashes of every text's distinct n-grams."""
    for _, _, data, offsets in W.chunks(texts):
        data = W.LOWER[data]
        starts, ends, first = W.spans(data, offsets, W.NOT_WHITE)
        hashes = W.span_hashes(data, starts, ends)
        grams = W.gram_hashes(hashes, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            else:
                yield W.gram_hashes(hashes[a:b], b - a) if b > a else hashes[:0]


def _cut(h: np.ndarray, mixed: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Digest sums and sizes of the ``parts`` fragments of a sorted set."""
    number = ((h >> W.U64(32)) * W.U64(parts)) >> W.U64(32)
    bounds = np.searchsorted(number, np.arange(parts + 1, dtype=np.uint64))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    return np.diff(total[bounds]), np.diff(bounds)


@lru_cache(None)
def choices(d: int) -> np.ndarray:
    """All choices of f - d of f fragments, one per row; f is the largest that gives no more than ``MAX_CHOICES`` of them."""
    f = d + 1
    while f < MAX_FRAGMENTS and comb(f + 1, d) <= max(MAX_CHOICES, d + 1):
        f += 1
    return np.array(list(combinations(range(f), f - d)))


def postings(h: np.ndarray, c: int, d: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Posting keys of a set in class ``c`` (the class in the low bits), the digests of its fragments' quarters, and how many of the
    keys suffice, the rarest first (None: all are needed).

    A long set is cut into twice d + 1 fragments. If more than d of them hold something, all but d of those agree in any set
    that links. So the empty ones need no posting, and one of the d + 1 first, in any order of all keys, is posted by both.
    """
    chosen, enough = choices(d), None
    single = chosen.shape[1] == 1
    if single:
        chosen = np.arange(2 * (d + 1))[:, None]
    parts = int(chosen.max()) + 1
    sums, sizes = _cut(h, W.mix(h ^ _SECOND), 4 * parts)
    place = np.arange(parts, dtype=np.uint64) + W.U64(c << 40)
    quarters = W.mix(sums.reshape(-1, 4) + np.arange(1, 5, dtype=np.uint64))
    keys = W.mix(quarters.sum(1, dtype=np.uint64) + W.mix(place))
    keys = W.mix(keys[chosen].sum(1, dtype=np.uint64))
    empty = np.flatnonzero(sizes.reshape(-1, 4).sum(1)[chosen].sum(1) == 0)
    if single and len(keys) - len(empty) > d:
        keys, enough = np.delete(keys, empty), d + 1
    elif len(empty):
        other = np.sort(W.mix(h + _SECOND))
        again, _ = _cut(other, W.mix(other), parts)
        again = W.mix(again + W.mix(place + W.U64(1 << 32)))[chosen].sum(1, dtype=np.uint64)
        shift = W.mix((empty.astype(np.uint64) + W.U64(1)) * _SECOND)
        more = [W.mix(again + x) for x in shift]
        keys = np.concatenate([np.delete(keys, empty), *more])
    keys = (keys << W.U64(_CLASS_BITS)) | W.U64(c)
    digests = np.zeros(-(-len(sums) // 16) * 16, np.uint64)
    digests[: len(sums)] = W.mix(sums) >> W.U64(60)
    packed = (digests.reshape(-1, 16) << (W.U64(4) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64), enough


_NO_POSTINGS = (np.zeros(0, np.int64), np.zeros(0, np.int64), None)


def _posted(h: np.ndarray, classes: Classes) -> list[tuple[int, tuple]]:
    """The one or two classes that a set is posted for, with its postings there."""
    if not len(h):
        return [(0, _NO_POSTINGS)]
    c = classes.of(len(h))
    d = classes.difference(c)
    out = [(c, postings(h, c, d) if d else _NO_POSTINGS)]
    if classes.next_too(len(h), c) and (d := classes.difference(c + 1)):
        out.append((c + 1, postings(h, c + 1, d)))
    return out


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


_SKETCH = "doc_id long, n long, d1 long, d2 long, cfg int, posted int, enough int, quarters array<long>, cfg_up int, posted_up int, enough_up int, quarters_up array<long>"


def sketches(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: set size, 128-bit digest of the set, number of posting keys and quarter digests for one or two classes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(num, den)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                size, d1, d2, own, up = [], [], [], [], []
                for h in gram_sets(batch.column(1), n):
                    size.append(len(h))
                    d1.append(W.mix(h).sum(dtype=np.uint64))
                    d2.append(W.mix(h ^ _SECOND).sum(dtype=np.uint64))
                    first, *second = [(c, len(keys), enough, quarters) for c, (keys, quarters, enough) in _posted(h, classes)]
                    own.append(first)
                    up.append(second[0] if second else (-1, 0, None, _NO_POSTINGS[1]))
                columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64))]
                for side in (own, up):
                    columns += [pa.array([r[i] for r in side], pa.int32()) for i in range(3)] + [_lists([r[3] for r in side], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, _SKETCH)


def combined(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Postings, one row per key and batch: (key, the smallest id, the other ids or null)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(num, den)
        for batch in batches:
            keys = [np.concatenate([keys for _, (keys, _, _) in _posted(h, classes)]) for h in gram_sets(batch.column(1), n)]
            if not sum(map(len, keys)):
                continue
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
            key = np.concatenate(keys)
            order = np.lexsort((rep, key))
            key, rep = key[order], rep[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(head, len(key)))
            rest = np.ones(len(key), bool)
            rest[head] = False
            offsets = np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rep[rest], pa.int64()), mask=pa.array(size == 1))
            out = pa.RecordBatch.from_arrays([pa.array(key[head], pa.int64()), pa.array(rep[head], pa.int64()), others], names=["key", "lead", "others"])
            for lo in range(0, out.num_rows, 100_000):
                yield out.slice(lo, 100_000)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "key long, lead long, others array<long>")


def _key_class() -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << _CLASS_BITS) - 1)).cast("int").alias("cfg")


def members(docs: DataFrame, named: DataFrame, ids: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, lead, total, rep) of every posting group of two or more of the representatives ``ids`` (rep) of the sketches ``named``."""
    reps = _listed(ids.select("rep"), ids.count())
    read = docs.select(F.col("doc_id").cast("long"), "text")
    rows = combined(read.join(reps, read["doc_id"] == reps["rep"], "left_semi"), n, num, den)
    group = Window.partitionBy("key")
    size = 1 + F.coalesce(F.when(F.col("others").isNotNull(), F.size("others")), F.lit(0))
    rows = rows.withColumn("total", F.sum(size).over(group)).where("total > 1")
    everyone = F.concat(F.array("lead"), F.coalesce("others", F.array().cast("array<long>")))
    rows = rows.select("key", "total", F.explode(everyone).alias("rep"), _key_class())
    sides = F.array(*[F.struct(F.col(f"cfg{u}").alias("cfg"), F.col(f"posted{u}").alias("posted"), F.col(f"enough{u}").alias("enough")) for u in ("", "_up")])
    known = named.select(F.col("doc_id").alias("rep"), "d1", F.explode(sides).alias("s")).where("s.enough IS NOT NULL")
    known = known.groupBy("rep", F.col("s.cfg").alias("cfg")).agg(F.min("s.posted").alias("posted"), F.min("s.enough").alias("enough"), (F.min("d1") == F.max("d1")).alias("one"))
    own = Window.partitionBy("rep", "cfg")  # one text's own keys
    rows = rows.join(known.where("one").drop("one"), ["rep", "cfg"], "left").withColumn("rank", F.dense_rank().over(own.orderBy("total", "key")))
    alone = F.col("posted") - F.max("rank").over(own)  # keys that no other text has come first
    rows = stored(rows.withColumn("rank", F.col("rank") + alone).where("enough IS NULL OR rank <= enough").select("key", "rep").distinct(), "postings")
    groups = rows.groupBy("key").agg(F.count("*").alias("total"), F.min("rep").alias("lead")).where("total > 1")
    return rows.join(groups, "key").select("key", "lead", "total", "rep")


def _sized(ids: DataFrame) -> DataFrame:
    """A list of ids, to be broadcast if it has no more than ``BROADCAST_IDS`` of them."""
    ids = stored(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _listed(ids: DataFrame, most: int) -> DataFrame:
    """A list of at most ``most`` ids from stored tables: broadcast as it is if that is within the bound, else stored and counted."""
    return F.broadcast(ids) if most <= BROADCAST_IDS else _sized(ids)


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids of stored pairs."""
    ids = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    return _listed(ids, 2 * pairs.count())


def _quarters_of(sketch: DataFrame, wanted: DataFrame) -> DataFrame:
    """Size, digest and quarters of the wanted ids, a list: (id, n, d1, cfg, quarters, cfg_up, quarters_up)."""
    got = sketch.select(F.col("doc_id").alias("id"), "n", "d1", "cfg", "quarters", "cfg_up", "quarters_up")
    got = got.join(wanted, "id", "left_semi")
    return got.dropDuplicates(["id", "d1"])


def _quarters(side: str) -> Column:
    return F.when(F.col(f"{side}.cfg") == F.col("cfg"), F.col(f"{side}.quarters")).otherwise(F.col(f"{side}.quarters_up"))


def _may_link(nx: Column, ny: Column, hx: Column, hy: Column, num: int, den: int) -> Column:
    """Size and quarter bounds; true for every pair that links."""
    def unlike(a: Column, b: Column) -> Column:  # digests of four bits that differ
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))

    differ = F.aggregate(F.zip_with(hx, hy, unlike), F.lit(0), lambda s, v: s + v)
    near = (F.least(nx, ny) * den >= F.greatest(nx, ny) * num)
    return near & (differ * (den + num) <= (nx + ny) * (den - num))


def bounded(pairs: DataFrame, sketch: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (x, y, cfg) that pass the bounds: (x, dx, nx, y, dy, ny)."""
    pairs = stored(pairs, "pairs")
    known = _quarters_of(sketch, _ends(pairs))
    a = known.select(F.col("id").alias("x"), F.struct("n", "d1", "cfg", "quarters", "quarters_up").alias("a"))
    b = known.select(F.col("id").alias("y"), F.struct("n", "d1", "cfg", "quarters", "quarters_up").alias("b"))
    met = pairs.join(a, "x").join(b, "y").where(_may_link(F.col("a.n"), F.col("b.n"), _quarters("a"), _quarters("b"), num, den))
    return met.select("x", F.col("a.d1").alias("dx"), F.col("a.n").alias("nx"), "y", F.col("b.d1").alias("dy"), F.col("b.n").alias("ny")).distinct()


def fragments(docs: DataFrame, n: int = WORDS, parts: int = FRAGMENTS) -> DataFrame:
    """(doc_id, d1, parts): every set cut into fragments of the global order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                d1, flat, cuts = [], [], [0]
                for h in gram_sets(batch.column(1), n):
                    d1.append(W.mix(h).sum(dtype=np.uint64))
                    number = ((h >> W.U64(32)) * W.U64(parts)) >> W.U64(32)
                    bounds = np.searchsorted(number, np.arange(1, parts + 1, dtype=np.uint64))
                    cuts.extend((bounds + cuts[-1]).tolist())
                    flat.append(h.view(np.int64))
                inner = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(flat)))
                outer = pa.ListArray.from_arrays(pa.array(range(0, parts * batch.num_rows + 1, parts), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(d1, np.uint64).view(np.int64)), outer], names=["doc_id", "d1", "parts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, d1 long, parts array<array<long>>")


def counted(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The links among the pairs: partial overlaps per fragment, summed per pair. (x, y, overlap, union)."""
    pairs = stored(pairs, "bounded")
    known = _ends(pairs)
    read = docs.select(F.col("doc_id").cast("long"), "text")
    sets = fragments(read.join(known, read["doc_id"] == known["id"], "left_semi"), n).dropDuplicates(["doc_id", "d1"])
    a = sets.select(F.col("doc_id").alias("x"), F.col("d1").alias("dx"), F.col("parts").alias("px"))
    b = sets.select(F.col("doc_id").alias("y"), F.col("d1").alias("dy"), F.col("parts").alias("py"))
    partial = F.zip_with("px", "py", lambda p, q: F.size(F.array_intersect(p, q)))
    overlap = F.aggregate(partial, F.lit(0), lambda s, v: s + v).cast("long")
    both = pairs.join(a, ["x", "dx"]).join(b, ["y", "dy"]).select("x", "y", overlap.alias("overlap"), (F.col("nx") + F.col("ny")).alias("sizes"))
    linked = both.where(F.col("overlap") * den >= (F.col("sizes") - F.col("overlap")) * num)
    return linked.select("x", "y", "overlap", (F.col("sizes") - F.col("overlap")).alias("union"))


def _mixed_groups(member: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of groups of three or more that hold more than one component: (key, rep, component)."""
    rows = member.where("total > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    rows = rows.select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return stored(rows.join(mixed, "key", "left_semi"), "mixed")


def _joined(labels: DataFrame, new: DataFrame) -> DataFrame:
    """New links together with the old ones, of which the components say all that matters."""
    return labels.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(new)


def link_classes(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. Runs its jobs when called."""
    sketch = stored(sketches(docs, n, num, den), "sketch")
    named = sketch.where("n > 0 AND doc_id IS NOT NULL")
    ids = stored(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "reps")
    member = stored(members(docs, named, ids, n, num, den), "members")

    def links_of(pairs: DataFrame) -> DataFrame:
        return stored(counted(bounded(pairs, sketch, num, den), docs, n, num, den).select("x", "y"), "new-links")

    links = links_of(member.where("rep <> lead").select(F.col("lead").alias("x"), F.col("rep").alias("y"), _key_class()).distinct())
    labels = components(links, kept=True)
    rows = _mixed_groups(member, labels)
    found = 0
    for turn in range(LEADER_ROUNDS):
        drawn = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("draw"), "rep", "component"))
        leads = rows.groupBy("key").agg(drawn.alias("l")).select("key", F.col("l.rep").alias("x"), F.col("l.component").alias("cx"))
        pairs = rows.join(leads, "key").where("component <> cx").select("x", F.col("rep").alias("y"), _key_class()).distinct()
        new = links_of(pairs)
        found, last = new.count(), found
        if not found:
            break
        labels = components(_joined(labels, new), kept=True)
        rows = _mixed_groups(member, labels)
        if found < WORTH * last:
            break
    new = stored(_rest(rows, sketch, docs, n, num, den), "rest-links")
    if not new.isEmpty():
        labels = components(_joined(labels, new), kept=True)
    found = sketch.select("doc_id", "n", "d1", "d2").join(ids, ["n", "d1", "d2"], "left")
    found = found.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _rest(rows: DataFrame, sketch: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links of the minority members of each mixed group with members of other components."""
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    major = sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("major"))
    known = _quarters_of(sketch, _listed(rows.select(F.col("rep").alias("id")).distinct(), rows.count()))
    full = rows.select("*", _key_class()).join(known.withColumnRenamed("id", "rep").withColumnRenamed("cfg", "own_cfg"), "rep")
    own = F.when(F.col("own_cfg") == F.col("cfg"), F.col("quarters")).otherwise(F.col("quarters_up"))
    full = stored(full.join(major, "key").select("key", "rep", "component", "major", "n", own.alias("quarters")), "rest")
    a = full.where("component <> major").select("key", *[F.col(c).alias(f"{c}_x") for c in ("rep", "component", "n", "quarters")])
    b = full.select("key", "major", *[F.col(c).alias(f"{c}_y") for c in ("rep", "component", "n", "quarters")])
    once = (F.col("component_y") == F.col("major")) | (F.col("rep_x") < F.col("rep_y"))
    other = (F.col("component_x") != F.col("component_y")) & once
    near = _may_link(F.col("n_x"), F.col("n_y"), F.col("quarters_x"), F.col("quarters_y"), num, den)
    met = a.join(b, (a["key"] == b["key"]) & other & near)
    pairs = met.select(F.col("rep_x").alias("x"), F.col("n_x").alias("nx"), F.col("rep_y").alias("y"), F.col("n_y").alias("ny")).distinct()
    digest = known.select("id", "d1", F.col("n").alias("size"))
    pairs = pairs.join(digest.select(F.col("id").alias("x"), F.col("d1").alias("dx"), F.col("size").alias("nx")), ["x", "nx"])
    pairs = pairs.join(digest.select(F.col("id").alias("y"), F.col("d1").alias("dy"), F.col("size").alias("ny")), ["y", "ny"])
    return counted(pairs.select("x", "dx", "nx", "y", "dy", "ny"), docs, n, num, den).select("x", "y")


_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
         JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN link l ON l.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


@query("op9_ngram_jaccard_join", _SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"))
