"""Cross-tokenizer alignment: where two tokenizers of one text end tokens at the same byte, and which tokens overlap.

Tokenizer A is a byte-level file read by ``tokenizers``, applied to a space and the text; B is a ``sentencepiece`` model,
applied to the text, before which it sets the space itself. Both lists of token ends are sorted byte offsets. The shorter
one drives a galloping search of the longer one: from where the previous end was found, the step doubles until it has
passed the wanted offset, then halves between the last two probes. A batch of texts is searched at once: of every list each
32nd end is sought first (and of those each 32nd, for long texts), then the ends between them step by step, all runs side
by side.

Ends found exactly cut the tokens into groups. The rank at which an end was found says how many of the other tokenizer's
ends lie before it; the ranks of a token's first and last byte bound the range of tokens that it overlaps.

Counts of id pairs over the corpus are summed in tasks first. Per B id the highest count is a table of vocabulary size. The
``HOT_PAIRS`` most frequent pairs are sent to the tasks; links of the other pairs, if there are any, meet their counts in a
join by pair. The result is the same for any limit.

Nulls and edge cases: a null or empty text, or one whose joined tokens of either tokenizer are not the bytes of space and
text (for example one that holds U+2581), has no tokens: zeros, and ``''`` instead of a hash. Special tokens' strings
are plain text. Repeated rows each get their row and all count; a null ``doc_id`` keeps its row; other columns are
ignored; an empty table gives an empty result. A text of any length is one unit of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.pieces import Book, cuts, ragged, spans_cuts
from wardline.llm.registry import query, table
from wardline.llm.words import chunks
from wardline.sources.tables import stored

#: Pairs whose counts are sent to every task (12 bytes each).
HOT_PAIRS = 1 << 20
#: Pair codes that a task sums before it sends them on.
HELD_CODES = 1 << 22
#: Bytes of text aligned at a time; a longer text is aligned alone.
ALIGNED_BYTES = 1 << 20
#: Needles between two that are found first.
FAN = 32
_pairs: dict[tuple[str, str], "TokenizerPair"] = {}


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class TokenizerPair:
    """Two tokenizer files and the tokens of the pieces met so far."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab()
        self.a_size, self.b_size = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.a_size
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        entries = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(entries)]
        self.a_lengths, self.b_lengths = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        #: Whether the model treats pieces by themselves; if not, whole texts are its pieces.
        self.cuttable = not spans_cuts(entries) and self.b.encode("\n", out_type=str) == ["▁", "<0x0A>"]
        self.book = Book(self.learn, 2)

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "TokenizerPair":
        if (a_path, b_path) not in _pairs:
            _pairs[a_path, b_path] = cls(a_path, b_path)
        return _pairs[a_path, b_path]

    def learn(self, pieces: list[bytes]) -> tuple[list[list], list[bool]]:
        texts = [p.decode() for p in pieces]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        if self.cuttable:  # after a newline no space is set before the piece
            b = [x[2:] for x in self.b.encode(["\n" + t for t in texts], num_threads=1)]
        else:
            b = self.b.encode([t[1:] for t in texts], num_threads=1)
        valid = [
            b"".join(map(self.a_bytes.__getitem__, x)) == p == b"".join(map(self.b_bytes.__getitem__, y)) for p, x, y in zip(pieces, a, b)
        ]
        return [a, b], valid


@dataclass
class Aligned:
    """Tokens of a batch of texts, one text after the other. Index arrays count tokens over the whole batch."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_first: np.ndarray  # first token of each text, and the end
    b_first: np.ndarray
    a_cut: np.ndarray  # last A token of each group
    b_cut: np.ndarray
    link_a: np.ndarray  # the tokens of each link
    link_b: np.ndarray

    def per_text(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many of the sorted or unsorted token places ``at`` fall into each text."""
        return np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(first) - 1)[: len(first) - 1]


def _search(ends: np.ndarray, wanted: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each wanted offset the first place at or after ``low`` whose end is not smaller, by doubling and then halving steps."""
    low, high, step, last = low.copy(), low.copy(), 1, len(ends) - 1
    going = np.flatnonzero(ends[high] < wanted)
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step, last)
        step *= 2
        going = going[ends[high[going]] < wanted[going]]
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        less = ends[middle] < wanted[going]
        low[going] = np.where(less, middle + 1, low[going])
        high[going] = np.where(less, high[going], middle)
        going = going[low[going] < high[going]]
    return low


def gallop(needles: np.ndarray, first: np.ndarray, ends: np.ndarray, ends_first: np.ndarray) -> np.ndarray:
    """Place in ``ends`` of the first end not smaller than each needle.

    Both lists hold one sorted run per text, runs in ascending order; ``first`` and ``ends_first`` say where runs begin (and
    the last one ends). The last needle of a run is not larger than the run's last end.
    """
    found = np.zeros(len(needles), np.int64)
    counts = np.diff(first)
    stride = 1
    while len(counts) and counts.max() > FAN * stride:
        stride *= FAN
    lanes, stop, at = first[:-1], first[1:], ends_first[:-1].astype(np.int64)
    begin = 0  # the heads themselves are sought on the highest level only
    while stride:
        for t in range(begin, FAN):
            here = lanes + t * stride
            inside = here < stop
            if not inside.all():
                lanes, stop, at, here = lanes[inside], stop[inside], at[inside], here[inside]
            if not len(here):
                break
            at = found[here] = _search(ends, needles[here], at)
        runs = -(-counts // stride)
        lanes = np.repeat(first[:-1], runs) + ragged(np.zeros(len(runs), np.int64), runs) * stride
        stop, at = np.repeat(first[1:], runs), found[lanes]
        begin, stride = 1, stride // FAN
    return found


def align(pair: TokenizerPair, data: np.ndarray, offsets: np.ndarray) -> Aligned:
    """Align a batch of texts given as bytes, each with its leading space. Texts without bytes or with other bytes in a tokenizer have no tokens."""
    n = len(offsets) - 1
    starts = cuts(data, offsets) if pair.cuttable else offsets[:-1][np.diff(offsets) > 0]
    codes = pair.book.codes(data, starts)
    text = np.searchsorted(offsets, starts, side="right") - 1
    bad = np.zeros(n, bool)
    bad[text[~pair.book.valid[codes]]] = True
    codes, text = codes[~bad[text]], text[~bad[text]]
    (a_ids, a_counts), (b_ids, b_counts) = pair.book.tokens(codes, 0), pair.book.tokens(codes, 1)
    a_first, b_first = (np.concatenate([[0], np.cumsum(np.bincount(text, c, n).astype(np.int64))]) for c in (a_counts, b_counts))
    a_ends, b_ends = np.cumsum(pair.a_lengths[a_ids]), np.cumsum(pair.b_lengths[b_ids])
    a_leads = np.diff(a_first) <= np.diff(b_first)
    parts = []
    for leads, short, s_first, long, l_first in ((a_leads, a_ends, a_first, b_ends, b_first), (~a_leads, b_ends, b_first, a_ends, a_first)):
        counts = np.where(leads, np.diff(s_first), 0)
        mine = ragged(s_first[:-1], counts)
        runs = np.concatenate([[0], np.cumsum(counts)])
        needles = short[mine]
        place = gallop(needles, runs, long, np.append(l_first[:-1], 0))
        hit = long[place] == needles if len(needles) else np.zeros(0, bool)
        begin = np.empty_like(place)  # first token of the other side that ends after this one begins
        begin[1:] = (place + hit)[:-1]
        heads = counts > 0
        begin[runs[:-1][heads]] = l_first[:-1][heads]
        over = place - begin + 1
        parts.append((mine[hit], place[hit], np.repeat(mine, over), ragged(begin, over)))
    (a_cut, b_cut, a_link, b_link), (b_cut2, a_cut2, b_link2, a_link2) = parts
    join = lambda x, y: np.concatenate([x, y]).astype(np.int64)
    return Aligned(a_ids, b_ids, a_first, b_first, np.sort(join(a_cut, a_cut2)), np.sort(join(b_cut, b_cut2)), join(a_link, a_link2), join(b_link, b_link2))


def group_texts(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The groups of each text as ``a1,a2|b1;a3|b2`` : bytes of all texts and the first byte of each (and the end); every text ends with a separator."""
    size = max(int(ids.max(initial=0)) for ids in (x.a_ids, x.b_ids)) + 1
    width = len(str(size - 1)) + 1
    digits = np.array([str(i) for i in range(size)], f"S{width}").view(np.uint8).reshape(size, width)
    lengths = (digits > 0).sum(1)
    closes_a, closes_b = np.zeros(len(x.a_ids), bool), np.zeros(len(x.b_ids), bool)
    closes_a[x.a_cut] = closes_b[x.b_cut] = True
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    ids = np.zeros(len(x.a_ids) + len(x.b_ids), np.int64)
    marks = np.zeros(len(ids), np.uint8)
    for own, group, before, closes, mark in (
        (x.a_ids, group_a, np.append(0, x.b_cut + 1), closes_a, b"|"), (x.b_ids, group_b, x.a_cut + 1, closes_b, b";"),
    ):
        place = np.arange(len(own)) + before[group] if len(own) else np.zeros(0, np.int64)
        ids[place] = own
        marks[place] = np.where(closes, mark[0], ord(","))
    cells, used = digits[ids], lengths[ids]
    cells[np.arange(len(ids)), used] = marks
    flat = cells[np.arange(width) <= used[:, None]]
    ends = np.append(0, np.cumsum(used + 1))
    return flat, ends[x.a_first + x.b_first]


def _batches(batches: Iterator[pa.RecordBatch], pair: TokenizerPair) -> Iterator[tuple[pa.Array, Aligned]]:
    """(doc_ids, aligned tokens) for runs of whole texts."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        for first, end, data, offsets in chunks(spaced, ALIGNED_BYTES):
            yield batch.column(0).slice(first, end - first), align(pair, data, offsets)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Tokens, groups and overlaps of each document: (doc_id, a_ids, b_ids, groups, links).

    ``groups`` holds, per group, how many tokens of A and of B the document has up to the group's end; ``links`` the places
    (from 0) of the A and the B token of each overlap.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, x in _batches(batches, TokenizerPair.of(a_path, b_path)):
            a_text = np.searchsorted(x.a_first, x.a_cut, side="right") - 1
            order = np.lexsort((x.link_b, x.link_a))
            l_text = np.searchsorted(x.a_first, x.link_a[order], side="right") - 1
            firsts = [np.append(0, np.cumsum(np.bincount(t, minlength=len(names)))) for t in (a_text, l_text)]
            pairs = ((x.a_cut + 1 - x.a_first[a_text], x.b_cut + 1 - x.b_first[a_text]), (x.link_a[order] - x.a_first[l_text], x.link_b[order] - x.b_first[l_text]))
            both = [
                pa.ListArray.from_arrays(pa.array(f, pa.int32()), pa.StructArray.from_arrays([pa.array(p, pa.int32()) for p in ab], ["a", "b"]))
                for f, ab in zip(firsts, pairs)
            ]
            yield pa.RecordBatch.from_arrays(
                [names, _lists(x.a_ids, x.a_first, pa.int32()), _lists(x.b_ids, x.b_first, pa.int32()), *both], names=["doc_id", "a_ids", "b_ids", "groups", "links"]
            )

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a: int, b: int>>, links array<struct<a: int, b: int>>"
    return _read(docs).mapInArrow(run, schema)


LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"


def linked(docs: DataFrame, a_path: str, b_path: str, a_size: int) -> DataFrame:
    """Counts and digest of each document with its distinct id pairs (B id times ``a_size`` plus A id) and how often it links them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = TokenizerPair.of(a_path, b_path), TaskContext.get().partitionId() << 40
        room = a_size * pair.b_size
        for names, x in _batches(batches, pair):
            n = len(names)
            flat, at = group_texts(x)
            shown = memoryview(flat)
            hashes = [hashlib.sha256(shown[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            text = np.repeat(np.arange(n), np.diff(x.a_first))[x.link_a]
            keys, times = np.unique(text * room + x.b_ids[x.link_b].astype(np.int64) * a_size + x.a_ids[x.link_a], return_counts=True)
            first = np.searchsorted(keys, np.arange(n + 1) * room)
            columns = [
                pa.array(np.arange(row, row + n)), names, pa.array(np.diff(x.a_first)), pa.array(np.diff(x.b_first)), pa.array(x.per_text(x.a_cut, x.a_first)),
                pa.array(np.bincount(text, minlength=n).astype(np.int64)), pa.array(hashes, pa.string()), _lists(keys % room, first, pa.int64()), _lists(times, first, pa.int32()),
            ]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    return _read(docs).mapInArrow(run, LINKED)


def _sum(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[heads], np.add.reduceat(times, heads) if len(heads) else times


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, n): links of each id pair in the whole corpus. Tasks sum their own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def together() -> tuple[np.ndarray, np.ndarray]:
            return _sum(np.concatenate([c for c, _ in held]), np.concatenate([t for _, t in held]))

        for batch in batches:
            codes, times = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy().astype(np.int64)
            for at in range(0, len(codes), HELD_CODES):
                held.append(_sum(codes[at : at + HELD_CODES], times[at : at + HELD_CODES]))
                size += len(held[-1][0])
                if size > HELD_CODES:
                    held = [together()]
                    size = len(held[0][0])
                    if size > HELD_CODES // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["code", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in together()], names=["code", "n"])

    return rows.select("codes", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def with_counts(rows: DataFrame, counts: DataFrame, a_size: int, b_size: int, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Each document's sum of pair counts and its number of links whose pair is its B id's most frequent one."""
    spark = rows.sparkSession
    top = np.zeros(b_size, np.int64)
    best = counts.groupBy(F.floor(F.col("code") / a_size).alias("b")).agg(F.max("n").alias("n")).toArrow()  # at most one row per B id
    top[best["b"].to_numpy()] = best["n"].to_numpy()
    n_pairs = counts.count()
    hot = counts
    if n_pairs > hot_pairs:  # counts above the one at that rank: never more than the limit, but for the rank's error of 1 in 10,000
        least = counts.agg(F.percentile_approx("n", 1.0 - hot_pairs / n_pairs, 10_000)).first()[0]
        hot = counts.where(F.col("n") > least)
    known = hot.toArrow()
    order = np.argsort(known["code"].to_numpy())
    sent = spark.sparkContext.broadcast((known["code"].to_numpy()[order], known["n"].to_numpy()[order], top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, highest = sent.value
        for batch in batches:
            mine, times = (batch.column(k).flatten().to_numpy() for k in (7, 8))
            sizes = pc.list_value_length(batch.column(7)).to_numpy()
            text = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(codes, mine), max(len(codes) - 1, 0))
            found = codes[at] == mine if len(codes) else np.zeros(len(mine), bool)
            count = np.where(found, n[at] if len(codes) else 0, 0) * times
            is_best = found & (count == highest[mine // a_size] * times)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, text, count)
            n_best = np.bincount(text[is_best], times[is_best], batch.num_rows).astype(np.int64)
            rest = ~found
            first = np.append(0, np.cumsum(np.bincount(text[rest], minlength=batch.num_rows)))
            columns = [pa.array(n_best), pa.array(total), _lists(mine[rest], first, pa.int64()), _lists(times[rest], first, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *columns], names=names)

    names = [*rows.columns[:7], "n_best", "count_sum", "codes", "times"]
    schema = LINKED.split(", codes")[0] + ", n_best long, count_sum long, codes array<long>, times array<int>"
    out = rows.mapInArrow(run, schema)
    if n_pairs <= hot_pairs:
        return out.drop("row", "codes", "times")
    out = stored(out, "aligned")
    rare = out.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    highest = counts.groupBy(F.floor(F.col("code") / a_size).alias("b")).agg(F.max("n").alias("top"))
    judged = counts.withColumn("b", F.floor(F.col("code") / a_size)).join(highest, "b").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    more = rare.join(judged, "code").groupBy("row").agg(
        F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    added = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
    return out.join(more, "row", "left").select(*names[1:7], added("n_best", "more_best"), added("count_sum", "more_sum"))


def alignment(docs: DataFrame, a_path: str, b_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every document."""
    pair = TokenizerPair.of(a_path, b_path)
    rows = stored(linked(docs, a_path, b_path, pair.a_size), "links")
    return with_counts(rows, stored(pair_counts(rows), "pairs"), pair.a_size, pair.b_size, hot_pairs)


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), *tokenizer_paths())
