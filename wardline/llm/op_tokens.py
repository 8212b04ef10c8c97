"""Token ids in directly addressable codes.

A segment holds the ids of whole consecutive documents (``SEGMENT_TOKENS`` or the one document that is longer). Its ids are
split into 8-bit chunks: level 0 holds the low chunk of every id, level 1 the next chunk of those ids that have one, and so
on. A bitmap per level says which entries continue on the next level; a rank directory (one count per ``BLOCK`` bits) gives
an entry's place there. Any id is found with one look-up per level, without decoding its neighbours.

A token file is a folder of Parquet rows, one row per segment, so Spark's writer commits it as a whole and lost executors
only repeat their tasks. Documents are dealt to shards by ranges of ``doc_id`` and sorted in them: shards, segments in a
shard and documents in a segment are in ascending order.

Encoding asks the tokenizer for each distinct piece of a text once per worker (``pieces``). Texts are cut only where the
byte-level pre-tokenizer always cuts as well, and never inside a special token's string, so the ids are those of the whole
text; such a string is the special token, as the tokenizer file says.

Nulls and edge cases: a null or empty text is the end id alone; repeated ids are kept, in text order; a null ``doc_id``
comes first; extra columns are ignored; an empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.pieces import Book, cuts
from wardline.llm.registry import query, table
from wardline.llm.words import chunks
from wardline.sources.tables import work_dir

#: Tokens after which a segment is closed.
SEGMENT_TOKENS = 1 << 18
#: Bits per entry of a rank directory.
BLOCK = 512
LEVELS = 4
SEGMENT_SCHEMA = (
    "shard int, segment int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)
_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A byte-level tokenizer file with a bounded memory of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.book = Book(self._learn, scale=2)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _learn(self, pieces: list[bytes]) -> tuple[list[list], list[bool]]:
        got = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)  # without offsets
        return [[e.ids for e in got]], [True] * len(got)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of whole texts: the first text's row, all ids, and the number of ids of each text."""
        for first, end, data, offsets in chunks(texts):
            starts = cuts(data, offsets)
            ids, counts = self.book.tokens(self.book.codes(data, starts))
            text = np.searchsorted(offsets, starts, side="right") - 1
            yield first, ids, np.bincount(text, counts, end - first).astype(np.int64)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        return [part for _, ids, counts in self.batches(texts) for part in np.split(ids.astype(np.uint32), np.cumsum(counts)[:-1])]


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of the levels in use."""
    chunks, bitmaps, ranks = [], [], []
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    for _ in range(LEVELS):
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        whole = np.zeros(-(-len(more) // BLOCK) * BLOCK // 8, np.uint8)
        whole[: len(bits)] = bits
        per_block = np.bitwise_count(whole).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        bitmaps.append(whole.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype(np.uint32).tobytes() if len(per_block) else b"")
        rest = rest[more] >> 8
        if not len(rest):
            break
    return chunks, bitmaps, ranks


def unpack(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment, from the last level back to the first."""
    above = np.zeros(0, np.uint32)
    for chunk, bitmap in zip(reversed(chunks), reversed(bitmaps)):
        low = np.frombuffer(chunk, np.uint8).astype(np.uint32)
        if len(above):
            more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(low), bitorder="little").view(bool)
            low[more] |= above << 8
        above = low
    return above


def access(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], at: int) -> int:
    """The id at one place of a segment: one chunk, one bit and one rank per level, nothing decoded around it."""
    if not 0 <= at < len(chunks[0]):
        raise IndexError(at)
    value = 0
    for level, chunk in enumerate(chunks):
        value |= chunk[at] << (8 * level)
        bitmap = bitmaps[level]
        if not bitmap[at >> 3] >> (at & 7) & 1:
            break
        block = at // BLOCK
        before = int.from_bytes(bitmap[block * BLOCK // 8 : (at >> 3)], "little").bit_count()
        before += (bitmap[at >> 3] & ((1 << (at & 7)) - 1)).bit_count()
        at = int.from_bytes(ranks[level][4 * block : 4 * block + 4], "little") + before
    return value


def segments(docs: DataFrame, path: str, end_id: int = 0, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Rows of a token file for ``docs``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = Encoder.of(path), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal names, lengths, held, size, number
            row = [shard, number, size, names, lengths, *pack(np.concatenate(held))]
            number, names, lengths, held, size = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _SEGMENT)], schema=_SEGMENT)

        for batch in batches:
            for first, ids, counts in encoder.batches(batch.column(1)):
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(np.uint32)  # the end id after each text
                ends += np.arange(1, len(ends) + 1)
                done = begin = 0
                while done < len(ends):  # as many whole texts as close the segment
                    stop = min(int(np.searchsorted(ends, begin + segment_tokens - size)) + 1, len(ends))
                    names.extend(batch.column(0).slice(first + done, stop - done).to_pylist())
                    lengths.extend((counts[done:stop] + 1).tolist())
                    held.append(ids[begin : ends[stop - 1]])
                    size, begin, done = size + int(ends[stop - 1]) - begin, int(ends[stop - 1]), stop
                    if size >= segment_tokens:
                        yield close()
        if held:
            yield close()

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = read.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(write, SEGMENT_SCHEMA)


_SEGMENT = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ("chunks", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> None:
    """Encode whole texts and write the token file."""
    segments(docs, path, end_id).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(folder)


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, segment, start): tokens before each segment. Sums within shards first, then over one row per shard."""
    sizes = read_segments(spark, folder).select("shard", "segment", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.select("shard", "segment", "n_tokens", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("local"))
    return local.join(base, "shard").select("shard", "segment", "n_tokens", (F.col("base") + F.col("local")).alias("start"))


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token file: (doc_id, start, n_tokens, ids_crc32[, ids])."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["chunks"], row["bitmaps"]).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                begins = ends - row["doc_tokens"]
                parts = [ids[a:b] for a, b in zip(begins, ends)]
                columns = [
                    pa.array([row["shard"]] * len(parts), pa.int32()), pa.array([row["segment"]] * len(parts), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(begins, pa.int64()), pa.array(row["doc_tokens"], pa.int64()),
                    pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "segment", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "shard int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = read_segments(spark, folder).select("shard", "segment", "doc_ids", "doc_tokens", "chunks", "bitmaps").mapInArrow(decode, schema)
    at = starts(spark, folder).select("shard", "segment", F.col("start").alias("segment_start"))
    return rows.join(at, ["shard", "segment"]).select(
        "doc_id", (F.col("segment_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """(pos, id) for the wanted positions of the whole file; positions outside it are dropped.

    Segments and positions meet on fixed buckets of ``SEGMENT_TOKENS`` positions; each segment is sent to the buckets it spans.
    """
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [access(r["chunks"], r["bitmaps"], r["ranks"], r["at"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["pos", "id"])

    at = starts(spark, folder)
    span = F.sequence(F.floor(F.col("start") / SEGMENT_TOKENS), F.floor((F.col("start") + F.col("n_tokens") - 1) / SEGMENT_TOKENS))
    directory = at.select("shard", "segment", "start", "n_tokens", F.explode(span).alias("bucket"))
    wanted = positions.select(F.col("pos").cast("long"), F.floor(F.col("pos") / SEGMENT_TOKENS).alias("bucket"))
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("n_tokens"))
    found = wanted.join(directory, "bucket").where(inside).select("pos", "shard", "segment", (F.col("pos") - F.col("start")).alias("at"))
    codes = read_segments(spark, folder).select("shard", "segment", "chunks", "bitmaps", "ranks")
    return found.join(codes, ["shard", "segment"]).select("pos", "at", "chunks", "bitmaps", "ranks").mapInArrow(look, "pos long, id long")


@query("op2_token_id_output")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_documents(spark, folder)
