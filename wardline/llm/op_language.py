"""Language identification with blended-spectrum presence kernels.

A text is the set of its character n-grams of 1 to ``SPECTRUM`` characters (lower case, anything but letters is one space), kept
as slots of a hash space. The kernel of two texts is the number of slots they share over the root of the product of their sizes.
Nyström: a few texts per language are landmarks, and kernel ridge regression, one language against the rest, is solved on
the kernels of a bounded sample with the landmarks. Since every kernel with a landmark is a sum over the landmark's slots,
landmark table and coefficients fold into one weight per slot and language, so a block of texts is scored by one matrix product.

Sample: ``PER_LANGUAGE`` texts of each language by the smallest hash of the id, ``LANDMARKS`` of them as landmarks, read whole. The
driver gets their slots and solves a system of the size of the landmarks. Scoring is one pass without a shuffle.

Nulls and edge cases: null, empty or letterless texts are ``und`` with score 0; rows without a language or an id teach nothing;
without any labelled text all are ``und``; of equal scores the language first in the alphabet wins; repeated rows each get
their row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.automaton import BMP, LOWER_CHARS
from wardline.llm.registry import query, table
from wardline.llm.sampling import crc_class

SPECTRUM = 4
SLOTS = 1 << 18
PER_LANGUAGE, LANDMARKS = 256, 32
RIDGE = 1e-4
#: Texts per matrix product.
BLOCK = 32
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(BMP)], bool)
_FOLD = np.where(_LETTER, LOWER_CHARS, 32).astype(np.uint32)


def _fold(char: str) -> int:
    """Code point of the lower-case letter; a space for anything else."""
    lower = char.lower()
    return ord(lower if len(lower) == 1 else char) if char.isalpha() else 32


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # slot to row of ``weights``, -1 where no landmark has the slot
    weights: np.ndarray  # slot row x language


def slots_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The occupied slots of each text, none for a text without letters."""
    seen = np.zeros(SLOTS, bool)
    for _, _, data, offsets in W.chunks(texts):
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        at = heads[offsets]
        folded = _FOLD[np.minimum(chars, BMP - 1)]
        high = np.flatnonzero(chars >= BMP)
        if len(high):  # rare: each distinct one is looked up
            kinds, which = np.unique(chars[high], return_inverse=True)
            folded[high] = np.array([_fold(chr(c)) for c in kinds.tolist()], np.uint32)[which]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            c = folded[a:b]
            space = c == 32
            if space.all():
                yield np.zeros(0, np.int64)
                continue
            keep = ~space
            keep[1:] |= ~space[:-1]
            keep[-1] = not space[-1]
            c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
            if c[-2] == 32:  # one of the text's own stands there already
                c = c[:-1]
            h = np.zeros(len(c), np.uint32)
            for n in range(1, SPECTRUM + 1):
                if len(c) < n:
                    break
                h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
                seen[((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(14)] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


def sample_ids(docs: DataFrame, usable: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang, rank) of at most ``per_language`` rows per language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select("doc_id", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # about three times the wanted rows of each language meet in the ranking, however many it has
    some = rows.withColumn("draw", draw).join(F.broadcast(counts), "lang").where(F.col("draw") * F.col("n") <= 3 * per_language + 30)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("doc_id", "lang", "rank")


def fit(docs: DataFrame, usable: Column | None = None, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Solve the regression on the bounded sample. Runs jobs; None without labelled texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [s.astype(np.int32) for s in slots_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32()))], names=["lang", "rank", "slots"])

    ids = sample_ids(docs, usable, per_language).withColumnsRenamed({"doc_id": "sample_id", "lang": "sample_lang"})
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id"))
    rows = texts.select("sample_lang", "rank", "text").mapInArrow(read, "lang string, rank int, slots array<int>").where(F.size("slots") > 0)
    got = sorted(((r["lang"], r["rank"], np.array(r["slots"])) for r in rows.toLocalIterator()), key=lambda r: r[:2])
    if not got:
        return None
    languages = sorted({r[0] for r in got})
    marks = [s for lang in languages for s in [r[2] for r in got if r[0] == lang][:landmarks]]
    used = np.unique(np.concatenate(marks))
    column = np.full(SLOTS, -1, np.int32)
    column[used] = np.arange(len(used))
    table = np.zeros((len(used), len(marks)), np.float32)
    for j, s in enumerate(marks):
        table[column[s], j] = 1 / np.sqrt(len(s))
    kernels = np.vstack([block_kernels(list(s for _, _, s in got[lo : lo + BLOCK]), column, table) for lo in range(0, len(got), BLOCK)])
    among = np.vstack([block_kernels(marks[lo : lo + BLOCK], column, table) for lo in range(0, len(marks), BLOCK)])
    target = np.array([[1.0 if r[0] == lang else -1.0 for lang in languages] for r in got])
    share = np.array([[sum(r[0] == lang for r in got)] for lang in [r[0] for r in got]], float)
    weight = 1 / share  # every language weighs the same
    kernels = kernels.astype(float)
    system = kernels.T @ (weight * kernels) + RIDGE * len(languages) * (among + 1e-6 * np.eye(len(marks)))
    alpha = np.linalg.solve(system, kernels.T @ (weight * target))
    return Model(languages, column, (table @ alpha).astype(np.float32))


def block_kernels(slots: list[np.ndarray], column: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Matrix product of a block's presence rows with ``table``, over the roots of the texts' sizes."""
    presence = np.zeros((len(slots), len(table)), np.float32)
    for i, s in enumerate(slots):
        at = column[s]
        presence[i, at[at >= 0]] = 1
    return (presence @ table) / np.sqrt(np.maximum([len(s) for s in slots], 1))[:, None]


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, block = [], [], []

            def flush() -> None:
                if block and model is not None:
                    values = block_kernels(block, model.column, model.weights)
                    best = values.argmax(1)
                    for s, k, v in zip(block, best, values[np.arange(len(block)), best]):
                        names.append(model.languages[k] if len(s) else UNKNOWN)
                        scores.append(float(min(max((v + 1) / 2, 0), 1)) if len(s) else 0.0)
                elif block:
                    names.extend([UNKNOWN] * len(block))
                    scores.extend([0.0] * len(block))
                block.clear()

            for s in slots_of(batch.column(1)):
                block.append(s)
                if len(block) == BLOCK:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, lang_pred string, score double")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs, fit(docs, crc_class("doc_id", 4) != 2))
    return out.select("doc_id", F.coalesce(crc_class("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
