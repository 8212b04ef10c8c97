"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

*Lexicon.* Words and word stems that labelled toxic texts have and others hardly ever have are candidates; a greedy cover then
takes those that explain most toxic texts, each text up to ``COVER`` times, so copies of one text add little.
*Matching.* The lexicon is a trie; the Levenshtein automata of its entries are intersected with it once (see ``automaton``),
and every word of every whole text runs through the result, so misspelled terms are met at the cost of exact ones.
*Context.* A hit counts by its window: is it inside quotation marks, do others stand within ``WINDOW`` words? Per text these
counts go into a logistic regression, which weighs exact, misspelled, quoted and clustered hits against the length.

Learning uses a bounded sample: at most ``MAX_TOXIC`` and ``MAX_OTHER`` labelled texts, whole, distinct by text. The driver gets
counts of at most ``MAX_CANDIDATES`` terms and one short feature row per sampled text. Scoring is one pass over the texts
without a shuffle; memory is one batch.

Nulls and edge cases: a null or empty text has no hits and gets the score of that; labels that are null are ignored, the larger
of several labels of a text counts; without labelled texts of both kinds every score is the toxic share (0 without any);
repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import automaton
from wardline.llm import words as W
from wardline.llm.registry import query, table
from wardline.llm.sampling import crc_class, smallest_hashes

MAX_TOXIC, MAX_OTHER = 3000, 6000
MAX_CANDIDATES, MAX_ENTRIES = 3000, 200
#: Times that one toxic text may ask for another entry.
COVER = 4
#: A candidate's share of other texts is at most this part of its share of toxic ones.
MAX_RATIO = 0.02
MIN_TEXTS = 3
#: Words on either side of a hit that make its context.
WINDOW = 8
STEMS = (4, 5, 6)
_QUOTES = np.zeros(automaton.BMP, bool)
_QUOTES[[ord(c) for c in "\"“”„«»‟"]] = True
FEATURES = ("plain_exact", "plain_misspelled", "quoted", "clustered", "per_word")


@dataclass
class Model:
    entries: list[str]
    automaton: automaton.Automaton | None
    weights: np.ndarray  # of FEATURES, then the constant

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _chars(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the chunk, and the texts' offsets in them."""
    text = data.tobytes().decode("utf-8", "replace")
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    low = chars < automaton.BMP
    lowered = chars.copy()
    lowered[low] = automaton.LOWER_CHARS[chars[low]]
    return lowered, heads[offsets]


def features(texts: pa.Array, auto: automaton.Automaton | None) -> np.ndarray:
    """One row of FEATURES per text."""
    out = []
    for _, _, data, offsets in W.chunks(texts):
        chars, at = _chars(data, offsets)
        plane = np.minimum(chars, automaton.BMP - 1)
        starts, ends, first = W.spans(plane, at, automaton.IS_WORD)
        n = len(at) - 1
        size = np.diff(first)
        f = np.zeros((n, len(FEATURES)))
        near = auto.run(chars, starts, ends) if auto is not None and len(starts) else np.full(len(starts), -1, np.int8)
        hit = np.flatnonzero(near >= 0)
        if len(hit):
            text = np.searchsorted(first, hit, side="right") - 1
            marks = np.zeros(len(chars) + 1, np.int64)
            np.cumsum(_QUOTES[plane], out=marks[1:])
            before = marks[starts[hit]] - marks[at[text]]
            quoted = (before % 2 == 1) & (marks[at[text + 1]] - marks[ends[hit]] > 0)
            close = np.zeros(len(hit), bool)
            pair = (np.diff(hit) <= WINDOW) & (text[1:] == text[:-1])
            close[1:] |= pair
            close[:-1] |= pair
            for column, chosen in enumerate((~quoted & (near[hit] == 0), ~quoted & (near[hit] > 0), quoted, ~quoted & close)):
                f[:, column] = np.bincount(text[chosen], minlength=n)
            plain = f[:, 0] + f[:, 1]
            f[:, 4] = 10 * plain / np.maximum(size, 10)
            f[:, :4] = np.log1p(f[:, :4])
        out.append(f)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _terms(texts: pa.Array) -> list[set[str]]:
    """Distinct words and stems (with ``*``) of each text."""
    out = []
    for _, _, data, offsets in W.chunks(texts):
        chars, at = _chars(data, offsets)
        starts, ends, first = W.spans(np.minimum(chars, automaton.BMP - 1), at, automaton.IS_WORD)
        text = chars.astype("<u4").tobytes().decode("utf-32-le", "replace")
        for a, b in zip(first[:-1], first[1:]):
            words = {text[s:e] for s, e in zip(starts[a:b], ends[a:b]) if 3 <= e - s <= 40}
            out.append(words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
    return out


def training_rows(docs: DataFrame, labels: DataFrame, usable=None) -> DataFrame:
    """A bounded sample of labelled texts: (text, toxic), one row per distinct text and label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = smallest_hashes(known.where("toxic = 1"), MAX_TOXIC).unionByName(smallest_hashes(known.where("toxic <> 1"), MAX_OTHER))
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most MAX_TOXIC + MAX_OTHER ids
    return rows.where(F.col("text").isNotNull()).select("text", (F.col("toxic") == 1).cast("int").alias("toxic")).dropDuplicates()


def learn_lexicon(rows: DataFrame) -> tuple[list[str], int, int]:
    """Entries of the lexicon, and the numbers of toxic and other texts of the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for terms, toxic in zip(_terms(batch.column(0)), batch.column(1).to_pylist()):
                tally[toxic].update(terms)
        # a term that no toxic text of this task has is only needed if another task's toxic text has it, so all are sent
        for toxic, counts in tally.items():
            items = list(counts.items())
            for lo in range(0, len(items), 50_000):
                part = items[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in part], pa.string()), pa.array([toxic] * len(part), pa.int32()), pa.array([c for _, c in part], pa.int64())],
                    names=["term", "toxic", "texts"],
                )

    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = kinds.get(1, 0), kinds.get(0, 0)
    if not n_toxic or not n_other:
        return [], n_toxic, n_other
    counts = rows.mapInArrow(count, "term string, toxic int, texts long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("texts")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("texts")).otherwise(0)).alias("o")
    )
    rare = F.col("o") * n_toxic <= MAX_RATIO * F.col("t") * n_other
    top = counts.where((F.col("t") >= MIN_TEXTS) & rare).orderBy(F.desc("t"), "term").limit(MAX_CANDIDATES)
    candidates = {r["term"]: (r["t"], r["o"]) for r in top.collect()}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(t & candidates.keys()) for t in _terms(batch.column(0))], pa.list_(pa.string()))], names=["terms"])

    met = [r["terms"] for r in rows.where("toxic = 1").mapInArrow(meet, "terms array<string>").where(F.size("terms") > 0).collect()]
    return cover(met, candidates), n_toxic, n_other


def cover(texts: list[list[str]], candidates: dict[str, tuple[int, int]]) -> list[str]:
    """Greedy multiple cover of the toxic texts by candidates; among equals a whole word, then the longer term."""
    holders = defaultdict(list)
    for i, terms in enumerate(texts):
        for t in terms:
            holders[t].append(i)
    need = [COVER] * len(texts)
    least = max(MIN_TEXTS, math.ceil(len(texts) / 400))
    chosen: list[str] = []
    gain = {t: sum(need[i] for i in h) for t, h in holders.items()}
    while gain and len(chosen) < MAX_ENTRIES:
        best = max(gain, key=lambda t: (gain[t] / (1 + candidates[t][1]), not t.endswith("*"), len(t), t))
        fresh = sum(need[i] > 0 for i in holders[best])
        if fresh < least:
            del gain[best]
            continue
        chosen.append(best)
        del gain[best]
        stem = best.rstrip("*")
        for i in holders[best]:
            if need[i] > 0:
                need[i] -= 1
                for t in texts[i]:
                    if t in gain:
                        gain[t] -= 1
        for t in [t for t in gain if t.rstrip("*").startswith(stem) and (best.endswith("*") or t == best) or (t.endswith("*") and not best.endswith("*") and best.startswith(t[:-1]) and len(holders[t]) == len(holders[best]))]:
            del gain[t]  # met by the chosen entry already
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps of ridge-penalised logistic regression; the constant comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, usable=None) -> Model:
    """Learn lexicon and weights. Runs jobs over the sample."""
    from wardline.sources.tables import stored

    rows = stored(training_rows(docs, labels, usable), "toxic-sample")
    entries, n_toxic, n_other = learn_lexicon(rows)
    if not entries:
        share = n_toxic / (n_toxic + n_other) if n_toxic + n_other else 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model([], None, np.array([0.0] * len(FEATURES) + [math.log(share / (1 - share))]))
    auto = automaton.build(entries)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(features(batch.column(0), auto)), pa.list_(pa.float64())), batch.column(1)], names=["f", "toxic"])

    got = rows.mapInArrow(read, "f array<double>, toxic int").collect()
    x, y = np.array([r["f"] for r in got]), np.array([r["toxic"] for r in got], float)
    return Model(entries, auto, fit_logistic(x, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, hits) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features(batch.column(1), model.automaton)
            hits = np.rint(np.expm1(f[:, :3]).sum(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(f)), pa.array(hits)], names=["doc_id", "score", "hits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, score double, hits long")


def passing(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns, in one pass."""
    at = docs.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at), model.automaton)) < threshold))

    return docs.mapInArrow(read, docs.schema)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_class("doc_id", 5) != 0)
    out = scored(docs, model).withColumn("held_out", F.coalesce(crc_class("doc_id", 5) == 0, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")
