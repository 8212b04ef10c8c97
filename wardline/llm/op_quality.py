"""Quality rules at two levels: each text by itself, then its host.

Base rules fail a text that is too short or mostly made of repeated windows. Failures are then counted per host (here:
``source``), and each host's failure rate is shrunk towards the corpus by an empirical beta prior: the prior's mean and
strength are the moments of all hosts' rates, so a host with few texts keeps close to the common rate and a host with many
is judged by its own. A host whose shrunk rate is above ``MAX_RATE`` is rejected, and its verdict is joined back to its texts.

Per-text counts come from whole Arrow batches in NumPy (no per-word Python) and are stored once, because the host level
needs them before any text can be judged. Host counts are combined before the shuffle; a host with a third of all rows is
one row per task there. The join back is Spark's to choose; a hot host's partition can be split.

Nulls and edge cases: a null or empty text has no words (and so fails); texts without a host (null) are judged by the
prior alone; repeated rows count each; extra columns are ignored; with no rows there is no host and no output. Hosts that
all have the same rate give a prior of strength ``MAX_STRENGTH``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import words as W
from wardline.llm.registry import query, table
from wardline.sources.tables import stored

MIN_WORDS = 50
#: Per cent of a text's words in repeated 3-word windows that it may have.
MAX_REPEATED = 50
#: Shrunk failure rate above which a host is rejected.
MAX_RATE = 0.5
#: Texts that the prior weighs at most.
MAX_STRENGTH = 10_000.0
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_HEAD = np.zeros(256, bool)  # first byte of a code point
_HEAD[[b for b in range(256) if b & 0xC0 != 0x80]] = True
_LINE = np.ones(256, bool)
_LINE[10] = False
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries share row and hash with another entry."""
    order = np.lexsort((hashes, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    out = np.zeros(len(rows), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of every text of a column."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in COUNTS}
    for _, _, data, offsets in W.chunks(texts):
        starts, ends, first = W.spans(data, offsets, W.NOT_WHITE)
        rows, n_words = W.rows_of(first), np.diff(first)
        inside = _HEAD[data] & W.NOT_WHITE[data]
        # lines: a line counts if a word lies in it
        line_starts, line_ends, line_first = W.spans(data, offsets, _LINE)
        has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_rows = W.rows_of(line_first)[has_word]
        line_hashes = W.span_hashes(data, line_starts[has_word], line_ends[has_word])
        order = np.lexsort((line_hashes, line_rows))
        again = (line_rows[order][1:] == line_rows[order][:-1]) & (line_hashes[order][1:] == line_hashes[order][:-1])
        dup_lines = np.bincount(line_rows[order][1:][again], minlength=len(n_words))
        # windows of three words of one text that occur again in it
        grams = W.gram_hashes(W.span_hashes(data, starts, ends), 3)
        whole = rows[: len(grams)] == rows[2:] if len(grams) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        twice = at[_repeats(rows[at], grams[at])]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[twice + k] = True
        for name, value in zip(COUNTS, (
            n_words, _per_text(inside, offsets), _per_text(_SYMBOLS[data], offsets), dup_lines, _per_text(covered, first)
        )):
            parts[name].append(value.astype(np.int64))
    return {name: np.concatenate(v) if v else np.zeros(0, np.int64) for name, v in parts.items()}


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, counts, base_failed) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(counts[c]) for c in COUNTS)], names=["doc_id", "host", *COUNTS]
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string"))
    counted = read.mapInArrow(count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, texts, failed) of every named host."""
    return counted.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("texts"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )


def beta_prior(hosts: DataFrame, max_strength: float = MAX_STRENGTH) -> tuple[float, float]:
    """(mean, strength) of the beta prior by the moments of the hosts' rates, each host weighing its texts; one row is read.

    Weighted variance of rates = mean (1 - mean) (1 / (strength + 1)) plus sampling noise; the noise part is taken off.
    """
    rate = F.col("failed") / F.col("texts")
    row = hosts.select(
        F.count("*").alias("k"), F.sum("texts").alias("n"), F.sum("failed").alias("f"),
        F.sum(F.col("failed") * rate).alias("s2"),
    ).first()
    if not row["k"]:
        return 0.0, max_strength
    mean = row["f"] / row["n"]
    spread = row["s2"] / row["n"] - mean * mean
    noise = mean * (1 - mean) * row["k"] / row["n"]
    extra = spread - noise
    if mean * (1 - mean) == 0 or extra <= 0:
        return mean, max_strength
    return mean, min(max_strength, max(1.0, mean * (1 - mean) / extra - 1))


def judged(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Counts, base verdict, shrunk host rate and final verdict of every row. Runs the counting job when called."""
    counted = stored(base_counts(docs, host), "quality")
    hosts = host_rates(counted)
    mean, strength = beta_prior(hosts)
    shrunk = (F.col("failed") + F.lit(mean) * F.lit(strength)) / (F.col("texts") + F.lit(strength))
    rates = hosts.select("host", shrunk.alias("host_rate"))
    rate = F.coalesce("host_rate", F.lit(mean))
    return counted.join(rates, "host", "left").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (rate <= max_rate)).alias("kept"), rate.alias("host_rate")
    )


_SQL = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM
        (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
c AS (SELECT w.doc_id, w.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT count(*) AS k, sum(n) AS n, sum(bad) / sum(n) AS mean, sum(bad * (bad / n)) / sum(n) - (sum(bad) / sum(n)) * (sum(bad) / sum(n)) AS spread FROM h),
p AS (SELECT coalesce(mean, 0) AS mean, CASE WHEN k = 0 OR mean * (1 - mean) = 0 OR spread - mean * (1 - mean) * k / n <= 0 THEN {MAX_STRENGTH}
        ELSE least({MAX_STRENGTH}, greatest(1, mean * (1 - mean) / (spread - mean * (1 - mean) * k / n) - 1)) END AS strength FROM m),
r AS (SELECT source, (bad + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(rate, mean) <= {MAX_RATE} AS kept
FROM p, f LEFT JOIN r ON f.source = r.source
"""


@query("op6_quality_rules", _SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("host_rate")
