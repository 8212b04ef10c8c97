"""Filter interaction audit: what five filters remove in every order, from one word per document.

A document fails some of the filters A to E. Its truth-table survival word has one bit for each of the 32 subsets of
filters; a bit is set where the document passes every filter of that subset. The number of documents with a bit set is
the number that survive the subset, so 32 counts per part and label answer every order and every step:

- kept after a step: survivors of the order's first filters; removed: the difference to the step before;
- redundant: what fails the filter, without what it removes; unique failures: survivors of the other four, less those of all;
- the Shapley sum: what a filter removes from the survivors of each subset without it, times the orders that begin so.

The words are counted by carry-save adders: three words of one weight become a sum word and a carry word of the next
weight, for all 32 bits at once, until at most two words of each weight are left. Tasks add up their own rows and send
32 counts per part; no group is ever gathered.

Filter E (an equal text with a smaller id) takes one grouped minimum per text digest (SHA-256) and one join on digest and
id together, so a text with very many copies is no hot key of the join.

Nulls and edge cases: a null text is the empty text; a null ``lang`` is the part ``''`` (as is an empty one); a null
``doc_id`` is larger than none, so it never fails E, and has no labels; repeated rows all count, and rows with one id are
no copies of each other; a document is good or toxic if any of its label rows says 1; other columns are ignored; an empty
table has no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.registry import query, table
from wardline.sources.tables import stored

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Parts that a task holds before it sends its counts on.
HELD_PARTS = 4096
#: Survival words by failed filters (bit k: fails filter k): bit s is set where the document passes all of subset s.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)
COUNTS_SCHEMA = "part string, subset int, kept long, good long, toxic long"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    tests = (
        n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]"),
    )
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed) of every row, without the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return read.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), failures(F.col("text")).alias("failed"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, failed, good, toxic) of every row, all five filters and both labels included."""
    rows = stored(facts(docs), "facts")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (
        rows.join(firsts, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
        .select(
            "doc_id", "part", (F.col("failed") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).cast("int").alias("failed"),
            F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
    )


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            n = len(words) // 3 * 3
            a, b, c = words[:n].reshape(3, -1)
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[n:]])
        bits = np.unpackbits(np.ascontiguousarray(words, "<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
        counts += weight * bits.sum(0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], weight * 2
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def send() -> pa.RecordBatch:
        parts, counts = list(held), np.stack(list(held.values()))
        held.clear()
        subsets = np.tile(np.arange(SUBSETS, dtype=np.int32), len(parts))
        columns = [pa.array(np.repeat(np.array(parts, object), SUBSETS), pa.string()), pa.array(subsets)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[:, k].ravel()) for k in range(3))], names=["part", "subset", "kept", "good", "toxic"])

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        codes, words = coded.indices.to_numpy(), SURVIVAL[batch.column(1).to_numpy()]
        good, toxic = (pc.cast(batch.column(k), pa.int8()).to_numpy().astype(bool) for k in (2, 3))
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
        for part, rows in zip(coded.dictionary.to_pylist(), np.split(order, ends[:-1])):
            mine = words[rows]
            counts = np.stack([positional_popcount(x) for x in (mine, mine[good[rows]], mine[toxic[rows]])])
            held[part] = held[part] + counts if part in held else counts
            if len(held) >= HELD_PARTS:
                yield send()
    if held:
        yield send()


def survivors(rows: DataFrame) -> DataFrame:
    """(part, kept, good, toxic): three arrays, documents that survive each of the 32 subsets."""
    counts = rows.select("part", "failed", "good", "toxic").mapInArrow(_count, COUNTS_SCHEMA)
    summed = counts.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))
    cells = summed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("cells"))
    return cells.select("part", *(F.col(f"cells.{c}").alias(c) for c in ("kept", "good", "toxic")))


def shapley_sums(kept: str) -> Column:
    """Array of the five filters' sums over all orders."""
    n, sums = len(FILTERS), []
    for k in range(n):
        without = [s for s in range(SUBSETS) if not s >> k & 1]
        terms = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (F.col(kept)[s] - F.col(kept)[s | 1 << k]) for s in without]
        sums.append(sum(terms[1:], terms[0]))
    return F.array(*sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    n, orders = len(FILTERS), ["".join(p) for p in permutations(FILTERS)]
    places = [FILTERS.index(letter) for order in orders for letter in order]
    before = [sum(1 << FILTERS.index(x) for x in order[:k]) for order in orders for k in range(n)]
    wide = survivors(judged(docs, labels)).withColumn("sums", shapley_sums("kept"))
    at = lambda values: F.lit(values)[F.col("at")]
    rows = wide.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(places) - 1)))).select(
        "*", at(places).alias("place"), at(before).alias("held"), at([s | 1 << k for s, k in zip(before, places)]).alias("then"),
        at([1 << k for k in places]).alias("alone"), at([SUBSETS - 1 - (1 << k) for k in places]).alias("others"),
    )
    fall = lambda name: F.col(name)[F.col("held")] - F.col(name)[F.col("then")]
    n_kept = lambda subset: F.col("kept")[F.col(subset)]
    return rows.select(
        "part", F.lit(orders)[F.floor(F.col("at") / n).cast("int")].alias("filter_order"), (F.col("at") % n + 1).alias("step"),
        n_kept("then").alias("kept"), fall("kept").alias("removed"),
        (F.col("kept")[0] - n_kept("alone") - fall("kept")).alias("redundant"), (n_kept("others") - F.col("kept")[SUBSETS - 1]).alias("unique_fails"),
        fall("good").alias("good_lost"), fall("toxic").alias("toxic_lost"), F.col("sums")[F.col("place")].alias("shapley"),
    )


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM split LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, s::INT AS step, substr(filter_order, s::INT, 1) AS f, substr(filter_order, 1, s::INT) AS upto,
    substr(filter_order, 1, s::INT - 1) AS held FROM orders, range(1, 6) r(s)),
audit AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN translate(upto, fails, '') = upto THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(held, fails, '') = held THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(held, fails, '') <> held THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(held, fails, '') = held THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(held, fails, '') = held THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM audit
"""


@query("op11_filter_audit", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
