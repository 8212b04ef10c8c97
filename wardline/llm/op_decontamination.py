"""Benchmark decontamination, wholly in DataFrame operations.

The windows of the benchmark (10 words; a shorter item is one window) become a hash set of anchors: for each window
the ``GRAM``-word grams that begin in its first ``stride`` words. A training text is read at every ``stride``-th word only:
any occurrence of a window holds exactly one such position, so one look-up in the set finds it. Each hit is then verified
word by word against the window, so no hash collision survives.

The set is broadcast when it has at most ``BROADCAST_WINDOWS`` windows; beyond that the same join is left to Spark.
Nothing else is kept in memory, and the training texts are never shuffled: only hits are.

Nulls and edge cases: a null or empty text has no words and no hits; a null item text has no window; a null ``item_id``
is shown as the word ``null``; repeated documents each get their row; other columns are left alone. An empty benchmark
gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.hot import free_names
from wardline.llm.registry import query, table

#: Words of a window.
WINDOW = 10
#: Largest number of distinct windows whose set is broadcast (about 1 kB each).
BROADCAST_WINDOWS = 200_000
#: Not a word: ASCII but for digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same classes for text whose case is kept.
MIXED_BREAKS, MIXED_LETTERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """Normalised words of a text; no words for null."""
    plain = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ascii_only = F.octet_length(plain) == F.length(plain)  # there lower() is the same and faster
    return F.array_remove(F.split(F.when(ascii_only, F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER)), BREAKS), "")


def word_count(text: str) -> Column:
    """Number of normalised words, counted without changing case."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{MIXED_BREAKS}+"), "")).cast("long")


def gram_length(length: int) -> int:
    """Words of an anchor in windows of ``length`` words; with stride ``length - gram + 1`` one anchor lies in any window."""
    return (length + 1) // 2


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the items they come from: (n, body, items)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words("text").alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    at = items.select("item", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    body = at.select("item", "n", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("body"))
    return body.groupBy("n", "body").agg(F.sort_array(F.collect_set("item")).alias("items"))


def anchors_of(windows: DataFrame, length: int) -> DataFrame:
    """One row per anchor of the windows of ``length`` words: (anchor, entries of (shift, body, items))."""
    gram = gram_length(length)
    w = F.split("body", " ")
    shifts = F.explode(F.sequence(F.lit(0), F.lit(length - gram)))
    rows = windows.where(F.col("n") == length).select("body", "items", w.alias("w"), shifts.alias("shift"))
    return (
        rows.select(F.xxhash64(F.slice("w", F.col("shift") + 1, F.lit(gram))).alias("anchor"), F.struct("shift", "body", "items").alias("entry"))
        .groupBy("anchor").agg(F.collect_list("entry").alias("entries"))
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Verified window occurrences per text: (doc_id, text_hash, starts: array of (start, n), items)."""
    wins = windows_of(benchmark, window)
    sizes = {r["n"]: r["windows"] for r in wins.groupBy("n").agg(F.count("*").alias("windows")).collect()}  # at most ``window`` rows
    small = sum(sizes.values()) <= broadcast_windows
    found = None
    for length in sorted(sizes):
        gram, stride = gram_length(length), length - gram_length(length) + 1
        read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("w"))
        # Outer, and without a filter on the number of words: a filter would be pushed down and split every text once more.
        places = F.sequence(F.lit(0), F.greatest(F.size("w") - gram, F.lit(0)), F.lit(stride))
        at = read.select("doc_id", "text_hash", "w", F.explode_outer(places).alias("at"))
        # Only the words that a window through the anchor can reach go on, never the whole text.
        begin = F.greatest(F.col("at") - (stride - 1), F.lit(0))
        keyed = at.select(
            "doc_id", "text_hash", "at", F.xxhash64(F.slice("w", F.col("at") + 1, F.lit(gram))).alias("anchor"),
            begin.alias("begin"), F.slice("w", begin + 1, F.col("at") - begin + length).alias("near"),
        )
        anchors = anchors_of(wins, length)
        met = keyed.join(F.broadcast(anchors) if small else anchors, "anchor")
        # Verified after the texts' hits are together: a filter before would become a join condition that keeps whole rows.
        hit = F.struct("at", "begin", "near", "entries", F.lit(length).alias("n")).alias("hit")
        met = met.select("doc_id", "text_hash", hit).groupBy("doc_id", "text_hash").agg(F.collect_set("hit").alias("met"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, starts array<struct<start:int,n:int>>, items array<string>")
    true = F.flatten(F.transform("met", lambda h: F.transform(
        F.filter(h["entries"], lambda e: _here(h, e)), lambda e: F.struct((h["at"] - e["shift"]).alias("start"), h["n"].alias("n"), e["items"].alias("items"))
    )))
    one = found.select("doc_id", "text_hash", F.explode(true).alias("t")).select("doc_id", "text_hash", F.struct("t.start", "t.n").alias("span"), "t.items")
    return one.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("span")).alias("starts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _here(h: Column, e: Column) -> Column:
    """Whether the window of an anchor's entry lies around the anchor, word for word."""
    start = h["at"] - e["shift"]
    return (start >= 0) & (F.array_join(F.slice(h["near"], F.greatest(start - h["begin"], F.lit(0)) + 1, h["n"]), " ") == e["body"])


def covered(starts: str) -> Column:
    """Number of words inside the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
        (a["n"] + F.greatest(s["start"] + s["n"] - F.greatest(a["end"], s["start"]), F.lit(0)).cast("long")).alias("n"),
    )
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with ``hit_starts`` and ``hit_items`` (null where clean); names that ``docs`` has already get underscores."""
    return _marked(docs, benchmark, window, broadcast_windows)[0]


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, str]:
    """``with_hits`` and the name of its column of hit starts."""
    doc, digest, starts, items = free_names(docs, "hit_doc", "hit_hash", "hit_starts", "hit_items")
    found = hits(docs, benchmark, window, broadcast_windows).select(
        F.col("doc_id").alias(doc), F.col("text_hash").alias(digest), F.col("starts").alias(starts), F.col("items").alias(items)
    )
    same = docs["doc_id"].eqNullSafe(found[doc]) & (F.xxhash64(docs["text"]) == found[digest])
    return docs.join(found, same, "left").drop(doc, digest), starts


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words hit, items met."""
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_count("text").alias("n_words"))
    found = hits(docs, benchmark, window).select(F.col("doc_id").alias("hit_doc"), F.col("text_hash").alias("hit_hash"), "starts", "items")
    same = counted["doc_id"].eqNullSafe(found["hit_doc"]) & (counted["text_hash"] == found["hit_hash"])
    n_hit = F.coalesce(covered("starts"), F.lit(0).cast("long"))
    return counted.join(found, same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window. The set of contaminated keys stays a join, never a list on the driver."""
    found = hits(docs, benchmark, window).select(F.col("doc_id").alias("hit_doc"), F.col("text_hash").alias("hit_hash"))
    same = docs["doc_id"].eqNullSafe(found["hit_doc"]) & (F.xxhash64(docs["text"]) == found["hit_hash"])
    return docs.join(found, same, "left_anti")


def clean_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words, and the separators before each of them, cut out of ``text``."""
    marked, starts = _marked(docs, benchmark, window)
    pieces = F.regexp_extract_all("text", F.lit(f"({MIXED_BREAKS}*{MIXED_LETTERS}+)"), 1)  # one per word, whatever its case
    kept = F.filter(pieces, lambda p, i: ~F.exists(starts, lambda s: (i >= s["start"]) & (i < s["start"] + s["n"])))
    cut = F.concat(F.array_join(kept, ""), F.regexp_extract("text", f"({MIXED_BREAKS}*)$", 1))
    return marked.withColumn("text", F.when(F.col(starts).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


_W = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_W}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_W}) AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS n, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS body FROM bw),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n),
dg AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS body FROM dw),
hit AS (SELECT doc_id, k, dg.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.body = win.body),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


@query("op10_benchmark_decontamination", _SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
