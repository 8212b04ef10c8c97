"""Token counts as delta-maintained rollups.

A rollup holds documents and tokens per source, language and tokenizer version. It is never recomputed: a batch of changes, each
with a document's values before and after (no before: an insert; no after: a delete; both: a revision), becomes signed sums per
key, and a total is the sum of the deltas of all committed batches. Sums are combined per task before the shuffle, so a source
with a third of all rows is one row per task.

A batch is committed under its id: its deltas are written to a folder of that id and count once Spark has committed the write
(its ``_SUCCESS`` file). Committing an id again changes nothing, whether the first try ended or not: a finished one is left as it is,
an unfinished one is written anew. So a driver may repeat any batch after a failure. ``compact`` folds committed batches into a
snapshot that names them.

Nulls and edge cases: a null source or language is a key of its own; a null or empty text has no tokens; a repeated change counts
again (deduplicate the feed if it may repeat within a batch); keys whose documents and tokens are both zero are not shown; an empty
batch commits nothing but its id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.op_tokens import Encoder, tokenizer_path
from wardline.llm.registry import query, table
from wardline.sources.tables import stored, work_dir

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """A folder of committed deltas; one batch is one folder in it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.folder}/batch={batch}/_SUCCESS")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was there already. ``changes``: before and after, structs of KEYS and n_tokens, or null."""
        if not batch or any(c in batch for c in "/=\\ "):
            raise ValueError("a batch id is a plain name")
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        """Ids of committed batches."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self.committed(n.removeprefix("batch=")))

    def totals(self) -> DataFrame:
        """Documents and tokens per key over all committed batches."""
        paths = [f"{self.folder}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*paths)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, target: str) -> "Rollup":
        """A rollup in ``target`` with one snapshot in the place of this one's batches; their ids stay committed there."""
        new = Rollup(self.spark, target)
        ids = self.batches()
        self.totals().write.mode("overwrite").parquet(f"{new.folder}/batch=snapshot-of-{len(ids)}")  # first: a reader never sees less
        for b in ids:
            if not new.committed(b):
                self.spark.createDataFrame([], _DELTA).write.mode("overwrite").parquet(f"{new.folder}/batch={b}")
        return new


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per key of a batch of changes."""
    def side(name: str, sign: int) -> Column:
        got = F.col(name)
        return F.struct(*[got[k].cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("n_docs"), (sign * F.coalesce(got["n_tokens"], F.lit(0))).cast("long").alias("n_tokens"))

    both = F.array_compact(F.array(F.when(F.col("before").isNotNull(), side("before", -1)), F.when(F.col("after").isNotNull(), side("after", 1))))
    rows = changes.select(F.explode(both).alias("d")).select("d.*")
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, digest) of every row; the digest names equal texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            n = np.concatenate([counts for _, _, counts in encoder.batches(batch.column(4))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n)], names=["doc_id", "source", "lang", "digest", "n_tokens"])

    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), digest.alias("digest"), F.col("text").cast("string"))
    return rows.mapInArrow(read, "doc_id long, source string, lang string, digest string, n_tokens long")


def image(tokenizer: str, n_tokens: Column | None = None) -> Column:
    """One side of a change."""
    n = F.col("n_tokens") if n_tokens is None else n_tokens
    return F.struct("source", "lang", F.lit(tokenizer).alias("tokenizer"), n.alias("n_tokens"))


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: load; delete exact copies (the smallest id stays); move a language to the next tokenizer
    version, which appends an end token. The second is committed twice."""
    rows = stored(counted(table(spark, sf_dir, "documents"), tokenizer_path()), "token-counts")
    none = F.lit(None).cast("struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("kept_id"))
    marked = rows.join(first, "digest").withColumn("kept", F.col("doc_id") == F.col("kept_id"))
    rollup = Rollup(spark, work_dir(spark, "token-rollup"))
    copies = marked.where("NOT kept").select(image("byte_bpe_50k.v1").alias("before"), none.alias("after"))
    rollup.commit("load", rows.select(none.alias("before"), image("byte_bpe_50k.v1").alias("after")))
    rollup.commit("copies", copies)
    moved = marked.where("kept AND lang <> 'en'")
    rollup.commit("version-2", moved.select(image("byte_bpe_50k.v1").alias("before"), image("byte_bpe_50k.v2", F.col("n_tokens") + 1).alias("after")))
    rollup.commit("copies", copies)
    return rollup.totals()
