"""Readers and sinks: batches, result tables, JSON evidence, event logs, quarantine, contract files."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as JavaColumn

from wardline.operators.contract import Contract
from wardline.sources.tables import work_dir  # noqa: F401

EVENT_SCHEMA = "timestamp_utc timestamp, event_type string, payload string"


def read_batch(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a batch; a missing path raises. CSV needs a schema: nothing is inferred by a second pass."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV batches need an explicit schema")
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write a result table; one file per task, none gathered on one executor."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def sorted_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, keys in sorted order, NULLs kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_json_evidence(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    sorted_json(df).write.mode(mode).text(path)


def event_rows(df: DataFrame, event_type: str | None = None, at: str | None = None) -> DataFrame:
    """Rows as events: payload is the row's JSON. Pass ``at`` to keep retries byte-identical."""
    skip = {c for c in ("event_type", at) if c and c in df.columns}
    body = F.to_json(F.struct(*sorted(c for c in df.columns if c not in skip)))
    return df.select(
        (F.col(at) if at else F.current_timestamp()).alias("timestamp_utc"),
        (F.lit(event_type) if event_type else F.col("event_type")).alias("event_type"),
        body.alias("payload"),
    )


def append_events(events: DataFrame, path: str) -> None:
    events.select("timestamp_utc", "event_type", "payload").write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path)


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The event log as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)


def quarantine(df: DataFrame, decisions: DataFrame, path: str, batch: str = "batch_name") -> None:
    """Write blocked batches whole, each under its own partition.

    ``decisions`` has one row per batch; Spark picks the join.
    """
    blocked = decisions.where(F.col("decision") == "BLOCK").select(batch)
    df.join(blocked, batch, "left_semi").write.mode("append").partitionBy(batch).parquet(path)


def streamed_sha256(spark: SparkSession, path: Column) -> Column:
    """SHA-256 of the bytes of the file at ``path``, read as a stream on the executors: no file is ever held as a value, of any size.

    Spark's own file value ends at 2 GiB and is whole in memory, and Python cannot open every store that Spark reads. So this is
    ``new DigestUtils("SHA-256").digestAsHex(new AutoCloseInputStream(p.getFileSystem(conf).open(p)))`` for ``p = new Path(path)``,
    put together from Spark's expressions for method calls; the stream closes itself at its end. ``conf`` is what readers of this
    session get.
    """
    jvm = spark._jvm
    sql, hadoop = jvm.org.apache.spark.sql, "org.apache.hadoop"
    catalyst, text = sql.catalyst.expressions, "java.lang.String"
    seq = lambda *items: jvm.org.apache.spark.api.python.PythonUtils.toSeq(list(items))
    kind = lambda name: jvm.org.apache.spark.util.Utils.classForName(name, True, False)
    of = lambda name: sql.types.ObjectType(kind(name))

    def new(name: str, *args: Any) -> Any:
        return catalyst.objects.NewInstance(kind(name), seq(*args), seq(), True, of(name), jvm.scala.Option.empty())

    def call(on: Any, method: str, gives: str, *args: Any) -> Any:
        return catalyst.objects.Invoke(on, method, of(gives), seq(*args), seq(), True, True, True)

    settings = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    conf = call(catalyst.Literal.fromObject(settings), "value", f"{hadoop}.conf.Configuration")
    at = new(f"{hadoop}.fs.Path", call(sql.classic.ExpressionUtils.expression(path._jc), "toString", text))
    opened = call(call(at, "getFileSystem", f"{hadoop}.fs.FileSystem", conf), "open", f"{hadoop}.fs.FSDataInputStream", at)
    digest = new("org.apache.commons.codec.digest.DigestUtils", catalyst.Literal.fromObject("SHA-256", of(text)))
    found = call(digest, "digestAsHex", text, new("org.apache.commons.io.input.AutoCloseInputStream", opened))
    utf8, string = kind("org.apache.spark.unsafe.types.UTF8String"), sql.types.DataTypes.StringType
    out = catalyst.objects.StaticInvoke(utf8, string, "fromString", seq(found), seq(), True, True, True, jvm.scala.Option.empty())
    return JavaColumn(sql.classic.ExpressionUtils.column(out))


def file_hashes(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, sha256, size_bytes) of the artifacts directly below ``paths`` whose names match ``glob``, or of files named by path.

    An artifact is a file or a folder, as Spark writes tables. A file has the SHA-256 of its bytes. A folder has the SHA-256 of
    one line ``<path inside it> <SHA-256 of that file>`` per file, in path order, each file hashed by itself; files
    that Spark's readers skip (names that begin with ``_`` or ``.``) are no part of it. Bytes are streamed, never held whole.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = reader.load([f"{r.rstrip('/')}/{glob}" for r in roots] if glob else roots)
    local = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    inside = F.lit(None).cast("string")
    for root in roots:
        head = F.concat(local(F.lit(root.rstrip("/"))), F.lit("/"))
        inside = F.coalesce(inside, F.when(F.startswith(local("path"), head), F.substr(local("path"), F.length(head) + 1)))
    part = F.coalesce(F.nullif(F.regexp_extract(inside, r"^[^/]+/(.+)$", 1), F.lit("")), F.lit(""))
    files = found.select("path", part.alias("part"), streamed_sha256(spark, F.col("path")).alias("sha256"), F.col("length").alias("size_bytes"))
    above = F.substr("path", F.lit(1), F.length("path") - F.length("part") - 1)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda x: F.concat_ws(" ", x["part"], x["sha256"]))
    one = F.max("part") == ""
    return files.groupBy(F.when(F.col("part") == "", F.col("path")).otherwise(above).alias("path")).agg(
        F.when(one, F.max("sha256")).otherwise(F.sha2(F.array_join(lines, "\n"), 256)).alias("sha256"), F.sum("size_bytes").alias("size_bytes")
    )


def load_contract(path: str) -> Contract:
    """Contract from a JSON file, or YAML where a YAML reader is installed."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    payload: Any
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:  # pragma: no cover
            raise ValueError("YAML contracts need a YAML reader; use JSON") from error
        payload = yaml.safe_load(text)
    else:
        payload = json.loads(text)
    return Contract.from_dict(payload)
