"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local run without that setting gets one folder of its own, removed when Python ends.
    """
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/wardline-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a shared folder")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="wardline-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_work(spark: SparkSession) -> bool:
    """Remove everything this application has stored. Call it when no returned DataFrame is needed any more."""
    return _removed(spark, shared_folder(spark))


def _removed(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back: computed once, lineage cut, safe against lost executors.

    Used where a reduced table feeds several later steps. Column pruning gives every use of a plain plan
    another exchange, so Spark would go back to the source for each of them.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove stored tables (what :func:`stored` returned) once all that was to be made of them is stored itself."""
    for df in tables:
        _removed(df.sparkSession, _folders.pop(df))
