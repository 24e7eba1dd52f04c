"""Written intermediates: tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_stored: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may leave it unset and then uses a folder of this process."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="driftline-fit-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, and safe from the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``; nothing may read it any more."""
    _delete(df.sparkSession.sparkContext, df.stored_path)


def discard_all() -> None:
    """Delete all that this process has stored; results that were not written elsewhere can no longer be read.

    A driver that ends while its session is alive does this by itself.
    """
    context = SparkContext._active_spark_context
    while _stored and context is not None:
        _delete(context, _stored[-1])


def _delete(context: SparkContext, name: str) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if name in _stored:
        _stored.remove(name)


atexit.register(discard_all)
