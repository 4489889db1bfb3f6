"""Shared scratch tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_OWN: dict[str, str] = {}
_WRITTEN: dict[str, None] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of one Arrow batch on its way to Python, unless the session says otherwise.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers started by this session import this package, and get batches of bounded bytes."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *[p for p in known if p and p != _ROOT]])
    if _ARROW not in spark.conf.getAll:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a local one only where that is unset and the executors share this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(_remove, _OWN[key])
    return f"file://{_OWN[key]}"


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its shuffle files deleted as soon as it is done."""
    before = _CLEANUP in spark.conf.getAll and spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before:
            spark.conf.set(_CLEANUP, before)
        else:
            spark.conf.unset(_CLEANUP)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the scratch folder and read it back.

    The copy has known sizes, so later joins broadcast it only below
    spark.sql.autoBroadcastJoinThreshold and shuffle it otherwise. The shuffle files of the
    query that made it are deleted at once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = None
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._scratch_path = path
    return copy


#: Rows that dealt() gives a task.
DEALT_ROWS = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table dealt by keys in so many parts that a task sorts about DEALT_ROWS rows, or one key's if that has more, whatever the table's size."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // DEALT_ROWS)), *keys)


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that table() returned, once nothing that is still to run reads them."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path in _WRITTEN:
            _delete(df.sparkSession, path)
            del _WRITTEN[path]


def shared_folder(spark: SparkSession, name: str) -> str | None:
    """Path of a new folder's name in the scratch folder, for tasks that open files there by themselves; None if that is no folder of files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() != "file":
        return None
    _WRITTEN[f"file://{path.toUri().getPath()}"] = None
    return path.toUri().getPath()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder whose name shared_folder gave."""
    _delete(spark, f"file://{path}")
    _WRITTEN.pop(f"file://{path}", None)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this driver; call it when no result that reads them is needed any more."""
    for path in list(_WRITTEN):
        _delete(spark, path)
    _WRITTEN.clear()
