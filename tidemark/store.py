"""Results kept by fingerprint: a table is computed once for all queries and runs that ask for the same of the same inputs."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame

from tidemark.scratch import scratch_dir


#: Setting that names a part of the store for a session to use alone; a new name begins with nothing.
PART = "tidemark.store.part"


@cache
def _code() -> str:
    """Digest of this package's source: a result of other code is another result."""
    digest = hashlib.sha256()
    root = Path(os.path.dirname(os.path.abspath(__file__)))
    for f in sorted(root.rglob("*.py")):
        digest.update(f"{f.relative_to(root)}\0".encode() + f.read_bytes())
    return digest.hexdigest()


def fingerprint(df: DataFrame, name: str, signature: str = "") -> str:
    """Digest of a name, a signature (such as that of the folds), this code, the plan of df, and path, length and time of every file it reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append((f, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([name, signature, _code(), df.semanticHash(), df.schema.json(), files]).encode()).hexdigest()


def stored(df: DataFrame, name: str, signature: str = "", build: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df, or what build makes of it, read from the store if the fingerprint of df is there, else written to it first.

    The store lies in the scratch folder (spark.checkpoint.dir), where it outlives the
    session. A result is written under a name of its own and then moved, so one that is there
    is whole; a changed input, plan, signature or code has another fingerprint. build is
    called only if its result is not there. Without input files nothing is kept.
    """
    if not df.inputFiles():
        return build(df) if build else df
    spark = df.sparkSession
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part = spark.conf.get(PART, None)
    path = f"{scratch_dir(spark).rstrip('/')}/store/{f'{part}/' if part else ''}{name}-{fingerprint(df, name, signature)}"
    fs = path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path_of(path)):
        own = f"{path}.{uuid.uuid4().hex}"
        (build(df) if build else df).write.option("compression", "zstd").parquet(own)
        fs.mkdirs(path_of(path).getParent())
        if not fs.rename(path_of(own), path_of(path)):  # another run was first
            fs.delete(path_of(own), True)
    return spark.read.parquet(path)
