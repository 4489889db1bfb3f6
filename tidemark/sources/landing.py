"""Landing and publishing: raw payloads with digests, partition choice, snapshots, manifests, registries, macro merges."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.upkeep import keep_last
from tidemark.scratch import ensure_importable

c = F.col


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Raw files with their size, sha256 and number of lines."""
    raw = spark.read.format("binaryFile").load(path)
    lines = F.size(F.split(F.decode("content", "ISO-8859-1"), "\n"))  # one character a byte
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), lines.alias("lines"), "content")


def decoded(files: DataFrame, key: str = "path", content: str = "content", fallback: str = "cp932") -> DataFrame:
    """(key, text) of bytes that are UTF-8, or else in the fallback encoding, unreadable bytes replaced.

    Spark's own decode knows only the Unicode encodings, so this runs over Arrow batches.
    """
    ensure_importable(files.sparkSession)

    def text(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(fallback, errors="replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(text, b.column(1).to_pylist()), pa.string())], names=[key, "text"])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, text string")


def price_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Raw partitions of a folder where there are any, else the canonical table beside them."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    raw = fs_path(f"{folder}/raw")
    fs = raw.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.exists(raw) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(raw))
    return spark.read.parquet(f"{folder}/raw" if found else f"{folder}/canonical")


def publish(df: DataFrame, folder: str, stamp: str) -> None:
    """Write a stamped snapshot, then the latest one from it; a reader of the snapshot never sees it change."""
    df.write.mode("errorifexists").parquet(f"{folder}/snapshot={stamp}")
    df.sparkSession.read.parquet(f"{folder}/snapshot={stamp}").write.mode("overwrite").parquet(f"{folder}/latest")


def write_json(path: str, value: dict) -> None:
    """Write a small document so that a reader sees the old or the new one, never a part."""
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True, indent=2, default=str)
    os.replace(temp, path)


def fingerprint(paths: Sequence[str]) -> str:
    """sha256 over names and digests of driver-side files, in order of name."""
    total = hashlib.sha256()
    for p in sorted(paths):
        with open(p, "rb") as f:
            total.update(f"{os.path.basename(p)}\0{hashlib.sha256(f.read()).hexdigest()}\n".encode())
    return total.hexdigest()


def manifest(df: DataFrame, name: str, keys: Sequence[str]) -> dict:
    """Rows, columns and an order-free digest of a table."""
    parts = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("rows"), parts.alias("sum")).first()
    return {"name": name, "rows": r["rows"], "keys": list(keys), "columns": {k: t for k, t in df.dtypes}, "digest": hashlib.sha256(str(r["sum"]).encode()).hexdigest()}


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated registry with a heading; blank cells are null."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.select(*[F.nullif(F.trim(x), F.lit("")).alias(x) for x in raw.columns])


def merge_macro(old: DataFrame, new: DataFrame, now: Column, required: Sequence[str], days: int = 10) -> tuple[DataFrame, DataFrame]:
    """(series, problems): union with the newer row kept, rows not yet available dropped; problems name families that are missing or stale."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    series = keep_last(both, ["family", "session_date"], [c("__new").desc(), c("available_at").desc_nulls_last()]).drop("__new").where(c("available_at") <= now)
    last = series.groupBy("family").agg(F.max("session_date").alias("last_session"))
    wanted = old.sparkSession.createDataFrame([(x,) for x in required], "family string")
    late = F.date_diff(F.to_date(now), c("last_session")) > days
    problem = F.when(c("last_session").isNull(), "missing").when(late, "stale")
    return series, wanted.join(last, "family", "left").withColumn("problem", problem).where("problem is not null")


def markdown(df: DataFrame, columns: Sequence[str], limit: int = 100) -> str:
    """Markdown table of the first rows, for a report."""
    rows = df.select(*columns).limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[x]) for x in columns) + " |" for r in rows])


def with_previous_lines(lines: DataFrame, keys: Sequence[str], order: str, text: str, n: int = 4) -> DataFrame:
    """Each line with the n lines before it, nearest first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    return lines.withColumn("previous", F.filter(F.array(*[F.lag(text, k).over(w) for k in range(1, n + 1)]), lambda x: x.isNotNull()))
