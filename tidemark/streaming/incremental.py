"""Structured Streaming: incremental tables, windows over event time, delayed outcomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.upkeep import upsert

c = F.col


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """events with a watermark; a stream's time column without zone is taken as the session's."""
    return (events.withColumn(time, c(time).cast("timestamp")) if events.isStreaming else events).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, length: str, late: str, keys: Sequence[str], *aggregates) -> DataFrame:
    w = F.window(c(time), length)
    return timed(events, time, late).groupBy(w.alias("w"), *keys).agg(*aggregates).select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), *keys, *[c(a) for a in _names(aggregates)])


def sliding(events: DataFrame, time: str, length: str, step: str, late: str, keys: Sequence[str], *aggregates) -> DataFrame:
    w = F.window(c(time), length, step)
    return timed(events, time, late).groupBy(w.alias("w"), *keys).agg(*aggregates).select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), *keys, *[c(a) for a in _names(aggregates)])


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: Sequence[str], *aggregates) -> DataFrame:
    w = F.session_window(c(time), gap)
    return timed(events, time, late).groupBy(w.alias("w"), *keys).agg(*aggregates).select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), *keys, *[c(a) for a in _names(aggregates)])


def _names(aggregates) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[1].strip("`") for a in aggregates]


def distinct_within(events: DataFrame, time: str, late: str, keys: Sequence[str]) -> DataFrame:
    """First row of each key within the watermark."""
    return timed(events, time, late).dropDuplicatesWithinWatermark(list(keys))


def matured(predictions: DataFrame, outcomes: DataFrame, keys: Sequence[str], made: str, known: str, horizon: str, late: str) -> DataFrame:
    """Stream-stream join of predictions with outcomes that became known after them, within the horizon."""
    p = timed(predictions, made, late)
    o = timed(outcomes, known, late).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [c(k) == c(f"__{k}") for k in keys]
    inside = (c(known) > c(made)) & (c(known) <= c(made) + F.expr(f"interval {horizon}"))
    return p.join(o, [*same, inside]).drop(*[f"__{k}" for k in keys])


def upsert_sink(spark: SparkSession, path: str, keys: Sequence[str], tie: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps the last row of each key in versions of a folder.

    Each batch writes version <id> from the one before, so a batch that runs again replaces
    its own version and nothing else; the last version is the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{path}/version={number - 1}") if number else batch.limit(0)
        upsert(old, batch, keys, tie).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def run_to_end(stream: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Everything that is available now, through a memory table (for tests and demonstrations)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
