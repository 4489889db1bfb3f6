"""Streams with keyed state against the batch operators: late rows, and a query that starts again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import control, scores
from tidemark.streaming import incremental, stateful

DAY0 = dt.datetime(2024, 1, 1)


def arrivals(rows, seed):
    """Rows as they arrive, most in order and some up to three days late, in six files."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: (r[1] + dt.timedelta(days=rng.choice([0, 0, 0, 1, 3])), r[0]))
    size = -(-len(order) // 6)
    return [order[k : k + size] for k in range(0, len(order), size)]


def streamed(spark, parts, schema, folder, make):
    """Result of the stream over the first four files, then, started again from its checkpoint, over the others."""
    for half in (parts[:4], parts[4:]):
        for rows in half:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(incremental.files(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 1))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_revisions(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, DAY0 + dt.timedelta(days=d), rng.random(), rng.random() * 0.5, rng.random() < 0.9) for s in "ABC" for d in range(30) if rng.random() < 0.8]
    schema = "s string, t timestamp, selected double, update_need double, active boolean"
    got = streamed(spark, arrivals(rows, 2), schema, str(tmp_path), lambda df: stateful.stream_revisions(df, ["s"], "t", "4 days"))
    got = {(r["s"], r["t"]): (r["action"], r["output"]) for r in got.collect()}
    want = {(r["s"], r["t"]): (r["action"], r["output"]) for r in control.revisions(spark.createDataFrame(rows, schema), ["s"], ["t"]).collect()}
    end = max(r[1] for r in rows) - dt.timedelta(days=4)
    assert got == {k: v for k, v in want.items() if k[1] <= end} and len(got) > 40


@pytest.mark.parametrize("delay", [0, 2])
def test_experts(spark, tmp_path, delay):
    rng = random.Random(3)
    rows = [(m, DAY0 + dt.timedelta(days=d), rng.random()) for m in ("a", "b", "c") for d in range(30) if rng.random() < 0.9]
    schema = "model string, t timestamp, loss double"
    got = streamed(spark, arrivals(rows, 4), schema, str(tmp_path), lambda df: stateful.stream_experts(df.withColumn("g", F.lit(1)), ["g"], "t", "4 days", 2.0, delay))
    got = {(r["t"], r["model"]): r["weight"] for r in got.collect()}
    batch = scores.expert_average(spark.createDataFrame(rows, schema), 2.0, delay, "t").collect()
    end = max(r[1] for r in rows) - dt.timedelta(days=4)
    want = {(r["t"], r["model"]): r["weight"] for r in batch if r["t"] <= end}
    assert got.keys() == want.keys() and len(got) > 50 and all(got[k] == pytest.approx(want[k]) for k in want)
