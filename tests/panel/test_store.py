"""Results by fingerprint: what is asked for again is read, what changed is computed anew."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark import store
from tidemark.scratch import scratch_dir


def kept(spark, name):
    folder = f"{scratch_dir(spark).removeprefix('file://')}/store"
    return sorted(f for f in os.listdir(folder) if f.startswith(f"{name}-")) if os.path.isdir(folder) else []


@pytest.fixture
def source(spark, tmp_path):
    path = f"{tmp_path}/in.parquet"
    spark.range(50).select("id", (F.col("id") % 7).alias("k")).write.parquet(path)
    return path


@pytest.fixture
def name():
    """A name of its own: the scratch folder may outlive a run."""
    return f"test{uuid.uuid4().hex}"


def counts(spark, path):
    return spark.read.parquet(path).groupBy("k").agg(F.count("*").alias("n"))


def test_the_same_question_is_answered_from_the_store(spark, source, name):
    one = store.stored(counts(spark, source), name)
    first = kept(spark, name)
    two = store.stored(counts(spark, source), name)
    assert len(first) == 1 == len(kept(spark, name)) and set(one.inputFiles()) == set(two.inputFiles())
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, counts(spark, source).collect()))


def test_changed_input_plan_or_signature_is_another_result(spark, source, name):
    store.stored(counts(spark, source), name)
    store.stored(counts(spark, source).where("k > 2"), name)
    store.stored(counts(spark, source), name, "other folds")
    assert len(kept(spark, name)) == 3
    spark.range(5).select("id", F.lit(1).cast("long").alias("k")).write.mode("append").parquet(source)
    again = store.stored(counts(spark, source), name)
    assert len(kept(spark, name)) == 4 and again.where("k = 1").first()["n"] == 12


def test_build_runs_once(spark, source, name):
    calls = []

    def build(df):
        calls.append(1)
        return df.withColumn("twice", 2 * F.col("n"))

    for _ in range(2):
        assert store.stored(counts(spark, source), name, build=build).where("k = 0").first()["twice"] == 16
    assert calls == [1]


def test_a_part_of_its_own_begins_with_nothing(spark, source, name):
    calls = []
    build = lambda df: calls.append(1) or df
    try:
        for part in ("x", "x", "y"):
            spark.conf.set(store.PART, f"{name}{part}")
            assert store.stored(counts(spark, source), name, build=build).count() == 7
    finally:
        spark.conf.unset(store.PART)
    assert calls == [1, 1]


def test_without_files_nothing_is_kept(spark, name):
    assert store.stored(spark.range(3), name).count() == 3 and kept(spark, name) == []


def test_bank_is_computed_once_for_all_queries(spark, small):
    from tidemark.plans import panel, studies  # noqa: F401 (it adds to the panel queries)

    panel.bank(spark, small)
    before = kept(spark, "bank")
    panel.QUERIES["classification_metrics"](spark, small).collect()
    panel.QUERIES["yearly_returns"](spark, small).collect()
    assert kept(spark, "bank") == before
