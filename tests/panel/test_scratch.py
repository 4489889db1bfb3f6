import glob
import os

import pytest

from tidemark import scratch


def exists(spark, path):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)


def test_tables_can_be_dropped_and_cleared(spark):
    df, other = scratch.table(spark.range(5), "t"), scratch.table(spark.range(3), "t")
    assert df.count() == 5 and df.schema["id"].dataType == spark.range(1).schema["id"].dataType
    scratch.drop(df, df.where("id > 1"))
    assert not exists(spark, df._scratch_path) and exists(spark, other._scratch_path) and other.count() == 3
    kept, scratch._WRITTEN = scratch._WRITTEN, {other._scratch_path: None}
    scratch.clear(spark)
    del kept[other._scratch_path]
    scratch._WRITTEN = kept
    assert not exists(spark, other._scratch_path)


def test_tables_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    def files():
        own = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in own for f in glob.glob(os.path.join(d.getPath(), "**", "shuffle_*.data"), recursive=True)}

    before = files()
    scratch.table(spark.range(100_000).groupBy((F.col("id") % 50_000).alias("k")).count(), "t")
    assert not files() - before and spark.conf.get(scratch._CLEANUP) == "false"


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "none"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Session)


def test_worker_path_is_set_once(spark):
    for _ in range(2):
        scratch.ensure_importable(spark)
    paths = spark.sparkContext.environment["PYTHONPATH"].split(":")
    assert paths.count(scratch._ROOT) == 1
