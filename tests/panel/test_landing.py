"""Landing, publishing and registries."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.sources import landing


def test_raw_files_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("一行\n二行".encode())
    (tmp_path / "b.txt").write_bytes("日本".encode("cp932"))
    files = landing.landed(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in landing.decoded(files).collect()}
    assert got == {"a.txt": "一行\n二行", "b.txt": "日本"}
    assert {r["path"].rsplit("/", 1)[1]: r["lines"] for r in files.collect()} == {"a.txt": 2, "b.txt": 1}


def test_publish_and_choose(spark, tmp_path):
    df = spark.range(3)
    landing.publish(df, str(tmp_path / "p"), "1")
    assert spark.read.parquet(str(tmp_path / "p" / "latest")).count() == 3
    df.write.parquet(str(tmp_path / "q" / "canonical"))
    assert landing.price_partitions(spark, str(tmp_path / "q")).count() == 3
    spark.range(5).write.parquet(str(tmp_path / "q" / "raw"))
    assert landing.price_partitions(spark, str(tmp_path / "q")).count() == 5


def test_documents_on_the_driver(spark, tmp_path):
    landing.write_json(str(tmp_path / "x.json"), {"b": 1, "a": dt.date(2024, 1, 1)})
    assert '"a": "2024-01-01"' in (tmp_path / "x.json").read_text()
    one = landing.fingerprint([str(tmp_path / "x.json")])
    landing.write_json(str(tmp_path / "x.json"), {"b": 2})
    assert one != landing.fingerprint([str(tmp_path / "x.json")])
    a, b = landing.manifest(spark.range(9), "t", ["id"]), landing.manifest(spark.range(9).orderBy(F.col("id").desc()), "t", ["id"])
    assert a == b and a["rows"] == 9


def test_registry_and_macro(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("name\tscore\nx\t1\ny\t \n")
    assert [tuple(r) for r in landing.registry(spark, str(tmp_path / "r.tsv")).collect()] == [("x", "1"), ("y", None)]
    kind = "family string, session_date date, close double, available_at timestamp"
    day = lambda d: (dt.date(2024, 1, d), dt.datetime(2024, 1, d, 12))
    old = spark.createDataFrame([("a", day(2)[0], 1.0, day(2)[1]), ("b", day(2)[0], 1.0, day(2)[1])], kind)
    new = spark.createDataFrame([("a", day(2)[0], 2.0, day(2)[1]), ("a", day(30)[0], 3.0, day(30)[1])], kind)
    series, problems = landing.merge_macro(old, new, F.lit(dt.datetime(2024, 1, 20)).cast("timestamp"), ["a", "b", "z"])
    assert sorted((r["family"], r["close"]) for r in series.collect()) == [("a", 2.0), ("b", 1.0)]
    assert {r["family"]: r["problem"] for r in problems.collect()} == {"a": "stale", "b": "stale", "z": "missing"}


def test_markdown_and_look_back(spark):
    df = spark.createDataFrame([("p", 1, "a|b"), ("p", 2, None), ("p", 3, "c")], "k string, n int, t string")
    assert landing.markdown(df.orderBy("n"), ["n", "t"]).splitlines()[2] == "| 1 | a\\|b |"
    got = landing.with_previous_lines(df, ["k"], "n", "t", 2).orderBy("n").collect()
    assert [r["previous"] for r in got] == [[], ["a|b"], ["a|b"]]
