"""Exact duplicates: plain Python, odd rows, and hashes that meet on purpose."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import exact

SPACE = re.compile(r"[\x20\x09-\x0D]")


def plain(rows):
    """(group_size, keep_id) of each (id, text)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {(i, t): (len(g := groups[SPACE.sub("", t or "")]), min(g)[3]) for i, t in rows}


@pytest.mark.parametrize("how", [{}, {"prefix": 2}, {"bits": 15}, {"prefix": 0, "bits": 15}])
def test_against_plain_python(spark, how):
    rng = random.Random(3)
    base = ["".join(rng.choices("ab \n", k=rng.randint(0, 7))) for _ in range(150)] + [" x", "x", "x ", "é ", "é", "日 本", "日本"]
    rows = [(k, rng.choice(base) if rng.random() < 0.9 else None) for k in range(600)]
    want = plain(rows)
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **how).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, want[i, t][1], want[i, t][0], want[i, t][1] == i) for i, t in rows}


def test_odd_rows(odd):
    got = exact.exact_duplicates(odd).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = {i: v for (i, _), v in plain(rows).items()}
    assert [c for c in got[0].asDict() if c != "kept"] == [c for c in odd.columns if c not in ("text", *exact.ADDED)] + ["keep_id", "group_size"]
    assert sorted((str(r["doc_id"]), r["group_size"], str(r["keep_id"])) for r in got) == sorted((str(i), want[i][0], str(want[i][1])) for i, _ in rows)
    twins = [r for r in got if r["keep_id"] == 1]  # ids 1, 2 and 1 again, with one text
    assert len(twins) == 3 and [r["doc_id"] for r in twins if r["kept"]] == [1]
    blank = [r for r in got if r["group_size"] == 3 and r["doc_id"] in (4, 5, 6)]
    assert len(blank) == 3 and {r["keep_id"] for r in blank} == {6}  # the one with most code points
    assert any(r["doc_id"] is None and r["kept"] for r in got)


def test_distinct_texts_keeps_all_columns(odd):
    got = exact.distinct_texts(odd)
    texts = [SPACE.sub("", r["text"] or "") for r in got.collect()]
    assert got.columns == odd.columns and len(texts) == len(set(texts)) == len({SPACE.sub("", r["text"] or "") for r in odd.collect()})


def test_unknown_ids_lose_and_a_hot_group_is_whole(spark):
    rows = [(None, "same text"), (7, "sametext"), (None, "same\ttext"), *[(k, "copy") for k in range(100, 1600)]]
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["group_size"], r["kept"]) for r in got if r["doc_id"] == 7] == [(3, False)]  # shorter than the others
    assert sum(r["kept"] for r in got if r["group_size"] == 3) == 1 and sum(r["kept"] for r in got if r["group_size"] == 1500) == 1
    assert {r["keep_id"] for r in got if r["group_size"] == 1500} == {100}


def test_sha256_and_texts_as_ids(spark):
    rows = [("b", " a b\u000b"), ("a", "ab"), ("c", None)]
    df = spark.createDataFrame(rows, "name string, body string")
    got = {r["name"]: r for r in exact.exact_duplicates(df.withColumn("h", exact.text_sha256(df["body"])), "name", "body").collect()}
    assert got["a"]["h"] == got["b"]["h"] == hashlib.sha256(b"ab").hexdigest() and got["c"]["h"] == hashlib.sha256(b"").hexdigest()
    assert (got["a"]["keep_id"], got["a"]["kept"], got["b"]["kept"]) == ("b", False, True)
    assert exact.exact_duplicates(df.where("false"), "name", "body").collect() == []


def test_only_built_in_functions(spark, odd):
    plan = exact.exact_duplicates(odd.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions|SerializeFromObject|ExistingRDD", plan)
