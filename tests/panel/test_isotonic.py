"""Isotonic blocks against plain pool-adjacent-violators on the whole column."""

import random
from collections import defaultdict

import pytest

from tidemark.operators import isotonic


def plain(rows):
    cells = defaultdict(lambda: [0, 0])
    for k, x, y in rows:
        if x is not None and y is not None:
            cells[k, x][0] += 1
            cells[k, x][1] += y
    order = sorted(cells, key=lambda v: (v[0] is not None, v[0] or "", v[1]))
    return sorted((str(k), low, high, n, s) for k, low, high, n, s in isotonic.pooled([(k, x, x, *cells[k, x]) for k, x in order]))


def found(df):
    return sorted((str(r["k"]), r["low"], r["high"], r["n"], r["s"]) for r in df.collect())


def shapes():
    rng = random.Random(1)
    noisy = [("a", rng.random() ** 2, int(rng.random() < 0.5)) for _ in range(400)]
    ties = [(rng.choice(["a", "b", None]), round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(3000)]
    falling = [("a", float(k), 200 - k) for k in range(200)]  # one block over all ranges
    rising = [("a", float(k), k) for k in range(200)]  # as many blocks as cells
    saw = [("b", float(k), 10 * k - 900 * (k % 97 == 0)) for k in range(400)]  # a late fall reaches far back
    return {"noisy": noisy, "ties": ties, "falling": falling, "rising": rising, "saw": saw, "unknown": [("a", None, 1), ("a", 0.5, None), ("a", 0.1, 1)]}


@pytest.mark.parametrize("cells", [60, isotonic.CELLS])
@pytest.mark.parametrize("shape", shapes())
def test_against_plain_version(spark, shape, cells):
    rows = shapes()[shape]
    df = spark.createDataFrame(rows, "k string, x double, y int").repartition(3)
    got = isotonic.isotonic_blocks(df, ["k"], "x", "y", cells=cells)
    assert found(got) == plain(rows)
    by_key = defaultdict(list)
    for r in got.collect():
        assert r["value"] == r["s"] / r["n"]
        by_key[r["k"]].append((r["low"], r["value"]))
    assert all([v for _, v in sorted(b)] == sorted({v for _, v in b}) for b in by_key.values())


def test_without_keys_with_weights_and_without_rows(spark):
    df = spark.createDataFrame([(0.1, 1.0, 2.0), (0.2, 0.0, 1.0), (0.3, 5.0, 1.0), (0.4, 9.0, 0.0)], "x double, y double, w double")
    got = [(r["low"], r["high"], r["n"], r["value"]) for r in isotonic.isotonic_blocks(df, [], "x", "y", "w").orderBy("low").collect()]
    assert got == [(0.1, 0.2, 3.0, pytest.approx(2 / 3)), (0.3, 0.3, 1.0, 5.0)]
    assert isotonic.isotonic_blocks(df.where("false"), [], "x", "y").collect() == []


def test_query_rounds_halves_as_its_sql(spark, monkeypatch):
    import duckdb

    from tidemark.plans import forests, panel

    rows = [(1995, "momentum", k / 2000, int(i < k - 985)) for k in range(990, 1030) for i in range(50)]  # every cell is a block
    given = spark.createDataFrame(rows, "fold int, model string, p double, y int")
    monkeypatch.setattr(forests, "bank", lambda *_: given)
    con = duckdb.connect()
    con.execute("create table bank (fold bigint, model varchar, p double, y int)")
    con.executemany("insert into bank values (?, ?, ?, ?)", rows)
    sql = panel.SQL["isotonic_curves"].replace(f"{panel._CASES}, ", "")
    got = [tuple(r) for r in forests.isotonic_curves(spark, "").collect()]
    assert sorted(got) == sorted(con.execute(sql).fetchall())
