"""Every registered panel query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans import control_plane, forests, panel, serving, studies  # noqa: F401 (they add to the panel queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 4) + 0.0 if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool)) else v


@pytest.mark.parametrize("name", panel.SQL)
def test_same_rows_as_sql(name, spark, small, duck):
    df = panel.QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = duck.sql(panel.SQL[name])
    assert sorted(rel.columns) == names
    want = sorted((tuple(plain(v) for v in row) for row in rel.select(*[f'"{c}"' for c in names]).fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4 * max(1, abs(x))), (name, a, b)


@pytest.mark.parametrize("name", [n for n in panel.QUERIES if n not in panel.SQL])
def test_other_queries_run(name, spark, small):
    assert panel.QUERIES[name](spark, small).count() >= 0


def test_upsert_reads_every_event(spark, small):
    rows = [r.asDict() for r in spark.read.parquet(f"{small}/events.parquet").select("event_id").collect()]
    want = {}
    for i in sorted(r["event_id"] for r in rows):
        k = i // 2 % 500
        want[k] = max(want.get(k, (-1, -1)), (i % 2, i))
    assert {r["k"]: r["event_id"] for r in panel.QUERIES["upsert_rows"](spark, small).collect()} == {k: i for k, (_, i) in want.items()}


def test_drift_has_every_year_but_the_first(spark, small):
    years = sorted(r[0] for r in spark.read.parquet(f"{small}/lineitem.parquet").selectExpr("year(l_shipdate)").distinct().collect())
    assert sorted(r["yr"] for r in panel.QUERIES["drift"](spark, small).collect()) == years[1:]


def test_flat_frames_of_technical_features_are_those_of_sql(spark, small, tmp_path):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier"):
        con.execute(f"copy (select * from '{small}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
    # supplier 0 trades the same quantity on each day, 1 at the same price, 2 does neither
    con.execute(
        f"""copy (select d as l_orderkey, 1::bigint as l_partkey, s as l_suppkey, 1 as l_linenumber, q as l_quantity, q * case when s = 1 then 16 else 900 + d * 7919 % 1000 end::double as l_extendedprice,
        (d * 31 % 11) / 100::double as l_discount, (1 + d * 17 % 8) / 100::double as l_tax, timestamp '1995-01-02' + d * interval 1 day as l_shipdate
        from (select d, s, case when s = 0 then 7 else 1 + d * 104729 % 50 end::double as q from range(70) x(d), range(3) y(s))) to '{tmp_path}/lineitem.parquet' (format parquet)"""
    )
    for t in ("region", "nation", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    names = ["symbol", "session_date", "return_autocorr_20", "return_log_volume_corr_5", "return_log_volume_corr_10", "trend_r2_20", "trend_r2_60", "volume_z20", "return_skew_20"]
    exact = lambda rows: sorted(tuple(str(v) if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows)
    got = exact(panel.QUERIES["technical_features"](spark, str(tmp_path)).select(*names).collect())
    assert got == exact(con.execute(f"select {', '.join(names)} from ({panel.SQL['technical_features']})").fetchall())
    last = {r[0]: r[2:7] for r in got if r[1].isoformat() == "1995-03-12"}
    assert last["0"][1:3] == ("nan", "nan") and last["1"] == ("nan", "nan", "nan", 1.0, 1.0) and "nan" not in last["2"]
