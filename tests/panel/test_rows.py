"""Packs and row rules on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import packs, rows


def T(d, h=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)


def test_event_features(spark):
    bars = spark.createDataFrame([("A", "us_stock", T(300)), ("B", "us_stock", T(300)), ("A", "us_stock", None)], "symbol string, asset_class string, available_at timestamp")
    ledger = spark.createDataFrame([("A", T(299), "10-Q"), ("A", T(296), "8-K"), ("A", T(280), "zz"), ("A", T(200), "8-K"), ("A", T(301), "8-K")], "symbol string, available_at timestamp, form string").withColumn("event_family", packs.form_family(F.col("form")))
    got = {(r["symbol"], r["available_at"]): r for r in packs.event_features(bars, ledger).collect()}
    a, b = got["A", T(300)], got["B", T(300)]
    assert (a["event_count_5d"], a["event_count_30d"], a["event_current_report_5d"], a["event_financial_report_180d"]) == (2, 3, 1, 1)
    assert a["event_burst_5d_vs_30d"] == 4 and a["event_rate_change_30d_vs_prev180d"] == 18 and a["event_latest_is_financial_report"] == 1 and a["event_days_since_latest"] == 1
    assert b["event_data_available"] == 0 and got["A", None]["event_count_5d"] == 0


def test_filing_features_skip_other_assets(spark):
    bars = spark.createDataFrame([("A", "us_stock", T(100)), ("A", "jp_stock", T(100))], "symbol string, asset_class string, available_at timestamp")
    filings = spark.createDataFrame([("A", "us_stock", T(70), "8-k"), ("A", "us_stock", T(10, 1), "DEF 14A"), ("A", "jp_stock", T(99), "8-K")], "symbol string, asset_class string, available_at timestamp, form string")
    got = {r["asset_class"]: r for r in packs.filing_features(bars, filings).collect()}
    u, j = got["us_stock"], got["jp_stock"]
    assert (u["sec_filings_30d"], u["sec_filings_90d"], u["sec_8k_30d"], u["sec_proxy_90d"], u["sec_days_since_filing"], u["sec_data_available"]) == (1, 2, 1, 1, 30, 1)
    assert j["sec_data_available"] == 0 and j["sec_filings_90d"] == 0


def test_rate_and_short_sale_contexts(spark):
    obs = spark.createDataFrame([(dt.date(2024, 1, d), T(d), s, float(d) + k) for d in range(1, 25) for k, s in enumerate(("L", "H", "W"))], "observation_date date, available_at timestamp, series_code string, value double")
    bars = spark.createDataFrame([("A", "us_stock", T(21)), ("A", "us_stock", T(0))], "symbol string, asset_class string, available_at timestamp")
    got = {r["available_at"]: r for r in packs.policy_rate_context(bars, obs, "L", "H", "W").collect()}
    assert got[T(21)]["boj_call_rate_level"] == 21 and got[T(21)]["boj_call_rate_change"] == 1 and got[T(21)]["boj_call_rate_range"] == -1 and got[T(21)]["boj_call_rate_level_z20"] > 1
    assert got[T(0)]["boj_call_rate_level"] is None
    vol = spark.createDataFrame([("a", dt.date(2024, 1, 2), T(3), 0.5, 0.1, 3.0, 0.0), ("a", dt.date(2024, 1, 3), T(4), 0.7, 0.1, 3.0, 0.0)], "symbol string, session_date date, available_at timestamp, short_ratio double, exempt_ratio double, log_volume double, venue_disagreement double")
    got = {r["available_at"]: r for r in packs.short_sale_context(bars, packs.short_sale_features(vol)).collect()}
    assert got[T(21)]["finra_short_ratio_change"] == pytest.approx(0.2) and got[T(21)]["finra_data_available"] == 1 and got[T(0)]["finra_short_ratio"] == 0


def test_tags_buckets_and_situations(spark):
    df = spark.createDataFrame([(0.8, 0, 0.12, 0.07), (0.55, 1, 0.01, None)], "p double, y int, e double, d double")
    got = df.select(rows.error_tags(*[F.col(x) for x in "pyed"]).alias("t"), rows.direction_bucket(F.col("p")).alias("b"), rows.disagreement_bucket(F.col("d")).alias("d"), rows.return_error_bucket(F.col("e")).alias("e")).collect()
    assert got[0]["t"] == ["direction_wrong", "high_confidence_wrong", "return_error_ge_5pct", "return_error_ge_10pct", "high_model_disagreement"] and got[1]["t"] == []
    assert (got[0]["b"], got[0]["d"], got[0]["e"]) == ("p>=0.75", "disagreement>=0.06", "10%<=error<20%") and got[1]["d"] == "unknown"
    s = spark.createDataFrame([("trend", 0.0, 1.0, None, 0.8, 0.0), ("trend", 0.0, 1.0, None, 0.5, -0.03), ("event", None, 3.5, None, None, None), ("normal", 0.0, 0.0, 0.0, 0.0, 0.0)], "r string, a double, b double, c double, d double, e double")
    assert [r[0] for r in s.select(rows.situation(*[F.col(x) for x in "rabcde"])).collect()] == ["breadth_up", "trend_down", "event_volume", "range"]


def test_entities(spark):
    u = spark.createDataFrame([("BRK.B", "Berk Inc", ["BRKB2"]), ("X", "Same", None), ("Y", "Same", None), ("Z", "Only One", None)], "symbol string, name string, aliases array<string>")
    f = spark.createDataFrame([(1, "BRK-B", "?"), (2, "brkb2", "?"), (3, "none", "only one!"), (4, None, "same")], "i int, ticker string, company string")
    got = {r["i"]: (r["symbol"], r["matched_by"]) for r in rows.resolve_entities(f, u).collect()}
    assert got == {1: ("BRK.B", "ticker"), 2: ("BRK.B", "alias"), 3: ("Z", "company"), 4: (None, None)}


def test_routes_take_the_most_specific(spark):
    df = spark.createDataFrame([(1, "A", "us", "r", "s"), (2, "B", "us", "r", "s"), (3, "C", "jp", "r", "t"), (4, "A", "us", "data_stressed", "s")], "i int, symbol string, asset_class string, regime string, situation string")
    tables = {"symbol": spark.createDataFrame([("A", "m1")], "symbol string, model_id string"), "asset_regime": spark.createDataFrame([("us", "r", "m2")], "asset_class string, regime string, model_id string"), "global": spark.createDataFrame([("m3",)], "model_id string")}
    got = {r["i"]: (r["model_id"], r["route_reason"]) for r in rows.route(df, tables).collect()}
    assert got == {1: ("m1", "symbol"), 2: ("m2", "asset_regime"), 3: ("m3", "global"), 4: (None, "data_stressed")}


def test_shrink_grid_finds_the_risky_rows(spark):
    df = spark.createDataFrame([(int(i % 2), 0.9 if i % 2 else 0.1, i / 100) for i in range(60)] + [(0, 0.9, 0.9 + i / 1000) for i in range(40)], "y int, p double, risk double")
    best = rows.shrink_grid(df).first()
    assert best["weight"] == 1.0 and best["quantile"] == 0.6


def test_long_bars_and_vendor_symbols(spark):
    fields = ("Open", "High", "Low", "Close", "Adj Close", "Volume")
    wide = spark.createDataFrame([("2024-01-05", *[1.0] * 5, None, *[None] * 6)], ", ".join(["Date string", *[f"`{s}|{f}` double" for s in ("A", "B") for f in fields]]))
    got = rows.long_bars(wide, ["A", "B"]).collect()
    assert [(r["provider_symbol"], r["close"], r["volume"]) for r in got] == [("A", 1.0, 0.0)]
    s = spark.createDataFrame([("7203", "jp_stock"), ("BRK.B", "us_stock")], "s string, a string")
    assert [r[0] for r in s.select(rows.vendor_symbol(F.col("s"), F.col("a"))).collect()] == ["7203.T", "BRK-B"]


def test_case_failure_uses_earlier_folds_only(spark):
    df = spark.createDataFrame([(f, 0.5, k / 10, 0.2, 0.1, int(k > 7)) for f in range(3) for k in range(10)], "fold int, case_predictability double, case_ood double, case_failure_risk double, case_disagreement double, failed int")
    out = rows.case_failure(df)
    assert out.where("fold = 0 and threshold is not null").count() == 0
    assert all(r["failure_lift"] is None or r["failure_lift"] > 1 for r in rows.failure_lift(out).collect())


def test_changes(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, m double")
    b = spark.createDataFrame([("y", 3.0), ("z", 4.0)], "k string, m double")
    got = {r["k"]: (r["status"], r["m_change"]) for r in rows.performance_change(a, b, ["k"], ["m"]).collect()}
    assert got == {"x": ("gone", None), "y": ("kept", 1.0), "z": ("new", None)}
