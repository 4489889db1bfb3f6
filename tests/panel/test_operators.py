"""Panel operators on small frames made by hand."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cols
from tidemark.operators import cross, patterns, retrieval, scores, technical, temporal, upkeep
from tidemark.sources import parsers
from tidemark.streaming import incremental


def T(h, m=0, d=1):
    return dt.datetime(2024, 1, d, h, m)


def test_asof_sees_only_what_was_known(spark):
    left = spark.createDataFrame([(1, T(7)), (2, T(9)), (3, T(5)), (4, None), (5, T(5, 30))], "i int, available_at timestamp")
    right = spark.createDataFrame([(T(5, 30), 1.0, 1), (T(5, 30), 2.0, 2), (T(5, 30, 2), 9.0, 3)], "available_at timestamp, v double, d int")
    got = {r["i"]: r["x_v"] for r in temporal.asof(left, right, [], "available_at", ["v"], ["d"], "x_").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None, 4: None, 5: 2.0}


def test_every_macro_family_reaches_the_bars(spark):
    bars = spark.createDataFrame([("a", T(7)), ("b", T(7)), ("c", T(4)), ("d", None)], "symbol string, available_at timestamp")
    rows = [("nikkei", T(5), 1, 0.1, 0.2, 9.0), ("nikkei", T(7), 2, 0.3, 0.4, 8.0), ("vix", T(6), 1, 0.5, 0.6, 20.0), ("sp500", T(8), 1, 0.7, 0.8, 7.0)]
    macro = spark.createDataFrame(rows, "family string, available_at timestamp, session_date int, ret_1d double, volatility_20 double, close double")
    got = {r["symbol"]: r for r in temporal.macro_context(bars, macro).collect()}
    assert len(temporal.CONTEXT) == 13 and set(got) == set("abcd") and set(temporal.CONTEXT) < set(got["a"].asDict())
    for s in "ab":
        assert (got[s]["nikkei_ret_1d_lag1"], got[s]["jp_market_volatility_lag1"], got[s]["vix_level_lag1"]) == (0.3, 0.4, 20.0)
        assert got[s]["sp500_ret_1d_lag1"] is None and got[s]["gold_ret_1d_lag1"] is None
    assert all(got[s][x] is None for s in "cd" for x in temporal.CONTEXT)


def test_asof_by_key(spark):
    left = spark.createDataFrame([("a", T(7)), ("b", T(7)), ("c", T(7))], "k string, t timestamp")
    right = spark.createDataFrame([("a", T(6), 1), ("a", T(8), 2), ("b", T(7), 3)], "k string, t timestamp, v int")
    assert {r["k"]: r["v"] for r in temporal.asof(left, right, ["k"], "t", ["v"]).collect()} == {"a": 1, "b": 3, "c": None}


def test_intervals_include_both_ends(spark):
    q = spark.createDataFrame([("a", T(0, 0, 10))], "symbol string, t timestamp")
    e = spark.createDataFrame([("a", T(0, 0, 3), "x"), ("a", T(0, 0, 10), "y"), ("a", T(0, 1, 10), "y"), ("a", T(23, 59, 2), "x")], "symbol string, t timestamp, form string")
    r = temporal.trailing_counts(q, e, "symbol", "t", {"n": ("7 days", None), "x": ("8 days", F.col("form") == "x")}, last="age").first()
    assert (r["n"], r["x"], r["age"]) == (2, 2, 0)


def test_ewm_equals_recursion_and_waits(spark):
    rng = random.Random(1)
    xs = [None, *[rng.random() for _ in range(30)]]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, t int, x double")
    got = {r["t"]: r["y"] for r in technical.ewm(df, ["k"], "t", {"y": ("x", 9)}).collect()}
    y = None
    for i, x in enumerate(xs):
        if x is not None:
            y = x if y is None else 0.8 * y + 0.2 * x
        want = y if i >= 9 else None
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-12)


def test_average_ranks_and_robust_scores(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None)], "g int, x double")
    got = sorted(r["p"] for r in df.select(cols.percent_rank(F.col("x"), ["g"]).alias("p")).collect() if r["p"] is not None)
    assert got == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3])
    flat = spark.createDataFrame([(1, 5.0)] * 10 + [(1, None)] + [(2, 1.0)] * 3, "g int, x double")
    z = cross.robust_z(flat, ["x"], ["g"]).collect()
    assert {r["cs_x_robust_z"] for r in z if r["g"] == 1} == {0.0} and {r["cs_x_robust_z"] for r in z if r["g"] == 2} == {None}


def test_upsert_and_conflicts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {(r["k"], r["v"]) for r in upkeep.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert upkeep.conflicts(old.union(new), ["k"], ["v"]).collect()[0]["k"] == 2


def test_point_in_time_audit(spark):
    df = spark.createDataFrame([(T(1), T(2)), (T(3), T(2)), (None, T(2))], "available_at timestamp, at timestamp")
    assert upkeep.point_in_time(df, "at").count() == 1
    with pytest.raises(ValueError, match="1 rows without and 1 rows"):
        upkeep.assert_point_in_time(df, "at")
    assert upkeep.feature_name_audit(["ret_1d", "target_x", "Outcome_y"]) == ["target_x", "Outcome_y"]


def test_calibration_bins_use_the_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 0.999, 1.0)], "p double")
    assert [r["b"] for r in df.select(scores.bin_of(F.col("p")).alias("b")).collect()] == [0, 1, 2, 3, 5, 6, 9, 9]


def test_regimes_in_order(spark):
    rows = [(None, 0.0, 0.5, 0.0, 1.0, None, None), (0.1, 0.0, 0.5, 0.03, 1.0, None, None), (0.6, 0.0, 0.5, 0.0, 1.0, None, None), (0.1, 0.0, 0.5, None, None, 31.0, None), (0.1, 0.02, 0.5, None, None, None, None), (0.1, 0.0, 0.5, None, None, None, 0.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double")
    assert [r[0] for r in df.select(cols.regime_label(*[F.col(x) for x in "abcdefg"])).collect()] == ["data_stressed", "event", "high_vol", "high_vol", "trend", "normal"]


def test_consensus_learns_from_all_prior_rows(spark):
    rng = random.Random(5)
    rows = [(f, i, [rng.random() * (f + 1) / 3, rng.random()], rng.randint(0, 1)) for f, n in ((0, 300), (1, 3), (2, 40)) for i in range(n)]
    rows += [(1, 100 + i, [0.5, 0.5], 1) for i in range(2)]
    cases = spark.createDataFrame([(f, y, ps, [], "x") for f, _, ps, y in rows], "fold int, y int, p array<double>, risk array<double>, regime string")
    got = {(r["pattern"], r["fold"]): r for r in patterns.evaluate(cases, ["a", "b"], fitted=False).collect()}
    spread = lambda ps: abs(ps[0] - ps[1]) / 2
    for q in (50, 75, 90):
        assert (f"consensus_shrink_q{q}", 0) not in got
        for fold in (1, 2):
            prior = sorted(spread(ps) for f, _, ps, _ in rows if f < fold)
            at = (len(prior) - 1) * q / 100
            low = int(at)
            limit = prior[low] + (at - low) * (prior[min(low + 1, len(prior) - 1)] - prior[low])
            loss = []
            for f, _, ps, y in rows:
                if f == fold:
                    p = 0.5 + (sum(ps) / 2 - 0.5) * (1 - 0.6 * min(spread(ps) / max(limit, 0.01), 1))
                    loss.append(-math.log(p if y else 1 - p))
            assert got[f"consensus_shrink_q{q}", fold]["logloss"] == pytest.approx(sum(loss) / len(loss), abs=1e-9)


def test_vote_strength_weighs_votes_by_confidence():
    x = patterns.Cases(np.array([[0.9, 0.6, 0.3], [0.5, 0.5, 0.5]]), np.zeros((2, 0)), ["x", "x"], None)
    assert patterns.PATTERNS["vote_strength_probability"](x).tolist() == pytest.approx([0.5 + (2 / 3 - 0.5) * (0.6 + 0.4 * (0.8 + 0.2 + 0.4) / 3), 0.8])


def test_patterns():
    x = patterns.Cases(np.array([[0.2, 0.4, 0.9]]), np.array([[1.0, np.nan]]), ["x"], None)
    got = {n: float(np.atleast_1d(fn(x))[0]) for n, fn in patterns.PATTERNS.items()}
    assert got["equal_mean"] == pytest.approx(0.5) and got["median_probability"] == 0.4 and got["trimmed_mean_1"] == pytest.approx(0.4)
    assert got["lower_tail_mean2"] == pytest.approx(0.3) and got["upper_tail_mean2"] == pytest.approx(0.65) and got["lower_quantile_mix"] == pytest.approx(0.425)
    assert got["odds_mean_2"] == pytest.approx((lambda o: o / (1 + o))(((0.25**2 + (2 / 3) ** 2 + 81) / 3) ** 0.5)) and got["rank_mean"] == pytest.approx(0.4)
    assert got["probit_mean"] == pytest.approx(0.5 + 0.5 * math.erf((-0.841621 - 0.253347 + 1.281552) / 3 / math.sqrt(2)), abs=1e-5)
    assert all(0 <= v <= 1 for v in got.values())

def test_nearest_excludes_self(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)] + [(30, None)], "i long, v array<double>")
    got = retrieval.nearest(df.where("i = 10"), df, "i", "v", k=3, blocks=4).orderBy("rank").collect()
    assert [r["neighbour_id"] for r in got] == [9, 11, 8]


def test_series_json(spark):
    good = {"RESULTSET": [{"SERIES_CODE": " S ", "VALUES": {"SURVEY_DATES": ["20240105", "20240108", "20240109"], "VALUES": ["1.5", "-", None]}}]}
    rows = parsers.series_json(spark.createDataFrame([(json.dumps(good),), (json.dumps({"data": good}),)], "value string")).collect()
    assert [(r["series_code"], r["value"], r["available_at"]) for r in rows] == [("S", 1.5, dt.datetime(2024, 1, 8, 6))] * 2
    bad = {"RESULTSET": [{"SERIES_CODE": "S", "VALUES": {"SURVEY_DATES": ["20240105"], "VALUES": []}}]}
    with pytest.raises(Exception, match="different length"):
        parsers.series_json(spark.createDataFrame([(json.dumps(bad),)], "value string")).collect()


def test_curve_and_index(spark, tmp_path):
    feed = "<feed xmlns:m='m' xmlns:d='d'>" + "".join(f"<entry><content><m:properties><d:NEW_DATE>2024-01-0{k}T00:00:00</d:NEW_DATE><d:BC_3MONTH>5</d:BC_3MONTH><d:BC_2YEAR>{4 + k}</d:BC_2YEAR><d:BC_5YEAR>4</d:BC_5YEAR><d:BC_10YEAR>3</d:BC_10YEAR></m:properties></content></entry>" for k in (4, 5)) + "</feed>"
    (tmp_path / "f.xml").write_text(feed)
    rows = parsers.yield_curve(spark, str(tmp_path / "f.xml")).orderBy("session_date").collect()
    assert rows[1]["treasury_2s10s"] == -6 and rows[1]["treasury_2y_chg1d"] == 1 and rows[1]["available_at"] == dt.datetime(2024, 1, 7, 21)
    (tmp_path / "i.idx").write_text("CIK|Company Name|Form Type|Date Filed|Filename\n----\n12|A B|10-K|2024-01-05|edgar/x.txt\n")
    assert [tuple(r) for r in parsers.filing_index(spark, str(tmp_path / "i.idx")).collect()] == [("12", "A B", "10-K", dt.date(2024, 1, 5), "edgar/x.txt")]


def test_html():
    html = "<h2>Stocks</h2><table><tr><th>S</th><td>a <b>b</b></td></tr></table><script>no</script><p>x &amp; y</p>"
    assert parsers.table_rows(html) == [("Stocks", ["S", "a b"])]
    assert parsers.visible_lines(html)[-1] == "x & y" and "no" not in parsers.visible_lines(html)


def test_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    for k in range(2):
        events.where(f"event_id % 2 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.files(spark, str(tmp_path / "in"), events.schema, 1)
    counted = incremental.tumbling(stream, "ts", "1 hour", "60 days", ["event_type"], F.count("*").alias("n"))
    assert incremental.run_to_end(counted, "complete", "hours", str(tmp_path / "c1")).agg(F.sum("n")).first()[0] == events.count()
    sink = incremental.upsert_sink(spark, str(tmp_path / "t"), ["user_id"], ["ts", "event_id"])
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "t").iterdir())
    assert spark.read.parquet(str(tmp_path / "t" / f"version={last}")).count() == events.select("user_id").distinct().count()


def test_copies_rank_by_id_in_large_blocks(spark):
    rng = random.Random(11)
    base = [[1000 + rng.random() for _ in range(64)] for _ in range(5)]
    rows = [(i, base[i % 5] if i % 400 < 5 else [1000 + rng.random() * 9 for _ in range(64)]) for i in range(18000)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = retrieval.nearest(df.where("id < 5"), df, "id", "v", blocks=1).collect()
    copies = [i for i in range(18000) if i % 400 < 5]
    for q in range(5):
        near = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["neighbour_id"] for r in near] == [i for i in copies if i % 5 == q and i != q][:12] and {r["distance"] for r in near} == {0.0}
