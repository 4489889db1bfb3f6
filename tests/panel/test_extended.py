"""Selection, conformal sets, control plane, memory, serving and filings on hand-made frames and against numpy."""

import datetime as dt
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import conformal, control, experience, logistic, production, scores, selection, upkeep
from tidemark.sources import filings, parsers

c = F.col


def T(d, h=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=9000)] + [("b", float(x)) for x in rng.integers(0, 5, 3000)] + [("c", 1.0), ("c", 2.0), ("d", None), ("e", 7.0)]
    levels = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "x", levels).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for k, r in got.items():
        assert r["q"] == pytest.approx(np.quantile([x for n, x in rows if n == k], levels).tolist(), abs=1e-12)
    whole = exact_quantiles(df, [], "x", [0.5]).first()
    assert whole["q"][0] == pytest.approx(np.median([x for _, x in rows if x is not None])) and whole["n"] == 12003


def test_quantiles_of_values_that_come_out_otherwise_each_time(spark):
    def jitter(batches):  # stands for sums of doubles, whose last bits hang on the order of additions
        rng = np.random.default_rng()
        for b in batches:
            yield b.set_column(1, "x", pa.array(b.column("x").to_numpy() + rng.uniform(-1e-9, 1e-9, b.num_rows)))

    rows = spark.createDataFrame([(k, float(x)) for k in range(40) for x in range(121)], "k int, x double").mapInArrow(jitter, "k int, x double")
    got = exact_quantiles(rows, ["k"], "x", [0.0, 0.1, 0.9, 1.0]).collect()
    assert len(got) == 40 and all(r["q"] == pytest.approx([0, 12, 108, 120], abs=1e-6) and r["n"] == 121 for r in got)


def test_metrics_against_plain(spark):
    rng = random.Random(2)
    rows = [("m", rng.randint(0, 1), round(rng.random(), 2)) for _ in range(400)] + [("one", 1, 0.3), ("m", None, 0.5), ("m", 1, None)]
    got = {r["k"]: r for r in scores.binary_metrics(spark.createDataFrame(rows, "k string, y int, p double"), ["k"]).collect()}
    y, p = np.array([r[1] for r in rows[:400]]), np.array([r[2] for r in rows[:400]])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert got["m"]["n"] == 400 and got["m"]["roc_auc"] == pytest.approx(auc) and got["m"]["brier"] == pytest.approx(((p - y) ** 2).mean())
    assert got["one"]["roc_auc"] is None and got["m"]["accuracy"] == pytest.approx(((p >= 0.5) == (y == 1)).mean())
    with pytest.raises(Exception, match="not a probability"):
        scores.binary_metrics(spark.createDataFrame([(1, 1.2)], "y int, p double"), []).collect()
    rows = spark.createDataFrame([("a", 1.0, True), ("a", float("nan"), False), ("a", 3.0, True)], "k string, x double, flag boolean")
    assert [tuple(r) for r in scores.mean_metrics(rows, ["k"], ["x", "flag", "none"]).collect()] == [("a", 3, 2.0)]


def plain_sets(cal, p):
    s = [1 - q if y == 1 else q for y, q in cal]
    return tuple((1 + sum(x >= t for x in s)) / (1 + len(s)) for t in (p, 1 - p))


def test_conformal_sets_against_counting(spark):
    rng = random.Random(4)
    make = lambda n: [("f", rng.choice("ab"), rng.randint(0, 1), round(rng.random(), 2), d) for d in range(n)]
    cal, test = make(60), make(30)
    names = "fold string, g string, y int, p double, session_date int"
    a, b = spark.createDataFrame(cal, names), spark.createDataFrame([(*r[:4], r[4] // 5) for r in test], names)
    for r in conformal.prediction_sets(a, b, ["fold"]).collect():
        p0, p1 = plain_sets([x[2:4] for x in cal], min(max(r["p"], 1e-6), 1 - 1e-6))
        assert r["p0"] == pytest.approx(p0) and r["p1"] == pytest.approx(p1) and r["has1"] == (p1 > 0.1)
    small = [x for x in cal if x[1] == "a"] + [x for x in cal if x[1] == "b"][:5]
    for r in conformal.group_prediction_sets(spark.createDataFrame(small, names), b, ["fold"], "g", least=10).collect():
        used = [x[2:4] for x in small if x[1] == "a"] if r["g"] == "a" else [x[2:4] for x in small]
        assert r["fallback"] == (r["g"] == "b") and r["p0"] == pytest.approx(plain_sets(used, min(max(r["p"], 1e-6), 1 - 1e-6))[0])
    got = conformal.adaptive_sets(a, b, ["fold"], alpha=0.2, gamma=0.05).collect()
    bank, level = [x[2:4] for x in cal], 0.2
    for day in range(6):
        rows = [r for r in got if r["session_date"] == day]
        assert len(rows) == 5 and all(r["alpha_used"] == pytest.approx(level) for r in rows)
        miss = 0
        for r in rows:
            p0, p1 = plain_sets(bank, r["p"])
            assert r["p0"] == pytest.approx(p0) and r["p1"] == pytest.approx(p1)
            miss += (p1 if r["y"] == 1 else p0) <= level
        level = min(max(level + 0.05 * (0.2 - miss / 5), 0.01), 0.5)
        bank += [(r["y"], r["p"]) for r in rows]


@pytest.fixture(scope="module")
def folds(spark):
    rng = random.Random(5)
    rows = [(f, m, 0.6 + 0.05 * rng.random() + 0.02 * (m == "b"), 0.2, 0.05) for f in range(12) for m in "ab"]
    return spark.createDataFrame(rows, "fold int, model string, logloss double, brier double, ece double")


def test_a_fold_cannot_change_its_own_choice(spark, folds):
    before = {r["fold"]: r["model"] for r in selection.sequential_policy(folds).collect()}
    poisoned = folds.withColumn("logloss", F.when(c("fold") == 8, F.when(c("model") == "a", 9.0).otherwise(0.0)).otherwise(c("logloss")))
    after = {r["fold"]: r["model"] for r in selection.sequential_policy(poisoned).collect()}
    assert min(before) == 3 and all(before[f] == after[f] for f in range(3, 9)) and after[9] == "b"


def test_policies_and_their_evidence(spark, folds):
    out = selection.policy_summary(selection.sequential_policy(folds, "b"))
    assert out["status"] == "EVALUATED" and out["positive_share"] > 0.5 and out["research_positive"] in (True, False)
    assert selection.policy_summary(selection.sequential_policy(folds.where("fold < 2"), "b"))["status"] == "INSUFFICIENT_OOS"
    nested = selection.nested_policy(folds).collect()
    assert {r["fold"] for r in nested} == set(range(6, 12)) and {r["baseline_model"] for r in nested} == {"a"}
    assert selection.nested_policy(folds.where("fold < 7")).collect() == []


def test_windows_need_their_folds(spark):
    rows = [(f, "m", w, 0.5 + w / 10000 + (f == 3) * 0.01, 0.1 * f) for f in range(6) for w in (0, 252) if not (w == 252 and f == 3)]
    df = spark.createDataFrame(rows, "fold int, model string, window int, logloss double, drift double")
    got = {r["fold"]: r["window"] for r in selection.model_window_choice(df).collect()}
    assert got == {3: 0, 4: 0, 5: 0}
    tie = spark.createDataFrame([(f, w, 0.5) for f in range(4) for w in (0, 756, 252)], "fold int, window int, logloss double")
    assert [r["window"] for r in selection.window_choice(tie).where("selected").collect()] == [252]
    assert [r["window"] for r in selection.drift_aware_window(tie.withColumn("drift", F.lit(0.1))).where("fold = 3").collect()] == [252]


def test_promotion_asks_for_an_edge(spark):
    names = "k string, model string, score double, folds int, rank_ic double"
    cand = spark.createDataFrame([("x", "new", 0.600, 4, 0.1), ("x", "near", 0.601, 4, 0.3), ("x", "old", 0.6025, 4, 0.0), ("y", "new", 0.60, 4, 0.1), ("z", "new", 0.5, 2, 0.1), ("z", "old", 0.6, 4, 0.1)], names)
    chosen = {r["k"]: r["model"] for r in selection.choose_candidates(cand, ["k"]).collect()}
    assert chosen == {"x": "near", "y": "new", "z": "old"}
    parents = spark.createDataFrame([("x", "old"), ("y", "old"), ("z", "old")], "k string, parent string")
    assert selection.promoted(selection.choose_candidates(cand, ["k"]), cand, parents, ["k"]).collect() == []  # 0.0015, not measured, itself
    assert [r["k"] for r in selection.promoted(selection.choose_candidates(cand, ["k"], tolerance=0.0), cand, parents, ["k"]).collect()] == ["x"]


def test_splits_holdout_and_locks(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(60)], "session_date date")
    splits = selection.purged_splits(days)
    leaks = selection.split_leaks(splits).collect()
    assert len(leaks) == 15 and all(r["leaks"] == 0 and r["n_test"] == 20 for r in leaks)
    spoilt = splits.withColumn("role", F.when(c("role") == "barred", "train").otherwise(c("role")))
    assert all(r["leaks"] > 0 for r in selection.split_leaks(spoilt).collect())
    hold = selection.rolling_holdout(days, 10, 40).first()
    assert (hold["holdout_end"] - hold["cutoff"]).days == 10 and selection.rolling_holdout(days, 10, 50).collect() == []
    lock = selection.holdout_lock(hold["cutoff"], hold["holdout_start"], hold["holdout_end"], 1, "f", T(0), "x")
    assert lock["status"].startswith("CUTOFF") and not selection.should_rotate(lock, False, "g")
    assert selection.should_rotate({"status": "FROZEN"}, True, "g") and not selection.should_rotate({"status": "FROZEN", "research_code_fingerprint_sha256": "g"}, True, "g")
    with pytest.raises(ValueError):
        selection.should_rotate(lock, True, "g")
    folds = spark.createDataFrame([(0, "train", dt.date(2024, 1, d)) for d in range(1, 25)] + [(0, "test", dt.date(2024, 1, 26))], "fold int, role string, session_date date")
    roles = selection.core_calibration(folds, least=5).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in roles} == {"core": 19, "calibration": 5, "test": 1}
    selection.assert_chronological(folds)
    with pytest.raises(ValueError, match="fold 0"):
        selection.assert_chronological(folds.withColumn("session_date", F.when(c("role") == "test", F.lit(dt.date(2024, 1, 3))).otherwise(c("session_date"))))


def test_overfit_battery(spark):
    rng = random.Random(6)
    good = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.01 + 0.005 * rng.gauss(0, 1)) for i in range(1200)], "session_date date, ret double")
    got = selection.anti_overfit(good, trials=10)
    assert got["status"] == "PASS" and got["adjusted_sharpe"] < got["sharpe"] and got["sign_flip_p"] < 0.05
    flat = good.withColumn("ret", c("ret") * F.when(F.dayofyear("session_date") % 2 == 0, 1).otherwise(-1))
    assert selection.anti_overfit(flat)["status"] == "FAIL" and selection.anti_overfit(good.limit(5))["status"] == "INSUFFICIENT_EVIDENCE"
    assert math.isnan(selection.block_sign_flip([0.1] * 5))


def test_logistic_is_that_of_the_small_solver(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(k), i) for i, ((a, b), k) in enumerate(zip(x, y))], "a double, b double, y int, i int")
    for balanced in (False, True):
        m = logistic.fit_logistic(df, ["a", "b"], "y", 0.25, balanced)
        means, scales, beta = logistic.fit_small(x, y, 0.25, balanced)
        assert m.weights == pytest.approx(beta[:2], abs=1e-6) and m.intercept == pytest.approx(beta[2], abs=1e-6) and m.rows == 500
    assert logistic.fit_logistic(df.limit(3), ["a"], "y").constant is not None and logistic.fit_logistic(df.where("false"), ["a"], "y").constant == 0.5
    out = logistic.prequential(df.withColumn("fold", F.floor(c("i") / 100).cast("int")), ["a", "b"], "y", "p")
    assert {r["p"] for r in out.where("fold = 0").collect()} == {0.5}
    moved = out.where("fold = 2").agg(F.sum("p")).first()[0]
    poisoned = df.withColumn("fold", F.floor(c("i") / 100).cast("int")).withColumn("y", F.when(c("fold") >= 2, 1 - c("y")).otherwise(c("y")))
    assert logistic.prequential(poisoned, ["a", "b"], "y", "p").where("fold = 2").agg(F.sum("p")).first()[0] == pytest.approx(moved)


def test_risk_is_shrunk_and_binned(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0), (0.9, 0.5, 1), (0.2, None, 0), (0.2, 0.7, 1)], "p double, r double, y int")
    got = [r[0] for r in df.select(control.risk_shrink(c("p"), c("r"), 0.5).alias("v")).collect()]
    assert got[0] == pytest.approx(0.9 - 0.4 * 0.35 * 0.75) and got[1] == 0.9 and got[2] == pytest.approx(0.2 * 0.65 + 0.5 * 0.35)
    bins = {r["risk_lo"]: (r["n"], r["error_rate"]) for r in control.risk_bins(df, "r", "y", "p").collect()}
    assert bins == {0.8: (1, 1.0), 0.4: (1, 0.0), 0.6: (1, 1.0)}


def test_forecasts_see_the_past_only(spark):
    rows = [(1, t, s) for t, s in enumerate("ababbaab")]
    df = spark.createDataFrame(rows, "k int, t int, s string")
    got = [r["forecast"] for r in scores.transition_forecasts(df, ["k"], "t", "s", ["a", "b"]).orderBy("t").collect()]
    for t in range(len(rows)):
        steps = [(rows[i][2], rows[i + 1][2]) for i in range(t - 1)]
        n = [1 + sum(x == (rows[t][2], b) for x in steps) for b in "ab"]
        assert got[t] == pytest.approx([v / sum(n) for v in n])


def test_revisions_follow_each_instrument(spark):
    df = spark.createDataFrame([("A", 1, 0.5, 0.0, True), ("A", 2, 0.6, 0.0, True), ("A", 3, 0.9, 0.0, True), ("A", 4, 0.1, 0.0, True), ("A", 5, 0.2, 0.9, False), ("B", 1, 0.7, 0.5, True)], "s string, t int, selected double, update_need double, active boolean")
    got = {(r["s"], r["t"]): (r["action"], round(r["output"], 6)) for r in control.revisions(df, ["s"], ["t"]).collect()}
    assert got == {("A", 1): ("maintain", 0.5), ("A", 2): ("maintain", 0.5), ("A", 3): ("micro_revision", 0.6), ("A", 4): ("recompute", 0.1), ("A", 5): ("abstain", 0.2), ("B", 1): ("recompute", 0.7)}


def test_files_are_taken_once(spark):
    files = spark.createDataFrame([("a", "1", True), ("b", "2", True), ("c", "3", False), ("d", "4", True)], "name string, digest string, complete boolean")
    known = spark.createDataFrame([("a", "1"), ("b", "old")], "name string, digest string")
    assert {r["name"]: r["decision"] for r in experience.new_files(files, known).collect()} == {"a": "skip", "b": "skip_changed", "c": "defer", "d": "process"}


def test_memory_adds_up(spark):
    rows = [(0.8, 0, 0.01, -0.04, 0.02, "us"), (0.4, 0, 0.0, -0.01, None, None)] * 20
    e = experience.resolved_errors(spark.createDataFrame(rows, "p double, y int, expected double, y_ret double, disagreement double, asset string"))
    one = experience.experience_sums(e, {"by_asset_class": "asset", "by_regime": "direction_confidence"}, {"error_types": "error_tags"})
    got = {(r["dimension"], r["segment"]): r for r in experience.finalized(experience.merge_experience(one, one)).collect()}
    assert got["by_asset_class", "us"]["n"] == 40 and got["by_asset_class", "UNKNOWN"]["accuracy"] == 1.0 and got["by_asset_class", "us"]["return_mae"] == pytest.approx(0.05)
    assert got["error_types", "high_confidence_wrong"]["n"] == 40
    ranked = experience.priorities(one, least=10)
    assert ranked.first()["impact"] > 0 and ranked.count() <= 30
    plan = experience.candidates(ranked, least=10)
    assert plan.first()["candidate_id"].startswith("exp-")
    scoped = spark.createDataFrame([("by_asset_class", "us", m, 4, 20, l, 0.0, "sig") for m, l in (("old", 0.7), ("new", 0.6))], "dimension string, segment string, model string, folds int, n_test_min int, logloss double, logloss_std double, signature string")
    judged = {r["segment"]: (r["status"], r["passes_screen"]) for r in experience.evaluated_candidates(plan, scoped, "old").collect() if r["dimension"] == "by_asset_class"}
    assert judged == {"us": ("EVALUATED", True)}
    daily = spark.createDataFrame([(str(d), 1, 1, 0.1, 0.1, 0.1, 0.01) for d in range(9)], "segment string, n int, correct int, logloss_sum double, brier_sum double, abs_return_error_sum double, squared_return_error_sum double")
    assert {r["sessions"]: r["n"] for r in experience.rolling_experience(daily).collect()} == {5: 5, 20: 9, 60: 9}


def test_a_join_that_must_not_multiply(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    good, bad = spark.createDataFrame([(1, 5)], "k int, b int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    assert sorted((r["k"], r["b"]) for r in experience.checked_join(left, good, ["k"]).collect()) == [(1, 5), (2, None)]
    with pytest.raises(Exception, match="key occurs twice"):
        experience.checked_join(left, bad, ["k"]).collect()


def test_sources_are_scored(spark):
    df = spark.createDataFrame([(True, True, False), (True, True, True)], "o boolean, s boolean, b boolean")
    assert [r[0] for r in df.select(experience.source_score({"official": c("o"), "secure": c("s")}, c("b"))).collect()] == [0.7, 0.0]


def test_caps_hold(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), s) for d in range(30) for s in range(10)]
    df = spark.createDataFrame(rows, "session_date date, symbol int")
    for most, recent in ((100, 5), (30, 5), (299, 29), (1000, 5), (40, 30)):
        got = upkeep.cap_training(df, most, recent, ["session_date", "symbol"]).collect()
        assert len(got) <= most or most >= 300
        if most == 100:
            assert sum(r["session_date"] >= dt.date(2024, 1, 26) for r in got) == 50
        if most == 30:
            assert {r["session_date"] for r in got} == {dt.date(2024, 1, d) for d in (28, 29, 30)}


def test_latest_usable_prediction(spark):
    p = spark.createDataFrame([("f1", "us", "A", 0.1, T(1), T(0)), ("f2", "us", "A", 0.2, T(2), T(1)), ("f3", "us", "A", 0.3, T(9), T(8)), ("f2", "us", "B", 0.4, T(2), T(3)), ("f4", "us", "A", 0.5, T(3), T(2)), ("f4", "us", "A", 0.6, T(3), T(2))], "file string, asset_class string, symbol string, p_up_1d double, prediction_time timestamp, available_at timestamp")
    watch = spark.createDataFrame([("us", "A"), ("us", "B")], "asset_class string, symbol string")
    got = {r["symbol"]: (r["p_up_1d"], r["watch_status"]) for r in production.latest_usable(p, watch, F.lit(T(5))).collect()}
    assert got == {"A": (0.2, "READY"), "B": (None, "MISSING")}


def test_gates(spark):
    fair = {"logloss": 0.6, "ece": 0.1, "n": 300}
    assert production.monitor_status(fair, fair, {"logloss": 0.69}, {"logloss": 0.69}) == "PASS"
    assert production.monitor_status(fair, fair | {"n": 100}, {"logloss": 0.69}, {"logloss": 0.69}) == "FAIL"
    assert production.governance({"pit": "PASS", "oos": "PASS", "holdout": "PASS", "calibration": "PASS"})["promotion"] == "ELIGIBLE" and production.governance({})["promotion"] == "HOLD"
    assert production.registry_faults([{"id": "a", "status": "production", "evidence": ""}, {"id": "a", "status": "x", "evidence": "y"}]) == ["twice: a", "a: no evidence", "a: production without evidence"]
    assert production.state_compatible({"schema_version": 1}, {"schema_version": 1, "feature_columns": [], "model_fingerprint": "x"}) == ["feature_columns", "model_fingerprint"]
    names = "asset_class string, symbol string, prediction_status string, p_up_1d double, return_q10_1d double, return_q50_1d double, return_q90_1d double, range_low_1d double, expected_close_1d double, range_high_1d double, available_at timestamp, prediction_time timestamp, model_id string"
    rows = [("us", "A", "READY", 0.5, -0.1, 0.0, 0.1, 9.0, 10.0, 11.0, T(0), T(1), "m"), ("us", "B", "READY", 1.5, 0.1, 0.0, 0.1, 9.0, 10.0, 11.0, T(2), T(1), None), ("us", "C", "DEFERRED", 0.4, None, None, None, None, None, None, T(0), T(1), None)]
    got = {r["symbol"]: r["faults"] for r in production.output_faults(spark.createDataFrame(rows, names)).collect()}
    assert got == {"A": [], "B": ["probability_out_of_range", "quantiles_not_ordered", "available_after_prediction", "no_model"], "C": ["deferred_with_values"]}
    items = spark.createDataFrame([("x", "READY", 0.5, "2024-01-01"), ("y", "READY", None, "2024-01-01"), ("x", "DEFERRED", None, None)], "display_name string, prediction_status string, p_up_1d double, target_date string")
    assert production.watchlist_faults(items, ["x", "z"]) == ["missing: z", "twice: x", "incomplete: y"]


def test_later_rows_do_not_reach_back(spark):
    from tidemark.operators import technical

    rng = random.Random(7)
    rows = [(i, "us", "A", dt.date(2024, 1, 1) + dt.timedelta(days=i), *[100 + rng.random() for _ in range(4)], 1000.0 + i) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, asset_class string, symbol string, session_date date, open double, high double, low double, close double, volume double")
    assert production.perturbed_columns(lambda d: technical.technical_features(d), df, "i", c("i") < 70, ["close", "volume"]) == 0
    ahead = lambda d: d.withColumn("x", F.lead("close").over(technical.Window.orderBy("i")))
    assert production.perturbed_columns(ahead, df, "i", c("i") < 70, ["close"]) == 1


def test_ablation_and_blends(spark):
    folds = spark.createDataFrame([(f, 0.7) for f in range(3)], "fold int, logloss double")
    out = production.ablation(folds, {"pack": ["x"]}, lambda d, extra: d.withColumn("logloss", c("logloss") - 0.1 * len(extra)))
    assert [round(r["gain"], 6) for r in out["pack"].collect()] == [0.1] * 3
    df = spark.createDataFrame([(0.4, 0.5, None), (None, None, None)], "a double, b double, d double")
    got = df.select(production.fallback_probability(c("a"), c("b"), c("d")).alias("v"), production.return_blend(c("a"), c("d")).alias("r")).collect()
    assert got[0]["v"] == pytest.approx((0.55 * 0.4 + 0.25 * 0.5) / 0.8) and got[0]["r"] == 0.4 and got[1]["v"] is None and got[1]["r"] is None


def test_search_pages(spark):
    hit = lambda i, form, kind, day, ciks=("77",), adsh="": {"_id": i, "_source": {"ciks": list(ciks), "form": form, "file_type": kind, "root_form": form, "file_date": day, "adsh": adsh}}
    page = json.dumps({"hits": {"hits": [hit("n1:a.htm", "8-K", "8-K", "2024-01-05"), hit("n1:ex.htm", "8-K", "EX-99", "2024-01-05"), hit("n2:b.htm", "S-1", "S-1", "2024-01-05"), hit("n3:c.htm", "8-K", "", "2023-01-05"), hit("n4:d.htm", "10-Q", "10-Q", "2024-01-06", ("77", "88"), "acc4")]}})
    raw = spark.createDataFrame([(page,), (page,), ('{"hits":{}}',)], "value string")
    got = sorted((r["cik"], r["form"], r["accession_number"], r["primary_document"]) for r in filings.search_pages(raw, ["8-K", "10-Q"], F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 2, 1))).collect())
    assert got == [("0000000077", "10-Q", "acc4", "d.htm"), ("0000000077", "8-K", "n1", "a.htm"), ("0000000088", "10-Q", "acc4", "d.htm")]


def test_ownership_forms(spark):
    xml = "<x:doc xmlns:x='u'><x:rptOwnerName> Jane </x:rptOwnerName><x:nonDerivativeTransaction><x:transactionDate><x:value>2024-01-02</x:value></x:transactionDate><x:transactionShares><x:value>5</x:value></x:transactionShares></x:nonDerivativeTransaction><x:nonDerivativeTransaction/></x:doc>"
    files = spark.createDataFrame([("a", bytearray(xml.encode())), ("b", bytearray(b"no xml")), ("c", None)], "path string, content binary")
    got = {r["path"]: r for r in filings.ownership(files).collect()}
    assert got["a"]["owner"] == "Jane" and [(t["transactionDate"], t["transactionShares"], t["transactionCode"]) for t in got["a"]["transactions"]] == [("2024-01-02", "5", None)]
    assert got["b"]["status"] == got["c"]["status"] == "NOT_XML" and got["b"]["transactions"] == []


def test_index_joins_by_number_then_name(spark):
    index = spark.createDataFrame([("77", "Any", "edgar/data/77/000000007724000001/a.txt"), ("99", "only one", "edgar/data/99/x.txt"), ("98", "Same", "y")], "cik string, company string, file_name string")
    companies = spark.createDataFrame([("0000000077", "A", "Alpha"), ("5", "Z", "Only One!"), ("6", "S1", "Same"), ("7", "S2", "Same")], "cik string, symbol string, name string")
    got = {r["cik"]: (r["symbol"], r["matched_by"], r["accession_number"]) for r in filings.index_symbols(index, companies).collect()}
    assert got == {"77": ("A", "cik", "0000000077-24-000001"), "99": ("Z", "company", "99"), "98": (None, None, "")}


def test_event_windows_and_dates(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = [("A", "8-K", day(5), T(5, 3), None, "n1"), ("A", "8-K", day(6), None, day(4), "n2"), ("A", "8-K", day(7), T(7), None, "n3"), ("A", "10-K", day(7), T(8), None, "n4"), ("A", "8-K", day(1), T(9), None, "n5")]
    df = spark.createDataFrame(rows, "symbol string, form string, filing_date date, acceptance_datetime timestamp, report_date date, accession_number string")
    got = filings.event_window(df, "symbol", ["8-K"], F.lit(day(2)), 2).orderBy("place").collect()
    assert [r["accession_number"] for r in got] == ["n3", "n1"]
    dated = {r["accession_number"]: (r["available_at_method"], r["available_at"]) for r in filings.dated_view(df).collect()}
    assert dated["n2"] == ("filing_date_eod_conservative", dt.datetime(2024, 1, 7, 4, 59, 59, 999999)) and dated["n1"][0] == "acceptance_datetime"
    seen = spark.createDataFrame([("s", day(1), T(1), 1.0), ("s", day(1), T(2), 2.0), ("s", day(2), T(9), 3.0)], "series string, d date, available_at timestamp, v double")
    assert [r["v"] for r in filings.collected(seen, ["series", "d"], F.lit(T(5))).collect()] == [2.0]
    windows = filings.request_windows(F.lit(day(1)), F.lit(day(20)), spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string"), 15, 2).collect()
    assert sorted((r["window_start"].day, r["window_end"].day, r["symbols"]) for r in windows) == [(1, 15, ["a", "b"]), (1, 15, ["c"]), (16, 20, ["a", "b"]), (16, 20, ["c"])]


def test_curve_keeps_the_first_entry_of_a_day(spark, tmp_path):
    entry = lambda d, x: f"<entry><content><m:properties><d:NEW_DATE>{d}T00:00:00</d:NEW_DATE><d:BC_2YEAR>{x}</d:BC_2YEAR></m:properties></content></entry>"
    (tmp_path / "f.xml").write_text("<feed xmlns:m='m' xmlns:d='d'>" + entry("2024-01-04", 1) + entry("2024-01-04", 2) + entry("2024-01-05", 3) + "</feed>")
    got = {r["session_date"].day: r["treasury_2y"] for r in parsers.yield_curve(spark, str(tmp_path / "f.xml")).collect()}
    assert got == {4: 1.0, 5: 3.0}


def test_quarters_files_and_arrays(spark, tmp_path):
    q = spark.range(1).select(parsers.quarters(F.lit(dt.date(2023, 11, 5)), F.lit(dt.date(2024, 4, 1))).alias("q")).first()["q"]
    assert [(d.year, d.month) for d in q] == [(2023, 10), (2024, 1), (2024, 4)]
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(3).write.parquet(str(tmp_path / "b"))
    rows = parsers.file_rows(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert rows.count() == 5 and all(r["file_name"].endswith(".parquet") for r in rows.select("file_name").collect())
    raw = spark.createDataFrame([("X", json.dumps({"form": ["8-K", "10-Q"], "n": ["1", "x"]}))], "symbol string, value string")
    got = parsers.columnar_arrays(raw, "value", {"form": "string", "n": "int"}).collect()
    assert [(r["symbol"], r["form"], r["n"]) for r in got] == [("X", "8-K", 1), ("X", "10-Q", None)]
    (tmp_path / "t.csv").write_text("a,b\n1,日\n", encoding="utf-8")
    assert filings.landed_series(spark, str(tmp_path / "t.csv"), "csv").first()["b"] == "日"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x").write_bytes(b"a\nb")
    got = filings.provenance(spark.read.format("binaryFile").load(str(tmp_path / "raw")), "src", F.lit(T(0))).first()
    assert (got["bytes"], got["lines"], got["source"]) == (3, 2, "src")


def test_registers_settings_and_choice(spark):
    register = spark.createDataFrame([("a", 2, True, "revised", ["us_stock"]), ("b", 1, False, "odd", ["us_stock"]), ("b", 3, False, "revised", [])], filings.SOURCE_COLUMNS)
    assert [r["id"] for r in filings.sources_for(register, "us_stock", True).collect()] == ["b", "a"] and filings.sources_for(register, "us_stock").count() == 1
    assert sorted(tuple(r["faults"]) for r in filings.register_faults(register).collect()) == [("id_twice", "no_asset_class"), ("id_twice", "unknown_mode")]
    name, best = filings.best_source({"x": spark.range(3), "y": spark.range(120)})
    assert name == "y" and best.count() == 120
    with pytest.raises(RuntimeError):
        filings.best_source({"x": spark.range(3)})
    df = spark.createDataFrame([("us",), ("jp",)], "asset_class string")
    assert filings.scope(df, " us ,").count() == 1 and filings.scope(df, "").count() == 2
    text = "# c\nmodel:\n  half_life: 252\n  names: [a, 'b']\n  on: true # yes\nlist:\n- x\n- 2.5\nempty:\n"
    want = {"model": {"half_life": 252, "names": ["a", "b"], "on": True}, "list": ["x", 2.5], "empty": None}
    assert filings._plain_yaml(text) == want and filings.config('{"a": 1}') == {"a": 1}


def test_prices_that_must_agree(spark):
    from tidemark.operators import audits

    names = "asset_class string, symbol string, session_date date, open double, high double, low double, close double, volume double, available_at timestamp, retrieved_at timestamp"
    row = lambda s, d, close=10.0, at=0: ("us", s, dt.date(2024, 1, d), 10.0, 11.0, 9.0, close, 5.0, T(d, 1), T(d + 1 + at))
    good = spark.createDataFrame([row("A", 1), row("A", 1, at=2), row("B", 1)], names)
    assert upkeep.canonical_checked(good, ["asset_class", "symbol", "session_date"]).count() == 2
    with pytest.raises(ValueError, match="rows of one key differ"):
        upkeep.canonical_checked(good.unionByName(spark.createDataFrame([row("B", 1, 10.5)], names)), ["asset_class", "symbol", "session_date"])
    keys = ["asset_class", "symbol"]
    expected = spark.createDataFrame([("us", "A"), ("us", "B")], "asset_class string, symbol string")
    none = expected.where("false")
    bars = spark.createDataFrame([row("A", 1), row("B", 1)], names)
    assert audits.quality_verdict(bars, expected, none, keys, F.lit(T(5)))["status"] == "PASS"
    assert audits.quality_verdict(bars, expected, none, keys, F.lit(T(40)))["reasons"] == ["stale:2"]
    more = expected.unionByName(spark.createDataFrame([("us", "C")], expected.schema))
    assert audits.quality_verdict(bars, more, none, keys, F.lit(T(5)))["reasons"] == ["missing:1"]
    late = spark.createDataFrame([("us", "C"), ("us", "Q")], expected.schema)
    got = audits.quality_verdict(bars, more, late, keys, F.lit(T(5)), critical=["C"])
    assert got["status"] == "FAIL" and got["reasons"][:2] == ["unknown:1", "critical:1"] and got["reasons"][2].startswith("deferred_share:0.333")


def test_bootstraps(spark):
    from tidemark.operators import evidence

    rng = random.Random(9)
    good = [0.1 + 0.05 * rng.gauss(0, 1) for _ in range(200)]
    a = evidence.paired_bootstrap(good)
    assert a["status"] == "OK" and a["low"] < a["mean"] < a["high"] and a["p_two_sided"] < 0.01 and a == evidence.paired_bootstrap(good)
    assert evidence.paired_bootstrap([0.1] * 5)["status"] == "INSUFFICIENT_CASES"
    df = spark.createDataFrame([(i // 20, x) for i, x in enumerate(good)], "session_date int, x double")
    clusters = evidence.session_clusters(df, c("x"))
    b = evidence.cluster_bootstrap(clusters)
    assert len(clusters) == 10 and b["mean"] == pytest.approx(a["mean"]) and b["probability_positive"] == 1.0
    assert evidence.cluster_bootstrap(clusters[:3])["status"] == "INSUFFICIENT_CLUSTERS"


def test_catalogue_words(spark):
    from tidemark.operators import rows

    df = spark.createDataFrame([(["x", "7203", "Toyota"], "個別株", "Toyota"), (["1343"], "上場投資信託", "n"), (["8951", "a"], "", "日本ビルファンド投資法人"), (["bad"], "?", "?")], "cells array<string>, section string, name string")
    got = [tuple(r) for r in df.select(rows.code_of(c("cells"), "japan"), rows.class_of(c("section"), c("name"), "japan")).collect()]
    assert got == [("7203", "jp_stock"), ("1343", "jp_etf"), ("8951", "jp_reit"), (None, None)]
    us = spark.createDataFrame([(["BRK.B", "App, Desk"], "米国株", "Berkshire"), (["SPY"], "x", "An ETF")], "cells array<string>, section string, name string")
    got = [tuple(r) for r in us.select(rows.code_of(c("cells"), "us"), rows.class_of(c("section"), c("name"), "us"), rows.channels_of(c("cells"), ["app", "web"])).collect()]
    assert got == [("BRK.B", "us_stock", ["app"]), ("SPY", "us_etf", [])]


def test_routes_fall_back_to_what_folds_choose(spark):
    from tidemark.operators import rows

    df = spark.createDataFrame([("A", "us", "r", "s"), ("B", "jp", "r", "s")], "symbol string, asset_class string, regime string, situation string")
    tables = {"regime": spark.createDataFrame([("q", "m0")], "regime string, model_id string"), "oos_asset": spark.createDataFrame([("us", "m1")], "asset_class string, model_id string"), "oos_global": spark.createDataFrame([("m2",)], "model_id string")}
    assert {r["symbol"]: (r["model_id"], r["route_reason"]) for r in rows.route(df, tables).collect()} == {"A": ("m1", "oos_asset"), "B": ("m2", "oos_global")}


def test_case_risk_is_learned_from_earlier_folds(spark):
    rng = random.Random(11)
    rows = []
    for f in range(4):
        for _ in range(150):
            o = rng.random()
            rows.append((f, 0.5, o, 0.2, 0.1, 0.6, int(rng.random() < o)))
    df = spark.createDataFrame(rows, "fold int, case_predictability double, case_ood double, case_failure_risk double, case_disagreement double, prediction double, failed int")
    got = control.learned_case_risk(df, least=100)
    assert {r["learned_risk"] for r in got.where("fold = 0").collect()} == {0.5} and got.where("fold = 3").stat.corr("learned_risk", "case_ood") > 0.9
    assert control.case_signs(df).first()["fixed_risk"] == pytest.approx((0.5 + rows[0][2] + 0.2 + 0.1) / 4)


def test_patterns_learn_nothing_from_their_own_fold(spark):
    from tidemark.operators import patterns

    rng = random.Random(12)
    rows = [(f, int(rng.random() < 0.5), [rng.random() for _ in range(3)], [rng.random(), None if rng.random() < 0.1 else rng.random()], rng.choice("xy")) for f in range(4) for _ in range(60)]
    names = "fold int, y int, p array<double>, risk array<double>, regime string"
    before = {(r["pattern"], r["fold"]): r for r in patterns.evaluate(spark.createDataFrame(rows, names), ["a", "b", "c"], fitted=False).collect()}
    assert len({p for p, _ in before}) > 170 and all(0 <= r["coverage"] <= 1 and r["n"] <= 60 for r in before.values())
    flipped = [(f, 1 - y if f == 3 else y, p, r, g) for f, y, p, r, g in rows]
    after = {(r["pattern"], r["fold"]): r for r in patterns.evaluate(spark.createDataFrame(flipped, names), ["a", "b", "c"], fitted=False).collect()}
    for (name, fold), r in before.items():
        if fold < 3:
            assert after[name, fold]["logloss"] == pytest.approx(r["logloss"])
        elif r["n"]:  # the same predictions, judged by the other outcome
            assert after[name, fold]["accuracy"] == pytest.approx(1 - r["accuracy"], abs=1e-9)
    best = patterns.best_so_far(spark.createDataFrame([(p, f, r["coverage"], r["logloss"]) for (p, f), r in before.items()], "pattern string, fold int, coverage double, logloss double"), 4, least=2)
    assert {r["fold"] for r in best.collect()} == {2, 3}


def test_fitted_patterns(spark):
    from tidemark.operators import patterns

    rng = random.Random(13)
    rows = [(f, y, [min(max(0.5 + 0.3 * (y - 0.5) + rng.gauss(0, 0.2), 0.01), 0.99) for _ in range(2)], [], "x") for f in range(2) for y in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "fold int, y int, p array<double>, risk array<double>, regime string")
    got = {r["pattern"]: r for r in patterns.evaluate(df, ["a", "b"]).where("fold = 1").collect()}
    assert len(got) == len(patterns.PATTERNS) + len(patterns.LEARNED)
    assert all(math.isfinite(r["logloss"]) for r in got.values() if r["n"])
    for name in ("stack_logistic_prob_C1", "platt_after_equal_mean", "beta_after_prior_quality", "cal_temperature_equal"):
        assert got[name]["logloss"] < got["equal_mean"]["logloss"], name


def test_models_of_one_instrument_and_one_series(spark):
    rng = random.Random(15)
    names = list(production.SYMBOL_FEATURES)
    rows = []
    for s, n in (("A", 260), ("B", 100)):
        for d in range(n):
            x = [rng.gauss(0, 1) for _ in names]
            x[0] = 3.0 if d == n - 1 else x[0]
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=d), *[None if rng.random() < 0.02 and k else v for k, v in enumerate(x)], None if d == n - 1 else int(x[0] + 0.3 * rng.gauss(0, 1) > 0)))
    df = spark.createDataFrame(rows, f"symbol string, session_date date, {', '.join(f'{x} double' for x in names)}, target_up_1d int")
    got = {r["symbol"]: r for r in production.symbol_models(df, ["symbol"]).collect()}
    assert got["A"]["p_symbol"] > 0.9 and got["A"]["n_calibration"] == 51 and got["B"]["p_symbol"] is None and got["B"]["n_core"] == 69
    close, rows = 100.0, []
    for d in range(200):
        close *= 1 + 0.01 * rng.gauss(0, 1)
        for family in ("x", "y")[: 1 + (d < 50)]:
            rows.append((family, dt.date(2020, 1, 1) + dt.timedelta(days=d), close, T(d)))
    macro = spark.createDataFrame(rows, "family string, session_date date, close double, available_at timestamp")
    w = production.Window.partitionBy("family").orderBy("session_date")
    macro = macro.withColumn("ret_1d", c("close") / F.lag("close").over(w) - 1).withColumn("volatility_20", F.stddev_samp("ret_1d").over(w.rowsBetween(-19, 0)))
    frame = production.market_frame(macro)
    p = {r["family"]: r["p_up_1d"] for r in production.market_probabilities(frame).collect()}
    assert 0 < p["x"] < 1 and p["y"] is None
    ranges = {r["family"]: r for r in production.market_ranges(frame).collect()}
    assert ranges["x"]["range_low_1d"] < ranges["x"]["expected_close_1d"] < ranges["x"]["range_high_1d"] and ranges["y"]["prediction_status"].startswith("DEFERRED")


def test_experience_memory_has_every_dimension_of_the_method(spark, small):
    from tidemark.plans import serving

    got = [r.asDict() for r in serving.experience_memory(spark, small).collect()]
    of = lambda d: {r["segment"]: r for r in got if r["dimension"] == d}
    total = sum(r["n"] for r in of("by_regime").values())
    for d in ("by_market_situation", "daily", "daily_by_model"):
        assert sum(r["n"] for r in of(d).values()) == total > 0
    daily, by_model = of("daily"), of("daily_by_model")
    assert all(sum(by_model[f"{x}|{m}"]["n"] for m in ("momentum", "reversal") if f"{x}|{m}" in by_model) == r["n"] for x, r in daily.items())
    for k in (5, 20, 60):
        assert of("rolling")[f"{k}_sessions"]["n"] == sum(daily[x]["n"] for x in sorted(daily)[-k:])
    assert len(of("by_direction_confidence")) == 4 and len(of("by_model_disagreement")) == len(of("by_error_bucket")) == 5
