"""Models, calibrators, evidence and audits."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, evidence, models


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        x = rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + math.exp(-2 * x)))
        rows.append((i, x, None if i % 50 == 0 else rng.gauss(0, 1), y, x / 50 + rng.gauss(0, 0.01), 1 / (1 + math.exp(-4 * x))))
    return spark.createDataFrame(rows, "i long, a double, b double, y int, y_ret double, p double").cache()


@pytest.mark.parametrize("name", models.DIRECTION)
def test_direction_models_learn(cases, name):
    scored = models.fit_probability(cases.where("i < 400"), cases.where("i >= 400").select("i", "a", "b", "y"), ["a", "b"], name, {"boosted": 8, "boosted_conservative": 8, "forest": 12})
    hit = scored.agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]
    assert scored.count() == 200 and hit > 0.65


def test_quantiles_in_order(cases):
    got = models.fit_quantiles(cases.where("i < 400"), cases.where("i >= 400"), ["a", "b"], "i", trees_=5).collect()
    assert len(got) == 200 and all(r["q"][0] <= r["q"][1] <= r["q"][2] for r in got)


def test_return_models(cases):
    train, test = cases.where("i < 400"), cases.where("i >= 400").select("i", "a", "b", "y_ret")
    sizes = {"mean": 20, "bands": 6}
    mean = models.fit_return(train, test, ["a", "b"], sizes)
    error, spread = mean.agg(F.avg(F.pow(F.col("y_ret") - F.col("expected_return"), 2)), F.var_pop("y_ret")).first()
    bands = models.fit_bands(train, test, ["a", "b"], sizes=sizes).collect()
    assert error < 0.6 * spread and len(bands) == 200 and all(r["q"] == sorted(r["q"]) for r in bands)
    inside = sum(r["q"][0] <= r["y_ret"] <= r["q"][2] for r in bands) / 200
    assert 0.6 < inside < 0.95


@pytest.mark.parametrize("name", models.CALIBRATORS)
def test_calibrators_lower_the_loss(cases, name):
    fitted = models.CALIBRATORS[name]().fit(cases)
    p = fitted.apply(F.col("p"))
    loss = lambda q: -(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))
    before, after, low, high = cases.agg(F.avg(loss(F.col("p"))), F.avg(loss(p)), F.min(p), F.max(p)).first()
    assert after < before and 0 < low <= high < 1
    assert [fitted.apply(F.col("p"))] and cases.select(fitted.apply(F.lit(0.5)).alias("v")).first()["v"] is not None


def test_one_class_calibrates_to_a_constant(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    for name in ("platt", "temperature"):
        got = df.select(models.CALIBRATORS[name]().fit(df).apply(F.col("p")).alias("v")).collect()
        assert got[0]["v"] == got[1]["v"] > 0.99
    assert (models.SIZES["forest"], models.SIZES["boosted"], models.SIZES["boosted_conservative"]) == (300, 300, 500)


def test_blend_skips_unknown(spark):
    df = spark.createDataFrame([(0.2, None, 0.6), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(models.blend([(F.col("a"), 0.55), (F.col("b"), 0.25), (F.col("c"), 0.2)])).collect()]
    assert got[0] == pytest.approx((0.2 * 0.55 + 0.6 * 0.2) / 0.75) and got[1] is None


def test_recency_weights_have_mean_one(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 1, 2, 3)], "session_date date")
    w = [r["weight"] for r in models.recency_weights(df, 1.0).orderBy("session_date").collect()]
    assert sum(w) == pytest.approx(4) and w[3] == pytest.approx(4 * w[0])


def test_bootstrap_is_seeded():
    x = [0.1, 0.2, -0.05, 0.3, 0.15, 0.1]
    one, two = evidence.moving_block_bootstrap(x), evidence.moving_block_bootstrap(x)
    assert one == two and one["probability_positive"] > 0.9 and one["p05"] <= one["mean"] <= one["p95"]
    assert evidence.sign_flip_p_value([1.0] * 8) < 0.05 < evidence.sign_flip_p_value([1.0, -1.0] * 4)
    assert math.isnan(evidence.moving_block_bootstrap([])["mean"])


def test_combinatorial_splits_are_purged():
    splits = evidence.combinatorial_splits(60)
    assert len(splits) == 15
    for train, test in splits:
        assert not set(train) & set(test) and not {t - 1 for t in test} & set(train) and not {t + 1 for t in test} & set(train)


def test_paired_evidence(spark):
    df = spark.createDataFrame([(f, m, 0.7 - 0.01 * (m == "new") * (f + 1)) for f in range(6) for m in ("new", "old")], "fold int, model string, logloss double")
    got = evidence.paired_evidence(evidence.paired_folds(df, "new", "old"))
    assert got["status"] == "OK" and got["positive_share"] == 1 and got["mean"] == pytest.approx(0.035)
    assert evidence.paired_evidence(evidence.paired_folds(df.where("fold < 3"), "new", "old"))["status"] == "INSUFFICIENT_FOLDS"
    s = {r["model"]: r for r in evidence.fold_summary(df).collect()}
    assert s["new"]["n_folds"] == 6 and s["new"]["recent"] < s["new"]["mean"] and s["new"]["signature"] == s["old"]["signature"]


def test_row_contract(spark):
    rows = [("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00"), ("2024-01-02T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z"), (None, None, None)]
    got = audits.row_contract(spark.createDataFrame(rows, "prediction_time string, prediction_cutoff string, available_at string")).collect()
    assert [r["pit_status"] for r in got] == ["PASS", "FAIL", "FAIL"]
    assert got[1]["violations"] == ["prediction_time_invalid", "available_after_cutoff"] and len(got[2]["violations"]) == 3


def test_gate_fails_closed():
    assert audits.gate({"a": 0}, {"a": 0})["status"] == "PASS"
    assert audits.gate({}, {"a": 0})["status"] == "BLOCKED" and audits.gate({"a": 1}, {"a": 0})["reasons"] == ["a: 1 > 0"]


def test_listed_and_delisted(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "snapshot_date int, symbol string")
    assert {(r["symbol"], r["change"]) for r in audits.listed_and_delisted(df, ["symbol"]).collect()} == {("c", "listed"), ("a", "delisted")}
    assert audits.snapshot_history(df, spark.createDataFrame([(2, "z"), (3, "z")], df.schema)).count() == 5


@pytest.mark.parametrize("name", models.CALIBRATORS)
def test_calibrators_learn_the_same_from_counted_cells(spark, name):
    df = spark.range(600).select((F.pmod(F.hash("id"), F.lit(37)) / 40.0).alias("p"), (F.pmod(F.hash("id", F.lit(1)), F.lit(40)) < F.pmod(F.hash("id"), F.lit(37))).cast("int").alias("y"))
    cells = models.probability_cells(df)
    assert cells.count() < 80
    asked = spark.createDataFrame([(k / 50,) for k in range(51)], "p double")
    got, want = ([r[0] for r in asked.select(models.CALIBRATORS[name]().fit(x).apply(F.col("p"))).collect()] for x in (cells, df))
    assert got == pytest.approx(want, abs=1e-6)


def test_isotonic_equals_the_fit_of_spark(spark):
    from pyspark.ml.regression import IsotonicRegression

    df = spark.range(3_000).select((F.pmod(F.hash("id"), F.lit(1009)) / 1009.0).alias("p"), (F.pmod(F.hash("id", F.lit(1)), F.lit(1009)) < F.pmod(F.hash("id"), F.lit(1009))).cast("int").alias("y"))
    model = IsotonicRegression(labelCol="y", featuresCol="p").fit(df.select(F.col("y").cast("double").alias("y"), "p"))
    fitted = models.Isotonic().fit(df)
    assert fitted.x.tolist() == pytest.approx(list(model.boundaries)) and fitted.y.tolist() == pytest.approx(list(model.predictions))
