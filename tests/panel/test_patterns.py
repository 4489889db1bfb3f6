"""Stackers and curves that are fitted together, against fits one at a time; quantiles of earlier folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import logistic, patterns


def cases(n=900, folds=3):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x = rng.gauss(0, 1)
        p = [round(1 / (1 + np.exp(-x)), 2), round(1 / (1 + np.exp(0.7 * x + 0.3)), 2)]
        rows.append((1990 + i % folds, int(rng.random() < 0.3 + 0.4 * (x > 0)), [float(v) for v in p], [rng.choice([None, float("nan"), x, 40 * x]), rng.random()], rng.choice("ab")))
    return rows


def test_fits_together_as_one_by_one(spark):
    df = spark.createDataFrame(cases(), "fold int, y int, p array<double>, risk array<double>, regime string").repartition(4)
    prior = patterns.priors(df, ["a", "b"], 2)
    for t in (1991, 1992):
        q = patterns.softmax(-prior[t].loss, 0.05)
        rows = df.where(f"fold < {t}").select("y", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), "risk")
        held = lambda x: patterns.clip(x, 1e-6, 1 - 1e-6)
        z = lambda x: F.log(held(x) / (1 - held(x)))
        rows = rows.withColumns({"z0": z(F.col("p0")), "z1": z(F.col("p1")), "equal_mean": (F.col("p0") + F.col("p1")) / 2, "prior_quality": F.col("p0") * float(q[0]) + F.col("p1") * float(q[1])}).cache()
        for s in patterns.STACK_STRENGTHS:
            for kind, names in (("prob", ["p0", "p1"]), ("logit", ["z0", "z1"])):
                one, got = logistic.fit_logistic(rows, names, "y", s, least=80), prior[t].stackers[f"{kind}_{s:g}"]
                assert (*got.means, *got.scales, *got.weights, got.intercept, got.rows) == pytest.approx((*one.means, *one.scales, *one.weights, one.intercept, one.rows), abs=1e-7)
        for name, column in (("equal_mean", "equal_mean"), ("prior_quality", "prior_quality"), ("model_0", "p0"), ("model_1", "p1")):
            p = F.col(column)
            for curve, given in (("platt", [z(p)]), ("beta", [F.log(held(p)), F.log(1 - held(p))])):
                one = logistic.fit_logistic(rows.select("y", *[g.alias(f"g{k}") for k, g in enumerate(given)]), [f"g{k}" for k in range(len(given))], "y", least=30)
                got = prior[t].curves[curve, name]
                assert (*got.weights, got.intercept) == pytest.approx((*one.weights, one.intercept), abs=1e-7)
            edges, values = prior[t].curves["isotonic", name]
            want = patterns.isotonic_blocks(rows, [], column, "y").orderBy("low").collect()
            assert edges.tolist() == pytest.approx([v for r in want for v in (r["low"], r["high"])]) and values.tolist() == [r["value"] for r in want for _ in range(2)]
            assert prior[t].curves["temperature", name] in patterns.TEMPERATURE_GRID
        known = [[r["risk"][j] for r in rows.collect() if r["risk"][j] is not None and not np.isnan(r["risk"][j])] for j in range(2)]
        assert prior[t].risk_middle.tolist() == pytest.approx([np.median(v) for v in known]) and prior[t].risk_spread.tolist() == pytest.approx([np.std(v) for v in known])
        rows.unpersist()


def test_jobs_do_not_grow_with_models_and_folds(spark):
    df = spark.createDataFrame(cases(folds=6), "fold int, y int, p array<double>, risk array<double>, regime string")
    spark.sparkContext.setJobGroup("patterns-jobs", "")
    try:
        patterns.priors(df, ["a", "b"], 2)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("patterns-jobs")) < 150  # 5 folds of 16 fits: over 1,000 one at a time
    finally:
        spark.sparkContext._jsc.clearJobGroup()
