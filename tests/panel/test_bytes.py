"""What shared steps move: exchanges, and rows that are dealt to find a quantile."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import control
from tidemark.operators.patterns import prior_quantiles
from tidemark.plans.panel import predicted


def most_shuffled(spark, run):
    """Records that the largest shuffle stage of run writes."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return max(n for stage, n in stages().items() if stage not in before)


def test_windows_of_cases_need_no_exchange_of_their_own(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables: bars are not broadcast
    try:
        plan = predicted(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and "Exchange hashpartitioning(asset_class" not in plan


def test_quantiles_deal_only_what_lies_inside_a_bracket(spark):
    df = spark.range(40_000).select((F.hash("id") / 1e9).alias("x"))
    got = []
    assert most_shuffled(spark, lambda: got.append(exact_quantiles(df, [], "x", [0.5]).first())) < 4_000
    assert got[0]["q"][0] == np.quantile([r[0] for r in df.collect()], 0.5) and got[0]["n"] == 40_000


def test_prior_quantiles_deal_few_values_of_a_crowded_bucket(spark, tmp_path):
    # one far value leaves all others in a few buckets of 4,096
    df = spark.range(40_000).select((F.col("id") % 8).cast("int").alias("fold"), F.when(F.col("id") == 7, 0.5).otherwise((F.pmod(F.hash("id"), F.lit(1_000_003)) / 1e10)).alias("v"))
    df.write.parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    got = []
    assert most_shuffled(spark, lambda: got.extend(prior_quantiles(df, "v", {"m": 0.5}).collect())) < 20_000
    rows = df.collect()
    assert {r["fold"]: r["m"] for r in got} == pytest.approx({t: np.quantile([r["v"] for r in rows if r["fold"] < t], 0.5) for t in range(1, 8)})


def test_revisions_hold_more_than_one_key_a_batch(spark):
    rows = [(None if k == 0 else f"k{k}", t, 0.1 * ((k * 7 + t * 3) % 10), 0.05 * ((k + t) % 9), (k + t) % 5 > 0) for k in range(30) for t in range(20)]
    df = spark.createDataFrame(rows, "s string, t int, selected double, update_need double, active boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["s"], r["t"]): (r["action"], r["output"]) for r in control.revisions(df, ["s"], ["t"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, state = {}, {}
    for s, t, value, asks, on in rows:
        action, state[s] = control.revised(state.get(s), value, asks, on)
        want[s, t] = (action, state[s])
    assert got == want
    plan = control.revisions(df, ["s"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_rows_are_not_exchanged_to_meet_a_row_a_fold(spark):
    rows = spark.createDataFrame([(f, "a", f % 2, "x") for f in range(4)], "fold int, regime string, failed int, strategy string")
    plan = control.prior_failure_rates(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    states = spark.createDataFrame([(f, 0.6, 0.1, 0.5, 0.8, 1.0, 0.2) for f in range(4)], "fold int, agreement double, prediction_entropy double, data_completeness double, feature_reliability double, ood double, x double")
    assert "rightHint=(strategy=broadcast)" in control.predictability(states)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("crowded", [False, True])
def test_nearest_cases_meet_few_cells_and_equal_all_pairs(spark, monkeypatch, crowded):
    from tidemark.operators import retrieval

    rng, asked = np.random.default_rng(4), []
    n = 3_000
    signs = rng.integers(0, 3, (n, 5)) / 4.0 if crowded else rng.normal(0, 0.2, (n, 5))
    fold, regime, failed = rng.integers(0, 5, n), rng.choice(["up", "down"], n), rng.integers(0, 2, n)
    names = ["prediction", "predictability", "ood", "failure_risk", "disagreement"]
    rows = [(k, int(fold[k]), str(regime[k]), int(failed[k]), *map(float, signs[k])) for k in range(n)] + [(n, None, "up", 1, *[0.1] * 5), (n + 1, 2, "up", 1, None, *[0.1] * 4)]
    df = spark.createDataFrame(rows, "id int, fold int, regime string, failed int, " + ", ".join(f"{x} double" for x in names))
    split = retrieval.Cells.split
    monkeypatch.setattr(retrieval.Cells, "split", lambda *x: asked.append(split(*x)) or asked[-1])
    got = {r["id"]: (r["hits"], r["failure_rate"], r["best_distance"]) for r in control.nearest_cases(df, "id", size=32).collect()}
    assert len(asked[0].regimes) > 20
    want = {}
    for k in range(n):
        d = sum(np.abs(signs[:, j] - signs[k, j]) / s for j, s in enumerate((0.2, 0.5, 0.5, 0.5, 0.1))) / 5 * np.where(regime == regime[k], 0.8, 1.0)
        d[fold >= fold[k]] = np.inf
        top = [j for j in np.argsort(d, kind="stable")[:10] if np.isfinite(d[j])]
        if top:
            want[k] = (len(top), pytest.approx(failed[top].mean()), pytest.approx(d[top[0]]))
    assert got == want


def test_experience_is_dealt_by_segments_without_joins(spark, small):
    from tidemark.operators import experience
    from tidemark.plans import serving

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = serving._errors(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and "Exchange hashpartitioning(asset_class" not in plan
    rows = [("a" if k % 3 else None, ["x", "y"] if k % 2 else [], 0.1 * (k % 10), k % 2, 0.01 * k) for k in range(40)]
    df = spark.createDataFrame(rows, "kind string, tags array<string>, p double, y int, return_error double")
    sums = experience.experience_sums(df, {"by": "kind"}, {"tags": "tags"})
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    got = {(r["dimension"], r["segment"]): (r["n"], r["abs_return_error_sum"]) for r in sums.collect()}
    total = lambda own: (len(own), pytest.approx(sum(r[4] for r in own)))
    assert got == {("by", "a"): total([r for r in rows if r[0]]), ("by", "UNKNOWN"): total([r for r in rows if not r[0]]), ("tags", "x"): total([r for r in rows if r[1]]), ("tags", "y"): total([r for r in rows if r[1]])}


def test_ranks_take_one_sort_each_and_tasks_bounded_rows(spark, monkeypatch, tmp_path):
    from tidemark import scratch
    from tidemark.operators import cross, scores

    monkeypatch.setattr(scratch, "DEALT_ROWS", 100)
    df = spark.range(2_000).select((F.col("id") % 40).cast("int").alias("d"), F.pmod(F.hash("id"), F.lit(17)).alias("p"), F.pmod(F.hash("id", F.lit(1)), F.lit(13)).alias("r"))
    df.write.parquet(f"{tmp_path}/r")
    rows = scratch.dealt(spark.read.parquet(f"{tmp_path}/r"), "d")
    assert rows.rdd.getNumPartitions() == 20
    sorts = lambda x: x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [")
    ranked = cross.cross_sectional_rank(rows, ["d"], "p", "r")
    assert sorts(ranked) == 3 and sorts(scores.rank_ic(rows, ["d"], "r", "p")) == 2
    got = ranked.where("d = 3").toPandas()
    pct = lambda x: x.rank(ascending=False) / len(x)
    score = 0.5 * pct(got["p"]) + 0.5 * pct(got["r"])
    assert got["rank_score"].tolist() == pytest.approx(score.tolist()) and got["rank"].tolist() == score.rank(ascending=False).tolist()
