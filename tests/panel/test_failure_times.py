"""Times to failure against a plain scan."""

import random

import pytest

from tidemark.operators import control


def plain(failed):
    """[(follow_up, event)] of every fold up to the last label."""
    last = max((k for k, v in enumerate(failed) if v is not None), default=-1)
    out = []
    for t in range(last + 1):
        hit = next((k for k in range(t, last + 1) if failed[k] == 1), None)
        out.append(((last if hit is None else hit) + 1 - t, int(hit is not None)))
    return out


@pytest.fixture(scope="module")
def history():
    rng = random.Random(3)
    made = {m: [int(rng.random() < share) for _ in range(14)] + [None] for m, share in (("a", 0.3), ("b", 0.1), ("d", 0.0))}
    made["a"][4] = None  # a fold without a label
    return {**made, "e": [None], "g": [1, None]}


@pytest.fixture(scope="module")
def labels(spark, history):
    return spark.createDataFrame([(10 + 3 * k, m, v) for m, x in history.items() for k, v in enumerate(x)], "fold int, model string, failed int")


def test_times_against_a_scan(labels, history):
    got = {}
    for r in control.failure_times(labels).orderBy("model", "fold").collect():
        got.setdefault(r["model"], []).append((r["follow_up"], r["event"]))
    assert got == {m: plain(x) for m, x in history.items() if plain(x)}


def test_scores_leave_censored_cases_out(labels, history):
    risks = control.failure_risk(labels)
    said = {(r["model"], (r["fold"] - 10) // 3): r["folds_to_failure"] for r in risks.collect()}
    for r in control.failure_time_scores(control.failure_times(labels), risks).collect():
        cases = [(said[r["model"], t], n) for t, (n, hit) in enumerate(plain(history[r["model"]])) if hit]
        censored = sum(1 - hit for _, hit in plain(history[r["model"]]))
        assert (r["event_cases"], r["censored_cases"]) == (len(cases), censored)
        assert r["mae"] == (pytest.approx(sum(abs(p - n) for p, n in cases) / len(cases)) if cases else None)
        assert r["observed_mean"] == (pytest.approx(sum(n for _, n in cases) / len(cases)) if cases else None)


def test_hazards_keep_censored_cases_at_risk(labels, history):
    for model in "abdg":
        survival, times = 1.0, plain(history[model])
        rows = [r for r in control.failure_hazard(control.failure_times(labels)).orderBy("horizon").collect() if r["model"] == model]
        assert [r["horizon"] for r in rows] == sorted({n for n, _ in times})
        for r in rows:
            risk, hits = sum(n >= r["horizon"] for n, _ in times), sum(n == r["horizon"] and hit for n, hit in times)
            survival *= 1 - hits / risk
            assert (r["at_risk"], r["events"]) == (risk, hits) and r["survival"] == pytest.approx(survival)


def test_a_failure_to_come_changes_no_earlier_risk(spark, history, labels):
    later = labels.where("fold < 40").unionByName(labels.where("fold >= 40").selectExpr("fold", "model", "1 - failed as failed"))
    of = lambda x: {(r["model"], r["fold"]): r["risk"] for r in control.failure_risk(x).where("fold <= 43").collect()}
    assert of(labels) == of(later)
