"""Adaptive conformal sets against a plain loop over sessions."""

import random

import numpy as np
import pytest

from tidemark.operators import conformal

NAMES = "fold string, model string, y int, p double, session_date int, `a.b` int, id int, key string"


def plain(cal, test, alpha, gamma, low, high):
    """{id: (p0, p1, level)} by one loop over sessions; rows without y or p are scored as far as they can be and not learned."""
    hold = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    score = lambda r: None if r[2] is None or r[3] is None else (1 - hold(r[3]) if r[2] == 1 else hold(r[3]))
    out = {}
    for key in {r[:2] for r in test}:
        bank, level = [s for r in cal if r[:2] == key and (s := score(r)) is not None], min(max(alpha, low), high)
        own = [r for r in test if r[:2] == key]
        for day in sorted({r[4] for r in own}):
            rows, missed = [r for r in own if r[4] == day], []
            for r in rows:
                p0, p1 = (None, None) if r[3] is None else ((1 + sum(x >= t for x in bank)) / (1 + len(bank)) for t in (hold(r[3]), 1 - hold(r[3])))
                out[r[6]] = (p0, p1, level)
                if score(r) is not None:
                    missed.append((p1 if r[2] == 1 else p0) <= level)
            if missed:
                level = min(max(level + gamma * (alpha - sum(missed) / len(missed)), low), high)
            bank += [s for r in rows if (s := score(r)) is not None]
    return out


@pytest.mark.parametrize("bucket", [500_000, 7])
@pytest.mark.parametrize("decimals", [1, 6])
def test_equal_to_a_loop_over_sessions(spark, monkeypatch, bucket, decimals):
    monkeypatch.setattr(conformal, "BUCKET_ROWS", bucket)
    rng = random.Random(decimals)
    p = lambda: rng.choice([None, 0.0, 1.0]) if rng.random() < 0.05 else round(rng.random(), decimals)
    make = lambda n, keys: [(*rng.choice(keys), rng.choice([0, 1, 1, None]), p(), rng.choice([1, 2, 3, 5, 8, 9, 20, 21, 22, 40, 41]), k, k, "x") for k in range(n)]
    keys = [("f", "a"), ("f", "a"), ("f", "a"), ("f", None), ("g", "a")]
    cal, test = make(60, keys[:4]), make(300, keys)
    got = conformal.adaptive_sets(spark.createDataFrame(cal, NAMES), spark.createDataFrame(test, NAMES), ["fold", "model"], alpha=0.2, gamma=0.05, low=0.05, high=0.3)
    assert {"a.b", "id", "key"} <= set(got.columns)
    rows = got.collect()
    wanted = plain(cal, test, 0.2, 0.05, 0.05, 0.3)
    assert len(rows) == len(test)
    for r in rows:
        p0, p1, level = wanted[r["id"]]
        assert r["alpha_used"] == pytest.approx(level, abs=1e-12)
        assert (r["p0"], r["p1"]) == ((None, None) if p0 is None else (pytest.approx(p0), pytest.approx(p1)))
        assert r["has1"] == (None if p1 is None else p1 > r["alpha_used"])


def test_without_rows_and_without_a_bank(spark):
    some = [("f", "a", 1, 0.7, d, 0, d, "x") for d in (1, 2, 2)]
    rows, none = spark.createDataFrame(some, NAMES), spark.createDataFrame([], NAMES)
    assert conformal.adaptive_sets(rows, none, ["fold", "model"]).collect() == []
    got = sorted((r["session_date"], r["p0"], r["p1"]) for r in conformal.adaptive_sets(none, rows, ["fold", "model"]).collect())
    assert got == [(1, 1.0, 1.0), (2, 0.5, 1.0), (2, 0.5, 1.0)]


def test_no_step_has_more_rows_than_its_input(spark, monkeypatch):
    kept, sizes = conformal.table, {}

    def noted(df, name):
        out = kept(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(conformal, "table", noted)
    monkeypatch.setattr(conformal, "BUCKET_ROWS", 100)
    rng = random.Random(4)
    make = lambda n: [("f", "a", rng.choice([0, 1]), round(rng.random(), 3), rng.randrange(30), k, k, "x") for k in range(n)]
    got = conformal.adaptive_sets(spark.createDataFrame(make(100), NAMES), spark.createDataFrame(make(600), NAMES), ["fold", "model"])
    assert got.count() == 600 and max(sizes.values()) <= 700  # a score was once a row for each of log2(sessions) blocks


def test_smaller_before_by_brute_force():
    rng = random.Random(5)
    for n, top in ((0, 1), (1, 1), (300, 1), (300, 9), (200, 1 << 20)):
        s, k = np.array([rng.randrange(top) for _ in range(n)], int), np.array([rng.randrange(4) for _ in range(n)], int)
        assert conformal.smaller_before(s, k).tolist() == [int(sum(k[j] for j in range(i) if s[j] < s[i])) for i in range(n)]
