"""Histogram trees against plain numpy versions that look at every split of every leaf."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 2000
    x = rng.normal(size=(n, 4)).round(2)
    x[::17, 1] = np.nan
    noise = rng.normal(size=n)
    y = (x[:, 0] + np.nan_to_num(x[:, 1]) * x[:, 2] + noise > 0).astype(float)
    r = (x[:, 0] * 0.02 + 0.01 * noise).round(5)
    w = rng.integers(1, 4, n).astype(float)
    data = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i]), float(r[i]), float(w[i])) for i in range(n)]
    return spark.createDataFrame(data, "i long, a double, b double, c double, d double, y double, r double, w double").repartition(5).cache()


NAMES = ["a", "b", "c", "d"]


def matrix(rows, bins, *columns):
    got = rows.orderBy("i").toPandas()
    return (bins.codes([got[x].to_numpy(float) for x in NAMES]), *[got[x].to_numpy(float) for x in columns])


def plain_tree(x, g, h, leaves, least, ridge):
    """(set of (rows of the node, feature, code) of the splits, leaves as row sets) by best-first growth over all splits."""

    def best(at):
        found = None
        for f in range(x.shape[1]):
            for code in np.unique(x[at, f]):
                left = x[at, f] <= code
                nl, nr = left.sum(), (~left).sum()
                hl, hr = h[at][left].sum(), h[at][~left].sum()
                if min(nl, nr) < least or min(hl, hr) < trees.LEAST_HESSIAN:
                    continue
                gl, gr = g[at][left].sum(), g[at][~left].sum()
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
                if gain > 0 and (found is None or gain > found[0] + 1e-12):
                    found = (gain, f, int(code), at[left], at[~left])
        return found

    every = np.arange(len(x))
    open_, done = [(every, best(every))], []
    while len(open_) < leaves:
        ready = [k for k, (_, b) in enumerate(open_) if b]
        if not ready:
            break
        k = max(ready, key=lambda k: open_[k][1][0])
        at, b = open_.pop(k)
        done.append((len(at), b[1], b[2]))
        open_ += [(side, best(side)) for side in b[3:]]
    return sorted(done), [at for at, _ in open_]


def splits_of(tree, x):
    feature, code, left, right, _ = tree
    at, out = {0: np.arange(len(x))}, []
    for k in range(len(feature)):
        if left[k] >= 0:
            goes = x[at[k], feature[k]] <= code[k]
            at[left[k]], at[right[k]] = at[k][goes], at[k][~goes]
            out.append((len(at[k]), int(feature[k]), int(code[k])))
    return sorted(out)


@pytest.mark.parametrize(("loss", "label", "leaves"), [("log", "y", 31), ("log", "y", 4), ("squared", "r", 15)])
def test_boosting_grows_the_trees_of_plain_numpy(rows, loss, label, leaves):
    bins = trees.fit_bins(rows, NAMES, 32)
    model = trees.fit_boosted(rows, NAMES, label, loss=loss, rounds=3, rate=0.3, leaves=leaves, weight="w", bins=bins)
    x, y, w = matrix(rows, bins, label, "w")
    p = (w * y).sum() / w.sum()
    f = np.full(len(y), math.log(p / (1 - p)) if loss == "log" else p)
    assert model.start == pytest.approx(f[0], rel=1e-5) and len(model.trees) == 3
    for tree in model.trees:
        g, h = model.loss.gradients(y, f)
        want, parts = plain_tree(x, w * g, w * h, leaves, 20, 1.0)
        assert splits_of(tree, x) == want and len(parts) <= leaves
        values = tree[4][trees.leaf_of(tree, x)]
        for at in parts:
            assert values[at] == pytest.approx(-0.3 * (w * g)[at].sum() / ((w * h)[at].sum() + 1.0), rel=1e-3, abs=1e-7)
        f = f + values
    got = {r["i"]: r["s"] for r in model.predict(rows, "s").select("i", "s").collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(list(1 / (1 + np.exp(-f)) if loss == "log" else f))


def smallest_reaching(v, w, q):
    order = np.argsort(v, kind="stable")
    return v[order][np.searchsorted(np.cumsum(w[order]), q * w.sum() - 1e-9)]


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_pinball_leaves_hold_exact_quantiles(rows, q):
    bins = trees.fit_bins(rows, NAMES, 32)
    model = trees.fit_boosted(rows, NAMES, "r", loss="pinball", level=q, rounds=3, rate=0.5, leaves=6, weight="w", bins=bins)
    x, y, w = matrix(rows, bins, "r", "w")
    f = np.full(len(y), smallest_reaching(y, w, q))
    assert model.start == f[0]
    for tree in model.trees:
        g, h = model.loss.gradients(y, f)
        assert splits_of(tree, x) == plain_tree(x, w * g, w * h, 6, 20, 1.0)[0]
        leaf = trees.leaf_of(tree, x)
        for k in np.unique(leaf):
            at = leaf == k
            assert tree[4][k] == 0.5 * smallest_reaching((y - f)[at], w[at], q)
        f = f + tree[4][leaf]


def test_models_do_not_depend_on_partitions_or_refreshed_scores(rows, monkeypatch):
    bins = trees.fit_bins(rows, NAMES, 16)
    how = {"rounds": 5, "rate": 0.2, "leaves": 5, "bins": bins}
    one = trees.fit_boosted(rows, NAMES, "y", **how)
    monkeypatch.setattr(trees, "REFRESH", 2)
    two = trees.fit_boosted(rows.repartition(2, "i"), NAMES, "y", **how)
    forest = [trees.fit_extra_trees(d, NAMES, "y", trees=4, depth=5, bins=bins) for d in (rows, rows.repartition(2, "i"))]
    assert one.start == two.start
    for a, b in [*zip(one.trees, two.trees, strict=True), *zip(forest[0].trees, forest[1].trees, strict=True)]:
        for u, v in zip(a[:4], b[:4], strict=True):
            assert u.tolist() == v.tolist()
        assert a[4] == pytest.approx(b[4], abs=1e-12)


def test_extra_trees_take_the_best_of_the_drawn_splits(rows):
    bins = trees.fit_bins(rows, NAMES, 32)
    forest = trees.fit_extra_trees(rows, NAMES, "y", trees=6, least=20, depth=6, tries=2, weight="w", bins=bins, at_once=40)
    x, y, w = matrix(rows, bins, "y", "w")
    for t, tree in enumerate(forest.trees):
        feature, code, left, right, value = tree
        todo = [(0, 1, np.arange(len(y)), np.zeros(4, int), bins.top - 1)]
        seen = 0
        while todo:
            k, path, at, low, high = todo.pop()
            seen += 1
            assert value[k] == pytest.approx((w * y)[at].sum() / w[at].sum(), rel=1e-5, abs=1e-9)
            best = None
            for f, b in trees.draw_splits(42, t, path, low, high, 2) if path < 64 and 0 < y[at].mean() < 1 else []:
                goes = x[at, f] <= b
                sides = [at[goes], at[~goes]]
                if min(map(len, sides)) >= 20:
                    score = sum((w * y)[s].sum() ** 2 / w[s].sum() for s in sides)
                    if best is None or score > best[0] + 1e-9:
                        best = (score, f, b, sides)
            assert (left[k] >= 0) == (best is not None)
            if best:
                _, f, b, sides = best
                assert (feature[k], code[k]) == (f, b)
                for side, child in enumerate((left[k], right[k])):
                    lo, hi = low.copy(), high.copy()
                    (lo if side else hi)[f] = b + 1 if side else b - 1
                    todo.append((child, 2 * path + side, sides[side], lo, hi))
        assert seen == len(feature)
    hit = forest.predict(rows, "p").agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]
    assert hit > 0.65


def test_pinball_loss_is_below_the_constants_on_held_out_rows(rows):
    train, test = rows.where("i % 4 <> 0"), rows.where("i % 4 = 0")
    for q in (0.1, 0.9):
        model = trees.fit_boosted(train, NAMES, "r", loss="pinball", level=q, rounds=12, rate=0.2, leaves=8, bins=32)
        loss = lambda s, q=q: F.avg(F.greatest(q * (F.col("r") - s), (q - 1) * (F.col("r") - s)))
        one, other = model.predict(test, "s").agg(loss(F.col("s")), loss(F.lit(model.start))).first()
        assert one < 0.9 * other


def test_forest_quantiles_by_brute_force(spark):
    rng = random.Random(2)
    train = [([rng.randrange(3), rng.randrange(4)], rng.choice([0.1, 0.2, 0.3, -0.5, None])) for _ in range(300)]
    test = [(k, [rng.randrange(3), rng.randrange(5)]) for k in range(60)]
    got = trees.forest_quantiles(spark.createDataFrame(train, "leaf array<int>, v double"), spark.createDataFrame(test, "id long, leaf array<int>"), "id", "v", [0.1, 0.5, 0.9])
    got = {r["id"]: r["q"] for r in got.collect()}
    for k, leaves in test:
        weight = defaultdict(int)
        for t, leaf in enumerate(leaves):
            own = [v for x, v in train if x[t] == leaf and v is not None]
            for v in set(own):
                weight[v] += own.count(v) * trees.SHARE // len(own)
        total, want = sum(weight.values()), []
        for q in (0.1, 0.5, 0.9):
            want.append(next(v for v in sorted(weight) if sum(weight[u] for u in weight if u <= v) >= q * total))
        assert got[k] == want


def test_bits_keep_the_order_of_doubles():
    x = np.array([-np.inf, -2.5, -1e-300, -0.0, 0.0, 3e-310, 1.0, 7.25, np.inf])
    u = trees.ordered_bits(x)
    assert (np.diff(u.astype(object)) >= 0).all() and u[3] == u[4] and [trees.of_ordered_bits(int(v)) for v in u] == [*x[:3], 0.0, *x[4:]]


def test_nothing_to_learn_from(spark, rows):
    empty = rows.where("false")
    assert trees.fit_boosted(empty, NAMES, "y", rounds=2).trees == () == trees.fit_extra_trees(empty, NAMES, "y", trees=2).trees
    assert trees.fit_boosted(rows, NAMES, "y", rounds=2, leaves=4, bins=8).predict(empty, "s").collect() == []
    flat = rows.select(F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b"), "y")
    model = trees.fit_boosted(flat, ["a", "b"], "y", rounds=2)
    assert model.trees == () and trees.fit_extra_trees(flat, ["a", "b"], "y", trees=2).predict(flat, "p").agg(F.count_distinct("p")).first()[0] == 1


def test_forest_quantiles_of_large_leaves_do_not_multiply_rows(spark):
    rng = np.random.default_rng(3)
    train = [([int(a), int(b)], float(v)) for a, b, v in zip(rng.integers(0, 2, 4000), rng.integers(0, 3, 4000), rng.normal(size=4000).round(3), strict=True)]
    test = [(k, [k % 2, k % 4]) for k in range(60)]  # leaf 3 of the second tree is not known
    got = trees.forest_quantiles(spark.createDataFrame(train, "leaf array<int>, v double"), spark.createDataFrame(test, "id long, leaf array<int>"), "id", "v", [0.1, 0.5, 0.9])
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()  # a row of test met every label of its leaves
    found = {r["id"]: r["q"] for r in got.collect()}
    for k, leaves in test:
        weight = {}
        for t, own in enumerate(leaves):
            labels = [v for x, v in train if x[t] == own]
            for v in set(labels):
                weight[v] = weight.get(v, 0) + trees.SHARE * labels.count(v) // len(labels)
        order = sorted(weight)
        upto = np.cumsum([weight[v] for v in order])
        assert found[k] == [order[int((upto >= upto[-1] * q).argmax())] for q in (0.1, 0.5, 0.9)]


def test_models_that_share_blocks_are_those_of_the_table(rows):
    bins = trees.fit_bins(rows, NAMES, 16)
    shared = trees.blocks(rows, NAMES, "r", bins=bins)
    assert shared.n == 2000 and shared.rows.count() <= rows.rdd.getNumPartitions()  # a pass hands blocks to Python, not rows
    for how in ({"loss": "squared"}, {"loss": "pinball", "level": 0.9}):
        one, two = (trees.fit_boosted(d, NAMES, "r", rounds=1, leaves=3, bins=bins, **how) for d in (rows, shared))
        assert one.start == two.start and [[v.tolist() for v in t] for t in one.trees] == [[v.tolist() for v in t] for t in two.trees]


def test_features_of_models_alone_are_those_of_the_pack():
    from tidemark.operators import technical
    from tidemark.plans.forests import FEATURES

    rng = np.random.default_rng(1)
    close = 50 + rng.normal(size=120).cumsum()
    low, high, volume = close - rng.random(120), close + rng.random(120), rng.integers(0, 9, 120).astype(float)
    with np.errstate(all="ignore"):
        alone, every = technical._plain(close, high, low, volume), technical._pack(close, close, high, low, volume)
    assert technical.PLAIN >= set(FEATURES)
    for x in technical.PLAIN:
        np.testing.assert_array_equal(alone[x], every[x])


@pytest.mark.parametrize("how", [{"loss": "log", "label": "y"}, {"loss": "squared", "label": "r"}, {"loss": "pinball", "level": 0.9, "label": "r", "weight": "w"}])
def test_tasks_that_grow_trees_together_grow_those_of_one_task(rows, monkeypatch, how):
    how = {"features": NAMES, "rounds": 4, "rate": 0.2, "leaves": 6, "bins": trees.fit_bins(rows, NAMES, 16)} | how
    alone = trees.fit_boosted(rows, **how)
    monkeypatch.setattr(trees, "TASK_ROWS", 700)
    together = trees.fit_boosted(rows.repartition(7), **how)
    assert len(alone.trees) == 4 and alone.start == together.start
    assert [[v.tolist() for v in t] for t in alone.trees] == [[v.tolist() for v in t] for t in together.trees]


def sizes_of(monkeypatch, query, spark, small):
    """What a query asks of the models, which are then made of one tree."""
    asked, boosted, forest = [], trees.fit_boosted, trees.fit_extra_trees
    monkeypatch.setattr(trees, "fit_boosted", lambda *a, rounds=300, **k: asked.append(("boosted", rounds)) or boosted(*a, rounds=1, **k))
    monkeypatch.setattr(trees, "fit_extra_trees", lambda df, x, y, trees=300, **k: asked.append(("forest", trees)) or forest(df, x, y, 1, **k))
    query(spark, small)
    return sorted(asked)


def test_direction_models_have_the_sizes_of_the_study(spark, small, monkeypatch):
    from tidemark.plans import forests

    assert sizes_of(monkeypatch, forests.direction_forecasts, spark, small) == [("boosted", 300), ("boosted", 500), ("forest", 300)]


def test_return_models_have_the_sizes_of_the_study(spark, small, monkeypatch):
    from tidemark.plans import forests

    assert sizes_of(monkeypatch, forests.return_bands, spark, small) == [("boosted", 250)] * 4


def test_both_ways_to_a_place_find_the_same():
    rng = np.random.default_rng(5)
    n, leaves, of_row = 50, 6, rng.integers(0, 6, (40, 3))
    key = np.flatnonzero(rng.random(3 * leaves * n) < 0.4)
    w = rng.integers(1, 1 << 40, len(key))
    home = (np.arange(3) * leaves + of_row) * n
    low, high = np.searchsorted(key, home), np.searchsorted(key, home + n)
    sums = np.concatenate([[0], np.cumsum(w)])
    more = (rng.random(40) * (sums[high] - sums[low]).sum(1)).astype(np.int64) + 1
    got = trees._sorted_place(low, high, more, key % n, w, n), trees._halved_place(low, high, home, more, key, sums, n)
    for r in range(40):
        at = np.concatenate([np.arange(a, b) for a, b in zip(low[r], high[r], strict=True)])
        want = next(x for x in range(n) if w[at][key[at] % n <= x].sum() >= more[r])
        assert got[0][r] == got[1][r] == want


def test_quantiles_of_a_large_table_are_those_of_its_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    train = spark.createDataFrame([([int(a), int(b)], float(v)) for a, b, v in zip(rng.integers(0, 9, 900), rng.integers(0, 7, 900), rng.normal(size=900), strict=True)], "leaf array<int>, v double")
    test = spark.createDataFrame([(k, [k % 9, k % 7]) for k in range(300)], "id long, leaf array<int>")
    of = lambda: sorted(map(tuple, trees.forest_quantiles(train, test, "id", "v", [0.1, 0.5, 0.9]).collect()))
    plain, parts = of(), []
    monkeypatch.setattr(trees, "SPOTS", 20)  # ranges are now put where quantiles lie
    monkeypatch.setattr(trees, "_ranged_quantiles", lambda rows, asked, sizes, edges, levels, was=trees._ranged_quantiles: parts.append(list(edges)) or was(rows, asked, sizes, edges, levels))
    assert of() == plain and len(parts) == 2 and parts[0] != parts[1]
