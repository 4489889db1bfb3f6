"""Selection evidence: paired fold differences, bootstraps, purged combinatorial splits, sequential conformal levels.

Inputs of the resampling are one number a fold or session; they are aggregated in Spark and
resampled on the driver with seeded numpy generators.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def moving_block_bootstrap(x: Sequence[float], block: int | None = None, replicates: int = 4000, seed: int = 42) -> dict[str, float]:
    """Mean of x, the share of replicates above zero, and their 5th and 95th percentiles."""
    v = np.asarray([u for u in x if u is not None and math.isfinite(u)], float)
    if len(v) < 2:
        return {"n": len(v), "mean": float(v.mean()) if len(v) else math.nan, "probability_positive": math.nan, "p05": math.nan, "p95": math.nan}
    size = block or max(1, round(len(v) ** (1 / 3)))
    rng = np.random.default_rng(seed)
    n_blocks = -(-len(v) // size)
    starts = rng.integers(0, len(v) - size + 1, (replicates, n_blocks))
    means = v[(starts[:, :, None] + np.arange(size)).reshape(replicates, -1)[:, : len(v)]].mean(1)
    return {"n": len(v), "mean": float(v.mean()), "probability_positive": float((means > 0).mean()), "p05": float(np.quantile(means, 0.05)), "p95": float(np.quantile(means, 0.95))}


def sign_flip_p_value(x: Sequence[float], replicates: int = 4000, seed: int = 42) -> float:
    """Two-sided permutation p-value of a zero mean under random signs."""
    v = np.asarray(x, float)
    if not len(v):
        return math.nan
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (replicates, len(v)))
    return float((1 + (np.abs((signs * v).mean(1)) >= abs(v.mean()) - 1e-15).sum()) / (replicates + 1))


def paired_bootstrap(changes: Sequence[float], replicates: int = 2000, seed: int = 20261002, least: int = 30) -> dict:
    """Mean of paired changes with a 95 % interval and a two-sided p-value, cases drawn one by one."""
    v = np.asarray([u for u in changes if u is not None and math.isfinite(u)], float)
    if len(v) < least:
        return {"status": "INSUFFICIENT_CASES", "n": len(v)}
    rng = np.random.default_rng(seed)
    means = np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(replicates)])
    low, high = np.quantile(means, [0.025, 0.975])
    p = min(1.0, 2 * min((means <= 0).mean(), (means >= 0).mean()))
    return {"status": "OK", "n": len(v), "mean": float(v.mean()), "low": float(low), "high": float(high), "p_two_sided": float(p)}


def cluster_bootstrap(clusters: Sequence[tuple[float, int]], replicates: int = 1000, seed: int = 42, least: int = 5) -> dict:
    """The same with whole clusters drawn: clusters are (sum of changes, number of cases), one a session."""
    kept = [(s, n) for s, n in clusters if n and s is not None and math.isfinite(s)]
    if len(kept) < least:
        return {"status": "INSUFFICIENT_CLUSTERS", "n": len(kept)}
    sums, sizes = np.array([s for s, _ in kept]), np.array([n for _, n in kept], float)
    drawn = np.random.default_rng(seed).integers(0, len(kept), (replicates, len(kept)))
    means = sums[drawn].sum(1) / sizes[drawn].sum(1)
    low, high = np.quantile(means, [0.025, 0.975])
    return {"status": "OK", "n": len(kept), "mean": float(sums.sum() / sizes.sum()), "low": float(low), "high": float(high), "probability_positive": float((means > 0).mean())}


def session_clusters(rows: DataFrame, change: Column, session: str = "session_date") -> list[tuple[float, int]]:
    """(sum, number) of the changes of each session, which is what cluster_bootstrap draws from."""
    got = rows.groupBy(session).agg(F.sum(change).alias("s"), F.count(change).alias("n")).orderBy(session).collect()  # a row a session
    return [(r["s"], r["n"]) for r in got]


def paired_folds(metrics: DataFrame, candidate: str, baseline: str, metric: str = "logloss") -> DataFrame:
    """(fold, gain): baseline less candidate on the folds both have."""
    one = metrics.where(c("model") == candidate).select("fold", c(metric).alias("__a"))
    two = metrics.where(c("model") == baseline).select("fold", c(metric).alias("__b"))
    return one.join(two, "fold").select("fold", (c("__b") - c("__a")).alias("gain"))


def paired_evidence(gains: DataFrame, comparisons: int = 1, alpha: float = 0.05, least: int = 5) -> dict:
    """Mean gain with a Bonferroni interval, share of positive folds and a bootstrap; INSUFFICIENT under least folds."""
    x = [r["gain"] for r in gains.orderBy("fold").collect()]
    if len(x) < least:
        return {"status": "INSUFFICIENT_FOLDS", "n": len(x)}
    mean, sd = float(np.mean(x)), float(np.std(x, ddof=1))
    half = NormalDist().inv_cdf(1 - alpha / (2 * max(comparisons, 1))) * sd / math.sqrt(len(x))
    boot = moving_block_bootstrap(x)
    return {"status": "OK", "n": len(x), "mean": mean, "low": mean - half, "high": mean + half, "positive_share": float(np.mean(np.array(x) > 0)), **{k: boot[k] for k in ("probability_positive", "p05")}}


def research_positive(relative_gain: float, positive_share: float, probability: float, p05: float, brier_change: float, ece_change: float) -> bool:
    """The rule all studies share."""
    return relative_gain >= 0.03 and positive_share >= 0.70 and probability >= 0.90 and p05 > 0 and brier_change <= 0.001 and ece_change <= 0


def combinatorial_splits(n: int, groups: int = 6, choose: int = 2, purge: int = 1, embargo: int = 1) -> list[tuple[list[int], list[int]]]:
    """(train, test) positions of every choice of test groups, training positions near a test purged."""
    edges = [round(k * n / groups) for k in range(groups + 1)]
    out = []
    for chosen in itertools.combinations(range(groups), choose):
        test = [i for g in chosen for i in range(edges[g], edges[g + 1])]
        barred = {j for g in chosen for j in range(edges[g] - purge, edges[g + 1] + embargo)}
        out.append(([i for i in range(n) if i not in barred], test))
    return out


def set_metrics(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage, size, singleton and empty shares of prediction sets (columns has0, has1, y)."""
    size = c("has0").cast("int") + c("has1").cast("int")
    covered = F.when(c("y") == 1, c("has1")).otherwise(c("has0")).cast("int")
    single = F.when(size == 1, covered)
    return sets.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(covered).alias("coverage"), F.avg(size).alias("mean_size"), F.avg((size == 1).cast("int")).alias("singleton_rate"),
        F.avg(single).alias("singleton_accuracy"), F.avg((size == 0).cast("int")).alias("empty_rate"),
    )


def interval_metrics(df: DataFrame, keys: Sequence[str], y: str, low: str, high: str, alpha: float = 0.2, severe: float = 0.05) -> DataFrame:
    """Interval score, coverage, width and share of misses by severe or more."""
    below, above = F.greatest(c(low) - c(y), F.lit(0.0)), F.greatest(c(y) - c(high), F.lit(0.0))
    return df.where(c(y).isNotNull() & c(low).isNotNull() & c(high).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((c(high) - c(low)) + 2 / alpha * (below + above)).alias("interval_score"), F.avg(((below + above) == 0).cast("int")).alias("coverage"),
        F.avg(c(high) - c(low)).alias("width"), F.avg(((below + above) >= severe).cast("int")).alias("severe_miss"),
    )


def quantile_metrics(df: DataFrame, keys: Sequence[str], y: str, q: str, level: float) -> DataFrame:
    """Pinball loss, mean absolute and squared errors and sign agreement of a quantile forecast."""
    e = c(y) - c(q)
    return df.where(e.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.greatest(level * e, (level - 1) * e)).alias("pinball"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg((F.signum(c(y)) == F.signum(c(q))).cast("int")).alias("sign_accuracy"),
    )


def fold_summary(metrics: DataFrame, keys: Sequence[str] = ("model",), metric: str = "logloss", span: tuple[str, str, str] | None = None) -> DataFrame:
    """Mean, deviation (0 with one fold), recency-weighted mean (weights from 1 to 2 over the folds) and the selection mean of both.

    With a column n its least and largest values are given too. span names the columns of
    fold, first and last test day; the signature is a digest of these, sorted, so that equal
    signatures mean the same folds. Without it the fold numbers alone are digested.
    """
    w = Window.partitionBy(*keys).orderBy("fold")
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = metrics.where(c(metric).isNotNull()).withColumn("__w", F.when(n >= 3, 1 + (F.row_number().over(w) - 1) / (n - 1)).otherwise(1.0))
    named = F.concat_ws(":", *[c(x).cast("string") for x in span]) if span else c("fold").cast("string")
    sizes = [F.min("n").alias("n_test_min"), F.max("n").alias("n_test_max")] if "n" in metrics.columns else []
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_folds"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), (F.sum(c("__w") * c(metric)) / F.sum("__w")).alias("recent"), *sizes,
        F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(named)), ","), 256), 1, 16).alias("signature"),
    )
    return out.withColumn("selection", 0.5 * c("mean") + 0.5 * c("recent"))


def better_than_parent(scoped: DataFrame, parents: DataFrame, keys: Sequence[str], edge: float = 0.002) -> DataFrame:
    """Scoped winners whose score beats their parent's on the same slice by the edge."""
    p = parents.select(*keys, c("score").alias("parent_score"))
    return scoped.join(p, list(keys)).where(c("parent_score") - c("score") >= edge)
