"""Logistic regression by Newton steps whose sums Spark aggregates; the driver solves systems of a few unknowns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cols import clip

c = F.col


@dataclass(frozen=True)
class Logistic:
    """Coefficients on standardised features; constant holds for models that could not be fitted."""

    features: tuple[str, ...]
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    intercept: float = 0.0
    constant: float | None = None
    rows: int = 0

    def probability(self) -> Column:
        """Probability of the label as a column over the features."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        z = F.lit(self.intercept)
        for name, m, s, w in zip(self.features, self.means, self.scales, self.weights, strict=True):
            z = z + F.lit(w / s) * (c(name) - F.lit(m))
        return 1 / (1 + F.exp(-clip(z, -50.0, 50.0)))


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, strength: float = 1.0, balanced: bool = False, least: int = 20, steps: int = 25, tolerance: float = 1e-9, weight: str | None = None) -> Logistic:
    """Ridge logistic regression: half the squared weights plus strength times the summed loss, the intercept free.

    Rows with nulls are left out. With fewer than least rows or one class the model is the
    mean label (one half without rows). balanced weighs the classes equally; weight names a
    column of row weights. Each step is one aggregation over the rows.
    """
    names = list(features)
    rows = df.select(*[c(x).cast("double").alias(f"x{k}") for k, x in enumerate(names)], c(label).cast("double").alias("y"), (c(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna()
    n = len(names)
    one = rows.agg(F.count("*").alias("n"), F.sum("y").alias("n1"), *[F.avg(f"x{k}").alias(f"m{k}") for k in range(n)], *[F.stddev_pop(f"x{k}").alias(f"s{k}") for k in range(n)]).first()
    count, ones = one["n"], float(one["n1"] or 0)
    if count < least or ones in (0.0, float(count)):
        return Logistic(tuple(names), constant=ones / count if count else 0.5, rows=count)
    means = [one[f"m{k}"] for k in range(n)]
    scales = [one[f"s{k}"] or 1.0 for k in range(n)]
    of = {1: count / (2 * ones), 0: count / (2 * (count - ones))} if balanced else {1: 1.0, 0: 1.0}
    z = [(c(f"x{k}") - F.lit(means[k])) / F.lit(scales[k]) for k in range(n)] + [F.lit(1.0)]
    rows = rows.select(*[v.alias(f"z{k}") for k, v in enumerate(z)], "y", (c("w") * F.when(c("y") == 1, F.lit(of[1])).otherwise(F.lit(of[0]))).alias("w")).cache()
    try:
        beta, ridge = np.zeros(n + 1), np.diag([1.0] * n + [0.0])
        for _ in range(steps):
            score = sum((F.lit(float(b)) * c(f"z{k}") for k, b in enumerate(beta)), F.lit(0.0))
            p = 1 / (1 + F.exp(-clip(score, -50.0, 50.0)))
            moved = rows.withColumn("p", p)
            pairs = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
            got = moved.agg(
                *[F.sum(c("w") * (c("p") - c("y")) * c(f"z{k}")).alias(f"g{k}") for k in range(n + 1)], *[F.sum(c("w") * c("p") * (1 - c("p")) * c(f"z{i}") * c(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs]
            ).first()
            gradient = strength * np.array([got[f"g{k}"] for k in range(n + 1)]) + ridge @ beta
            hessian = ridge + 1e-9 * np.eye(n + 1)
            for i, j in pairs:
                hessian[i, j] += strength * got[f"h{i}_{j}"]
                if i != j:
                    hessian[j, i] += strength * got[f"h{i}_{j}"]
            step = np.linalg.solve(hessian, gradient)
            beta = beta - step
            if np.abs(step).max() < tolerance:
                break
    finally:
        rows.unpersist()
    return Logistic(tuple(names), tuple(means), tuple(scales), tuple(float(b) for b in beta[:n]), float(beta[n]), rows=count)


Each = Callable[[pa.RecordBatch, frozenset[int]], Iterable[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]


def sums_together(rows: DataFrame, each: Each, of: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray], places: Iterable[int]) -> dict[int, np.ndarray]:
    """For each place, of(place, features, label, weight) summed over all rows, in one pass; each(batch, places) gives a batch's part in each place."""
    asked = frozenset(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, x, y, w in each(batch, asked):
                known = ~np.isnan(x).any(1)
                got = of(place, x, y, w) if known.all() else of(place, x[known], y[known], w[known])
                total[place] = total[place] + got if place in total else got
        size = [len(v) for v in total.values()]
        columns = np.repeat(list(total), size), np.concatenate([np.arange(0), *map(np.arange, size)]), np.concatenate([np.zeros(0), *total.values()])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["place", "i", "v"])

    out: dict[int, dict[int, float]] = {}
    for r in rows.mapInArrow(run, "place long, i long, v double").groupBy("place", "i").agg(F.sum("v").alias("v")).collect():  # a few rows a place
        out.setdefault(r["place"], {})[r["i"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def fit_together(rows: DataFrame, each: Each, fits: Sequence[tuple[Sequence[str], float, int]], steps: int = 25, tolerance: float = 1e-9) -> list[Logistic]:
    """The model of fit_logistic for each (features, strength, least) of fits; a step of all of them is one pass over the rows.

    each(batch, places) yields (place in fits, feature matrix, labels 0 and 1, weights) for the
    places asked for. Weights count equal rows, so least is compared with their sum.
    """
    one = sums_together(rows, each, lambda _, x, y, w: np.array([w.sum(), w @ y, *(w @ x)]), range(len(fits)))
    out: list[Logistic | None] = []
    for k, (names, _, least) in enumerate(fits):
        count, ones = one[k][:2] if k in one else (0.0, 0.0)
        few = count < least or ones in (0.0, count)
        out.append(Logistic(tuple(names), constant=float(ones / count) if count else 0.5, rows=int(count)) if few else None)
    open_ = [k for k, m in enumerate(out) if m is None]
    means = {k: one[k][2:] / one[k][0] for k in open_}
    square = sums_together(rows, each, lambda k, x, y, w: w @ (x - means[k]) ** 2, open_) if open_ else {}
    scales = {k: np.where(square[k] > 0, np.sqrt(square[k] / one[k][0]), 1.0) for k in open_}
    beta = {k: np.zeros(len(means[k]) + 1) for k in open_}

    def moved(k: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - means[k]) / scales[k], np.ones(len(x))])
        p = 1 / (1 + np.exp(-np.clip(z @ beta[k], -50, 50)))
        return np.concatenate([z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])

    going = list(open_)
    for _ in range(steps):
        if not going:
            break
        for k, got in sums_together(rows, each, moved, going).items():
            n, strength = len(beta[k]), fits[k][1]
            ridge = np.diag([1.0] * (n - 1) + [0.0])
            step = np.linalg.solve(ridge + 1e-9 * np.eye(n) + strength * got[n:].reshape(n, n), strength * got[:n] + ridge @ beta[k])
            beta[k] = beta[k] - step
            if np.abs(step).max() < tolerance:
                going.remove(k)
    for k in open_:
        values = [tuple(map(float, v)) for v in (means[k], scales[k], beta[k][:-1])]
        out[k] = Logistic(tuple(fits[k][0]), *values, float(beta[k][-1]), rows=int(one[k][0]))
    return out


def prequential(df: DataFrame, features: Sequence[str], label: str, name: str, fold: str = "fold", last: int | None = None, frozen_from: int | None = None, **how) -> DataFrame:
    """df with the probability that a model of the earlier folds gives each row; the first fold has one half.

    last limits the history to so many folds before; from fold frozen_from on the model of
    that fold stays. Folds are few, and each has a model of its own.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    out, kept = F.lit(None).cast("double"), None
    for k, t in enumerate(folds):
        if frozen_from is None or t <= frozen_from or kept is None:
            history = df.where(c(fold).isin(folds[max(0, k - last) : k] if last else folds[:k])) if k else None
            kept = fit_logistic(history, features, label, **how) if k else Logistic(tuple(features), constant=0.5)
        out = F.when(c(fold) == t, kept.probability()).otherwise(out)
    return df.withColumn(name, out)


def fit_small(x: np.ndarray, y: np.ndarray, strength: float = 1.0, balanced: bool = False, scale: bool = True, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, coefficients with the intercept last) of the same model on a small matrix, such as one instrument's rows."""
    means, scales = (x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)) if scale else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([(x - means) / scales, np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1))) if balanced else np.ones(len(y))
    beta, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -50, 50)))
        gradient = strength * z.T @ (w * (p - y)) + ridge @ beta
        hessian = strength * (z * (w * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    return means, scales, beta
