"""Probabilistic metrics, conformal sets, online experts, fold evidence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import average_rank, clean, clip, correlation, ratio
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators.conformal import at_or_above
from tidemark.operators.technical import _by_key, _numbers, residual_rank

c = F.col
#: Edges of ten equal bins as their nearest doubles (fixed values).
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def log_loss(y: Column, p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def bin_of(p: Column) -> Column:
    """Bin 0 to 9; the last bin is closed."""
    return sum((F.when(p >= e, 1).otherwise(0) for e in EDGES[1:]), F.lit(0))


def checked(p: Column) -> Column:
    """p, or an error where it is not a probability."""
    return F.when(p.isNull() | ((p >= 0) & (p <= 1)), p).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), p.cast("string"))))


def binary_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Per keys: n, logloss, brier, accuracy, ece over ten bins, and roc_auc by rank sums (null with one class).

    Rows without outcome or probability are left out; a probability outside [0, 1] is an
    error. Equal probabilities are counted first, and their ranks are summed up from those
    of narrow buckets, so no task sorts the rows of a key.
    """
    keys = list(keys)
    rows = df.where(c(p).isNotNull() & c(y).isNotNull()).select(*keys, checked(c(p).cast("double")).alias("__p"), c(y).cast("double").alias("__y"))
    each = rows.groupBy(*keys, "__p").agg(F.count("*").alias("__n"), F.sum("__y").alias("__n1"))
    q, n, n1 = c("__p"), c("__n"), c("__n1")
    each = each.withColumn("__bucket", F.floor(q * 4096).cast("int"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("__rank", F.sum(n).over(inside) - n + (n + 1) / 2)  # mean rank within the bucket
    buckets = each.groupBy(*keys, "__bucket").agg(F.sum(n).alias("__b"), F.sum(n1).alias("__b1"), F.sum(n1 * c("__rank")).alias("__r"), *[
        F.sum(x).alias(name) for name, x in {
            "__l": n1 * log_loss(F.lit(1.0), q) + (n - n1) * log_loss(F.lit(0.0), q), "__s": n1 * (1 - q) ** 2 + (n - n1) * q**2, "__a": F.when(q >= 0.5, n1).otherwise(n - n1),
            **{f"__p{k}": F.when(bin_of(q) == k, n * q) for k in range(10)}, **{f"__n{k}": F.when(bin_of(q) == k, n) for k in range(10)}, **{f"__y{k}": F.when(bin_of(q) == k, n1) for k in range(10)},
        }.items()
    ])
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,097 buckets a key
    buckets = buckets.withColumn("__r", c("__r") + c("__b1") * F.coalesce(F.sum("__b").over(before), F.lit(0)))
    one = buckets.groupBy(*keys).agg(F.sum("__b").alias("n"), *[F.sum(x).alias(x) for x in ("__b1", "__r", "__l", "__s", "__a", *[f"__{t}{k}" for t in "pny" for k in range(10)])])
    total, ones = c("n").cast("double"), c("__b1")
    gap = sum((F.coalesce(F.abs(c(f"__p{k}") - c(f"__y{k}")), F.lit(0.0)) for k in range(10)), F.lit(0.0))
    return one.where("n > 0").select(
        *keys, "n", (c("__l") / total).alias("logloss"), (c("__s") / total).alias("brier"), (c("__a") / total).alias("accuracy"),
        ratio(c("__r") - ones * (ones + 1) / 2, ones * (total - ones)).alias("roc_auc"), (gap / total).alias("ece"),
    )


def mean_metrics(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric over the rows where it is finite; columns that are no numbers are left out."""
    kinds = dict(rows.dtypes)
    numbers = [m for m in metrics if kinds.get(m) in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds.get(m, "").startswith("decimal")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.avg(clean(c(m))).alias(m) for m in numbers])


def segment_metrics(df: DataFrame, dimensions: Sequence[str], sets: Sequence[Sequence[str]], least: int = 30) -> DataFrame:
    """logloss, Brier and accuracy of every grouping set in one pass; segments under least rows are left out."""
    rows = df.select(*dimensions, log_loss(c("y"), c("p")).alias("__l"), ((c("p") - c("y")) ** 2).alias("__b"), F.when((c("p") >= 0.5) == (c("y") == 1), 1.0).otherwise(0.0).alias("__a"))
    grouped = rows.groupingSets([[c(x) for x in s] for s in sets], *dimensions)
    return grouped.agg(F.count("*").alias("n"), F.avg("__l").alias("logloss"), F.avg("__b").alias("brier"), F.avg("__a").alias("accuracy")).where(c("n") >= least)


def rank_ic(df: DataFrame, group: Sequence[str], y: str, signal: str, least: int = 5) -> DataFrame:
    """Spearman correlation per group with least rows and two distinct values of each."""
    rows = df.where(c(y).isNotNull() & c(signal).isNotNull())
    ranked = rows.withColumns({"__ry": average_rank(c(y), group), "__rs": average_rank(c(signal), group)})
    per = ranked.groupBy(*group).agg(F.count("*").alias("n"), *[(F.min(x) < F.max(x)).alias(k) for x, k in ((y, "__dy"), (signal, "__ds"))], correlation(c("__ry"), c("__rs")).alias("rank_ic"))
    return per.where((c("n") >= least) & c("__dy") & c("__ds")).drop("__dy", "__ds")


def conformal_p_values(calibration: DataFrame, test: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """(keys, score, row_id, p_value): p = (1 + calibration scores not below the test score) / (n + 1)."""
    keys = list(keys)
    counts = at_or_above(calibration.select(*keys, c(score).alias("score")), test.select(*keys, c(score).alias("t")), keys)
    counts = counts.select(*[c(k).alias(f"__{k}") for k in keys], "t", ((1 + c("above")) / (c("n") + 1)).alias("p_value"))
    on = [*[c(k).eqNullSafe(c(f"__{k}")) for k in keys], c(score) == c("t")]
    return test.select(*keys, score, c("row_id").cast("string").alias("row_id")).join(counts, on).select(*keys, score, "row_id", "p_value")


def residual_interval(df: DataFrame, keys: Sequence[str], order: str, residual: str, alpha: float = 0.2, window: int = 252, least: int = 200) -> DataFrame:
    """half_width: the conservative rank of the last absolute residuals before each row, null under least."""

    def fn(rows: pa.Table) -> dict[str, np.ndarray]:
        x = rows.column(residual)
        known = x.is_valid().to_numpy()
        return {"half_width": residual_rank(_numbers(rows, residual), known, alpha, window, least)}

    return _by_key(df, keys, order, ["half_width"], fn)


def expert_average(sessions: DataFrame, eta: float, delay: int = 0, session: str = "session_date", keys: Sequence[str] = ()) -> DataFrame:
    """Weights of each model at each session from its losses up to the session before (and delay more).

    sessions has one row (keys, session, model, loss). With no sharing the weights are the
    softmax of -eta times the summed losses, so a running sum suffices.
    """
    line = Window.partitionBy(*keys, "model").orderBy(session).rowsBetween(Window.unboundedPreceding, -1 - delay)
    lost = sessions.withColumn("__z", -eta * F.coalesce(F.sum("loss").over(line), F.lit(0.0)))
    day = Window.partitionBy(*keys, session)
    e = F.exp(c("__z") - F.max("__z").over(day))
    return lost.withColumn("weight", e / F.sum(e).over(day)).drop("__z")


def shared_expert_average(sessions: DataFrame, eta: float, share: float, models: Sequence[str], session: str = "session_date", delay: int = 0) -> DataFrame:
    """Weights with a fixed share mixed in after each released outcome: a fold over session rows, which are few.

    An outcome is released delay sessions after the next one begins; only then are weights
    moved and shared. Returns (session, weights): an array in the order of models, in force
    at the session.
    """
    k = len(models)
    day = sessions.groupBy(session).pivot("model", list(models)).agg(F.first("loss")).select(session, F.array(*[F.coalesce(c(f"`{m}`"), F.lit(0.0)) for m in models]).alias("loss"))
    day = day.withColumn("loss", F.lag("loss", 1 + delay).over(Window.orderBy(session)))
    rows = day.agg(F.array_sort(F.collect_list(F.struct(session, "loss"))).alias("rows"))
    even = F.array_repeat(F.lit(1.0 / k), k)

    def step(acc: Column, row: Column) -> Column:
        w = acc["w"]
        raw = F.zip_with(w, row["loss"], lambda a, x: a * F.exp(-eta * x))
        total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
        mixed = F.when(row["loss"].isNull(), w).otherwise(F.transform(raw, lambda a: (1 - share) * a / total + share / k))
        return F.struct(mixed.alias("w"), F.concat(acc["out"], F.array(mixed)).alias("out"))

    start = F.struct(even.alias("w"), F.array().cast("array<array<double>>").alias("out"))
    folded = rows.select("rows", F.aggregate("rows", start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select(F.explode(F.arrays_zip(c("rows").alias("rows"), c("out").alias("out"))).alias("z")).select(c(f"z.rows.{session}").alias(session), c("z.out").alias("weights"))


def prior_fold_score(folds: DataFrame, half_life: float = 2.0, penalty: float = 0.25, metric: str = "logloss", extra: Sequence[str] = ()) -> DataFrame:
    """For each fold and model, the weighted mean plus penalty times weighted deviation over earlier folds.

    Weights halve every half_life folds. (fold, model, extra, score, n_prior); the first fold has none.
    """
    names = ["model", *extra]
    t = folds.select(c("fold").alias("__t")).distinct()
    prior = folds.join(t, c("fold") < c("__t")).withColumn("__w", F.pow(F.lit(0.5), (c("__t") - c("fold")) / half_life))
    mean = F.sum(c("__w") * c(metric)) / F.sum("__w")
    square = F.sum(c("__w") * c(metric) * c(metric)) / F.sum("__w")
    out = prior.groupBy("__t", *names).agg(mean.alias("__m"), square.alias("__q"), F.count("*").alias("n_prior"))
    spread = F.sqrt(F.greatest(c("__q") - c("__m") * c("__m"), F.lit(0.0)))
    return out.select(c("__t").alias("fold"), *names, (c("__m") + penalty * spread).alias("score"), "n_prior")


def select_prior(scores: DataFrame, ties: Sequence[str] = ("model",)) -> DataFrame:
    """The model with the least score of each fold; ties go to the smallest of the tie columns."""
    order = F.struct("score", *ties)
    return scores.groupBy("fold").agg(F.min_by("model", order).alias("model"), F.min("score").alias("score"))


def walk_forward(dates: DataFrame, min_train: int, test: int, step: int, embargo: int = 1, purge: int = 1, date: str = "session_date") -> DataFrame:
    """(fold, role, date): training sessions end purge sessions, and tests begin embargo sessions, around the cut."""
    n = dates.select(date).distinct()
    ranked = n.withColumn("__i", F.row_number().over(Window.orderBy(date)) - 1)
    total = F.count("*").over(Window.partitionBy())
    ranked = ranked.withColumn("__n", total)
    start = F.lit(min_train)
    folds = F.when(c("__n") > min_train + embargo, F.sequence(F.lit(0), F.floor((c("__n") - start - embargo - 1) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    each = ranked.withColumn("fold", F.explode(folds)).withColumn("__end", start + c("fold") * step)
    role = F.when(c("__i") < c("__end") - purge, "train").when((c("__i") >= c("__end") + embargo) & (c("__i") < c("__end") + embargo + test), "test")
    return each.withColumn("role", role).where(c("role").isNotNull()).select("fold", "role", date)


def error_overlap(df: DataFrame, case: Sequence[str]) -> DataFrame:
    """For each two models: correlation of their errors and Jaccard overlap of their wrong cases."""
    rows = df.select(*case, "model", (c("p") - c("y")).alias("e"), ((c("p") >= 0.5) != (c("y") == 1)).alias("w"))
    other = rows.select(*[c(x).alias(f"__{x}") for x in case], c("model").alias("model_b"), c("e").alias("e_b"), c("w").alias("w_b"))
    both = rows.join(other, [c(x) == c(f"__{x}") for x in case]).where(c("model") < c("model_b"))
    either = F.sum(F.when(c("w") | c("w_b"), 1).otherwise(0))
    return both.groupBy(c("model").alias("model_a"), "model_b").agg(correlation(c("e"), c("e_b")).alias("error_corr"), ratio(F.sum(F.when(c("w") & c("w_b"), 1.0).otherwise(0.0)), either.cast("double")).alias("error_jaccard"))


#: Quantiles by which distributions are compared (fixed values).
DRIFT_LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)


def _profiles(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, q, s, n): quantiles, deviation and number of the values of each feature."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), c(x).cast("double").alias("x")) for x in features]))
    long = df.select(*keys, each.alias("z")).select(*keys, "z.*").where("x is not null")
    names = [*keys, "feature"]
    spread = long.groupBy(*[c(k).alias(f"__{k}") for k in names]).agg(F.stddev_pop("x").alias("s"))
    return exact_quantiles(long, names, "x", DRIFT_LEVELS).join(spread, [c(k).eqNullSafe(c(f"__{k}")) for k in names]).select(*names, "q", "s", "n")


def _shift(reference: str, query: str, deviation: str) -> Column:
    scale = F.greatest(F.element_at(reference, 4) - F.element_at(reference, 2), c(deviation), F.lit(1e-8))
    return F.aggregate(F.zip_with(reference, query, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / 5 / scale


def drift_score(reference: DataFrame, query: DataFrame, features: Sequence[str], least: int = 20) -> DataFrame:
    """Mean over five quantiles of the shift over the larger of IQR and deviation, averaged over features with enough values."""
    one = _profiles(reference, [], features).withColumnsRenamed({"q": "q_r", "s": "s_r", "n": "n_r"})
    both = one.join(_profiles(query, [], features), "feature").where((c("n_r") >= least) & (c("n") >= least))
    return both.agg(F.avg(_shift("q_r", "q", "s_r")).alias("drift"), F.count("*").alias("n_features"))


def drift_between(df: DataFrame, order: str, features: Sequence[str], least: int = 20) -> DataFrame:
    """(order, drift, n_features): drift_score() of each value of order against the one before it that the table has."""
    line = Window.partitionBy("feature").orderBy(order)
    profile = _profiles(df.where(c(order).isNotNull()), [order], features)
    both = profile.select(order, "q", "n", *[F.lag(x).over(line).alias(f"{x}_r") for x in ("q", "s", "n")]).where((c("n_r") >= least) & (c("n") >= least))
    return both.groupBy(order).agg(F.avg(_shift("q_r", "q", "s_r")).alias("drift"), F.count("*").alias("n_features"))


def transition_matrix(df: DataFrame, keys: Sequence[str], order: str, state: str, states: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """(from_state, to_state, share) over all pairs of states, each counted alpha times more than it was seen."""
    n = markov_transitions(df, keys, order, state).select(c("from_state").alias("__f"), c("to_state").alias("__t"), "n")
    names = F.array(*map(F.lit, states))
    grid = df.sparkSession.range(1).select(F.explode(names).alias("from_state")).select("from_state", F.explode(names).alias("to_state"))
    full = grid.join(n, (c("from_state") == c("__f")) & (c("to_state") == c("__t")), "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.lit(float(alpha)))
    return full.select("from_state", "to_state", (c("n") / F.sum("n").over(Window.partitionBy("from_state"))).alias("share"))


def transition_forecasts(df: DataFrame, keys: Sequence[str], order: str, state: str, states: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Each row with the shares of what followed its state before: forecast, an array in the order of states.

    A row sees the states before it only, so the last step it counts is that between the two
    rows before. Counts run along the rows of a key; nothing is collected.
    """
    line = Window.partitionBy(*keys).orderBy(order)
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__from", F.lag(state).over(line))
    seen = {(a, b): F.coalesce(F.sum(((c("__from") == a) & (c(state) == b)).cast("double")).over(past), F.lit(0.0)) + alpha for a in states for b in states}
    rows = rows.withColumns({f"__{i}_{j}": seen[a, b] for i, a in enumerate(states) for j, b in enumerate(states)})
    out = F.lit(None).cast("array<double>")
    for i, a in enumerate(states):
        total = sum((c(f"__{i}_{j}") for j in range(len(states))), F.lit(0.0))
        out = F.when(c(state) == a, F.array(*[c(f"__{i}_{j}") / total for j in range(len(states))])).otherwise(out)
    return rows.withColumn("forecast", out).drop("__from", *[f"__{i}_{j}" for i in range(len(states)) for j in range(len(states))])


def markov_transitions(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """Counts and row shares of state changes between consecutive rows of a key."""
    line = Window.partitionBy(*keys).orderBy(order)
    pairs = df.select(F.lag(state).over(line).alias("from_state"), c(state).alias("to_state")).where("from_state is not null and to_state is not null")
    n = pairs.groupBy("from_state", "to_state").count().withColumnRenamed("count", "n")
    return n.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("from_state")))
