"""Selection by earlier folds: policies, training windows, calibrators, routes and their promotion.

Inputs are metrics, one row a fold and candidate; everything decided at a fold reads rows of
earlier folds only. One operator, prior_evidence, weighs those rows; the policies differ in
what they compare, in ties, and in which history they ask for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evidence import moving_block_bootstrap, research_positive

c = F.col
#: Calibrators in the order that settles ties (fixed values).
CALIBRATORS = ("platt", "beta", "isotonic", "temperature")


def prior_evidence(
    rows: DataFrame,
    by: Sequence[str],
    metric: str = "logloss",
    also: Sequence[str] = (),
    half_life: float = 4.0,
    penalty: float = 0.25,
    least: int = 3,
    exact: bool = False,
    like: tuple[str, float] | None = None,
) -> DataFrame:
    """For each fold and candidate (by): score, mean, std and n_prior over its rows of earlier folds.

    Weights halve every half_life folds; score is the weighted mean plus penalty times the
    weighted deviation. Candidates with fewer than least rows are left out; with exact only
    the least folds directly before count, and all of them must be there. like names a
    column and a scale: rows weigh less by exp(-|difference| / scale) to the candidate's
    own row of the fold, which must be there. Further columns in also get weighted means.
    """
    by = list(by)
    known = rows.where(c(metric).isNotNull() & ~F.isnan(c(metric).cast("double")))
    asked = rows.select("fold", *by, like[0]) if like else rows.select("fold").distinct()
    asked = asked.select(c("fold").alias("__t"), *([c(x).alias(f"__{x}") for x in (*by, like[0])] if like else []))
    on = (c("fold") < c("__t")) & ((c("fold") >= c("__t") - least) if exact else F.lit(True))
    for x in by if like else ():
        on = on & c(x).eqNullSafe(c(f"__{x}"))
    pairs = known.join(asked, on)  # folds are few
    w = F.pow(F.lit(0.5), (c("__t") - c("fold")) / half_life)
    if like:
        w = w * F.exp(-F.abs(c(like[0]) - c(f"__{like[0]}")) / like[1])
    pairs = pairs.withColumn("__w", w)
    mean = lambda x: F.sum(c("__w") * x) / F.sum("__w")
    out = pairs.groupBy("__t", *by).agg(
        mean(c(metric)).alias("mean"), mean(c(metric) * c(metric)).alias("__q"), F.count("*").alias("n_prior"), F.count_distinct("fold").alias("__folds"), F.sum("__w").alias("__all"), *[mean(c(x)).alias(x) for x in also]
    ).where((c("n_prior") >= least) & (c("__all") > 0))
    if exact:
        out = out.where((c("n_prior") == least) & (c("__folds") == least))
    std = F.sqrt(F.greatest(c("__q") - c("mean") * c("mean"), F.lit(0.0)))
    return out.select(c("__t").alias("fold"), *by, (c("mean") + penalty * std).alias("score"), "mean", std.alias("std"), "n_prior", *also)


def least_by(scored: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The row of each key that comes first by order, which must settle all ties."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return scored.withColumn("__first", first).where("__first = 1").drop("__first")


def _scored(decisions: DataFrame, rows: DataFrame, baseline: DataFrame | str | None) -> DataFrame:
    """Decisions (fold, model, ...) with the metrics that the choice and the baseline got in that fold."""
    names = [x for x in ("logloss", "brier", "ece") if x in rows.columns]
    mine = rows.select(c("fold").alias("__f"), c("model").alias("__m"), *names)
    out = decisions.join(mine, (c("fold") == c("__f")) & (c("model") == c("__m"))).drop("__f", "__m")
    if baseline is None:
        return out
    if isinstance(baseline, str):
        base = rows.where(c("model") == baseline).select(c("fold").alias("__f"), c("model").alias("baseline_model"), *[c(x).alias(f"baseline_{x}") for x in names])
    else:
        base = rows.join(F.broadcast(baseline.select(c("model").alias("__b"))), c("model") == c("__b"))  # one row
        base = base.select(c("fold").alias("__f"), c("__b").alias("baseline_model"), *[c(x).alias(f"baseline_{x}") for x in names])
    return out.join(base, c("fold") == c("__f"), "left").drop("__f").withColumn("gain", c("baseline_logloss") - c("logloss"))


def sequential_policy(rows: DataFrame, baseline: str | None = None, least: int = 3, half_life: float = 4.0, penalty: float = 0.25) -> DataFrame:
    """For each fold the model with the least prior score, and what it and the baseline then got.

    Ties go to the smaller mean, then the name. Folds without enough history, and folds in
    which the chosen model has no row, give no decision.
    """
    evidence = prior_evidence(rows, ["model"], half_life=half_life, penalty=penalty, least=least)
    chosen = least_by(evidence, ["fold"], "score", "mean", "model")
    return _scored(chosen.select("fold", "model", "score", "n_prior"), rows, baseline)


def nested_policy(rows: DataFrame, outer_start: int | None = None, baseline: str | None = None, least: int = 3, least_outer: int = 5, half_life: float = 4.0, penalty: float = 0.25) -> DataFrame:
    """sequential_policy over an outer block of later folds, against one model fixed before that block.

    The block begins at the middle fold unless told; without a baseline it is the model that
    the folds before the block choose. Too few folds on either side give no decision.
    """
    folds = sorted(r["fold"] for r in rows.where(c("logloss").isNotNull()).select("fold").distinct().collect())  # folds are few
    start = outer_start if outer_start is not None else (folds[len(folds) // 2] if folds else 0)
    enough = len(folds) >= least + least_outer and sum(f < start for f in folds) >= least and sum(f >= start for f in folds) >= least_outer
    evidence = prior_evidence(rows, ["model"], half_life=half_life, penalty=penalty, least=least)
    chosen = least_by(evidence, ["fold"], "score", "mean", "model")
    fixed = baseline or chosen.where(c("fold") == start).select("model")
    out = _scored(chosen.where((c("fold") >= start) & F.lit(enough)).select("fold", "model", "score", "n_prior"), rows, fixed)
    return out.withColumn("outer_start", F.lit(start))


def policy_summary(decisions: DataFrame, least: int = 5, seed: int = 20260925) -> dict:
    """Means of choice and baseline, share of better folds, bootstrap and verdict; one row a fold reaches the driver."""
    rows = decisions.orderBy("fold").collect()
    if not rows:
        return {"status": "INSUFFICIENT_OOS", "folds": 0, "research_positive": False}

    def mean(name: str) -> float:
        x = [r[name] for r in rows if name in r and r[name] is not None and math.isfinite(r[name])]
        return sum(x) / len(x) if x else math.nan

    out = {"status": "EVALUATED", "folds": len(rows), **{x: mean(x) for x in ("logloss", "brier", "ece", "baseline_logloss", "baseline_brier", "baseline_ece")}}
    gains = [r["gain"] for r in rows if "gain" in r and r["gain"] is not None and math.isfinite(r["gain"])]
    change = out["baseline_logloss"] - out["logloss"]
    relative = change / abs(out["baseline_logloss"]) if out["baseline_logloss"] else math.nan
    boot = moving_block_bootstrap(gains, seed=seed) if len(gains) >= least else {"probability_positive": 0.0, "p05": -math.inf}
    share = sum(g > 0 for g in gains) / len(gains) if gains else 0.0
    worse = lambda x: (lambda d: 0.0 if math.isnan(d) else d)(out[x] - out[f"baseline_{x}"])
    positive = len(gains) >= least and research_positive(relative, share, boot["probability_positive"], boot["p05"], worse("brier"), worse("ece"))
    return out | {"relative": relative, "positive_share": share, "probability_positive": boot["probability_positive"], "p05": boot["p05"], "research_positive": positive}


def model_window_choice(rows: DataFrame, least: int = 3, half_life: float = 4.0, penalty: float = 0.25) -> DataFrame:
    """(fold, model, window, score): chosen jointly by the least folds directly before, all of which a pair must have."""
    evidence = prior_evidence(rows, ["model", "window"], half_life=half_life, penalty=penalty, least=least, exact=True)
    return least_by(evidence, ["fold"], "score", "model", "window").select("fold", "model", "window", "score")


def drift_aware_window(rows: DataFrame, least: int = 2, half_life: float = 4.0, scale: float = 0.5, penalty: float = 0.25) -> DataFrame:
    """(fold, window, score, mean, n_prior) by earlier folds of like drift; ties go to the shorter window, 0 (all history) last."""
    evidence = prior_evidence(rows.where("drift is not null and drift >= 0"), ["window"], half_life=half_life, penalty=penalty, least=least, like=("drift", scale))
    return least_by(evidence, ["fold"], "score", "mean", F.when(c("window") == 0, 10**9).otherwise(c("window"))).select("fold", "window", "score", "mean", "n_prior")


def calibrator_route(rows: DataFrame, least: int = 2, half_life: float = 4.0, penalty: float = 0.25, default: str = "platt") -> DataFrame:
    """(fold, method) for every fold of rows (fold, method, logloss, ece, brier): ties by ece, brier, then the fixed order."""
    known = rows.where(c("method").isin(*CALIBRATORS) & c("ece").isNotNull() & c("brier").isNotNull())
    evidence = prior_evidence(known, ["method"], also=("ece", "brier"), half_life=half_life, penalty=penalty, least=least)
    rank = F.array_position(F.array(*map(F.lit, CALIBRATORS)), c("method"))
    chosen = least_by(evidence, ["fold"], "score", "ece", "brier", rank).select(c("fold").alias("__f"), "method", "score")
    folds = rows.select("fold").distinct()
    return folds.join(chosen, c("fold") == c("__f"), "left").select("fold", F.coalesce("method", F.lit(default)).alias("method"), "score")


def window_choice(rows: DataFrame, least: int = 3, penalty: float = 0.25) -> DataFrame:
    """(window, logloss, logloss_std, folds, selected): least mean plus penalty times deviation; ties to the shorter window, 0 last."""
    one = rows.where(c("logloss").isNotNull()).groupBy("window").agg(F.avg("logloss").alias("logloss"), F.coalesce(F.stddev_samp("logloss"), F.lit(0.0)).alias("logloss_std"), F.count("*").alias("folds"))
    order = Window.partitionBy().orderBy((c("folds") < least).cast("int"), c("logloss") + penalty * c("logloss_std"), F.when(c("window") == 0, 10**9).otherwise(c("window")))  # windows are few
    return one.withColumn("selected", (F.row_number().over(order) == 1) & (c("folds") >= least))


def calibrator_choice(rows: DataFrame, asset_rows: DataFrame, share: float = 0.5, penalty: float = 0.25, least: int = 3) -> DataFrame:
    """(method, score, ece, selected): folds' log loss mixed half and half with that of asset classes.

    rows and asset_rows have one row (method, logloss, ece) a fold, and a fold and asset
    class. A method with fewer than least asset rows counts by its folds' mean alone.
    """
    deviation = F.coalesce(F.stddev_samp("logloss"), F.lit(0.0))
    one = rows.groupBy("method").agg(F.avg("logloss").alias("m"), deviation.alias("s"), F.avg("ece").alias("ece"), F.count("*").alias("n")).where(c("n") >= least)
    two = asset_rows.groupBy(c("method").alias("a_method")).agg(F.avg("logloss").alias("am"), deviation.alias("as_"), F.count("*").alias("an"))
    both = one.join(two, c("method") == c("a_method"), "left")
    mean = (1 - share) * c("m") + share * F.when(c("an") >= least, c("am")).otherwise(c("m"))
    std = (1 - share) * c("s") + share * F.coalesce("as_", F.lit(0.0))
    out = both.select("method", (mean + penalty * std).alias("score"), "ece")
    order = Window.partitionBy().orderBy("score", "ece", F.array_position(F.array(*map(F.lit, CALIBRATORS)), c("method")))  # methods are few
    return out.withColumn("selected", F.row_number().over(order) == 1)


def rebalanced(rows: DataFrame, asset_rows: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """(model, selection_logloss, selection_logloss_std, n_classes): half a model's own log loss, half its mean over asset classes.

    rows (model, logloss, logloss_std); asset_rows (asset_class, model, logloss, folds).
    Classes with fewer than least folds do not count; with fewer than two classes the
    model's own figures stand.
    """
    macro = asset_rows.where((c("folds") >= least) & c("logloss").isNotNull()).groupBy(c("model").alias("__m"))
    macro = macro.agg(F.avg("logloss").alias("__mean"), F.stddev_samp("logloss").alias("__std"), F.count("*").alias("__n"))
    both = rows.join(macro, c("model") == c("__m"), "left")
    enough = c("__n") >= 2
    mix = lambda own, other: F.when(enough, (1 - share) * own + share * other).otherwise(own)
    return both.select("model", mix(c("logloss"), c("__mean")).alias("selection_logloss"), mix(F.coalesce("logloss_std", F.lit(0.0)), c("__std")).alias("selection_logloss_std"), F.coalesce("__n", F.lit(0)).alias("n_classes"))


def choose_candidates(candidates: DataFrame, keys: Sequence[str], least: int = 3, tolerance: float = 0.002) -> DataFrame:
    """Of each key, the model with the best rank IC among those whose score is within tolerance of the least.

    candidates (keys, model, score, folds, rank_ic); a missing rank IC counts as the worst;
    then the smaller score and the name decide. Candidates of fewer than least folds drop out.
    """
    known = candidates.where((c("folds") >= least) & c("score").isNotNull())
    near = known.withColumn("__best", F.min("score").over(Window.partitionBy(*keys))).where(c("score") <= c("__best") + tolerance).drop("__best")
    return least_by(near, keys, c("rank_ic").desc_nulls_last(), "score", "model")


def promoted(chosen: DataFrame, candidates: DataFrame, parents: DataFrame, keys: Sequence[str], edge: float = 0.002) -> DataFrame:
    """(keys, model, score, parent, parent_score) of choices that beat their parent's model on the same slice by edge.

    parents (keys, parent) names the model that would serve otherwise. A parent that the
    slice has not measured, or that is the choice itself, lets nothing pass.
    """
    keys = list(keys)
    p = parents.select(*[c(k).alias(f"__{k}") for k in keys], "parent")
    measured = candidates.select(*[c(k).alias(f"___{k}") for k in keys], c("model").alias("__pm"), c("score").alias("parent_score"))
    out = chosen.join(p, [c(k) == c(f"__{k}") for k in keys]).join(measured, [*[c(k) == c(f"___{k}") for k in keys], c("parent") == c("__pm")])
    return out.where((c("model") != c("parent")) & (c("parent_score") - c("score") >= edge)).select(*keys, "model", "score", "parent", "parent_score")


def scoped_routes(metrics: DataFrame, served: str, edge: float = 0.002, tolerance: float = 0.002) -> dict[str, DataFrame]:
    """Promoted routes of every scope, each against the most specific route already there.

    metrics has one row (scope, asset_class, regime, situation, symbol, model, score, folds,
    n_test_min, rank_ic) a candidate, with nulls in the columns that a scope does not use;
    served is the model of the global route. Scopes and what they ask for: regime and asset
    3 folds; asset_regime 2; situation and asset_situation 3 folds of 30 rows; symbol and
    symbol_regime 4 folds of 10 rows. A situation belongs to a regime (column regime).
    """
    asks = {"regime": (("regime",), 3, 0), "asset": (("asset_class",), 3, 0), "asset_regime": (("asset_class", "regime"), 2, 0), "situation": (("situation",), 3, 30), "asset_situation": (("asset_class", "situation"), 3, 30), "symbol": (("asset_class", "symbol"), 4, 10), "symbol_regime": (("asset_class", "symbol", "regime"), 4, 10)}
    #: Scopes whose route a parent may come from, the most specific first.
    above = {"regime": (), "asset": (), "asset_regime": ("asset", "regime"), "situation": (), "asset_situation": ("asset_regime", "asset", "regime"), "symbol": ("asset",), "symbol_regime": ("asset_regime", "asset", "regime")}
    routes: dict[str, DataFrame] = {}
    for scope, (keys, folds, rows) in asks.items():
        mine = metrics.where((c("scope") == scope) & (c("folds") >= folds) & (F.coalesce(c("n_test_min"), F.lit(0)) >= rows) & c("score").isNotNull())
        slices = mine.select(*dict.fromkeys((*keys, "asset_class", "regime"))).distinct()
        found = []
        for n, up in enumerate(above[scope]):
            names = asks[up][0]
            r = routes[up].select(*[c(k).alias(f"__{n}_{k}") for k in names], c("model").alias(f"__{n}_model"))
            slices = slices.join(r, [c(k) == c(f"__{n}_{k}") for k in names], "left")
            found.append(c(f"__{n}_model"))
        parents = slices.select(*keys, F.coalesce(*found, F.lit(served)).alias("parent")).distinct()
        routes[scope] = promoted(choose_candidates(mine, keys, folds, tolerance), mine, parents, keys, edge)
    return routes


def return_estimator(candidates: DataFrame, keys: Sequence[str] = (), least: int = 3, guard: float = 1.10, penalty: float = 0.25, tolerance: float = 0.005) -> DataFrame:
    """Of each key, the estimator (name, mae, rank_ic, rank_ic_std, folds) to use.

    Its error is at most guard times the least; among those, rank IC less penalty times its
    deviation is within tolerance of the best; then the least error, best score and name decide.
    """
    known = candidates.where((c("folds") >= least) & c("mae").isNotNull() & c("rank_ic").isNotNull()).withColumn("score", c("rank_ic") - penalty * F.coalesce("rank_ic_std", F.lit(0.0)))
    whole = Window.partitionBy(*keys)
    fair = known.withColumn("__mae", F.min("mae").over(whole)).where(c("mae") <= c("__mae") * max(1.0, guard)).drop("__mae")
    near = fair.withColumn("__best", F.max("score").over(whole)).where(c("score") >= c("__best") - tolerance).drop("__best")
    return least_by(near, keys, "mae", c("score").desc(), "name")


def core_calibration(fold_dates: DataFrame, share: float = 0.2, least: int = 20, session: str = "session_date") -> DataFrame:
    """Dates (fold, role, session) with training dates split: the last max(least, share) of a fold are its calibration."""
    train = Window.partitionBy("fold", "role").orderBy(c(session).desc())
    n = F.count("*").over(Window.partitionBy("fold", "role"))
    late = F.row_number().over(train) <= F.greatest(F.lit(least), F.floor(n * share))
    return fold_dates.withColumn("role", F.when(c("role") != "train", c("role")).when(late, "calibration").otherwise("core"))


def chronology_faults(fold_dates: DataFrame, session: str = "session_date", order: Sequence[str] = ("train", "test")) -> DataFrame:
    """Folds whose roles are out of order: (fold, earlier, later, last_earlier, first_later)."""
    span = fold_dates.groupBy("fold", "role").agg(F.min(session).alias("first"), F.max(session).alias("last"))
    faults = None
    for a, b in zip(order, order[1:]):
        one = span.where(c("role") == a).select("fold", c("last").alias("last_earlier"))
        two = span.where(c("role") == b).select(c("fold").alias("__f"), c("first").alias("first_later"))
        found = one.join(two, c("fold") == c("__f")).where(c("last_earlier") >= c("first_later")).select("fold", F.lit(a).alias("earlier"), F.lit(b).alias("later"), "last_earlier", "first_later")
        faults = found if faults is None else faults.unionByName(found)
    return faults


def assert_chronological(fold_dates: DataFrame, session: str = "session_date", order: Sequence[str] = ("train", "test")) -> None:
    bad = chronology_faults(fold_dates, session, order).first()
    if bad:
        raise ValueError(f"fold {bad['fold']}: {bad['earlier']} ends {bad['last_earlier']}, {bad['later']} begins {bad['first_later']}")


def purged_splits(dates: DataFrame, groups: int = 6, choose: int = 2, purge: int = 1, embargo: int = 1, session: str = "session_date") -> DataFrame:
    """(split, session, position, role) of every choice of test groups; dates near a test date are barred from training."""
    import itertools

    whole = Window.partitionBy()  # sessions are few
    ranked = dates.select(session).where(c(session).isNotNull()).distinct().withColumns({"position": F.row_number().over(Window.orderBy(session)) - 1, "__n": F.count("*").over(whole)})
    # group g holds the positions from g * n // groups to (g + 1) * n // groups
    of = sum((F.when(c("position") >= F.floor(F.lit(g) * c("__n") / groups), 1).otherwise(0) for g in range(1, groups)), F.lit(0))
    splits = F.explode(F.array(*[F.struct(F.lit("-".join(map(str, x))).alias("split"), F.array(*map(F.lit, x)).alias("tests")) for x in itertools.combinations(range(groups), choose)]))
    each = ranked.withColumn("__g", of).withColumn("__s", splits).select(session, "position", c("__s.split").alias("split"), F.array_contains(c("__s.tests"), c("__g")).alias("__test"))
    line = Window.partitionBy("split").orderBy("position")
    near = F.max(c("__test").cast("int")).over(line.rowsBetween(-embargo, purge)) == 1
    return each.select("split", session, "position", F.when(c("__test"), "test").when(near, "barred").otherwise("train").alias("role"))


def split_leaks(splits: DataFrame, reach: int = 1) -> DataFrame:
    """(split, n_train, n_test, leaks): training positions within reach sessions of a test position, where outcomes overlap."""
    line = Window.partitionBy("split").orderBy("position").rangeBetween(-reach, reach)
    near = F.max((c("role") == "test").cast("int")).over(line) == 1
    return splits.withColumn("__near", near).groupBy("split").agg(
        F.sum((c("role") == "train").cast("int")).alias("n_train"), F.sum((c("role") == "test").cast("int")).alias("n_test"), F.sum(((c("role") == "train") & c("__near")).cast("int")).alias("leaks")
    )


def rolling_holdout(dates: DataFrame, holdout: int = 63, before: int = 252, session: str = "session_date") -> DataFrame:
    """One row (cutoff, holdout_start, holdout_end): the last holdout sessions; none if fewer than before + holdout + 1."""
    known = dates.where(c(session).isNotNull())
    last = known.select(session).distinct().orderBy(c(session).desc()).limit(holdout + 1)
    n = known.agg(F.count_distinct(session).alias("n"))
    ranked = last.withColumn("__r", F.row_number().over(Window.orderBy(session)))
    ends = ranked.agg(F.min(session).alias("cutoff"), F.max(F.when(c("__r") == 2, c(session))).alias("holdout_start"), F.max(session).alias("holdout_end"))
    return ends.join(F.broadcast(n)).where(c("n") >= before + holdout + 1).drop("n")  # one row each


def should_rotate(lock: dict, result_exists: bool, fingerprint: str) -> bool:
    """Whether a finished holdout gives way to a new one: only after its result, when the code that it judged has changed."""
    if not result_exists:
        return False
    if lock.get("status") != "FROZEN":
        raise ValueError("a judged holdout must be frozen")
    return lock.get("research_code_fingerprint_sha256") != fingerprint


def holdout_lock(cutoff: date, start: date, end: date, generation: int, fingerprint: str, now, source: str, revision: str | None = None) -> dict:
    """Record that freezes a holdout's dates before a model is chosen."""
    return {
        "status": "CUTOFF_FROZEN_PENDING_MODEL", "cutoff_date": str(cutoff), "holdout_start": str(start), "holdout_end": str(end), "cutoff_frozen_at": now.isoformat(), "cutoff_frozen_git_sha": revision,
        "holdout_generation": int(generation), "research_code_fingerprint_sha256": fingerprint, "selection_source": source, "selected_model": None, "regime_selected_models": {},
    }


def yearly_returns(returns: DataFrame, day: str = "session_date", value: str = "ret") -> DataFrame:
    """(year, mean_return) of daily returns."""
    return returns.where(c(value).isNotNull() & c(day).isNotNull()).groupBy(F.year(day).alias("year")).agg(F.avg(value).alias("mean_return"))


def overfit_figures(returns: DataFrame, trials: int = 1, periods: int = 252, day: str = "session_date", value: str = "ret") -> DataFrame:
    """One row: n, annualised Sharpe ratio, its penalty for having been chosen among trials, years and positive years.

    The penalty is the normal quantile at 1 - 1 / trials (by an approximate inverse error
    function) times the ratio's standard error; null under 20 returns.
    """
    from tidemark.functions.cols import inverse_erf

    one = returns.where(c(value).isNotNull() & c(day).isNotNull()).agg(F.count("*").alias("n"), F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    years = yearly_returns(returns, day, value).agg(F.count("*").alias("years"), F.avg((c("mean_return") > 0).cast("double")).alias("positive_year_share"))
    sharpe = F.when(c("__s") > 0, c("__m") / c("__s") * math.sqrt(periods))
    z = math.sqrt(2.0) * inverse_erf(F.lit(1.0 - 2.0 * max(1.0 / max(2, trials), 1e-12)))
    error = F.sqrt(F.greatest((1 + 0.5 * c("sharpe") * c("sharpe")) / c("n"), F.lit(1e-12)))
    out = one.withColumn("sharpe", sharpe).withColumn("selection_penalty", F.when(c("n") >= 20, F.greatest(z * error, F.lit(0.0))))
    out = out.withColumn("adjusted_sharpe", c("sharpe") - c("selection_penalty"))
    return out.select("n", "sharpe", "selection_penalty", "adjusted_sharpe").join(F.broadcast(years))  # one row each


def block_sign_flip(x: Sequence[float], block: int = 5, permutations: int = 1000, seed: int = 42) -> float:
    """Two-sided p-value of a zero mean when blocks of neighbours change sign together; nan for short series."""
    import numpy as np

    v = np.asarray([u for u in x if u is not None and math.isfinite(u)], float)
    if len(v) < max(20, 2 * block):
        return math.nan
    sums = v[: len(v) // block * block].reshape(-1, block).sum(1)
    rng = np.random.default_rng(seed)
    signs = rng.choice(np.array([-1.0, 1.0]), size=(max(100, permutations), len(sums)))
    hits = (np.abs((signs * sums).sum(1)) / (len(sums) * block) >= abs(v.mean())).sum()
    return float((hits + 1) / (max(100, permutations) + 1))


def anti_overfit(returns: DataFrame, trials: int = 1, least_years: int = 3, least_share: float = 0.6, most_p: float = 0.05, seed: int = 42, day: str = "session_date", value: str = "ret") -> dict:
    """Figures of overfit_figures, the sign-flip p-value over the daily series, and a verdict: PASS, FAIL or INSUFFICIENT_EVIDENCE."""
    one = overfit_figures(returns, trials, day=day, value=value).first().asDict()
    if one["n"] < 20:
        return {"status": "INSUFFICIENT_EVIDENCE", "rows": one["n"]}
    series = [r[0] for r in returns.where(c(value).isNotNull() & c(day).isNotNull()).orderBy(day).select(value).collect()]  # one a session
    p = block_sign_flip(series, seed=seed)
    checks = {"sign_flip": p <= most_p, "adjusted_sharpe": (one["adjusted_sharpe"] or 0) > 0, "years": one["years"] >= least_years and one["positive_year_share"] >= least_share}
    status = "PASS" if all(checks.values()) else "INSUFFICIENT_EVIDENCE" if one["years"] < least_years else "FAIL"
    return {"status": status, "rows": one["n"], "sign_flip_p": p, **one, "checks": checks}


def ordinal_share(x: Column, keys: Sequence[str], ties: Sequence[str], descending: bool = False) -> Column:
    """Place of x within keys, ties settled by the columns named, over the number of rows."""
    w = Window.partitionBy(*keys).orderBy(x.desc() if descending else x.asc(), *ties)
    return F.row_number().over(w) / F.count("*").over(Window.partitionBy(*keys))


def rank_score(p: Column, expected: Column, uncertainty: Column, keys: Sequence[str], ties: Sequence[str], weight: Column | float, penalty: Column | float) -> Column:
    """Score of a row within its session: shares of places of probability and return, less that of uncertainty."""
    weight, penalty = (F.lit(x) if isinstance(x, float) else x for x in (weight, penalty))
    return weight * ordinal_share(p, keys, ties, True) + (1 - weight) * ordinal_share(expected, keys, ties, True) - penalty * ordinal_share(uncertainty, keys, ties)


def ranking_grid(cases: DataFrame, keys: Sequence[str], ties: Sequence[str], weights: Sequence[float] = (0.25, 0.5, 0.75), penalties: Sequence[float] = (0.0, 0.05, 0.1)) -> DataFrame:
    """(fold, weight, penalty, rank_ic): mean correlation of the rank score and the outcome over the groups (keys) of a fold.

    cases (fold, keys, p, expected, uncertainty, y_ret). Groups of fewer than two rows, or
    without spread on either side, do not count.
    """
    parts = cases.withColumns({"__p": ordinal_share(c("p"), keys, ties, True), "__e": ordinal_share(c("expected"), keys, ties, True), "__u": ordinal_share(c("uncertainty"), keys, ties)})
    grid = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.lit(float(k)).alias("penalty")) for w in weights for k in penalties])
    each = parts.withColumn("__g", F.explode(grid)).select("fold", *keys, "y_ret", "__p", "__e", "__u", "__g.weight", "__g.penalty")
    score = c("weight") * c("__p") + (1 - c("weight")) * c("__e") - c("penalty") * c("__u")
    group = each.groupBy("fold", *[k for k in keys if k != "fold"], "weight", "penalty").agg(
        F.count("*").alias("n"), F.covar_pop(score, c("y_ret")).alias("cov"), F.stddev_pop(score).alias("s"), F.stddev_pop("y_ret").alias("r")
    ).where("n >= 2 and s > 1e-12 and r > 1e-12")
    return group.groupBy("fold", "weight", "penalty").agg(F.avg(c("cov") / (c("s") * c("r"))).alias("rank_ic"))


def ranking_choice(grid: DataFrame, least: int = 3, penalty: float = 0.25, default: tuple[float, float] = (0.5, 0.0)) -> DataFrame:
    """(fold, weight, penalty, rank_ic, baseline_rank_ic): the pair with the best prior rank IC less its deviation.

    A pair counts with least earlier folds; ties go to the larger weight, then penalty;
    folds without evidence take the default.
    """
    line = Window.partitionBy("weight", "penalty").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.avg("rank_ic").over(line) - penalty * F.coalesce(F.stddev_samp("rank_ic").over(line), F.lit(0.0))
    scored = grid.withColumn("__score", F.when(F.count("rank_ic").over(line) >= least, prior))
    fixed = (c("weight") == default[0]) & (c("penalty") == default[1])
    order = [c("__score").desc_nulls_last(), F.when(c("__score").isNull(), (~fixed).cast("int")), c("weight").desc(), c("penalty").desc()]
    scored = scored.withColumn("baseline_rank_ic", F.max(F.when(fixed, c("rank_ic"))).over(Window.partitionBy("fold")))
    return least_by(scored, ["fold"], *order).select("fold", "weight", "penalty", "rank_ic", "baseline_rank_ic")
