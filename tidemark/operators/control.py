"""Control plane over the prediction bank: state of each case, routing, policies, failures and their memory.

Cases have one row (fold, keys, y, p: array of the models' probabilities in the order of
models, risk: array of context values). Whatever a fold learns comes from earlier folds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import clip, ratio
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators.patterns import EPS, deviation, mean, prior_quantiles, total
from tidemark.operators.scores import binary_metrics, log_loss
from tidemark.scratch import ensure_importable, table

c = F.col
STATE = ("mean_probability", "std_probability", "probability_range", "prediction_entropy", "agreement", "data_completeness", "feature_reliability", "feature_drift", "information_shock")
#: Scenario names and the regimes of the soft posterior (fixed values).
SCENARIOS = ("continuation_up", "continuation_down", "range_neutral", "shock")
REGIMES = ("trend_up", "range", "trend_down", "shock", "unknown")


def prior_medians(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """(fold, m_x and s_x for each value x): exact medians and population deviations over all rows of the earlier folds.

    rows are read several times, so they should come from a table.
    """
    bounds = rows.agg(*[f(x).alias(f"{k}_{x}") for x in values for k, f in (("lo", F.min), ("hi", F.max), ("mid", F.avg))]).first()
    line = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # a row a fold
    off = lambda x: c(x) - F.lit(bounds[f"mid_{x}"] or 0.0)  # noqa: E731  sums of squares lose least around the mean
    per = rows.groupBy("fold").agg(*[y for x in values for y in (F.sum(off(x)).alias(f"a_{x}"), F.sum(off(x) * off(x)).alias(f"q_{x}"), F.count(x).alias(f"n_{x}"))])
    out = per.select("fold", *[
        F.sqrt(F.greatest(ratio(F.sum(f"q_{x}").over(line), F.sum(f"n_{x}").over(line).cast("double")) - ratio(F.sum(f"a_{x}").over(line), F.sum(f"n_{x}").over(line).cast("double")) ** 2, F.lit(0.0))).alias(f"s_{x}") for x in values
    ])
    spans = {x: (bounds[f"lo_{x}"], bounds[f"hi_{x}"] - bounds[f"lo_{x}"]) for x in values if bounds[f"lo_{x}"] is not None}
    wide = {x: v for x, v in spans.items() if v[1] > 0}
    out = out.withColumns({f"m_{x}": F.lit(spans[x][0] if x in spans else None).cast("double") for x in values if x not in wide})
    if not wide:
        return out
    # all values at once, each scaled to [0, 1/2]
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("name"), ((c(x) - F.lit(low)) / F.lit(2.0 * span)).alias("v")) for x, (low, span) in wide.items()]))
    found = prior_quantiles(rows.select("fold", each.alias("z")).select("fold", "z.*"), "v", {"m": 0.5}, keys=["name"])
    of = lambda x: F.max(F.when(c("name") == x, c("m"))) * F.lit(2.0 * wide[x][1]) + F.lit(wide[x][0])
    found = table(found.groupBy(c("fold").alias("__f")).agg(*[of(x).alias(f"m_{x}") for x in wide]), "prior-medians")
    return out.join(found, c("fold") == c("__f"), "left").drop("__f")


def state_vector(cases: DataFrame, n_risk: int, gap: int = 2, volume: int = 1) -> DataFrame:
    """cases with the columns STATE; gap and volume are the places of those values in risk.

    feature_drift is one number a fold: how far the medians of its risk values lie from
    those of all earlier folds, in their deviations, held at 8 and divided by it.
    """
    p, r = c("p"), c("risk")
    centre = mean(p)
    up = mean(F.transform(p, lambda v: F.when(v >= 0.5, 1.0).otherwise(0.0)))
    q = clip(centre, EPS, 1 - EPS)
    at = lambda k: F.coalesce(F.element_at(r, k + 1), F.lit(0.0))
    shock = clip(F.greatest((F.abs(at(gap)) - 0.03) / 0.05, (at(volume) - 3.0) / 6.0, F.lit(0.0)), 0.0, 1.0) if n_risk > max(gap, volume) else F.lit(0.0)
    known = mean(F.transform(r, lambda v: v.isNotNull().cast("double"))) if n_risk else F.lit(1.0)
    rows = cases.withColumns({
        "mean_probability": centre, "std_probability": deviation(p), "probability_range": F.array_max(p) - F.array_min(p), "prediction_entropy": -(q * F.log(q) + (1 - q) * F.log(1 - q)),
        "agreement": F.greatest(up, 1 - up), "data_completeness": known, "information_shock": shock,
    })
    names = [f"r{k}" for k in range(n_risk)]
    flat = cases.select("fold", *[F.element_at("risk", k + 1).alias(x) for k, x in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("name"), c(x).alias("v")) for x in names])) if names else F.lit(None).cast("struct<name:string,v:double>")
    middle = exact_quantiles(flat.select("fold", each.alias("z")).select("fold", "z.*"), ["fold", "name"], "v", [0.5])
    now = flat.select("fold").distinct().join(middle.withColumnRenamed("fold", "__q"), c("fold") == c("__q"), "left")
    now = now.groupBy("fold").agg(*[F.max(F.when(c("name") == x, c("q")[0])).alias(f"c_{x}") for x in names])
    past = prior_medians(flat, names).withColumnRenamed("fold", "__f")
    both = now.join(past, c("fold") == c("__f"), "left")
    scale = lambda x: F.when(F.coalesce(c(f"s_{x}"), F.lit(0.0)) < 1e-6, 1.0).otherwise(c(f"s_{x}"))
    moves = F.filter(F.array(*[clip(F.abs(c(f"c_{x}") - c(f"m_{x}")) / scale(x), 0.0, 8.0) / 8.0 for x in names]), lambda v: v.isNotNull()) if names else F.array().cast("array<double>")
    drift = both.select(c("fold").alias("__d"), F.when(F.size(moves) > 0, mean(moves)).otherwise(0.0).alias("feature_drift"))
    rows = rows.join(F.broadcast(drift), c("fold") == c("__d")).drop("__d")  # a row a fold
    return rows.withColumn("feature_reliability", clip(c("data_completeness") * (1 - 0.5 * c("feature_drift")), 0.0, 1.0))


def ood_score(states: DataFrame, columns: Sequence[str] = STATE) -> DataFrame:
    """states with ood: root mean square of the columns' distances from the medians of earlier folds, in deviations, over 4 and held at 1; 0 in the first fold."""
    past = prior_medians(states, columns).withColumnRenamed("fold", "__f")
    z = [(c(x) - c(f"m_{x}")) / F.when(F.coalesce(c(f"s_{x}"), F.lit(0.0)) < 1e-6, 1.0).otherwise(c(f"s_{x}")) for x in columns]
    root = F.sqrt(sum((v * v for v in z), F.lit(0.0)) / len(z))
    return states.join(F.broadcast(past), c("fold") == c("__f"), "left").withColumn("ood", F.coalesce(clip(root / 4.0, 0.0, 1.0), F.lit(0.0))).drop("__f", *[f"{k}_{x}" for x in columns for k in "ms"])


def predictability(states: DataFrame) -> DataFrame:
    """states with predictability and future_predictability: the fold's means carried on by their last change, held at 0.15, times 0.75."""
    raw = clip(0.28 * c("agreement") + 0.22 * (1 - c("prediction_entropy") / math.log(2.0)) + 0.20 * c("data_completeness") + 0.20 * c("feature_reliability") + 0.10 * (1 - c("ood")), 0.0, 1.0)
    rows = states.withColumn("predictability", raw)
    per = rows.groupBy("fold").agg(F.avg("predictability").alias("__m"))
    line = Window.orderBy("fold")
    speed = F.coalesce(F.lag("__m", 1).over(line) - F.lag("__m", 2).over(line), F.lit(0.0))
    per = per.select(c("fold").alias("__f"), clip(speed, -0.15, 0.15).alias("__v"))
    return rows.join(F.broadcast(per), c("fold") == c("__f")).withColumn("future_predictability", clip(c("predictability") + c("__v") * 0.75, 0.0, 1.0)).drop("__f", "__v")


def history_weights(bank: DataFrame, temperature: float = 0.1, floor: float = 0.03) -> DataFrame:
    """(fold, model, quality): weights by the mean of earlier folds' log losses, none under floor before they are normed; even in the first fold."""
    per = bank.groupBy("fold", "model").agg(F.avg(log_loss(c("y"), c("p"))).alias("l"))
    prior = F.coalesce(F.avg("l").over(Window.partitionBy("model").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)), F.lit(math.log(2.0)))
    day = Window.partitionBy("fold")
    raw = per.withColumn("z", prior).withColumn("e", F.greatest(F.exp(-(c("z") - F.min("z").over(day)) / temperature), F.lit(floor)))
    return raw.select("fold", "model", (c("e") / F.sum("e").over(day)).alias("quality"))


def normed(x: Column) -> Column:
    s = F.greatest(total(x), F.lit(EPS))
    return F.transform(x, lambda v: v / s)


def routing_weights(p: Column, quality: Column) -> Column:
    """Row-wise weights: a model counts less the farther it stands from the mean of the row, in the row's deviations."""
    m, s = mean(p), F.greatest(deviation(p), F.lit(0.01))
    return normed(F.zip_with(p, quality, lambda v, q: F.exp(-F.abs(v - m) / s) * clip(q, EPS, 1 - EPS)))


def failure_aware(weights: Column, risks: Column) -> Column:
    """Weights times each model's chance to hold, 0.15 at least."""
    return normed(F.zip_with(weights, risks, lambda w, r: w * F.greatest(1 - clip(r, 0.0, 1.0), F.lit(0.15))))


def failure_labels(bank: DataFrame) -> DataFrame:
    """(fold, model, failed): whether the model did worse in the next fold by more than the allowance of any metric; null in the last."""
    m = binary_metrics(bank, ["fold", "model"])
    line = Window.partitionBy("model").orderBy("fold")
    nxt = {x: F.lead(x).over(line) for x in ("accuracy", "logloss", "brier", "ece")}
    worse = (nxt["accuracy"] < c("accuracy") - 0.03) | (nxt["logloss"] > c("logloss") + 0.02) | (nxt["brier"] > c("brier") + 0.008) | (nxt["ece"] > c("ece") + 0.02)
    return m.select("fold", "model", worse.cast("int").alias("failed"))


def failure_risk(labels: DataFrame, last: int = 8) -> DataFrame:
    """(fold, model, risk, folds_to_failure): weighted mean of the labels known before the fold, later ones weighing up to twice as much.

    A fold's label needs the next fold's outcomes, so at fold t it is known for folds up to
    t - 2, of which those from t - last on count. Without any the risk is one half.
    """
    w = Window.partitionBy("model").orderBy("fold").rowsBetween(-last, -2)
    known = F.collect_list("failed").over(w)
    weights = F.transform("__k", lambda v, i: F.lit(0.5) + F.when(F.size("__k") > 1, 0.5 * i / (F.size("__k") - 1)).otherwise(0.0))
    out = labels.withColumn("__k", known)
    hit = F.zip_with(c("__k"), weights, lambda v, x: v * x)
    risk = F.when(F.size("__k") > 0, total(hit) / total(weights)).otherwise(0.5)
    out = out.withColumn("risk", clip(risk, 0.0, 1.0)).drop("__k")
    return out.select("fold", "model", "risk", (1 / F.greatest(c("risk"), F.lit(0.05))).alias("folds_to_failure"))


def failure_times(labels: DataFrame) -> DataFrame:
    """(fold, model, follow_up, event): folds from a fold to the model's next failure, or to its last label where none follows (event 0).

    A failure by the label of the fold itself counts as one fold away. Folds after the last
    label have no row; a window holds a row a fold.
    """
    line = Window.partitionBy("model").orderBy("fold")
    rest = line.rowsBetween(0, Window.unboundedFollowing)
    rows = labels.withColumn("__i", F.row_number().over(line))
    rows = rows.withColumns({"__next": F.min(F.when(c("failed") == 1, c("__i"))).over(rest), "__last": F.max(F.when(c("failed").isNotNull(), c("__i"))).over(rest)})
    rows = rows.where(c("__last").isNotNull())
    return rows.select("fold", "model", (F.coalesce("__next", "__last") + 1 - c("__i")).alias("follow_up"), c("__next").isNotNull().cast("int").alias("event"))


def failure_time_scores(times: DataFrame, risks: DataFrame) -> DataFrame:
    """A row a model: how far the folds_to_failure said at each fold lie from the failures that came; censored cases are counted, not scored."""
    said = risks.select(c("fold").alias("__f"), c("model").alias("__m"), c("folds_to_failure").alias("said"))
    rows = times.join(said, (c("fold") == c("__f")) & (c("model") == c("__m")))
    hit = c("event") == 1
    gap = F.when(hit, F.abs(c("said") - c("follow_up")))
    return rows.groupBy("model").agg(
        F.sum("event").alias("event_cases"), F.sum(1 - c("event")).alias("censored_cases"), F.avg("event").alias("event_rate"), F.when(F.sum("event") > 0, F.avg(F.when(hit, c("said")))).otherwise(F.avg("said")).alias("predicted_mean"),
        F.avg(F.when(hit, c("follow_up"))).alias("observed_mean"), F.avg(gap).alias("mae"), F.median(gap).alias("median_abs_error"),
    )


def failure_hazard(times: DataFrame) -> DataFrame:
    """(model, horizon, at_risk, events, hazard, survival): discrete hazards by folds ahead, with censored cases at risk as long as they are followed."""
    per = times.groupBy("model", c("follow_up").alias("horizon")).agg(F.sum("event").alias("events"), F.count("*").alias("__n"))
    line = Window.partitionBy("model").orderBy("horizon")
    rows = per.withColumn("at_risk", F.sum("__n").over(line.rowsBetween(0, Window.unboundedFollowing))).withColumn("hazard", c("events") / c("at_risk"))
    left = F.collect_list("hazard").over(line.rowsBetween(Window.unboundedPreceding, 0))  # a value a horizon
    survival = F.aggregate(left, F.lit(1.0), lambda acc, h: acc * (1 - h))
    return rows.select("model", "horizon", "at_risk", "events", "hazard", survival.alias("survival"))


def severity(risk: Column) -> Column:
    return F.when(risk >= 0.9, "critical").when(risk >= 0.75, "failure").when(risk >= 0.5, "warning").otherwise("normal")


def policy(predictability_: Column, ood: Column, failure: Column, retrieval: Column) -> Column:
    """How a case is predicted."""
    return (
        F.when((predictability_ < 0.25) | (ood >= 0.85) | (failure >= 0.82), "abstain").when((predictability_ < 0.45) | (ood >= 0.55) | (failure >= 0.60), "risk_control")
        .when(retrieval >= 0.70, "retrieval").when((predictability_ >= 0.70) & (ood < 0.30), "ensemble").otherwise("standard")
    )


def strategy_probability(strategy: Column, p: Column, weights: Column, retrieval: Column) -> Column:
    """Probability under a strategy; the first model is the standard."""
    base = total(F.zip_with(p, weights, lambda a, b: a * b))
    value = F.when(strategy == "standard", F.element_at(p, 1)).when(strategy == "retrieval", 0.8 * base + 0.2 * retrieval).when(strategy == "risk_control", 0.7 * base + 0.15).otherwise(base)
    return clip(value, EPS, 1 - EPS)


def update_need(reach: Column, shock: Column, reliability: Column) -> Column:
    return clip(0.35 * reach + 0.25 * shock + 0.20 * (1 - reliability), 0.0, 1.0)


def revised(before: float | None, value: float, asks: float, on: bool) -> tuple[str, float]:
    """(action, output) for a prediction, given the last output of its key (fixed values)."""
    before = value if before is None else before
    change = min(max(asks + abs(value - before), 0.0), 1.0)
    if not on:
        return "abstain", value
    if change < 0.25:
        return "maintain", before
    if change < 0.45:
        return "micro_revision", 0.75 * before + 0.25 * value
    if change < 0.72:
        return "recompute", value
    return "deep_recompute", 0.85 * value + 0.15 * 0.5


def revisions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], selected: str = "selected", need: str = "update_need", active: str = "active") -> DataFrame:
    """rows with action and output: each key's prediction is kept, moved, or made anew by how much it should change.

    The last output of a key is its state, which needs its rows in order: they come sorted,
    in batches of many keys, and a task holds one batch and the state of one key.
    """
    ensure_importable(rows.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k) for k in keys]
            first = np.zeros(batch.num_rows, bool)
            for x in own:
                first[1:] |= pc.not_equal(x[1:], x[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
            for i in [0, *np.flatnonzero(first).tolist()]:  # nulls are one key
                first[i] = (last if i == 0 else [x[i - 1].as_py() for x in own]) != [x[i].as_py() for x in own]
            last = [x[-1].as_py() for x in own]
            actions, outputs = [], []
            for new, value, asks, on in zip(first.tolist(), batch.column(selected).to_pylist(), batch.column(need).to_pylist(), batch.column(active).to_pylist(), strict=True):
                action, before = revised(None if new else before, value, asks, on)
                actions.append(action)
                outputs.append(before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(actions, pa.string()), pa.array(outputs, pa.float64())], [*batch.schema.names, "action", "output"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda x: run(x), f"{kinds}, action string, output double")


def attribution(prediction: Column, outcome: Column, predictability_: Column, ood: Column, risk: Column, disagreement: Column) -> Column:
    """Why a prediction failed, by the first sign that holds; known only after the outcome."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when((prediction >= 0.5) == (outcome == 1), "correct").when((prediction >= 0.75) | (prediction <= 0.25), "high_confidence_wrong").when(yes(ood >= 0.85), "ood_extrapolation")
        .when(yes(risk >= 0.82), "future_failure_warning").when(yes(predictability_ < 0.25), "low_predictability").when(yes(disagreement >= 0.06), "high_model_disagreement").otherwise("other_prediction_error")
    )


def prior_failure_rates(ledger: DataFrame, keys: Sequence[str] = ("regime", "strategy")) -> DataFrame:
    """ledger (fold, keys, failed) with the failure rate of its keys over earlier folds, raw and smoothed by half a failure in one case."""
    per = ledger.groupBy("fold", *keys).agg(F.sum("failed").alias("f"), F.count("*").alias("n"))
    folds = ledger.select(c("fold").alias("__t")).distinct()
    seen = per.join(folds, c("fold") < c("__t")).groupBy("__t", *[c(k).alias(f"__{k}") for k in keys]).agg(F.sum("f").alias("__f"), F.sum("n").alias("__n"))  # sums of folds, which are few
    out = ledger.join(F.broadcast(seen), [c("fold") == c("__t"), *[c(k).eqNullSafe(c(f"__{k}")) for k in keys]], "left")
    return out.withColumns({"prior_failure_rate": c("__f") / c("__n"), "smoothed_failure_rate": (c("__f") + 0.5) / (c("__n") + 1.0)}).drop("__t", "__f", "__n", *[f"__{k}" for k in keys])


def router_stability(weights: DataFrame) -> DataFrame:
    """One row: mean and largest change of the fold's mean weights (fold, model, weight), and the share of folds where one model has 0.9."""
    change = F.abs(c("weight") - F.lag("weight").over(Window.partitionBy("model").orderBy("fold")))
    per = weights.withColumn("__c", change).groupBy("fold").agg(F.sum("__c").alias("l1"), F.max("weight").alias("top"))
    return per.agg(F.avg("l1").alias("mean_change"), F.max("l1").alias("max_change"), F.avg((c("top") >= 0.9).cast("double")).alias("concentrated_share"))


# states of the market and what to do about them -----------------------------------------------------


def regime_posterior(trend: Column, volatility: Column, liquidity: Column | float = 0.0, event: Column | float = 0.0, temperature: float = 1.0) -> Column:
    """Soft membership in REGIMES, an array."""
    liquidity, event = (F.lit(x) if isinstance(x, float) else x for x in (liquidity, event))
    size = F.abs(trend)
    raw = F.array(trend - 0.5 * volatility - 0.2 * event, -size - 0.2 * volatility + 0.1 * liquidity, -trend - 0.5 * volatility - 0.2 * event, 0.8 * volatility + 0.8 * event - 0.2 * liquidity, -0.5 * size - 0.25 * volatility)
    top = F.array_max(raw)
    e = F.transform(raw, lambda v: F.exp(F.greatest((v - top) / temperature, F.lit(-50.0))))
    s = total(e)
    return F.transform(e, lambda v: v / s)


def scenario_mixture(up: Column, shock: Column, disagreement: Column) -> Column:
    """Weights of SCENARIOS, an array that sums to one."""
    mass = clip(0.55 * shock + 0.35 * disagreement, 0.0, 1.0)
    sure = clip(2 * F.abs(up - 0.5), 0.0, 1.0)
    rise, fall = (1 - mass) * sure * up, (1 - mass) * sure * (1 - up)
    return F.array(rise, fall, (1 - mass) - rise - fall, mass)


def uncertainty(*channels: Column) -> Column:
    """Mean of the channels, each held in [0, 1]."""
    return clip(sum((clip(x, 0.0, 1.0) for x in channels), F.lit(0.0)) / len(channels), 0.0, 1.0)


def information_action(doubt: Column, data_quality: Column, ood: Column, stability: Column) -> Column:
    """PREDICT, or what to do first; of the rules that hold the last in order of severity decides."""
    return F.when((ood >= 0.85) | (doubt >= 0.80), "ABSTAIN").when((stability < 0.40) & (doubt >= 0.55), "WAIT").when(data_quality < 0.60, "ACQUIRE_MORE").otherwise("PREDICT")


def scenario_levels(mean_p: Column, dispersion: Column, ood: Column) -> dict[str, Column]:
    """Columns of the scenario proxy: weights of normal, bullish and bearish, their levels and the spread."""
    spread = clip(0.03 + 0.45 * dispersion + 0.20 * ood, 0.03, 0.25)
    tail = clip(0.10 + 0.55 * dispersion + 0.35 * ood, 0.10, 0.60)
    bull = tail * clip(mean_p, 0.15, 0.85)
    hold = lambda x: clip(x, 0.001, 0.999)
    return {"normal": 1 - tail, "bullish": bull, "bearish": tail - bull, "normal_level": hold(mean_p), "bullish_level": hold(mean_p + spread), "bearish_level": hold(mean_p - spread), "spread": spread}


def nearest_cases(ledger: DataFrame, key: str, regime: str = "regime", top: int = 10, size: int = 1024) -> DataFrame:
    """(key, hits, failure_rate, best_distance) of each case from the most alike cases of earlier folds.

    ledger (key, fold, regime, prediction, predictability, ood, failure_risk, disagreement,
    failed). Distance is the mean of the scaled differences, times 0.8 in the same regime,
    ties to the smaller key. Cases that are alike in all of these and in their fold are one
    spot: it is asked for once, and of its history no more than the top smallest keys can count.

    Spots lie in cells of about size, split at medians of a sample of 200,000 at most, which
    moves the borders, not the result. A spot looks in its own cell first, and then only
    where the bounds of a cell leave room for a nearer case: exact, and a task holds a cell and
    at most 64 * size visits.
    """
    from tidemark.operators.retrieval import Cells, nearest_in

    signs, scales = ("prediction", "predictability", "ood", "failure_risk", "disagreement"), (0.20, 0.50, 0.50, 0.50, 0.10)
    spark = ledger.sparkSession
    ensure_importable(spark)
    rows = ledger.select(c(key).alias("id"), "fold", c(regime).cast("string").alias("regime"), c("failed").cast("double").alias("failed"), *[c(x).cast("double").alias(x) for x in signs]).dropna(subset=["fold", *signs])
    rows = rows.where(" and ".join(f"abs({x}) < double('infinity')" for x in signs)).withColumn("u", F.monotonically_increasing_id())
    alike = Window.partitionBy("fold", "regime", *signs).orderBy("id", "u")
    rows = table(rows.withColumns({"r": F.row_number().over(alike), "spot": F.first("u").over(alike)}).drop("u"), "case-spots")
    held = rows.where(c("r") <= top)
    sizes = {r["regime"]: r["count"] for r in held.groupBy("regime").count().collect()}  # a row a regime
    share = min(1.0, 200_000 / max(1, sum(sizes.values())))
    some = held.where(F.pmod(F.xxhash64("spot", "r"), F.lit(1_000_000)) < int(share * 1_000_000)).select("regime", *signs).toArrow()
    cells = Cells.split(some.column("regime").to_pylist(), np.column_stack([some.column(x).to_numpy() for x in signs]), sizes, scales, size)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = cells.of(b.column("regime"), np.column_stack([b.column(x).to_numpy() for x in signs]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "cell"])

    points = table(held.mapInArrow(lambda x: placed(x), f"{kinds}, cell int"), "case-cells")
    own = points.groupBy("cell", "fold").agg(F.count("*").alias("n"), *[f(x).alias(f"{k}_{x}") for x in signs for k, f in (("lo", F.min), ("hi", F.max))]).toArrow()  # a row a cell and fold
    cells = cells.bounded(own, signs)
    parts = max(1, min(len(cells.regimes), max(4 * spark.sparkContext.defaultParallelism, len(cells.regimes) // 16)))
    kind = ledger.schema[key].dataType.simpleString()
    fold = ledger.schema["fold"].dataType.simpleString()
    schema = f"spot long, other {kind}, d double, failed double, cell int, fold {fold}, {', '.join(f'{x} double' for x in signs)}, factor double, bound double"
    first = points.repartition(parts, "cell").groupBy("cell").applyInArrow(lambda t: cells.search(t, signs, top), schema)
    first = table(first, "case-visits")
    visits = first.where("cell is not null").drop("other", "d", "failed")
    # a cell that many visit is dealt in pieces
    pieces = visits.groupBy(c("cell").alias("v")).agg(F.ceil(F.count("*") / (64 * size)).cast("int").alias("pieces"))
    pieces = table(pieces, "case-pieces")
    asked = visits.join(F.broadcast(pieces), c("cell") == c("v")).withColumn("piece", F.pmod(F.xxhash64("spot"), c("pieces")).cast("int"))
    there = points.join(F.broadcast(pieces), c("cell") == c("v")).withColumn("piece", F.explode(F.sequence(F.lit(0), c("pieces") - 1)))
    asked, there = (x.drop("v", "pieces").repartition(parts, "cell", "piece") for x in (asked, there))
    more = asked.groupBy("cell", "piece").cogroup(there.groupBy("cell", "piece")).applyInArrow(lambda x, y: nearest_in(x, y, signs, scales, top), f"spot long, other {kind}, d double, failed double")
    found = first.where("cell is null").select("spot", "other", "d", "failed").unionByName(more)
    best = lambda df, by: df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("d", "other"))).where(c("__r") <= top).drop("__r")
    each = best(rows.select("id", "spot").join(best(found, "spot"), "spot"), "id")
    return each.groupBy(c("id").alias(key)).agg(F.count("*").alias("hits"), F.avg("failed").alias("failure_rate"), F.min("d").alias("best_distance"))


# risk of single predictions ------------------------------------------------------------------------


def risk_features(rows: DataFrame, experts: str = "p", p: str = "probability", context: Sequence[str] = ()) -> DataFrame:
    """rows with the features cr_*: five of the probabilities, and each context value with its gaps filled by the median and marked."""
    q = clip(c(p), EPS, 1 - EPS)
    x = c(experts)
    up = mean(F.transform(x, lambda v: F.when(v >= 0.5, 1.0).otherwise(0.0)))
    out = {
        "cr_confidence": F.abs(q - 0.5), "cr_entropy": -(q * F.log(q) + (1 - q) * F.log(1 - q)), "cr_disagreement": deviation(x),
        "cr_range": F.array_max(x) - F.array_min(x), "cr_conflict": F.least(up, 1 - up),
    }
    middle = {}
    if context:
        from tidemark.functions.quantiles import exact_quantiles

        for name in context:
            got = exact_quantiles(rows, [], name, [0.5]).first()
            middle[name] = float(got["q"][0]) if got else 0.0
    for name in context:
        out[f"cr_{name}"] = F.coalesce(c(name).cast("double"), F.lit(middle[name]))
        out[f"cr_{name}_missing"] = c(name).isNull().cast("double")
    return rows.withColumns({k: clip(v, -10.0, 10.0) for k, v in out.items()})


def risk_shrink(p: Column, risk: Column, base_rate: Column | float, threshold: float = 0.60, most: float = 0.35) -> Column:
    """p drawn toward the base rate as far as the risk of an error passes the threshold; the direction is never turned by it alone."""
    base = clip(F.lit(float(base_rate)) if isinstance(base_rate, float) else base_rate, 1e-5, 1 - 1e-5)
    share = most * clip((F.coalesce(risk, F.lit(1.0)) - threshold) / max(1 - threshold, EPS), 0.0, 1.0)
    return clip((1 - share) * clip(p, EPS, 1 - EPS) + share * base, EPS, 1 - EPS)


def risk_bins(rows: DataFrame, risk: str, y: str, p: str) -> DataFrame:
    """(risk_lo, risk_hi, n, error_rate, mean_risk) in four fixed bins."""
    lo = F.when(c(risk) >= 0.8, 0.8).when(c(risk) >= 0.6, 0.6).when(c(risk) >= 0.4, 0.4).otherwise(0.0)
    hi = F.when(c(risk) >= 0.8, 1.01).when(c(risk) >= 0.6, 0.8).when(c(risk) >= 0.4, 0.6).otherwise(0.4)
    wrong = ((c(p) >= 0.5) != (c(y) == 1)).cast("double")
    return rows.where(c(risk).isNotNull()).groupBy(lo.alias("risk_lo"), hi.alias("risk_hi")).agg(F.count("*").alias("n"), F.avg(wrong).alias("error_rate"), F.avg(risk).alias("mean_risk"))


def loss_weights(losses: Column, temperature: float = 0.25, uniform: float = 0.1) -> Column:
    """Weights of experts by their predicted losses (an array): a softmax with an even share mixed in."""
    z = F.transform(losses, lambda v: -v / temperature)
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    s, n = total(e), F.size(losses)
    return F.transform(e, lambda v: (1 - uniform) * v / s + uniform / n)


def smoothed_rate(failed: Column) -> Column:
    """Aggregate: failures and a half over rows and one."""
    return (F.sum(failed) + 0.5) / (F.count(failed) + 1.0)


#: What a learned model of case failures reads (fixed values).
CASE_SIGNS = ("case_predictability", "case_ood", "case_failure_risk", "case_disagreement")


def case_signs(rows: DataFrame) -> DataFrame:
    """rows with the signs held in [0, 1], the prediction's confidence and entropy, and the fixed score: the mean of four risks."""
    p = clip(c("prediction"), 0.0, 1.0)
    q = clip(p, 1e-12, 1 - 1e-12)
    held = {x: clip(c(x), 0.0, 1.0) for x in CASE_SIGNS}
    out = rows.withColumns(held)
    fixed = (1 - c("case_predictability") + c("case_ood") + c("case_failure_risk") + c("case_disagreement")) / 4
    return out.withColumns({"case_confidence": 2 * F.abs(p - 0.5), "case_entropy": -(q * F.log(q) + (1 - q) * F.log(1 - q)) / math.log(2.0), "fixed_risk": fixed})


def learned_case_risk(rows: DataFrame, frozen_from: int | None = None, least: int = 240) -> DataFrame:
    """rows (fold, CASE_SIGNS, prediction, failed) with learned_risk, by a logistic model of the cases of earlier folds.

    From fold frozen_from on the model stays, so locked outcomes never feed back.
    """
    from tidemark.operators.logistic import prequential

    return prequential(case_signs(rows), [*CASE_SIGNS, "case_confidence", "case_entropy"], "failed", "learned_risk", frozen_from=frozen_from, strength=0.25, balanced=True, least=least)
