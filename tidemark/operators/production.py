"""Serving: baselines, blends, latest usable predictions, monitoring rules and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import clip, full, ratio, rolling, rolling_median, trailing
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators.logistic import fit_small
from tidemark.operators.upkeep import keep_last, violations
from tidemark.scratch import ensure_importable

c = F.col
#: Features of the models by instrument, and of the market baseline (fixed values).
SYMBOL_FEATURES = ("ret_1d", "ret_5d", "ret_20d", "ret_60d", "volatility_20", "volume_ratio_20", "price_vs_sma60", "trend_r2_20", "gap_pct", "return_z20")
MARKET_FEATURES = ("ret_1d", "ret_5d", "ret_20d", "volatility_20", "price_vs_sma20", "volatility_vs_median20")


def blend(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of the probabilities that there are, weights made to sum to one; null without any."""
    known = [F.when(p.isNotNull(), F.lit(float(w))).otherwise(0.0) for p, w in parts]
    weight = sum(known, F.lit(0.0))
    value = sum((F.coalesce(clip(p, 1e-5, 1 - 1e-5), F.lit(0.0)) * w for (p, _), w in zip(parts, known, strict=True)), F.lit(0.0))
    return clip(ratio(value, weight), 1e-5, 1 - 1e-5)


def fallback_probability(global_: Column, asset: Column, symbol: Column) -> Column:
    """The global, asset and instrument models mixed 0.55, 0.25 and 0.20."""
    return blend([(global_, 0.55), (asset, 0.25), (symbol, 0.20)])


def return_blend(median: Column, mean: Column, share: float = 0.5) -> Column:
    """Expected return: the median and mean forecasts mixed, either alone where the other is missing."""
    return F.coalesce(share * median + (1 - share) * mean, median, mean)


def symbol_models(rows: DataFrame, keys: Sequence[str], features: Sequence[str] = SYMBOL_FEATURES, label: str = "target_up_1d", date: str = "session_date", least_core: int = 160, least_calibration: int = 30, share: float = 0.2) -> DataFrame:
    """(keys, p_symbol, n_core, n_calibration): each instrument's own logistic model on its last row.

    Gaps are filled by medians, features scaled, classes weighed equally, ridge strength
    0.25; the last share of the known rows calibrates it by a logistic curve. Instruments
    with too few rows, or one class on either side, get null. A task holds one instrument.
    """
    ensure_importable(rows.sparkSession)
    names = list(features)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(date, "ascending")])
        x = np.column_stack([group.column(f).cast(pa.float64()).to_numpy() for f in names])
        y = group.column(label).cast(pa.float64()).to_numpy()
        known = np.flatnonzero(~np.isnan(y))
        cut = len(known) - int(max(least_calibration, len(known) * share))
        core, cal = known[: max(cut, 0)], known[max(cut, 0) :]
        p = None
        if len(core) >= least_core and len(cal) >= least_calibration and len(set(y[core])) == 2 and len(set(y[cal])) == 2:
            with np.errstate(all="ignore"):
                fill = np.array([np.nanmedian(v) if (~np.isnan(v)).any() else 0.0 for v in x[core].T])
            z = np.where(np.isnan(x), fill, x)
            means, scales, beta = fit_small(z[core], y[core], 0.25, balanced=True)
            score = np.clip((z - means) / scales @ beta[:-1] + beta[-1], -50, 50)
            _, _, curve = fit_small(score[cal][:, None], y[cal], 1e6, scale=False)
            p = float(1 / (1 + np.exp(-np.clip(curve[0] * score[-1] + curve[1], -50, 50))))
        first = group.slice(0, 1).select(list(keys))
        return first.append_column("p_symbol", pa.array([p], pa.float64())).append_column("n_core", pa.array([len(core)], pa.int64())).append_column("n_calibration", pa.array([len(cal)], pa.int64()))

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*dict.fromkeys([*keys, date, label, *names])).groupBy(*keys).applyInArrow(lambda g: run(g), f"{kinds}, p_symbol double, n_core long, n_calibration long")


def market_frame(context: DataFrame, date: str = "session_date") -> DataFrame:
    """Macro rows with what the market baseline reads: compounded returns, distance from the mean price, volatility against its median."""
    known = keep_last(context.dropna(subset=[date, "available_at", "close", "ret_1d", "volatility_20"]), ["family", date], [c("available_at").desc()])
    w = lambda n: trailing(["family"], date, n)
    grown = lambda n: full(c("ret_1d"), F.product(1 + c("ret_1d")).over(w(n)), w(n), n) - 1
    return known.withColumns({
        "ret_5d": grown(5), "ret_20d": grown(20), "price_vs_sma20": ratio(c("close"), rolling(F.avg, c("close"), w(20), 20)) - 1,
        "volatility_vs_median20": ratio(c("volatility_20"), rolling_median(c("volatility_20"), w(20), 20)) - 1,
    })


def market_ranges(frame: DataFrame, date: str = "session_date", least: int = 120, last: int = 120, near: int = 60) -> DataFrame:
    """(family, n, close, expected_close_1d, range_low_1d, range_high_1d, prediction_status) on the last session.

    The expected return is the mean of the last near next-day returns, the range their 10th
    and 90th percentiles over the last ones; families with fewer than least rows are deferred.
    """
    line = Window.partitionBy("family").orderBy(date)
    rows = frame.dropna(subset=list(MARKET_FEATURES)).withColumn("__r", ratio(F.lead("close").over(line), c("close")) - 1)
    back = Window.partitionBy("family").orderBy(c(date).desc())
    rows = rows.withColumns({"__k": F.row_number().over(back), "__n": F.count("*").over(Window.partitionBy("family"))})
    one = rows.groupBy("family").agg(F.max("__n").alias("n"), F.max_by("close", date).alias("close"), F.max(date).alias(date), F.avg(F.when(c("__k").between(2, near + 1), c("__r"))).alias("__e"))
    q = exact_quantiles(rows.where(c("__k").between(2, last + 1)), ["family"], "__r", [0.1, 0.9]).select(c("family").alias("__f"), "q")
    out = one.join(q, c("family") == c("__f"), "left")
    ready = c("n") >= least
    value = lambda r: F.when(ready, c("close") * (1 + r))
    return out.select(
        "family", date, "n", "close", value(c("__e")).alias("expected_close_1d"), value(c("q")[0]).alias("range_low_1d"), value(c("q")[1]).alias("range_high_1d"),
        F.when(ready, "READY").otherwise("DEFERRED_INSUFFICIENT_PIT_HISTORY").alias("prediction_status"),
    )


def market_probabilities(frame: DataFrame, date: str = "session_date", least: int = 100) -> DataFrame:
    """(family, p_up_1d): a logistic model of each family on its last session; null with too few rows. A task holds one family."""
    ensure_importable(frame.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(date, "ascending")])
        x = np.column_stack([group.column(f).to_numpy() for f in MARKET_FEATURES])
        close = group.column("close").to_numpy()
        known = ~np.isnan(x).any(1)
        x, close = x[known], close[known]
        y = (close[1:] > close[:-1]).astype(float)
        p = None
        if len(y) >= least and len(set(y)) == 2:
            means, scales, beta = fit_small(x[:-1], y, 1.0, balanced=True)
            p = float(1 / (1 + np.exp(-np.clip((x[-1] - means) / scales @ beta[:-1] + beta[-1], -50, 50))))
        return group.slice(0, 1).select(["family"]).append_column("p_up_1d", pa.array([p], pa.float64()))

    return frame.select("family", date, "close", *[c(f) for f in MARKET_FEATURES]).groupBy("family").applyInArrow(lambda g: run(g), f"family {frame.schema['family'].dataType.simpleString()}, p_up_1d double")


def latest_usable(predictions: DataFrame, watch: DataFrame, cutoff: Column, keys: Sequence[str] = ("asset_class", "symbol"), target: str | None = None) -> DataFrame:
    """Each watched instrument with its latest prediction that was made, and whose inputs were known, by the cutoff.

    A file that names an instrument twice is not used for it. target names a column of watch
    with the day that the prediction must be for.
    """
    once = predictions.withColumn("__n", F.count("*").over(Window.partitionBy("file", *keys))).where("__n = 1").drop("__n")
    fair = once.where((c("prediction_time") <= cutoff) & (c("available_at") <= c("prediction_time")) & (c("available_at") <= cutoff))
    if target:
        days = watch.select(*[c(k).alias(f"__{k}") for k in keys], c(target).alias("__target"))
        fair = fair.join(days, [*[c(k) == c(f"__{k}") for k in keys], c("target_date") == c("__target")]).drop("__target", *[f"__{k}" for k in keys])
    best = keep_last(fair, list(keys), [c("prediction_time").desc(), c("file").desc()])
    taken = [x for x in best.columns if x not in keys and x not in watch.columns]
    return watch.join(best.select(*keys, *taken), list(keys), "left").withColumn("watch_status", F.when(c("prediction_time").isNull(), "MISSING").otherwise("READY"))


def monitor_status(overall: Mapping, recent: Mapping, baseline: Mapping, recent_baseline: Mapping, least: int = 250, most_ece: float = 0.25) -> str:
    """PASS if both the whole and the recent sessions beat a constant forecast and are calibrated, and there are enough recent rows."""
    fair = lambda m, b: m["logloss"] is not None and m["logloss"] < b["logloss"] and m["ece"] <= most_ece
    return "PASS" if fair(overall, baseline) and recent["n"] >= least and fair(recent, recent_baseline) else "FAIL"


def baseline_loss(resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, base_rate, logloss, brier) of always forecasting the share of ups."""
    one = resolved.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(c("y").cast("double")).alias("base_rate"))
    q = clip(c("base_rate"), 1e-6, 1 - 1e-6)
    return one.withColumns({"logloss": -(c("base_rate") * F.log(q) + (1 - c("base_rate")) * F.log(1 - q)), "brier": c("base_rate") * (1 - c("base_rate"))})


def output_faults(predictions: DataFrame, keys: Sequence[str] = ("asset_class", "symbol")) -> DataFrame:
    """predictions with the rules of a prediction file that each row breaks."""
    twice = F.count("*").over(Window.partitionBy(*keys)) > 1
    known = lambda x: c(x).isNotNull() & ~F.isnan(c(x).cast("double"))
    ready = c("prediction_status") == "READY"
    return predictions.withColumn("faults", violations(
        ("duplicate_key", twice), ("probability_out_of_range", ready & ~F.coalesce(known("p_up_1d") & c("p_up_1d").between(0.0, 1.0), F.lit(False))),
        ("quantiles_not_ordered", ready & F.coalesce((c("return_q10_1d") > c("return_q50_1d")) | (c("return_q50_1d") > c("return_q90_1d")), F.lit(True))),
        ("range_not_ordered", ready & F.coalesce((c("range_low_1d") > c("expected_close_1d")) | (c("expected_close_1d") > c("range_high_1d")), F.lit(False))),
        ("available_after_prediction", F.coalesce(c("available_at") > c("prediction_time"), F.lit(True))), ("no_model", ready & c("model_id").isNull()),
        ("deferred_with_values", ~ready & known("p_up_1d")),
    ))


def watchlist_faults(rows: DataFrame, expected: Sequence[str], name: str = "display_name") -> list[str]:
    """Why a watchlist does not hold: items missing, twice, or READY without values."""
    found = rows.select(name, "prediction_status", "p_up_1d", "target_date").collect()  # one row an item
    names = [r[name] for r in found]
    out = [f"missing: {x}" for x in expected if x not in names] + [f"twice: {x}" for x in sorted(set(names)) if names.count(x) > 1]
    return out + [f"incomplete: {r[name]}" for r in found if r["prediction_status"] == "READY" and (r["p_up_1d"] is None or r["target_date"] is None)]


def raw_input_audit(bars: DataFrame, features: Sequence[str], keys: Sequence[str], now: Column) -> DataFrame:
    """One row of counts that an independent reader makes of the raw input: keys, times, prices, future rows, and names that leak."""
    from tidemark.operators.upkeep import feature_name_audit, valid_bar

    dup = bars.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(c("count") - 1), F.lit(0)).alias("duplicate_keys"))
    one = bars.agg(
        F.count("*").alias("n_rows"), F.count(F.when(F.greatest(*[c(k).isNull() for k in keys]), 1)).alias("null_keys"), F.count(F.when(c("available_at").isNull(), 1)).alias("unknown_times"),
        F.count(F.when(c("available_at") > now, 1)).alias("future_rows"), F.count(F.when(~F.coalesce(valid_bar(), F.lit(False)), 1)).alias("invalid_bars"),
        F.count(F.when(F.to_date("available_at") < c("session_date"), 1)).alias("known_before_session"),
    )
    return one.join(F.broadcast(dup)).withColumn("leaking_names", F.lit(len(feature_name_audit(features))))  # one row each


def governance(checks: Mapping[str, str], required: Sequence[str] = ("pit", "oos", "holdout", "calibration")) -> dict:
    """Record of what stands against promotion: every required check must say PASS; anything else, or nothing, is a blocker."""
    blockers = [f"{k}: {checks.get(k, 'MISSING')}" for k in required if checks.get(k) != "PASS"]
    return {"promotion": "HOLD" if blockers else "ELIGIBLE", "blockers": blockers, "production_changed": False, "research_only": True}


def registry_faults(registry: Sequence[Mapping], needed: Sequence[str] = ("id", "status", "evidence")) -> list[str]:
    """What is wrong with a registry of studies: ids twice, fields missing, production claims without evidence."""
    ids = [r.get("id") for r in registry]
    out = [f"twice: {x}" for x in sorted({i for i in ids if i is not None and ids.count(i) > 1})]
    out += [f"{r.get('id')}: no {k}" for r in registry for k in needed if r.get(k) in (None, "", [])]
    return out + [f"{r.get('id')}: production without evidence" for r in registry if r.get("status") == "production" and not r.get("evidence")]


def state_compatible(state: Mapping, release: Mapping, fields: Sequence[str] = ("schema_version", "feature_columns", "model_fingerprint")) -> list[str]:
    """Fields in which a stored state and a release differ; an empty list means that the state can be used."""
    return [f for f in fields if state.get(f) is None or state.get(f) != release.get(f)]


def perturbed_columns(predict, rows: DataFrame, key: str, cut: Column, columns: Sequence[str], shift: float = 1e6) -> int:
    """Rows up to the cut whose result changes when the columns of later rows are disturbed; 0 for a causal predict.

    predict takes and returns a DataFrame with the key; all doubles of its result are compared.
    """
    moved = rows.withColumns({x: F.when(cut, c(x)).otherwise(c(x) + shift) for x in columns})
    before, after = predict(rows), predict(moved)
    names = [n for n, t in before.dtypes if t == "double" and n not in columns]
    kept = rows.where(cut).select(c(key).alias("__k"))
    a = before.join(kept, c(key) == c("__k"), "left_semi").select(c(key).alias("__a"), *[c(n).alias(f"{n}_a") for n in names])
    both = after.select(c(key).alias("__b"), *[c(n).alias(f"{n}_b") for n in names]).join(a, c("__a") == c("__b"))
    differs = F.greatest(*[~c(f"{n}_a").eqNullSafe(c(f"{n}_b")) for n in names]) if len(names) > 1 else ~c(f"{names[0]}_a").eqNullSafe(c(f"{names[0]}_b"))
    return both.where(differs).count()


def ablation(base: DataFrame, packs: Mapping[str, Sequence[str]], run, metric: str = "logloss") -> dict[str, DataFrame]:
    """For each feature pack the gains per fold of adding it: run(rows, extra features) gives (fold, metric) over the same folds."""
    plain = run(base, ()).select("fold", c(metric).alias("__base"))
    return {name: run(base, tuple(extra)).join(plain, "fold").select("fold", (c("__base") - c(metric)).alias("gain")) for name, extra in packs.items()}
