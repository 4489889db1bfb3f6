"""Experience of resolved predictions: additive counters, what they point at, hard cases, candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import ratio
from tidemark.operators.rows import direction_bucket, disagreement_bucket, error_tags, return_error_bucket
from tidemark.operators.scores import log_loss

c = F.col
SUMS = ("n", "correct", "logloss_sum", "brier_sum", "abs_return_error_sum", "squared_return_error_sum")
#: Dimensions of the memory, and the actions that a weak segment of each calls for (fixed values).
ACTIONS = {
    "by_regime": "regime_specific_model_challenge", "by_market_situation": "situation_specific_route_challenge", "by_asset_class": "asset_specific_model_challenge", "by_model_id": "model_replacement_challenge",
    "by_model_disagreement": "disagreement_policy_challenge", "error_types": "error_type_mitigation_challenge", "by_error_bucket": "return_uncertainty_challenge", "by_direction_confidence": "confidence_calibration_challenge",
}


def resolved_errors(rows: DataFrame) -> DataFrame:
    """rows (p, y, expected, y_ret, disagreement) with return_error, hardness and the segments they fall into."""
    error = c("expected") - c("y_ret")
    wrong = ((c("p") >= 0.5) != (c("y") == 1)).cast("double")
    return rows.withColumns({
        "return_error": error, "hardness": F.abs(error) + 0.02 * F.abs(c("p") - c("y")) + 0.02 * wrong,
        "direction_confidence": direction_bucket(c("p")), "model_disagreement": disagreement_bucket(c("disagreement")), "error_bucket": return_error_bucket(error),
        "error_tags": error_tags(c("p"), c("y"), error, c("disagreement")),
    })


def experience_sums(errors: DataFrame, columns: dict[str, str], lists: dict[str, str] | None = None) -> DataFrame:
    """Additive counters (dimension, segment, SUMS) of every dimension in one pass.

    columns maps a dimension to the column that names its segment (a missing value is
    UNKNOWN), lists to a column with an array of segments, of which a row may have several.
    """
    one = [F.array(F.struct(F.lit(d).alias("dimension"), F.coalesce(c(x).cast("string"), F.lit("UNKNOWN")).alias("segment"))) for d, x in columns.items()]
    named = lambda d: lambda v: F.struct(F.lit(d).alias("dimension"), v.alias("segment"))
    one += [F.transform(c(x), named(d)) for d, x in (lists or {}).items()]
    # rows that fall into the same segments are added up before they are dealt to the dimensions
    named_by = list(dict.fromkeys([*columns.values(), *(lists or {}).values()]))
    sums = {
        "n": F.count("*"), "correct": F.sum(((c("p") >= 0.5) == (c("y") == 1)).cast("long")), "logloss_sum": F.sum(log_loss(c("y"), c("p"))), "brier_sum": F.sum((c("p") - c("y")) ** 2),
        "abs_return_error_sum": F.sum(F.abs("return_error")), "squared_return_error_sum": F.sum(c("return_error") ** 2),
    }
    each = errors.groupBy(*named_by).agg(*[v.alias(f"__{k}") for k, v in sums.items()])
    rows = each.select(F.explode(F.concat(*one)).alias("z"), *[f"__{k}" for k in sums])
    return rows.groupBy("z.dimension", "z.segment").agg(*[F.sum(f"__{k}").alias(k) for k in sums])


def merge_experience(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of both tables added up."""
    keys = [x for x in old.columns if x not in SUMS]
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in SUMS if x in old.columns])


def finalized(sums: DataFrame) -> DataFrame:
    """Counters with the ratios they stand for."""
    n = F.greatest(c("n"), F.lit(1)).cast("double")
    return sums.withColumns({
        "accuracy": c("correct") / n, "logloss": c("logloss_sum") / n, "brier": c("brier_sum") / n, "return_mae": c("abs_return_error_sum") / n, "return_rmse": F.sqrt(F.greatest(c("squared_return_error_sum"), F.lit(0.0)) / n),
    })


def rolling_experience(daily: DataFrame, sessions: Sequence[int] = (5, 20, 60), session: str = "segment") -> DataFrame:
    """Finalised sums of the last so many sessions, one row each; daily has one row a session."""
    ranked = daily.withColumn("__r", F.row_number().over(Window.orderBy(c(session).desc())))  # a row a session
    each = ranked.withColumn("sessions", F.explode(F.array(*map(F.lit, sessions)))).where(c("__r") <= c("sessions"))
    return finalized(each.groupBy("sessions").agg(*[F.sum(x).alias(x) for x in SUMS]))


def priorities(sums: DataFrame, reference: str = "by_regime", least: int = 30, most: int = 30) -> DataFrame:
    """The most segments whose losses lie above the overall one, by (loss above it times rows, rows).

    The overall loss is that of the reference dimension, which holds every row once. Ties go
    to the dimension and segment first in order.
    """
    whole = sums.where(c("dimension") == reference).agg(ratio(F.sum("logloss_sum"), F.sum("n").cast("double")).alias("__all"))
    rows = finalized(sums.where(c("n") >= least)).join(F.broadcast(whole))  # one row
    out = rows.withColumn("impact", (c("logloss") - F.coalesce("__all", F.lit(0.0))) * c("n")).select("dimension", "segment", "n", "logloss", "accuracy", "return_mae", "impact")
    return out.orderBy(c("impact").desc(), c("n").desc(), "dimension", "segment").limit(most)


def candidates(ranked: DataFrame, least: int = 30, most: int = 20) -> DataFrame:
    """Research candidates of the segments that do worse than the whole: id, action, and what they must pass first."""
    action = F.lit("generic_failure_structure_research")
    for dimension, name in ACTIONS.items():
        action = F.when(c("dimension") == dimension, name).otherwise(action)
    rows = ranked.where((c("n") >= least) & (c("impact") > 0)).withColumn("action", action)
    ident = F.concat(F.lit("exp-"), F.substring(F.sha2(F.concat_ws("|", "dimension", "segment"), 256), 1, 12))
    return rows.withColumns({"candidate_id": ident, "required_evaluation": F.lit("chronological_oos"), "promotion_status": F.lit("HOLD_UNTIL_OOS")}).orderBy(c("impact").desc(), c("n").desc(), "dimension", "segment").limit(most)


def evaluated_candidates(plan: DataFrame, scoped: DataFrame, served: str, least: int = 3, rows: int = 10, gain: float = 0.0, penalty: float = 0.25) -> DataFrame:
    """Each candidate with what folds on its own slice say: its best model against the one that serves.

    scoped (dimension, segment, model, folds, n_test_min, logloss, logloss_std, signature).
    Only models measured on the same folds as the serving one are compared; without enough
    evidence, or without the serving model in it, the status says so.
    """
    score = c("logloss") + penalty * F.coalesce("logloss_std", F.lit(0.0))
    fit = scoped.where((c("folds") >= least) & (c("n_test_min") >= rows) & c("logloss").isNotNull() & c("signature").isNotNull()).withColumn("score", score)
    mine = fit.where(c("model") == served).select(c("dimension").alias("__d"), c("segment").alias("__s"), c("signature").alias("__sig"), c("score").alias("parent_score"))
    same = fit.join(mine, (c("dimension") == c("__d")) & (c("segment") == c("__s")) & (c("signature") == c("__sig")))
    best = same.groupBy(c("dimension").alias("b_d"), c("segment").alias("b_s")).agg(F.min_by("model", F.struct("score", "model")).alias("best_model"), F.min("score").alias("best_score"), F.first("parent_score").alias("parent_score"))
    any_ = fit.select(c("dimension").alias("a_d"), c("segment").alias("a_s"), F.lit(True).alias("__any")).distinct()
    scopes = scoped.select(c("dimension").alias("k_d"), c("segment").alias("k_s"), F.lit(True).alias("__known")).distinct()
    on = lambda p: (c("dimension") == c(f"{p}_d")) & (c("segment") == c(f"{p}_s"))
    out = plan.join(best, on("b"), "left").join(any_, on("a"), "left").join(scopes, on("k"), "left")
    status = F.when(c("__known").isNull(), "NO_DIRECT_OOS_SCOPE").when(c("__any").isNull(), "INSUFFICIENT_OOS_EVIDENCE").when(c("best_model").isNull(), "NO_COMPARABLE_PARENT").otherwise("EVALUATED")
    relative = (c("parent_score") - c("best_score")) / F.greatest(F.abs("parent_score"), F.lit(1e-9))
    passes = F.coalesce((c("best_model") != served) & (relative >= gain), F.lit(False))
    return out.select(*plan.columns, status.alias("status"), "best_model", "best_score", "parent_score", relative.alias("relative_gain"), passes.alias("passes_screen"))


def hard_cases(errors: DataFrame, ties: Sequence[str], time: str = "prediction_time", most: int = 1000, recent: int = 500) -> DataFrame:
    """The most hardest cases, and which of them are the recent latest; both lists are of fixed length."""
    top = errors.orderBy(c("hardness").desc_nulls_last(), *ties).limit(most)
    place = F.row_number().over(Window.orderBy(c(time).desc_nulls_last(), c("hardness").desc(), *ties))  # at most `most` rows
    return top.withColumn("is_recent", place <= recent)


def new_files(files: DataFrame, processed: DataFrame) -> DataFrame:
    """files (name, digest, complete) with what to do: process, defer, skip, or skip as changed after it was processed."""
    known = processed.select(c("name").alias("__n"), c("digest").alias("__d"))
    what = F.when(c("__n").isNotNull() & (c("digest") != c("__d")), "skip_changed").when(c("__n").isNotNull(), "skip").when(~F.coalesce("complete", F.lit(False)), "defer").otherwise("process")
    return files.join(known, c("name") == c("__n"), "left").withColumn("decision", what).drop("__n", "__d")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of each column, missing values included."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in columns]))
    return df.select(each.alias("z")).groupBy("z.column", "z.value").agg(F.count("*").alias("n"))


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a key of right may occur once only; a second row of it is an error when the join runs."""
    taken = [x for x in right.columns if x not in keys]
    one = right.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(x).alias(x) for x in taken])
    sure = F.when(c("__n") > 1, F.raise_error(F.concat_ws(" ", F.lit("key occurs twice:"), *[c(k).cast("string") for k in keys]))).otherwise(c("__n"))
    return left.join(one.withColumn("__n", sure).where("__n = 1").drop("__n"), list(keys), how)


#: Weights of what speaks for a data source (fixed values).
SOURCE_WEIGHTS = {"official": 0.65, "reachable": 0.15, "secure": 0.05, "tabular": 0.05, "recent": 0.05, "point_in_time": 0.05}


def source_score(signs: dict[str, Column], blocked: Column) -> Column:
    """Worth of a data source from 0 to 1 by the signs it has; one that is blocked has none."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    total = sum((F.when(yes(signs[k]), w).otherwise(0.0) for k, w in SOURCE_WEIGHTS.items() if k in signs), F.lit(0.0))
    return F.round(F.greatest(F.least(total - F.when(yes(blocked), 1.0).otherwise(0.0), F.lit(1.0)), F.lit(0.0)), 6)
