"""Row contracts, lineage, gates and monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scores import binary_metrics
from tidemark.operators.upkeep import violations

c = F.col
#: A time must name its zone (fixed pattern).
ZONED = r"(Z|[+-]\d\d:?\d\d)$"


def zoned_time(text: Column) -> Column:
    """Timestamp of ISO text that names its zone; anything else is null."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def row_contract(cases: DataFrame) -> DataFrame:
    """Each case with the violations of its point-in-time contract and a PASS or FAIL status."""
    made, cut, known = zoned_time(c("prediction_time")), zoned_time(c("prediction_cutoff")), zoned_time(c("available_at"))
    found = violations(
        ("prediction_time_invalid", made.isNull()), ("prediction_cutoff_invalid", cut.isNull()), ("available_at_invalid", known.isNull()),
        ("available_after_cutoff", F.coalesce(known > cut, F.lit(False))), ("cutoff_after_prediction", F.coalesce(cut > made, F.lit(False))),
    )
    return cases.withColumn("violations", found).withColumn("pit_status", F.when(F.size("violations") == 0, "PASS").otherwise("FAIL"))


def duplicate_cases(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cases.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def lineage(rows: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, Column]]) -> DataFrame:
    """Status by the first condition that holds (PASS if none) and a digest of the keys and times."""
    status = None
    for name, cond in order:
        status = F.when(cond, name) if status is None else status.when(cond, name)
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(c(k).cast("string"), F.lit("")) for k in keys]), 256)
    return rows.withColumns({"lineage_status": status.otherwise("PASS") if status is not None else F.lit("PASS"), "lineage_sha256": digest})


def staleness(table: DataFrame, keys: Sequence[str], now: Column, days: int = 10, date: str = "session_date") -> DataFrame:
    """Keys whose last session lies more than days before now."""
    return table.groupBy(*keys).agg(F.max(date).alias("last_session")).where(F.date_diff(F.to_date(now), c("last_session")) > days)


def missing_keys(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), list(keys), "left_anti")


def gate(counts: dict[str, int], limits: dict[str, int]) -> dict:
    """PASS, or BLOCKED with the reasons; a count that is unknown blocks."""
    reasons = [f"{k}: {counts.get(k)} > {v}" for k, v in limits.items() if counts.get(k) is None or counts[k] > v]
    return {"status": "BLOCKED" if reasons else "PASS", "reasons": reasons}


def quality_verdict(bars: DataFrame, expected: DataFrame, deferred: DataFrame, keys: Sequence[str], now: Column, days: int = 10, most_deferred: float = 0.05, critical: Sequence[str] = ()) -> dict:
    """PASS or FAIL of the price table with the reasons.

    expected and deferred name instruments (keys): those that should have prices, and those
    that the provider could not give this time. Missing or stale instruments that are not
    deferred, deferred ones that nobody expects or too large a share of them, invalid rows,
    and a deferred instrument whose symbol begins with a critical prefix fail the table.
    """
    from tidemark.operators.upkeep import quality_report

    report = quality_report(bars, [*keys, "session_date"]).first()
    one = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    put_off = deferred.select(*keys).distinct().withColumn("__d", F.lit(True))
    seen = bars.where(c("available_at") <= now).groupBy(*keys).agg(F.max("session_date").alias("__last"))
    both = one.join(put_off, list(keys), "full").join(seen, list(keys), "left")
    late, gone = F.date_diff(F.to_date(now), c("__last")) > days, c("__e").isNotNull() & c("__last").isNull()
    known, unknown = c("__d").isNotNull() & c("__e").isNotNull(), c("__d").isNotNull() & c("__e").isNull()
    prefix = F.lit(False)
    for x in critical:
        prefix = prefix | c("symbol").startswith(x)
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("int"))
    r = both.agg(n(c("__e").isNotNull()).alias("expected"), n(known).alias("deferred"), n(unknown).alias("unknown"), n(gone & c("__d").isNull()).alias("missing"), n(c("__e").isNotNull() & late & c("__d").isNull()).alias("stale"), n(known & prefix).alias("critical")).first()
    counts = {x: report[x] for x in ("duplicates", "invalid_bars", "missing_close", "negative_volume")} | {x: r[x] or 0 for x in ("unknown", "missing", "stale", "critical")}
    reasons = [f"{k}:{v}" for k, v in counts.items() if v]
    share = (r["deferred"] or 0) / r["expected"] if r["expected"] else 0.0
    reasons += [f"deferred_share:{share:.6f}"] if share > most_deferred else []
    reasons += ["no_rows"] if not report["n_rows"] else []
    return {"status": "FAIL" if reasons else "PASS", "rows": report["n_rows"], "reasons": reasons}


def monitor(resolved: DataFrame, segments: Sequence[Sequence[str]], recent: int = 20, least: int = 30, date: str = "session_date") -> dict[str, DataFrame]:
    """Metrics over all resolved predictions, over the recent sessions, and by segment."""
    last = resolved.select(date).distinct().orderBy(c(date).desc()).limit(recent)
    out = {"overall": binary_metrics(resolved, []), "recent": binary_metrics(resolved.join(last, date, "left_semi"), [])}
    for s in segments:
        out["_".join(s)] = binary_metrics(resolved, list(s)).where(c("n") >= least)
    return out


def resolve(predictions: DataFrame, bars: DataFrame, keys: Sequence[str] = ("asset_class", "symbol")) -> DataFrame:
    """Predictions joined with the next bar's outcome, known after the prediction was made."""
    line = Window.partitionBy(*keys).orderBy("session_date")
    out = bars.select(*keys, "session_date", (F.lead("close").over(line) / c("close") - 1).alias("y_ret"), F.lead("available_at").over(line).alias("outcome_available_at"))
    rows = predictions.join(out, [*keys, "session_date"]).where(c("y_ret").isNotNull() & (c("outcome_available_at") > c("prediction_time")))
    return rows.withColumn("y", (c("y_ret") > 0).cast("int"))


def snapshot_history(history: DataFrame, snapshot: DataFrame, date: str = "snapshot_date") -> DataFrame:
    """History with the snapshot added unless its day is there already."""
    return history.unionByName(snapshot.join(history.select(date).distinct(), date, "left_anti").select(*history.columns))


def listed_and_delisted(history: DataFrame, keys: Sequence[str], date: str = "snapshot_date") -> DataFrame:
    """(date, keys, change): instruments that appear or vanish between consecutive snapshots."""
    days = history.select(date).distinct()
    step = days.select(date, F.lag(date).over(Window.orderBy(date)).alias("__before")).where("__before is not null")
    now = history.select(date, *keys).join(step, date)
    then = history.select(c(date).alias("__before"), *keys).join(step, "__before")
    both = lambda a, b, tag: a.select(date, *keys).join(b.select(date, *keys), [date, *keys], "left_anti").withColumn("change", F.lit(tag))
    return both(now, then, "listed").unionByName(both(then, now, "delisted"))
