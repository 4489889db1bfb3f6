"""Table maintenance and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by a total order (give every tie a column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Old and new rows, the new one where both have a key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [c("__new").desc(), *[c(x).desc_nulls_last() for x in tie]]).drop("__new")


def valid_bar() -> Column:
    o, h, low, cl = c("open"), c("high"), c("low"), c("close")
    return (o > 0) & (h > 0) & (low > 0) & (cl > 0) & (h >= F.greatest(o, cl, low)) & (low <= F.least(o, cl, h))


def canonical(bars: DataFrame, keys: Sequence[str], retrieved: str = "retrieved_at", available: str = "available_at") -> DataFrame:
    """Valid bars known when retrieved, one a key, the latest retrieved."""
    fair = bars.where(c(retrieved).isNull() | c(available).isNull() | (c(available) <= c(retrieved))).where(valid_bar())
    return keep_last(fair, keys, [c(retrieved).desc_nulls_last(), c(available).desc_nulls_last(), c("close").desc(), c("volume").desc()])


def canonical_checked(bars: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("open", "high", "low", "close", "volume"), retrieved: str = "retrieved_at", available: str = "available_at") -> DataFrame:
    """canonical(), or an error where rows of one key differ in the columns: conflicting sources are not settled by time."""
    fair = bars.where(c(retrieved).isNull() | c(available).isNull() | (c(available) <= c(retrieved))).where(valid_bar())
    bad = conflicts(fair, keys, columns).select(*keys).first()
    if bad:
        raise ValueError(f"rows of one key differ: {tuple(bad)}")
    return canonical(bars, keys, retrieved, available)


def conflicts(bars: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys whose rows differ in the given columns; a canonical table must have none."""
    return bars.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*columns)).alias("versions")).where("versions > 1")


def prune(bars: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars of instruments that are in the universe."""
    return bars.join(universe.select(*keys).distinct(), list(keys), "left_semi")


def point_in_time(df: DataFrame, at: str, available: str = "available_at") -> DataFrame:
    """Rows that were available at the time in column at; unknown times are not."""
    return df.where(c(available) <= c(at))


def assert_point_in_time(df: DataFrame, at: str, available: str = "available_at") -> None:
    """Raise unless every row was available at the time in column at."""
    if available not in df.columns:
        raise ValueError(f"no column {available}")
    r = df.agg(F.count(F.when(c(available).isNull(), 1)).alias("unknown"), F.count(F.when(c(available) > c(at), 1)).alias("future")).first()
    if r["unknown"] or r["future"]:
        raise ValueError(f"{r['unknown']} rows without and {r['future']} rows with a later time")


def last_sessions(df: DataFrame, n: int, date: str = "session_date") -> DataFrame:
    """Rows of the last n distinct sessions."""
    return df.join(df.select(date).distinct().orderBy(c(date).desc()).limit(n), date, "left_semi")


def ranked_by_date(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """df with the place of each row in the order given, which begins with a date: rows are ranked within a date and dates are counted up."""
    day, rest = order[0], list(order[1:])
    sizes = df.groupBy(c(day).alias("__d")).agg(F.count("*").alias("__k"))
    before = sizes.select("__d", F.coalesce(F.sum("__k").over(Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a date
    inside = F.row_number().over(Window.partitionBy(day).orderBy(*rest))
    return df.withColumn("__in", inside).join(before, c(day).eqNullSafe(c("__d"))).withColumn(name, c("__before") + c("__in")).drop("__in", "__d", "__before")


def cap_training(df: DataFrame, most: int, recent: int, order: Sequence[str], date: str = "session_date") -> DataFrame:
    """At most most rows: the recent sessions whole, and of the older rows every stride-th by order, the latest of them.

    Where the recent sessions alone have more, the latest rows of these. order begins with
    the date and must settle all ties.
    """
    first = df.select(date).distinct().orderBy(c(date).desc()).limit(recent).agg(F.min(date)).first()[0]
    n = df.agg(F.count(F.when(c(date) < first, 1)).alias("old"), F.count("*").alias("all")).first()
    if n["all"] <= most:
        return df
    new, budget = n["all"] - n["old"], max(0, most - (n["all"] - n["old"]))
    old_rows, new_rows = df.where(c(date) < first), df.where((c(date) >= first) | c(date).isNull())
    if not budget:
        return ranked_by_date(new_rows, order, "__rn").where(c("__rn") > new - most).drop("__rn")
    if n["old"] <= budget:
        return df
    stride = max(2, -(-n["old"] // budget))
    taken = -(-n["old"] // stride)
    picked = ranked_by_date(old_rows, order, "__rn").where(((c("__rn") - 1) % stride == 0) & (F.floor((c("__rn") - 1) / stride) >= taken - budget)).drop("__rn")
    return picked.unionByName(new_rows)


def quality_report(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, duplicate keys, invalid bars, missing closes, negative volumes, first and last session."""
    dup = bars.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(c("count") - 1), F.lit(0)).alias("duplicates"))
    one = bars.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(~F.coalesce(valid_bar(), F.lit(False)), 1)).alias("invalid_bars"),
        F.count(F.when(c("close").isNull(), 1)).alias("missing_close"),
        F.count(F.when(c("volume") < 0, 1)).alias("negative_volume"),
        F.min("session_date").alias("first_session"),
        F.max("session_date").alias("last_session"),
    )
    return one.join(F.broadcast(dup))  # one row each


def violations(*named: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, as an array."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in named]), lambda x: x.isNotNull())


def feature_name_audit(columns: Sequence[str], forbidden: Sequence[str] = ("target", "future", "outcome", "label", "raw_price_return")) -> list[str]:
    """Feature names that would leak the outcome."""
    return [x for x in columns if any(f in x.lower() for f in forbidden)]


def provenance_coverage(df: DataFrame, source: str = "source", retrieved: str = "retrieved_at", available: str = "available_at") -> DataFrame:
    """Per source: rows, and the shares with a retrieval time and with an availability time."""
    return df.groupBy(source).agg(
        F.count("*").alias("n"), (F.count(retrieved) / F.count("*")).alias("retrieved_share"), (F.count(available) / F.count("*")).alias("available_share")
    )
