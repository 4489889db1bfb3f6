"""Point-in-time joins: as-of by union and forward fill, and event counts in trailing intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, take: Sequence[str], tie: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Each left row with the latest right row whose time is not after its own (inclusive).

    Both sides are merged and filled forward in one window per key: linear, with no pairs.
    Without keys only the distinct left times enter the window, and the result goes back by
    an equality join, so the single window holds times, not rows. Ties on the right end with
    the largest tie columns; a null time finds nothing.
    """
    by = list(by)
    times = left.select(*by, on).where(F.col(on).isNotNull()).distinct()
    value = F.struct(*[F.col(x) for x in take])
    blank = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    order = [F.col(x) for x in tie]
    r = right.where(F.col(on).isNotNull()).select(*by, on, F.lit(0).alias("__side"), F.struct(F.lit(0).alias("t"), *order).alias("__tie"), value.alias("__v"))
    none = F.lit(None).cast(r.schema["__tie"].dataType)
    x = times.select(*by, on, F.lit(1).alias("__side"), none.alias("__tie"), blank.alias("__v"))
    w = Window.partitionBy(*by).orderBy(on, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = r.union(x).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    names = [*by, on]
    found = filled.select(*[F.col(n).alias(f"__r_{n}") for n in names], *[F.col(f"__v.{t}").alias(f"{prefix}{t}") for t in take])
    same = [F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in by] + [F.col(on) == F.col(f"__r_{on}")]
    return left.join(found, same, "left").drop(*[f"__r_{n}" for n in names])


def asof_each(left: DataFrame, right: DataFrame, each: str, on: str, take: Sequence[str], tie: Sequence[str] = (), name: str = "found") -> DataFrame:
    """asof() without keys once for every value of each: column name maps the value to a struct of take.

    Only the distinct left times meet the values, so left rows are not multiplied. A value
    that is not known yet maps to nulls; a null time has no map.
    """
    right = right.where(F.col(each).isNotNull())
    values = sorted(r[0] for r in right.select(each).distinct().collect())  # a few series
    listed = F.array(*map(F.lit, values)) if values else F.array().cast(f"array<{right.schema[each].dataType.simpleString()}>")
    times = left.select(on).where(F.col(on).isNotNull()).distinct().withColumn(each, F.explode(listed))
    entry = F.struct(each, F.struct(*take).alias("__v"))
    found = asof(times, right, [each], on, take, tie).groupBy(F.col(on).alias("__on")).agg(F.map_from_entries(F.collect_list(entry)).alias(name))
    return left.join(found, F.col(on) == F.col("__on"), "left").drop("__on")


#: Context column of a bar -> (macro family, its column) (fixed values).
CONTEXT = {f"{x}_ret_1d_lag1": (x, "ret_1d") for x in ("nikkei", "topix", "sp500", "nasdaq", "usd_jpy", "dxy", "gold", "oil", "hyg")} | {
    "vix_level_lag1": ("vix", "close"), "us10y_level_lag1": ("us10y", "close"),
    "jp_market_volatility_lag1": ("nikkei", "volatility_20"), "us_market_volatility_lag1": ("sp500", "volatility_20"),
}


def macro_context(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """The context columns of every bar, each from its family's latest row; null where the family is absent or not known yet."""
    out = asof_each(bars, macro, "family", "available_at", ["ret_1d", "volatility_20", "close"], ["session_date"], "__macro")
    return out.withColumns({k: F.col("__macro")[family][x] for k, (family, x) in CONTEXT.items()}).drop("__macro")


def trailing_counts(
    queries: DataFrame, events: DataFrame, key: str, on: str, counts: Mapping[str, tuple[str, Column | None]], last: str | None = None, age: str | None = None
) -> DataFrame:
    """Events in [t - interval, t], both ends inclusive, for each query row.

    counts maps a name to (interval, condition on events or None); an interval is text such
    as "30 days", or "210 days to 30 days" for one that ends before t. Both sides share one
    range window per key, so an event is read once whatever the number of intervals. last
    names a column for the whole days since the latest event, age one for the exact days.
    """
    flags = {n: (F.when(cond, 1).otherwise(0) if cond is not None else F.lit(1)) for n, (_, cond) in counts.items()}
    e = events.where(F.col(on).isNotNull()).select(key, on, F.lit(0).alias("__q"), *[f.alias(f"__f_{n}") for n, f in flags.items()])
    q = queries.select(key, on).distinct().select(key, on, F.lit(1).alias("__q"), *[F.lit(0).alias(f"__f_{n}") for n in flags])
    line = Window.partitionBy(key).orderBy(F.unix_micros(F.col(on).cast("timestamp")))
    merged = e.union(q)
    latest = F.max(F.when(F.col("__q") == 0, F.unix_micros(F.col(on).cast("timestamp")))).over(line.rangeBetween(Window.unboundedPreceding, 0))
    spans = {n: _span(text) for n, (text, _) in counts.items()}
    out = merged.select(
        key, on, "__q", *[F.coalesce(F.sum(f"__f_{n}").over(line.rangeBetween(-a, -b)), F.lit(0)).alias(n) for n, (a, b) in spans.items()], latest.alias("__last")
    ).where("__q = 1")
    days = (F.unix_micros(F.col(on).cast("timestamp")) - F.col("__last")) / 86_400_000_000
    if last:
        out = out.withColumn(last, F.floor(days).cast("int"))
    if age:
        out = out.withColumn(age, days)
    renamed = out.drop("__q", "__last").withColumnsRenamed({key: "__k", on: "__t"})
    return queries.join(renamed, (F.col(key) == F.col("__k")) & (F.col(on) == F.col("__t")), "left").drop("__k", "__t")


def _span(text: str) -> tuple[int, int]:
    first, _, second = text.partition(" to ")
    return _micros(first), _micros(second) if second else 0


def _micros(span: str) -> int:
    n, unit = span.split()
    return int(n) * {"hour": 3_600, "day": 86_400}[unit.rstrip("s")] * 1_000_000
