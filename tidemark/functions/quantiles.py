"""Exact quantiles of large columns without a task that holds a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import drop, table

c = F.col
#: Inverse of the rank error of the sketch that brackets a quantile.
ACCURACY = 2_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], name: str = "q") -> DataFrame:
    """(keys, name: array, n): exact quantiles of the non-null values of each key, interpolated linearly between neighbours.

    A sketch with bounded rank error brackets each quantile; only the different values inside
    a bracket, a few thousandths of a key's, are then sorted. Without keys the result is one row.
    The values are written once and read by every step: sums of doubles come out otherwise by
    a last bit whenever they are formed anew, and ranks counted over other bits name other values.
    """
    keys = list(keys)
    rows = df.where(c(value).isNotNull()).select(*keys, c(value).cast("double").alias("__v")).where(~F.isnan("__v"))
    rows = table(rows, "quantile-values")
    slack = 2.0 / ACCURACY
    asked = [x for q in levels for x in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", asked, ACCURACY).alias("__s"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    few = c("__n") * F.lit(slack) < 2  # a bracket must reach over the neighbours between which the quantile lies
    one = lambda k, q: F.struct(
        F.lit(k).alias("level"), F.lit(float(q)).alias("q"),
        F.when(F.lit(q <= slack) | few, c("__min")).otherwise(c("__s")[2 * k]).alias("low"), F.when(F.lit(q >= 1 - slack) | few, c("__max")).otherwise(c("__s")[2 * k + 1]).alias("high"),
    )
    brackets = sketch.select(*[c(k).alias(f"__k_{k}") for k in keys], "__n", F.explode(F.array(*[one(k, q) for k, q in enumerate(levels)])).alias("__b")).select(*[f"__k_{k}" for k in keys], "__n", "__b.*")
    brackets = table(brackets, "quantile-brackets")  # a sketch merged in another order may have other bounds
    on = [c(k).eqNullSafe(c(f"__k_{k}")) for k in keys]
    # a few brackets a key; what lies under a bracket is counted as one null, so only values inside are dealt
    inside = rows.join(F.broadcast(brackets), c("__v") <= c("high")) if not keys else rows.join(brackets, [*on, c("__v") <= c("high")])
    group = [*keys, "level"]
    near = inside.groupBy(*group, "q", "__n", F.when(c("__v") >= c("low"), c("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    line = Window.partitionBy(*group).orderBy(c("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__end", F.sum("__c").over(line)).where(c("__v").isNotNull())
    at = (c("__n") - 1) * c("q")
    start, stop = c("__end") - c("__c"), c("__end")
    holds = lambda r: (start <= r) & (r < stop)
    low_rank, high_rank = F.floor(at), F.least(F.floor(at) + 1, c("__n") - 1)
    found = near.groupBy(*group).agg(
        F.max("__n").alias("__n"), F.max(F.when(holds(low_rank), c("__v"))).alias("__a"), F.max(F.when(holds(high_rank), c("__v"))).alias("__b"), F.max(at - F.floor(at)).alias("__f")
    )
    value_at = c("__a") + (c("__b") - c("__a")) * c("__f")
    out = table(found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", value_at.alias("x")))), lambda z: z["x"]).alias(name), F.max("__n").alias("n")), "quantiles")
    drop(rows, brackets)
    return out
