"""Column functions shared by the panel operators. Missing values are NULL throughout."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a, b)


def clean(x: Column) -> Column:
    """NaN and infinities become NULL."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def clip(x: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """x held within bounds; null stays null, unlike with greatest and least."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    y = x if low is None else F.greatest(x, lit(low))
    y = y if high is None else F.least(y, lit(high))
    return F.when(x.isNotNull(), y)


def trailing(keys: Sequence[str], order: str | Sequence[str], n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    by = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*by).rowsBetween(-(n - 1), 0)


def full(x: Column, value: Column, w: WindowSpec, n: int) -> Column:
    """value (an aggregate over w) where the frame holds n non-null x, else null."""
    return F.when(F.count(x).over(w) == n, value)


def rolling(fn, x: Column, w: WindowSpec, n: int) -> Column:
    return full(x, fn(x).over(w), w, n)


def rolling_z(x: Column, w: WindowSpec, n: int) -> Column:
    return ratio(x - rolling(F.avg, x, w, n), rolling(F.stddev_samp, x, w, n))


def rolling_median(x: Column, w: WindowSpec, n: int) -> Column:
    return full(x, F.percentile(x, F.lit(0.5)).over(w), w, n)


def rolling_skew(x: Column, w: WindowSpec, n: int) -> Column:
    """Bias-corrected skewness; Spark's is that of the population."""
    return full(x, F.skewness(x).over(w), w, n) * F.lit(math.sqrt(n * (n - 1)) / (n - 2))


def rolling_kurtosis(x: Column, w: WindowSpec, n: int) -> Column:
    """Bias-corrected excess kurtosis."""
    g2 = full(x, F.kurtosis(x).over(w), w, n)
    return F.lit((n - 1) / ((n - 2) * (n - 3))) * (F.lit(n + 1) * g2 + F.lit(6.0))


def correlation(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation of the pairs without nulls; null where either side does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    over = (lambda e: e.over(w)) if w is not None else (lambda e: e)
    return ratio(over(F.covar_pop(a, b)), over(F.stddev_pop(a)) * over(F.stddev_pop(b)))


def _ranked(x: Column, keys: Sequence[str], descending: bool) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last())


def average_rank(x: Column, keys: Sequence[str], descending: bool = False) -> Column:
    """Rank with ties averaged; nulls get none. Ties are peers in the order of the ranks, so one sort serves both."""
    ranked = _ranked(x, keys, descending)
    ties = F.count(x).over(ranked.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(ranked) + (ties - 1) / 2.0)


def percent_rank(x: Column, keys: Sequence[str], descending: bool = False) -> Column:
    """Average rank over the number of non-null values."""
    every = _ranked(x, keys, descending).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return average_rank(x, keys, descending) / F.count(x).over(every)


def entropy(probabilities: Column) -> Column:
    """Entropy (natural logarithm) of an array of probabilities."""
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def normalized_entropy(probabilities: Column) -> Column:
    n = F.size(probabilities)
    return F.when(n > 1, entropy(probabilities) / F.log(n.cast("double"))).otherwise(F.lit(0.0))


def logit(p: Column, limit: float = 50.0) -> Column:
    return clip(F.log(p / (1 - p)), -limit, limit)


def sigmoid(z: Column, limit: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-clip(z, -limit, limit)))


def inverse_erf(x: Column) -> Column:
    """Winitzki's approximation with a = 0.147."""
    a = 0.147
    log = F.log(1 - x * x)
    first = F.lit(2 / (math.pi * a)) + log / 2
    return F.signum(x) * F.sqrt(F.sqrt(first * first - log / a) - first)


def array_median(x: Column) -> Column:
    s, n = F.array_sort(x), F.size(x)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.element_at(s, low + 1) + F.element_at(s, high + 1)) / 2)


def next_weekday(d: Column) -> Column:
    days = F.when(F.dayofweek(d) == 6, 3).when(F.dayofweek(d) == 7, 2).otherwise(1)
    return F.date_add(d, days)


def local_time(d: Column, clock: str, zone: str) -> Column:
    """UTC timestamp of a local wall-clock time on a date; daylight saving is the zone's."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(d.cast("string"), F.lit(f" {clock}"))), zone)


def market_family(asset_class: Column) -> Column:
    return F.when(asset_class.startswith("jp_"), "jp").when(asset_class.startswith("us_"), "us").otherwise("other")


def name_key(x: Column) -> Column:
    """Company name reduced to upper-case letters and digits."""
    return F.regexp_replace(F.upper(x), r"[^\p{L}\p{N}]", "")


def regime_label(vol: Column, gap_sma60: Column, threshold: Column, gap: Column, vol_ratio: Column, vix: Column, breadth: Column) -> Column:
    """First rule that holds: missing inputs, event, high volatility, trend, normal."""
    missing = vol.isNull() | gap_sma60.isNull()
    event = F.coalesce(F.abs(gap) >= 0.03, F.lit(False)) | F.coalesce(vol_ratio >= 3.0, F.lit(False))
    high = (vol >= threshold) | F.coalesce(vix >= 30.0, F.lit(False))
    trend = (F.abs(gap_sma60) >= 0.02) | F.coalesce((breadth <= 0.25) | (breadth >= 0.75), F.lit(False))
    return F.when(missing, "data_stressed").when(event, "event").when(high, "high_vol").when(trend, "trend").otherwise("normal")


def anonymous_id(*parts: Column, digits: int = 24) -> Column:
    """First hex digits of the sha256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)
