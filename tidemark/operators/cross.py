"""Cross-sections by date: ranks, robust scores, daily market state, regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import average_rank, clip, full, market_family, percent_rank, ratio, rolling, rolling_median, trailing

c = F.col


def robust_z(df: DataFrame, columns: Sequence[str], keys: Sequence[str], limit: float = 5.0, least: int = 10) -> DataFrame:
    """(x - median) / (1.4826 MAD) within keys, clipped; null in groups under least values, 0 for every row where the scale vanishes."""
    w = Window.partitionBy(*keys)
    df = df.withColumns({f"__m_{x}": F.percentile(c(x), F.lit(0.5)).over(w) for x in columns})
    df = df.withColumns({f"__s_{x}": 1.4826 * F.percentile(F.abs(c(x) - c(f"__m_{x}")), F.lit(0.5)).over(w) for x in columns})
    out = {}
    for x in columns:
        n, scale = F.count(c(x)).over(w), c(f"__s_{x}")
        z = clip(ratio(c(x) - c(f"__m_{x}"), scale), -limit, limit)
        out[f"cs_{x}_robust_z"] = F.when(n < least, None).when(scale <= 1e-12, F.lit(0.0)).otherwise(z)
    return df.withColumns(out).drop(*[f"__{k}_{x}" for k in "ms" for x in columns])


def daily_market(df: DataFrame, date: str = "session_date") -> DataFrame:
    """One row a date and market family: medians, breadth over all rows, dispersion, interquartile range, their trailing medians and compounded returns."""
    day = df.groupBy(date, "market_family").agg(
        F.percentile("volatility_20", F.lit(0.5)).alias("median_vol"),
        F.percentile("ret_1d", F.lit(0.5)).alias("median_ret"),
        (F.sum(F.when(c("ret_1d") > 0, 1).otherwise(0)) / F.count("*")).alias("breadth_up"),
        (F.percentile("ret_1d", F.lit(0.9)) - F.percentile("ret_1d", F.lit(0.1))).alias("market_dispersion_1d"),
        (F.percentile("ret_1d", F.lit(0.75)) - F.percentile("ret_1d", F.lit(0.25))).alias("market_ret_iqr_1d"),
    )
    w = lambda n: trailing(["market_family"], date, n)
    day = day.withColumns({f"market_dispersion_{n}d": rolling_median(c("market_dispersion_1d"), w(n), n) for n in (5, 20)})
    grown = lambda n: full(c("median_ret"), F.product(1 + c("median_ret")).over(w(n)), w(n), n) - 1
    day = day.withColumns({"market_median_ret_5d": grown(5), "market_median_ret_20d": grown(20), "market_median_vol_20d": rolling_median(c("median_vol"), w(20), 20)})
    return day.withColumn("market_dispersion_vs_20d", ratio(c("market_dispersion_1d"), c("market_dispersion_20d")) - 1)


#: Columns whose robust scores are features, where the input has them (fixed values).
ROBUST = ("ret_1d", "volatility_20", "volume_ratio_20", "range_pct", "price_vs_sma20")


def cross_context(features: DataFrame, date: str = "session_date") -> DataFrame:
    """Ranks and robust scores within (date, market family), each row against its market's day, and asset flags.

    With a column sector, the sector's mean return, the row's strength against it and its
    rank in it; with market_ret_1d, the return against that.
    """
    kind = c("asset_class")
    df = features.withColumn("market_family", market_family(kind))
    flags = {"jp": kind.startswith("jp_"), "us": kind.startswith("us_"), "stock": kind.endswith("_stock"), "etf": kind.endswith("_etf"), "reit": kind == "jp_reit"}
    df = df.withColumns({f"asset_is_{k}": v.cast("double") for k, v in flags.items()})
    keys = [date, "market_family"]
    df = df.withColumns({"cs_ret_1d_rank": percent_rank(c("ret_1d"), keys), "cs_vol_rank": percent_rank(c("volatility_20"), keys, descending=True)})
    df = robust_z(df, [x for x in ROBUST if x in df.columns], keys)
    df = df.join(daily_market(df, date), keys, "left")
    df = df.withColumns({
        "ret_vs_market_median": c("ret_1d") - c("median_ret"), "vol_vs_market_median": ratio(c("volatility_20"), c("median_vol")) - 1,
        "residual_volatility_20d": ratio(c("volatility_20"), c("market_median_vol_20d")) - 1,
        "residual_momentum_20d": c("ret_20d") - c("market_median_ret_20d") if "ret_20d" in df.columns else F.lit(None).cast("double"),
    })
    if "sector" in df.columns:
        group = [*keys, "sector"]
        mean = F.avg("ret_1d").over(Window.partitionBy(*group))
        df = df.withColumns({"sector_ret_1d": mean, "relative_strength_1d": c("ret_1d") - mean, "sector_rank": percent_rank(c("ret_1d"), group)})
    if "market_ret_1d" in df.columns:
        df = df.withColumn("market_relative_ret_1d", c("ret_1d") - c("market_ret_1d"))
    return df


def market_regime(daily: DataFrame, date: str = "session_date") -> DataFrame:
    """Regime of each day of each market.

    high_vol at or above the trailing 75th percentile of volatility (60 sessions, 20 at
    least), else trend where the 20-session mean return is 0.005 or more either way, else
    normal; a breadth from 0.25 to 0.75 is balanced whatever else holds.
    """
    w = trailing(["market_family"], date, 60)
    high = F.when(F.count("median_vol").over(w) >= 20, F.percentile("median_vol", F.lit(0.75)).over(w))
    drift = F.abs(rolling(F.avg, c("median_ret"), trailing(["market_family"], date, 20), 20))
    label = F.when(c("breadth_up").between(0.25, 0.75), "balanced").when(c("median_vol") >= high, "high_vol").when(drift >= 0.005, "trend").otherwise("normal")
    return daily.withColumn("vol_threshold", high).withColumn("market_regime", label)


def cross_sectional_rank(
    df: DataFrame,
    keys: Sequence[str],
    probability: str = "p_up_1d",
    expected: str = "expected_return_1d",
    weight: float = 0.5,
    uncertainty: str | None = None,
    penalty: float = 0.0,
    orientation: str = "compat",
) -> DataFrame:
    """rank_score and rank within keys from average ranks of probability and return.

    The compatible orientation ranks descending percentages and then the score descending,
    so the largest inputs get the largest rank numbers; "best_first" turns both around.
    """
    down = orientation == "compat"
    score = weight * percent_rank(c(probability), keys, down) + (1 - weight) * percent_rank(c(expected), keys, down)
    if uncertainty:
        score = score - penalty * percent_rank(c(uncertainty), keys)
    df = df.withColumn("rank_score", score)
    return df.withColumn("rank", average_rank(c("rank_score"), keys, descending=True))


def backtest(
    predictions: DataFrame,
    bars: DataFrame,
    keys: Sequence[str] = ("asset_class", "symbol"),
    sleeve: Sequence[str] = ("asset_class",),
    top: float = 0.1,
    costs: Sequence[float] = (0, 5, 10, 20),
    least: int = 20,
) -> DataFrame:
    """Daily long/short decile returns: (prediction_date, cost_bps, n, gross, net, equity, drawdown).

    An outcome is the return to the next bar, unknown around splits; it counts only if that
    bar became available after the prediction was made. A date and sleeve is traded with
    least rows; sleeves of a date are averaged before compounding.
    """
    line = Window.partitionBy(*keys).orderBy("session_date")
    split = (F.coalesce(c("stock_splits"), F.lit(0.0)) != 0) | (F.coalesce(F.lead("stock_splits").over(line), F.lit(0.0)) != 0)
    forward = F.when(~split, ratio(F.lead("close").over(line), c("close")) - 1)
    out = bars.select(*keys, "session_date", forward.alias("outcome"), F.lead("available_at").over(line).alias("outcome_at"))
    joined = predictions.join(out, [*keys, "session_date"]).where(c("outcome").isNotNull() & c("expected_return_1d").isNotNull() & (c("outcome_at") > c("prediction_time")))
    group = ["prediction_date", *sleeve]
    ranked = joined.withColumns({"n": F.count("*").over(Window.partitionBy(*group)), "pct": percent_rank(c("rank_score"), group)}).where(c("n") >= least)
    each = ranked.groupBy(*group).agg(
        F.max("n").alias("n"), (F.avg(F.when(c("pct") >= 1 - top, c("outcome"))) - F.avg(F.when(c("pct") <= top, c("outcome")))).alias("gross")
    )
    day = each.groupBy("prediction_date").agg(F.sum("n").alias("n"), F.avg("gross").alias("gross"))
    grid = day.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(x)) for x in costs])))
    grid = grid.withColumn("net", c("gross") - 2 * c("cost_bps") / 10_000)
    run = Window.partitionBy("cost_bps").orderBy("prediction_date").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("equity", F.product(1 + F.coalesce(c("net"), F.lit(0.0))).over(run))
    return grid.withColumn("drawdown", ratio(c("equity"), F.max("equity").over(run)) - 1)
