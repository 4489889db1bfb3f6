"""Feature packs joined at the time they were known: yield curve, policy rate, short sales, filings, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import ratio, rolling_z, trailing
from tidemark.operators.temporal import asof, trailing_counts

c = F.col
#: Family of each filing form (fixed values).
FORM_FAMILY = {
    "8-K": "current_report", "6-K": "current_report", "10-Q": "financial_report", "10-K": "financial_report", "20-F": "financial_report",
    "40-F": "financial_report", "SC 13D": "ownership", "SC 13G": "ownership", "DEF 14A": "proxy", "S-1": "offering", "S-3": "offering",
    "S-4": "offering", "424B2": "offering",
}


def form_family(form: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FORM_FAMILY.items() for x in kv])
    return F.coalesce(F.element_at(table, F.upper(form)), F.lit("other"))


def event_id(symbol: Column, accession: Column, available: Column, form: Column, document: Column) -> Column:
    """symbol:accession, or symbol:anon- and 24 hex digits of a digest where there is no accession number."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat_ws("|", text(symbol), text(available), text(form), text(document)), 256), 1, 24)
    known = F.trim(text(accession))
    return F.when(known != "", F.concat(text(symbol), F.lit(":"), known)).otherwise(F.concat(text(symbol), F.lit(":anon-"), digest))


def curve_context(bars: DataFrame, curve: DataFrame) -> DataFrame:
    """Every treasury_* column of the curve as it was known at each bar."""
    names = [x for x in curve.columns if x.startswith("treasury_")]
    return asof(bars, curve, [], "available_at", names, ["session_date"])


def policy_rate_context(bars: DataFrame, observations: DataFrame, level: str, high: str, low: str, history: int = 20) -> DataFrame:
    """Level, high, low, change, range and rolling z of a policy rate given as three series in long form."""
    codes = [level, high, low]
    wide = observations.where(c("value").isNotNull()).groupBy("observation_date", "available_at").pivot("series_code", codes).agg(F.max_by("value", "value"))
    line = Window.orderBy("observation_date", "available_at")  # one row a day
    w = trailing([], ["observation_date", "available_at"], history)
    x = wide.select("available_at", "observation_date", c(f"`{level}`").alias("boj_call_rate_level"), c(f"`{high}`").alias("boj_call_rate_high"), c(f"`{low}`").alias("boj_call_rate_low"))
    x = x.withColumns(
        {
            "boj_call_rate_change": c("boj_call_rate_level") - F.lag("boj_call_rate_level").over(line),
            "boj_call_rate_range": c("boj_call_rate_high") - c("boj_call_rate_low"),
            "boj_call_rate_level_z20": rolling_z(c("boj_call_rate_level"), w, history),
        }
    )
    return asof(bars, x, [], "available_at", [n for n in x.columns if n.startswith("boj_")], ["observation_date"])


def short_sale_features(volumes: DataFrame, history: int = 20) -> DataFrame:
    """Ratios of short volume with their change and rolling z, by symbol (volumes as parsers.short_volume gives them)."""
    line, w = Window.partitionBy("symbol").orderBy("session_date"), trailing(["symbol"], "session_date", history)
    return volumes.select(
        "symbol", "session_date", "available_at", c("short_ratio").alias("finra_short_ratio"), c("exempt_ratio").alias("finra_short_exempt_ratio"),
        c("log_volume").alias("finra_total_volume_log"), c("venue_disagreement").alias("finra_venue_disagreement"),
        (c("short_ratio") - F.lag("short_ratio").over(line)).alias("finra_short_ratio_change"), rolling_z(c("short_ratio"), w, history).alias("finra_short_ratio_z20"),
    )


def short_sale_context(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Short-sale features of US stocks as known at each bar; 0 where there are none, with a flag that tells."""
    names = [n for n in features.columns if n.startswith("finra_")]
    rows = features.withColumn("__k", F.upper("symbol")).drop("symbol")
    left = bars.withColumn("__k", F.when(c("asset_class") == "us_stock", F.upper("symbol")))
    out = asof(left, rows, ["__k"], "available_at", names, ["session_date"])
    known = c("finra_short_ratio").isNotNull()
    return out.withColumn("finra_data_available", known.cast("double")).withColumns({n: F.coalesce(c(n), F.lit(0.0)) for n in names}).drop("__k")


def filing_features(bars: DataFrame, filings: DataFrame) -> DataFrame:
    """Counts of recent filings by form for US stocks, days since the latest, and whether there was any."""
    f = filings.where((c("asset_class") == "us_stock") & c("available_at").isNotNull()).withColumn("form", F.upper("form"))
    form = lambda *names: c("form").isin(*names)
    counts = {
        "sec_filings_30d": ("30 days", None), "sec_filings_90d": ("90 days", None), "sec_8k_30d": ("30 days", form("8-K", "6-K")), "sec_10q_180d": ("180 days", form("10-Q")),
        "sec_10k_365d": ("365 days", form("10-K", "20-F", "40-F")), "sec_proxy_90d": ("90 days", form("DEF 14A")),
    }
    us = c("asset_class") == "us_stock"
    left = bars.withColumn("__s", F.when(us, c("symbol")))
    q = left.where("__s is not null and available_at is not null").select("__s", "available_at").distinct()
    found = trailing_counts(q, f.withColumn("__s", c("symbol")), "__s", "available_at", counts, age="sec_days_since_filing")
    found = found.withColumnsRenamed({"__s": "__fs", "available_at": "__fa"})
    out = left.join(found, (c("__s") == c("__fs")) & (c("available_at") == c("__fa")), "left").drop("__s", "__fs", "__fa")
    out = out.withColumn("sec_data_available", c("sec_days_since_filing").isNotNull().cast("double"))
    return out.withColumns({n: F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in [*counts, "sec_days_since_filing"]})


def event_features(bars: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sixteen features of the event ledger: counts by family, age, burst, change of rate and the latest family."""
    fam = lambda x: c("event_family") == x
    counts = {
        "event_count_5d": ("5 days", None), "event_count_30d": ("30 days", None), "event_count_90d": ("90 days", None), "event_current_report_5d": ("5 days", fam("current_report")),
        "event_current_report_30d": ("30 days", fam("current_report")), "event_financial_report_180d": ("180 days", fam("financial_report")),
        "event_ownership_180d": ("180 days", fam("ownership")), "event_proxy_180d": ("180 days", fam("proxy")), "__prior": ("210 days to 30 days", None),
    }
    q = bars.where("available_at is not null").select("symbol", "available_at").distinct()
    found = trailing_counts(q, ledger, "symbol", "available_at", counts, age="__age")
    found = asof(found, ledger, ["symbol"], "available_at", ["event_family"], ["event_id"] if "event_id" in ledger.columns else [], "__last_")
    prior, c30 = c("__prior").cast("double"), c("event_count_30d").cast("double")
    found = found.withColumns(
        {
            "event_data_available": c("__age").isNotNull().cast("double"),
            "event_days_since_latest": F.coalesce(c("__age"), F.lit(0.0)),
            "event_burst_5d_vs_30d": F.when(c30 > 0, 6 * c("event_count_5d") / F.greatest(c30, F.lit(1.0))).otherwise(0.0),
            "event_rate_change_30d_vs_prev180d": F.when(prior > 0, c30 / (prior / 6)).otherwise(c30),
            **{f"event_latest_is_{x}": F.coalesce(c("__last_event_family") == x, F.lit(False)).cast("double") for x in ("current_report", "financial_report", "ownership", "proxy")},
        }
    ).drop("__prior", "__age", "__last_event_family")
    names = [n for n in found.columns if n.startswith("event_")]
    found = found.withColumnsRenamed({"symbol": "__es", "available_at": "__ea"})
    out = bars.join(found, (c("symbol") == c("__es")) & (c("available_at") == c("__ea")), "left").drop("__es", "__ea")
    return out.withColumns({n: F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in names})


def curvature(two: Column, five: Column, ten: Column) -> Column:
    return 2 * five - two - ten


def compounded(x: Column, keys: list[str], order: str, n: int) -> Column:
    """Product of 1 + x over the last n rows, less one; null until there are n."""
    w = trailing(keys, order, n)
    return F.when(F.count(x).over(w) == n, F.product(1 + x).over(w) - 1)


def relative_strength(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Mean of the group and each row's difference from it."""
    m = F.avg(value).over(Window.partitionBy(*group))
    return df.withColumns({"sector_ret_1d": m, "relative_strength_1d": c(value) - m, "relative_ratio_1d": ratio(c(value), m)})
