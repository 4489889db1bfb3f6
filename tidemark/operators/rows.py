"""Row-wise rules: eligibility, buckets, labels, projections, identities, routes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import name_key, ratio
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators.patterns import prior_quantiles
from tidemark.operators.upkeep import violations

c = F.col
#: Asset classes that predictions are made for (fixed values).
ELIGIBLE = ("jp_stock", "jp_etf", "jp_reit", "us_stock", "us_etf")


def eligible(asset_class: Column, tradeable: Column) -> Column:
    return asset_class.isin(*ELIGIBLE) & F.coalesce(tradeable, F.lit(False))


def completeness(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """READY where all features are known, else DEFERRED_INCOMPLETE_FEATURES, with their names."""
    missing = violations(*[(x, c(x).isNull()) for x in features])
    return df.withColumn("missing_features", missing).withColumn("prediction_status", F.when(F.size("missing_features") == 0, "READY").otherwise("DEFERRED_INCOMPLETE_FEATURES"))


def outside_holdout(df: DataFrame, cutoff: Column, end: Column, date: str = "session_date") -> DataFrame:
    return df.where((c(date) <= cutoff) | (c(date) > end))


def shard(df: DataFrame, keys: Sequence[str], count: int, index: int) -> DataFrame:
    """One of count parts by a hash of the keys."""
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(count)) == index)


def vendor_symbol(symbol: Column, asset_class: Column) -> Column:
    """Symbol as the price vendor writes it: a suffix for Japan, a dash for a dot elsewhere."""
    return F.when(asset_class.startswith("jp_"), F.concat(symbol, F.lit(".T"))).otherwise(F.replace(symbol, F.lit("."), F.lit("-")))


def long_bars(wide: DataFrame, symbols: Sequence[str], fields: Sequence[str] = ("Open", "High", "Low", "Close", "Adj Close", "Volume"), date: str = "Date") -> DataFrame:
    """Rows (provider_symbol, session_date, fields) of a vendor table with a column `symbol|field` each; bars without prices go, no volume is 0."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("provider_symbol"), *[c(f"`{s}|{f}`").cast("double").alias(f.lower().replace(" ", "_")) for f in fields]) for s in symbols]))
    rows = wide.select(F.to_date(date).alias("session_date"), each.alias("z")).select("session_date", "z.*")
    return rows.dropna(subset=["open", "high", "low", "close", "adj_close"]).fillna(0.0, ["volume"])


def direction_bucket(p: Column) -> Column:
    return F.when(p <= 0.25, "p<=0.25").when(p < 0.5, "0.25<p<0.50").when(p < 0.75, "0.50<=p<0.75").when(p.isNotNull(), "p>=0.75")


def disagreement_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x < 0.01, "disagreement<0.01").when(x < 0.03, "0.01<=disagreement<0.03").when(x < 0.06, "0.03<=disagreement<0.06").otherwise("disagreement>=0.06")


def return_error_bucket(x: Column) -> Column:
    e = F.abs(x)
    return F.when(e < 0.02, "<2%").when(e < 0.05, "2%<=error<5%").when(e < 0.10, "5%<=error<10%").when(e < 0.20, "10%<=error<20%").when(e.isNotNull(), ">=20%")


def error_tags(p: Column, y: Column, return_error: Column, disagreement: Column) -> Column:
    wrong = (p >= 0.5) != (y == 1)
    sure, fair = (p >= 0.75) | (p <= 0.25), (p >= 0.60) | (p <= 0.40)
    e = F.abs(return_error)
    return violations(
        ("direction_wrong", wrong), ("high_confidence_wrong", wrong & sure), ("moderate_confidence_wrong", wrong & ~sure & fair), ("near_boundary_wrong", wrong & ~sure & ~fair),
        ("return_error_ge_5pct", e >= 0.05), ("return_error_ge_10pct", e >= 0.10), ("return_error_ge_20pct", e >= 0.20), ("high_model_disagreement", disagreement >= 0.06),
    )


#: Pages of the catalogue, the code that an instrument has there, and the words that tell its class (fixed values).
CODES = {"japan": "^[0-9]{4}[A-Z]?$", "us": r"^[A-Z][A-Z0-9.\-]{0,7}$"}
CLASS_WORDS = {
    "japan": (("jp_reit", ("REIT", "投資法人")), ("jp_etf", ("ETF", "上場投資信託")), ("jp_stock", ("個別", "日本株"))),
    "us": (("us_etf", ("ETF",)), ("us_stock", ("米国株",))),
}


def code_of(cells: Column, market: str) -> Column:
    """The first of a row's first four cells that looks like an instrument's code."""
    return F.get(F.filter(F.slice(cells, 1, 4), lambda x: x.rlike(CODES[market])), F.lit(0))


def class_of(section: Column, name: Column, market: str) -> Column:
    """Asset class by the words of section and name, the first that matches; null without any."""
    text = F.upper(F.concat_ws(" ", section, name))
    out = F.lit(None).cast("string")
    for kind, names in reversed(CLASS_WORDS[market]):
        hit = F.lit(False)
        for w in names:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, kind).otherwise(out)
    return out


def channels_of(cells: Column, known: Sequence[str]) -> Column:
    """Words of the row's cells that name a known trade channel, each once, in the order found."""
    words = F.flatten(F.transform(cells, lambda x: F.split(F.lower(x), r"[,\s]+")))
    return F.array_distinct(F.filter(words, lambda x: x.isin(*known)))


def situation(regime: Column, gap: Column, vol_ratio: Column, vix: Column, breadth: Column, sma60: Column) -> Column:
    """Finer label of what put a row into its regime."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    event = F.when(yes(F.abs(gap) >= 0.03), "event_gap").when(yes(vol_ratio >= 3), "event_volume").otherwise("event")
    high = F.when(yes(vix >= 30), "high_vol_vix").otherwise("high_vol")
    trend = (
        F.when(yes(sma60 >= 0.02), "trend_up").when(yes(sma60 <= -0.02), "trend_down").when(yes(breadth >= 0.75), "breadth_up").when(yes(breadth <= 0.25), "breadth_down").otherwise("trend")
    )
    return F.when(regime == "event", event).when(regime == "high_vol", high).when(regime == "trend", trend).when(regime == "data_stressed", "data_stressed").otherwise("range")


def ordered_interval(low: Column, middle: Column, high: Column) -> tuple[Column, Column, Column]:
    """The three made monotone: low is the least, high the greatest, middle stays between."""
    a, b = F.least(low, middle, high), F.greatest(low, middle, high)
    return a, F.least(F.greatest(middle, a), b), b


def price_projection(df: DataFrame, close: str = "close") -> DataFrame:
    """Expected close and range from return quantiles q10_1d, q50_1d, q90_1d and expected_return_1d."""
    a, m, b = ordered_interval(c("q10_1d"), c("q50_1d"), c("q90_1d"))
    return df.withColumns({"expected_close_1d": c(close) * (1 + c("expected_return_1d")), "range_low_1d": c(close) * (1 + a), "q50_close_1d": c(close) * (1 + m), "range_high_1d": c(close) * (1 + b)})


def model_disagreement(predictions: DataFrame, case: Sequence[str]) -> DataFrame:
    """Population deviation of the models' probabilities of each case."""
    return predictions.groupBy(*case).agg(F.stddev_pop("p").alias("model_disagreement"), F.count("*").alias("n_models"))


def resolve_entities(filings: DataFrame, universe: DataFrame) -> DataFrame:
    """Filings with the symbol they belong to: exact ticker, then an alias, then a company name that is unique.

    filings has ticker and company, universe symbol, name and aliases (array). The three
    tables joined hold one row a key, so no filing is doubled.
    """
    u = universe.select("symbol", "name", F.coalesce(c("aliases"), F.array().cast("array<string>")).alias("aliases"))
    tick = u.select(name_key(c("symbol")).alias("k1"), c("symbol").alias("s1")).groupBy("k1").agg(F.min("s1").alias("s1"))
    alias = u.select("symbol", F.explode("aliases").alias("a")).select(name_key(c("a")).alias("k2"), c("symbol").alias("s2")).groupBy("k2").agg(F.min("s2").alias("s2"))
    company = u.select(name_key(c("name")).alias("k3"), c("symbol").alias("s3")).groupBy("k3").agg(F.min("s3").alias("s3"), F.count_distinct("s3").alias("n")).where("n = 1").drop("n")
    t, n = name_key(c("ticker")), name_key(c("company"))
    out = filings.join(tick, t == c("k1"), "left").join(alias, t == c("k2"), "left").join(company, n == c("k3"), "left")
    how = F.when(c("s1").isNotNull(), "ticker").when(c("s2").isNotNull(), "alias").when(c("s3").isNotNull(), "company")
    return out.withColumns({"symbol": F.coalesce("s1", "s2", "s3"), "matched_by": how}).drop("k1", "s1", "k2", "s2", "k3", "s3")


def top_per_kind(sources: DataFrame, kind: str, score: str, n: int, tie: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(kind).orderBy(c(score).desc_nulls_last(), *tie)
    return sources.withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)


#: Route tables in the order in which they are asked; the first that knows the row decides.
ROUTES = (
    ("symbol_regime", ("symbol", "regime")), ("symbol", ("symbol",)), ("asset_situation", ("asset_class", "situation")), ("situation", ("situation",)),
    ("asset_regime", ("asset_class", "regime")), ("asset", ("asset_class",)), ("regime", ("regime",)), ("global", ()),
    # behind the frozen routes, what the folds choose
    ("oos_asset_regime", ("asset_class", "regime")), ("oos_asset", ("asset_class",)), ("oos_regime", ("regime",)), ("oos_global", ()),
)


def route(rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """model_id and route_reason of each row: data_stressed rows are held back, others take the most specific route there is.

    Each table has one row a key with the model to use; tables are joined, not looped over.
    """
    out, models, reasons = rows, [], []
    for name, keys in ROUTES:
        t = tables.get(name)
        if t is None:
            continue
        r = t.select(*[c(k).alias(f"__{k}") for k in keys], c("model_id").alias(f"__m_{name}"))
        out = out.join(r, [c(k) == c(f"__{k}") for k in keys], "left").drop(*[f"__{k}" for k in keys]) if keys else out.join(F.broadcast(r.limit(1)), how="left")
        models.append(c(f"__m_{name}"))
        reasons.append(F.when(c(f"__m_{name}").isNotNull(), F.lit(name)))
    held = c("regime") == "data_stressed"
    model = F.coalesce(*models) if models else F.lit(None).cast("string")
    reason = F.coalesce(*reasons, F.lit("no_route")) if reasons else F.lit("no_route")
    out = out.withColumns({"model_id": F.when(~held, model), "route_reason": F.when(held, "data_stressed").otherwise(reason)})
    return out.drop(*[f"__m_{name}" for name, _ in ROUTES])


def selective_shrink(p: Column, risk: Column, threshold: Column, weight: Column) -> Column:
    """p drawn toward one half by weight where the risk passes the threshold."""
    return F.when(risk > threshold, 0.5 + (p - 0.5) * (1 - weight)).otherwise(p)


def shrink_grid(rows: DataFrame, quantiles: Sequence[float] = (0.5, 0.6, 0.7, 0.8, 0.9), weights: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Loss of every pair of threshold and weight over rows (y, p, risk), best first: the grid is an array, so rows are read once."""
    cut = exact_quantiles(rows, [], "risk", quantiles, "cuts").select("cuts")
    grid = [(i, q, w) for i, q in enumerate(quantiles) for w in weights]
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.element_at("cuts", i + 1).alias("threshold"), F.lit(w).alias("weight")) for i, q, w in grid]))
    x = rows.join(F.broadcast(cut)).select("y", "p", "risk", each.alias("g")).select("y", "p", "risk", "g.*")  # one row of cuts
    q = F.greatest(F.least(selective_shrink(c("p"), c("risk"), c("threshold"), c("weight")), F.lit(1 - 1e-6)), F.lit(1e-6))
    out = x.groupBy("quantile", "weight").agg(F.first("threshold").alias("threshold"), F.avg(-(c("y") * F.log(q) + (1 - c("y")) * F.log(1 - q))).alias("logloss"), F.avg((q - c("y")) ** 2).alias("brier"))
    return out.orderBy("logloss", "brier", c("weight").desc())


def yearly_robustness(df: DataFrame, keys: Sequence[str], value: str, date: str = "session_date") -> DataFrame:
    """Mean over years of the yearly mean, and the share of years above zero."""
    per = df.groupBy(*keys, F.year(date).alias("__y")).agg(F.avg(value).alias("__m"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_years"), F.avg("__m").alias("mean"), F.avg((c("__m") > 0).cast("int")).alias("positive_share"))


def performance_change(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Outer join of two metric tables with the change of each metric and what became of each key."""
    b = before.select(*[c(k).alias(f"__{k}") for k in keys], *[c(m).alias(f"{m}_before") for m in metrics], F.lit(True).alias("__b"))
    out = after.withColumn("__a", F.lit(True)).join(b, [c(k).eqNullSafe(c(f"__{k}")) for k in keys], "full")
    status = F.when(c("__b").isNull(), "new").when(c("__a").isNull(), "gone").otherwise("kept")
    return out.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], status.alias("status"), *[x for m in metrics for x in (c(f"{m}_before"), c(m).alias(f"{m}_after"), (c(m) - c(f"{m}_before")).alias(f"{m}_change"))])


def case_failure(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Fixed risk score (mean of the four signals) and the 75th percentile of all earlier folds as its threshold."""
    score = (c("case_ood") + c("case_failure_risk") + c("case_disagreement") + (1 - c("case_predictability"))) / 4
    rows = df.withColumn("risk_score", score)
    scaled = rows.select(c(fold).alias("fold"), (c("risk_score") / 2).alias("__half"))  # the operator takes values up to one half
    prior = prior_quantiles(scaled, "__half", {"__q": 0.75}).select(c("fold").alias("__t"), (2 * c("__q")).alias("threshold"))
    return rows.join(prior, c(fold) == c("__t"), "left").drop("__t").withColumn("flagged", c("risk_score") > c("threshold"))


def failure_lift(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Failure rates of flagged and other cases, their ratio, and the share of failures that was flagged."""
    f = c("failed").cast("double")
    return df.where("threshold is not null").groupBy(fold).agg(
        F.count("*").alias("n"), ratio(F.avg(F.when(c("flagged"), f)), F.avg(F.when(~c("flagged"), f))).alias("failure_lift"), ratio(F.sum(F.when(c("flagged"), f)), F.sum(f)).alias("error_capture")
    )
