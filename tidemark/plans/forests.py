"""Queries of the direction, return and quantile models and of the isotonic fit, over all bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import isotonic, models, technical, trees
from tidemark.plans.panel import _CASES, KEY, _r, bank, query, rounded
from tidemark.scratch import ensure_importable, table
from tidemark.sources import views

c = F.col
#: Trees of the quantile forest.
QUANTILE_TREES = 24
FEATURES = ("ret_1d", "ret_5d", "ret_20d", "volatility_20", "range_pct", "close_location", "volume_ratio_20", "drawdown_from_high_20")


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars with features and a known next return: those before 1997 for learning, the others."""
    ensure_importable(spark)
    # targets first: their windows then take the exchange of the bars, as the features do
    b = technical.targets(views.bars(spark, sf_dir)).select(*KEY, "open", "high", "low", "close", "volume", "target_ret_1d", "target_up_1d")
    b = technical.technical_features(b, only=FEATURES)
    b = table(b.where("target_ret_1d is not null").select(*KEY, *FEATURES, c("target_up_1d").alias("y"), c("target_ret_1d").alias("y_ret")), "model-cases")
    return b.where("session_date < '1997-01-01'"), b.where("session_date >= '1997-01-01'")


@query()
def direction_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a rise on each bar from 1997 on, by every direction model, learned from the bars before."""
    train, test = _cases(spark, sf_dir)
    out = models.fit_probabilities(train, test.select(*KEY, *FEATURES, "y"), FEATURES)
    return rounded(out.select(*KEY, "y", *[f"p_{m}" for m in models.DIRECTION]), 6)


@query()
def return_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected return and its q10, q50 and q90 on each bar from 1997 on, by boosting with squared and pinball loss."""
    train, test = _cases(spark, sf_dir)
    out = models.fit_bands(train, test, FEATURES, mean=True)
    return rounded(out.select(*KEY, "y_ret", "expected_return", *[c("q")[k].alias(f"q{q}") for k, q in enumerate((10, 50, 90))]), 6)


@query()
def forest_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q10, q50 and q90 of the return on each bar from 1997 on, by a quantile forest over the rows of its leaves."""
    train, test = _cases(spark, sf_dir)
    named = test.withColumn("case", F.concat_ws("|", *KEY))
    q = models.fit_quantiles(train, named, FEATURES, "case", trees_=QUANTILE_TREES)
    part = F.split("case", r"\|")
    keys = [part[0].alias("asset_class"), part[1].alias("symbol"), part[2].cast("date").alias("session_date")]
    return rounded(q.select(*keys, *[c("q")[k].alias(f"q{q_}") for k, q_ in enumerate((10, 50, 90))]), 6)


@query()
def calibrated_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss of the second half-years by model and calibrator; each calibrator learns from the first half-years."""
    rows = bank(spark, sf_dir).select("model", "y", "p", (F.month("session_date") <= 6).alias("first"))
    rows = table(models.probability_cells(rows, "model", "first"), "calibration-cases")
    out = None
    for model in ("momentum", "reversal"):
        own = rows.where(c("model") == model)
        loss = lambda q: F.sum(-(c("y") * F.log(q) + (1 - c("y")) * F.log(1 - q)) * c("weight")) / F.sum("weight")
        fitted = {k: models.CALIBRATORS[k]().fit(own.where("first")).apply(c("p")) for k in models.CALIBRATORS}
        one = own.where("not first").groupBy("model").agg(F.sum("weight").alias("n"), *[loss(q).alias(k) for k, q in fitted.items()])
        out = one if out is None else out.unionByName(one)
    return rounded(out, 5)


#: Edges of the codes of the split that SQL can follow: steps of 2%.
_GRID = tuple((k - 20) * 0.02 for k in range(41))
_SPLIT = ("ret_1d", "ret_5d", "ret_20d", "range_pct")


@query(
    f"""with {views.BARS_SQL}, r as (
      select asset_class, symbol, session_date, stock_splits, lead(stock_splits) over line as next_splits, lead(close) over line / nullif(close, 0) - 1 as fwd, (high - low) / nullif(close, 0) as range_pct,
             {', '.join(f'close / nullif(lag(close, {n}) over line, 0) - 1 as ret_{n}d' for n in (1, 5, 20))}
      from bars window line as (partition by symbol order by session_date)),
    k as (select *, (fwd > 0)::int as y from r where fwd is not null and stock_splits = 0 and coalesce(next_splits, 0) = 0),
    base as (select avg(y) as m, ln(avg(y) / (1 - avg(y))) as f0 from k),
    coded as (select asset_class, symbol, session_date, y, {', '.join(f'len(list_filter({list(_GRID)}::double[], lambda e: e < coalesce({x}, 0))) as c{j}' for j, x in enumerate(_SPLIT))} from k),
    long as (select unnest([0, 1, 2, 3]) as feature, unnest([c0, c1, c2, c3]) as code, y from coded),
    cells as (select feature, code, sum(m - y) as g, sum(m * (1 - m)) as h, count(*) as n from long, base group by feature, code),
    upto as (select feature, code, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl, sum(g) over (partition by feature) as ga, sum(h) over (partition by feature) as ha, sum(n) over (partition by feature) as na
             from cells window w as (partition by feature order by code)),
    best as (select *, gl ** 2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga ** 2 / (ha + 1) as gain from upto where nl >= 20 and na - nl >= 20 order by round(gain, 7) desc, feature, code limit 1)
    select asset_class, symbol, session_date, {_r('1 / (1 + exp(-(f0 + case when [c0, c1, c2, c3][feature + 1] <= code then -gl / (hl + 1) else -(ga - gl) / (ha - hl + 1) end)))', 'p', 6)} from coded, base, best"""
)
def boosted_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a rise of every bar after one round of boosting with one split over all bars, features in steps of 2%."""
    ensure_importable(spark)
    b = technical.targets(views.bars(spark, sf_dir))
    line = technical.Window.partitionBy("asset_class", "symbol").orderBy("session_date")
    past = {f"ret_{n}d": F.try_divide("close", F.lag("close", n).over(line)) - 1 for n in (1, 5, 20)}
    b = b.withColumns(past | {"range_pct": F.try_divide(c("high") - c("low"), c("close"))}).where("target_up_1d is not null")
    cases = table(b.select(*KEY, *_SPLIT, c("target_up_1d").alias("y")), "split-cases")
    bins = trees.Bins(_SPLIT, (0.0,) * len(_SPLIT), (_GRID,) * len(_SPLIT))
    return rounded(trees.fit_boosted(cases, _SPLIT, "y", rounds=1, rate=1.0, leaves=2, bins=bins).predict(cases, "p").select(*KEY, "p"), 6)


@query(
    f"""with {_CASES}, cells as (select fold, model, round(p, 3) as x, count(*)::bigint as n, sum(y)::bigint as s from bank group by all),
    ranked as (select *, sum(n) over w as cn, sum(s) over w as cs, row_number() over w as i from cells window w as (partition by fold, model order by x)),
    -- the fit at i is the largest, over starts at or before i, of the least mean from there to an end at or after i
    spans as (select a.fold, a.model, a.i as j, b.i as k, (b.cs - a.cs + a.s)::double / (b.cn - a.cn + a.n) as m from ranked a join ranked b on a.fold = b.fold and a.model = b.model and a.i <= b.i),
    least as (select fold, model, j, k as i, min(m) over (partition by fold, model, j order by k desc) as m from spans),
    fit as (select fold, model, i, max(m) as v from least where j <= i group by all)
    select fold, model, min(x) as low, max(x) as high, sum(n)::bigint as n, sum(s)::bigint as s, {_r('any_value(v)', 'value', 6)} from fit join ranked using (fold, model, i) group by fold, model, round(v, 12)"""
)
def isotonic_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising steps of the outcome on the probability, in thousandths, for each fold and model."""
    # as the SQL rounds: the double of 1000 p, which lies under the half for 0.5005, where the decimal lies on it
    b = bank(spark, sf_dir).select("fold", "model", (F.round(c("p") * 1000) / 1000).alias("x"), "y")
    return rounded(isotonic.isotonic_blocks(b, ["fold", "model"], "x", "y"), 6, low=3, high=3)
