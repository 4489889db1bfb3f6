"""Queries over the prediction bank: conformal sets, selection by earlier folds, evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import conformal as sets
from tidemark.operators import scores, selection
from tidemark.plans.panel import _BASE, _BIN, _CASES, _DAY, _HIT, _LL, _RZ, KEY, _base, _r, bank, query, rounded
from tidemark.scratch import ensure_importable
from tidemark.sources import views

c = F.col

# conformal sets --------------------------------------------------------------------------------

_Q = "least(greatest(p, 1e-6), 1 - 1e-6)"
# The last step of these is materialized: under a LIMIT around the statement DuckDB never ends otherwise.
_CAL = f"cal as (select *, case when y = 1 then 1 - {_Q} else {_Q} end as score from bank where month(session_date) <= 6), test as (select *, {_Q} as q from bank where month(session_date) > 6)"


def _counts(bank_: str, keys: str, tag: str) -> str:
    """CTEs: the number of bank scores at or above every test threshold of its keys."""
    return f"""
    {tag}asked as (select distinct {keys}, unnest([q, 1 - q]) as t from test),
    {tag}both as (select {keys}, score as t, 1 as k, 0 as ask from {bank_} union all select {keys}, t, 0, 1 from {tag}asked),
    {tag}seen as (select *, sum(k) over (partition by {keys} order by t desc range unbounded preceding) as above, sum(k) over (partition by {keys}) as n from {tag}both),
    {tag}counts as (select {keys}, t, above, n from {tag}seen where ask = 1)"""


_SET_COLUMNS = f"""{_r('p0', 'p0', 9)}, {_r('p1', 'p1', 9)}, p0 > 0.1::double as has0, p1 > 0.1::double as has1, (p0 > 0.1::double)::int + (p1 > 0.1::double)::int as set_size"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = bank(spark, sf_dir)
    first = F.month("session_date") <= 6
    return rows.where(first), rows.where(~first)


@query(
    f"""with {_CASES}, {_CAL}, {_counts('cal', 'fold, model', 'a_')},
    v as materialized (select x.*, (1 + hi.above) / (1 + hi.n) as p1, (1 + lo.above) / (1 + lo.n) as p0 from test x
      left join a_counts hi on hi.fold = x.fold and hi.model = x.model and hi.t = 1 - x.q left join a_counts lo on lo.fold = x.fold and lo.model = x.model and lo.t = x.q)
    select asset_class, symbol, session_date, model, {_SET_COLUMNS} from v"""
)
def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction sets of the second half of each year from the first, by fold and model."""
    cal, test = _halves(spark, sf_dir)
    out = sets.prediction_sets(cal, test, ["fold", "model"])
    return rounded(out.select(*KEY, "model", "p0", "p1", "has0", "has1", "set_size"), 9)


@query(
    f"""with {_CASES}, {_CAL}, {_counts('cal', 'fold, model', 'a_')}, {_counts('cal', 'fold, model, asset_class', 'g_')},
    v as materialized (select x.*, coalesce(gh.n, 0) < 50 as fallback, case when gh.n >= 50 then (1 + gh.above) / (1 + gh.n) else (1 + hi.above) / (1 + hi.n) end as p1, case when gl.n >= 50 then (1 + gl.above) / (1 + gl.n) else (1 + lo.above) / (1 + lo.n) end as p0 from test x
      left join a_counts hi on hi.fold = x.fold and hi.model = x.model and hi.t = 1 - x.q left join a_counts lo on lo.fold = x.fold and lo.model = x.model and lo.t = x.q
      left join g_counts gh on gh.fold = x.fold and gh.model = x.model and gh.asset_class = x.asset_class and gh.t = 1 - x.q left join g_counts gl on gl.fold = x.fold and gl.model = x.model and gl.asset_class = x.asset_class and gl.t = x.q)
    select asset_class, symbol, session_date, model, fallback, {_SET_COLUMNS} from v"""
)
def conformal_group_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction sets by asset class, those of all classes where a class has few calibration rows."""
    cal, test = _halves(spark, sf_dir)
    out = sets.group_prediction_sets(cal, test, ["fold", "model"], "asset_class")
    return rounded(out.select(*KEY, "model", "fallback", "p0", "p1", "has0", "has1", "set_size"), 9)


@query(
    f"""with {_CASES}, {_CAL}, {_counts('cal', 'fold, model', 'a_')},
    v as (select x.*, (1 + hi.above) / (1 + hi.n) > 0.1::double as h1, (1 + lo.above) / (1 + lo.n) > 0.1::double as h0 from test x
      left join a_counts hi on hi.fold = x.fold and hi.model = x.model and hi.t = 1 - x.q left join a_counts lo on lo.fold = x.fold and lo.model = x.model and lo.t = x.q),
    w as (select *, h0::int + h1::int as size, case when y = 1 then h1 else h0 end::int as covered from v)
    select fold, model, count(*) as n, {_r('avg(covered)', 'coverage')}, {_r('avg(size)', 'mean_size')}, {_r('avg((size = 1)::int)', 'singleton_rate')}, {_r('avg(case when size = 1 then covered end)', 'singleton_accuracy')}, {_r('avg((size = 0)::int)', 'empty_rate')} from w group by all"""
)
def conformal_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and size of the prediction sets of each fold and model."""
    from tidemark.operators.evidence import set_metrics

    cal, test = _halves(spark, sf_dir)
    return rounded(set_metrics(sets.prediction_sets(cal, test, ["fold", "model"]), ["fold", "model"]))


@query(
    f"""with recursive {_CASES}, {_CAL},
    days as (select *, row_number() over (partition by fold, model order by session_date) as rn from (select fold, model, session_date, list(case when y = 1 then 1 - q else q end) as own from test group by all)),
    start as (select fold, model, list(score) as cal from cal group by all),
    banks as (select d.fold, d.model, d.session_date, d.rn, list_concat(coalesce(any_value(s.cal), []), coalesce(flatten(list(e.own) filter (where e.own is not null)), [])) as held
      from days d left join start s on s.fold = d.fold and s.model = d.model left join days e on e.fold = d.fold and e.model = d.model and e.rn < d.rn group by d.fold, d.model, d.session_date, d.rn),
    v as (select x.asset_class, x.symbol, x.session_date, x.fold, x.model, x.y, b.rn, (1 + len(list_filter(b.held, lambda s: s >= 1 - x.q))) / (1 + len(b.held)) as p1, (1 + len(list_filter(b.held, lambda s: s >= x.q))) / (1 + len(b.held)) as p0
      from test x join banks b on b.fold = x.fold and b.model = x.model and b.session_date = x.session_date),
    own as (select fold, model, rn, list(case when y = 1 then p1 else p0 end) as covered from v group by all),
    f(fold, model, rn, a) as (select fold, model, rn, 0.1::double from own where rn = 1 union all
      select n.fold, n.model, n.rn, least(greatest(f.a + 0.02 * (0.1::double - len(list_filter(o.covered, lambda x: x <= f.a)) / len(o.covered)), 0.01), 0.5) from f join own o on o.fold = f.fold and o.model = f.model and o.rn = f.rn join own n on n.fold = f.fold and n.model = f.model and n.rn = f.rn + 1)
    select asset_class, symbol, session_date, v.model, {_r('p0', 'p0', 9)}, {_r('p1', 'p1', 9)}, {_r('a', 'alpha_used', 9)}, (p0 > a)::int + (p1 > a)::int as set_size from v join f on f.fold = v.fold and f.model = v.model and f.rn = v.rn"""
)
def conformal_adaptive_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction sets whose level and bank of scores follow the sessions."""
    ensure_importable(spark)
    cal, test = _halves(spark, sf_dir)
    used = [*KEY, "fold", "model", "y", "p"]
    out = sets.adaptive_sets(cal.select(used), test.select(used), ["fold", "model"])
    return rounded(out.select(*KEY, "model", "p0", "p1", "alpha_used", "set_size"), 9)


# metrics by quarter, on which the selections work --------------------------------------------------

_QUARTER = "((year(session_date) - 1992) * 4 + quarter(session_date))::int"
_MET = f"""{_CASES}, rows as (select *, {_QUARTER} as q, abs(hash_of) % 3 as win from (select *, ascii(symbol) as hash_of from bank)),
  one as (select q as fold, model, avg({_LL}) as logloss, avg((p - y) ** 2) as brier, avg(p) as mean_p from rows group by all),
  bins as (select q as fold, model, {_BIN} as b, count(*) as k, abs(avg(p) - avg(y)) as gap from rows group by all), eces as (select fold, model, sum(k * gap) / sum(k) as ece from bins group by all),
  metrics as (select fold, model, logloss, brier, ece from one join eces using (fold, model) where logloss is not null),
  wins as (select q as fold, model, win::int * 252 as window_, avg({_LL}) as logloss, abs(avg(p) - 0.5) * 10 as drift from rows group by all),
  classes as (select asset_class, model, count(*) as folds, avg(logloss) as logloss, coalesce(stddev_samp(logloss), 0) as logloss_std from (select asset_class, model, q, avg({_LL}) as logloss from rows group by all) group by all)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = (F.year("session_date") - 1992) * 4 + F.quarter("session_date")
    return bank(spark, sf_dir).withColumns({"fold": quarter.cast("int"), "window": (F.ascii("symbol") % 3 * 252).cast("int")})


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, model, logloss, brier, ece) by quarter."""
    return scores.binary_metrics(_rows(spark, sf_dir), ["fold", "model"]).select("fold", "model", "logloss", "brier", "ece")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, model, window, logloss, drift): three groups of instruments stand for three training windows."""
    loss = F.avg(scores.log_loss(c("y"), c("p"))).alias("logloss")
    return _rows(spark, sf_dir).groupBy("fold", "model", "window").agg(loss, (F.abs(F.avg("p") - 0.5) * 10).alias("drift"))


def _prior(rows: str, by: str, half: float, pen: float, least: int, also: str = "", extra: str = "1", on: str = "") -> str:
    """Subquery: weighted evidence of earlier folds, one row a fold t and candidate."""
    sums = "".join(f", sum(w * {x}) / sum(w) as {x}" for x in also.split() if x)
    return f"""(select t, {by}, mu + {pen} * sqrt(greatest(sq - mu * mu, 0)) as score, mu, n {"".join(f", {x}" for x in also.split())} from
      (select t, {by}, sum(w * logloss) / sum(w) as mu, sum(w * logloss * logloss) / sum(w) as sq, count(*) as n{sums} from
        (select r.*, f.t, power(0.5, (f.t - r.fold) / {half}::double) * {extra} as w from {rows} r join (select distinct fold as t{", " + on if on else ""} from {rows}) f on r.fold < f.t {"and r." + on.split()[0].rstrip(",") + " = f." + on.split()[0].rstrip(",") if on else ""}) group by t, {by}) where n >= {least})"""


_FIRST = lambda order, part="t": f"row_number() over (partition by {part} order by {order}) as rn"


@query(
    f"""with {_MET}, e as (select *, {_FIRST('score, mu, model')} from {_prior('metrics', 'model', 4.0, 0.25, 3)} x),
    d as (select t as fold, model, score, n as n_prior from e where rn = 1)
    select d.fold, d.model, {_r('d.score', 'score')}, d.n_prior, {_r('m.logloss', 'logloss')}, {_r('b.logloss - m.logloss', 'gain')}, {_r('m.ece', 'ece')}
    from d join metrics m on m.fold = d.fold and m.model = d.model left join metrics b on b.fold = d.fold and b.model = 'reversal'"""
)
def sequential_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that earlier quarters choose for each quarter, against a fixed one."""
    out = selection.sequential_policy(_metrics(spark, sf_dir), "reversal")
    return rounded(out.select("fold", "model", "score", "n_prior", "logloss", "gain", "ece"))


@query(
    f"""with {_MET}, e as (select *, {_FIRST('score, mu, model')} from {_prior('metrics', 'model', 4.0, 0.25, 3)} x), d as (select t as fold, model, score, n as n_prior from e where rn = 1),
    s as (select list_sort(list(distinct fold)) as f from metrics), o as (select f[len(f) // 2 + 1] as start from s), b as (select model from d, o where fold = start)
    select d.fold, d.model, {_r('d.score', 'score')}, o.start as outer_start, (select model from b) as baseline_model, {_r('x.logloss - m.logloss', 'gain')}
    from d join o on d.fold >= o.start join metrics m on m.fold = d.fold and m.model = d.model left join metrics x on x.fold = d.fold and x.model = (select model from b)"""
)
def nested_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection over the later half of the quarters against the model that the earlier half would have fixed."""
    out = selection.nested_policy(_metrics(spark, sf_dir))
    return rounded(out.select("fold", "model", "score", "outer_start", "baseline_model", "gain"))


@query(
    f"""with {_MET}, x as (select f.t, r.model, r.window_, count(*) as n, count(distinct r.fold) as k, sum(w * logloss) / sum(w) as mu, sum(w * logloss * logloss) / sum(w) as sq from
      (select r.*, f.t, power(0.5, (f.t - r.fold) / 4.0::double) as w from wins r join (select distinct fold as t from wins) f on r.fold < f.t and r.fold >= f.t - 3) r join (select distinct fold as t from wins) f on f.t = r.t group by all),
    e as (select *, mu + 0.25 * sqrt(greatest(sq - mu * mu, 0)) as score from x where n = 3 and k = 3), g as (select *, {_FIRST('score, model, window_')} from e)
    select t as fold, model, window_ as "window", {_r('score', 'score')} from g where rn = 1"""
)
def model_window_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and training window chosen together by exactly the last three quarters."""
    return rounded(selection.model_window_choice(_windows(spark, sf_dir)))


@query(
    f"""with {_MET}, m as (select fold, window_, logloss, drift from wins where model = 'momentum'),
    p as (select f.fold as t, f.window_, sum(w * r.logloss) / sum(w) as mu, sum(w * r.logloss * r.logloss) / sum(w) as sq, count(*) as n from m f, lateral (select r.logloss, power(0.5, (f.fold - r.fold) / 4.0::double) * exp(-abs(r.drift - f.drift) / 0.5) as w from m r where r.window_ = f.window_ and r.fold < f.fold) r group by all having count(*) >= 2),
    e as (select *, mu + 0.25 * sqrt(greatest(sq - mu * mu, 0)) as score from p), g as (select *, {_FIRST('score, mu, case when window_ = 0 then 1000000000 else window_ end')} from e)
    select t as fold, window_ as "window", {_r('score', 'score')}, {_r('mu', 'mean')}, n as n_prior from g where rn = 1"""
)
def drift_aware_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training window chosen by earlier quarters of like drift."""
    return rounded(selection.drift_aware_window(_windows(spark, sf_dir).where("model = 'momentum'").drop("model")))


_METHODS = """methods as (select fold, case when model = 'momentum' then 'platt' else 'beta' end as method, logloss, ece, brier from metrics union all
  select fold, case when model = 'momentum' then 'isotonic' else 'temperature' end, logloss + 0.01 * (fold % 3 - 1), ece, brier from metrics)"""


def _methods(m: DataFrame) -> DataFrame:
    """Quarterly metrics of four calibrators, made of those of two models."""
    first = F.when(c("model") == "momentum", "platt").otherwise("beta")
    second = F.when(c("model") == "momentum", "isotonic").otherwise("temperature")
    one = m.select("fold", first.alias("method"), "logloss", "ece", "brier")
    return one.unionByName(m.select("fold", second.alias("method"), (c("logloss") + 0.01 * (c("fold") % 3 - 1)).alias("logloss"), "ece", "brier"))


_ORDER = "list_position(['platt', 'beta', 'isotonic', 'temperature'], method)"


@query(
    f"""with {_MET}, {_METHODS}, e as (select *, {_FIRST(f'score, ece, brier, {_ORDER}')} from {_prior('methods', 'method', 4.0, 0.25, 2, 'ece brier')} x)
    select f.fold, coalesce(e.method, 'platt') as method, {_r('e.score', 'score')} from (select distinct fold from methods) f left join e on e.t = f.fold and e.rn = 1"""
)
def calibrator_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrator of each quarter by the earlier ones."""
    return rounded(selection.calibrator_route(_methods(_metrics(spark, sf_dir))))


@query(
    f"""with {_MET}, {_METHODS}, a as (select method, avg(logloss) as m, coalesce(stddev_samp(logloss), 0) as s, avg(ece) as ece from methods group by method having count(*) >= 3),
    ar as (select q as fold, asset_class, case when model = 'momentum' then 'platt' else 'beta' end as method, avg({_LL}) as logloss from rows group by all), b as (select method, avg(logloss) as am, coalesce(stddev_samp(logloss), 0) as s2, count(*) as n from ar group by method),
    v as (select a.method, 0.5 * m + 0.5 * case when n >= 3 then am else m end + 0.25 * (0.5 * s + 0.5 * coalesce(s2, 0)) as score, ece from a left join b using (method))
    select method, {_r('score', 'score')}, {_r('ece', 'ece')}, row_number() over (order by score, ece, {_ORDER}) = 1 as selected from v"""
)
def calibrator_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One calibrator for all folds, half by the folds and half by their asset classes."""
    named = F.when(c("model") == "momentum", "platt").otherwise("beta").alias("method")
    by_class = _rows(spark, sf_dir).groupBy("fold", "asset_class", named).agg(F.avg(scores.log_loss(c("y"), c("p"))).alias("logloss"))
    return rounded(selection.calibrator_choice(_methods(_metrics(spark, sf_dir)), by_class))


@query(
    f"""with {_MET}, w as (select window_ as "window", avg(logloss) as m, coalesce(stddev_samp(logloss), 0) as s, count(*) as folds from wins where model = 'momentum' group by all)
    select "window", {_r('m', 'logloss')}, {_r('s', 'logloss_std')}, folds, row_number() over (order by (folds < 3)::int, m + 0.25 * s, case when "window" = 0 then 1000000000 else "window" end) = 1 and folds >= 3 as selected from w"""
)
def window_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training window by mean and deviation over all quarters."""
    return rounded(selection.window_choice(_windows(spark, sf_dir).where("model = 'momentum'")))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_class, model, folds, logloss, logloss_std) over the quarters."""
    each = _rows(spark, sf_dir).groupBy("asset_class", "model", "fold").agg(F.avg(scores.log_loss(c("y"), c("p"))).alias("l"))
    return each.groupBy("asset_class", "model").agg(F.count("*").alias("folds"), F.avg("l").alias("logloss"), F.coalesce(F.stddev_samp("l"), F.lit(0.0)).alias("logloss_std"))


@query(
    f"""with {_MET}, g as (select model, avg(logloss) as m, coalesce(stddev_samp(logloss), 0) as s from metrics group by model), a as (select model, avg(logloss) as am, stddev_samp(logloss) as s2, count(*) as n from classes where folds >= 3 group by model)
    select model, {_r('case when n >= 2 then 0.5 * m + 0.5 * am else m end', 'selection_logloss')}, {_r('case when n >= 2 then 0.5 * s + 0.5 * s2 else s end', 'selection_logloss_std')}, coalesce(n, 0) as n_classes from g left join a using (model)"""
)
def rebalanced_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss of each model, half its own and half the mean over asset classes."""
    m = _metrics(spark, sf_dir).groupBy("model").agg(F.avg("logloss").alias("logloss"), F.coalesce(F.stddev_samp("logloss"), F.lit(0.0)).alias("logloss_std"))
    return rounded(selection.rebalanced(m, _classes(spark, sf_dir)))


_GRID_RANK = lambda x, d: f"row_number() over (partition by fold, session_date, asset_class order by {x} {d}, symbol) / count(*) over (partition by fold, session_date, asset_class)"
_GRID = f"""{_CASES}, k as (select year(session_date)::int as fold, session_date, asset_class, symbol, pa as p, coalesce(ret_1d, 0) as expected, coalesce(range_pct, 0) as uncertainty, y_ret from cases where y_ret is not null),
  s as (select *, {_GRID_RANK('p', 'desc')} as rp, {_GRID_RANK('expected', 'desc')} as re, {_GRID_RANK('uncertainty', 'asc')} as ru from k),
  e as (select s.*, w, u, w * rp + (1 - w) * re - u * ru as score from s, (select unnest([0.25::double, 0.5::double, 0.75::double]) as w), (select unnest([0.0::double, 0.05::double, 0.1::double]) as u)),
  g as (select fold, session_date, asset_class, w, u, covar_pop(score, y_ret) / (stddev_pop(score) * stddev_pop(y_ret)) as ic from e group by all having count(*) >= 2 and stddev_pop(score) > 1e-12 and stddev_pop(y_ret) > 1e-12),
  grid as (select fold, w, u, avg(ic) as rank_ic from g group by all)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank(spark, sf_dir).where("model = 'momentum'").select(*KEY, "fold", "p", "y_ret")
    extra = _base(spark, sf_dir).select(*KEY, F.coalesce("ret_1d", F.lit(0.0)).alias("expected"), F.coalesce("range_pct", F.lit(0.0)).alias("uncertainty"))
    return selection.ranking_grid(rows.join(extra, KEY), ["fold", "session_date", "asset_class"], ["symbol"])


@query(f"with {_GRID} select fold, w as weight, u as penalty, {_r('rank_ic', 'rank_ic')} from grid")
def ranking_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC of every weight and penalty of the rank score, by year."""
    return rounded(_grid(spark, sf_dir))


@query(
    f"""with {_GRID}, p as (select *, case when count(rank_ic) over l >= 3 then avg(rank_ic) over l - 0.25 * coalesce(stddev_samp(rank_ic) over l, 0) end as prior from grid window l as (partition by w, u order by fold rows between unbounded preceding and 1 preceding)),
    r as (select *, max(case when w = 0.5 and u = 0 then rank_ic end) over (partition by fold) as base, row_number() over (partition by fold order by prior desc nulls last, case when prior is null then (not (w = 0.5 and u = 0))::int end, w desc, u desc) as rn from p)
    select fold, w as weight, u as penalty, {_r('rank_ic', 'rank_ic')}, {_r('base', 'baseline_rank_ic')} from r where rn = 1"""
)
def nested_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and penalty of the rank score that earlier years choose for each year."""
    return rounded(selection.ranking_choice(_grid(spark, sf_dir)))


@query(
    f"""with {views.BARS_SQL}, d as (select distinct session_date from bars), r as (select *, row_number() over (order by session_date) - 1 as i, count(*) over () as n from d),
    f as (select *, unnest(range(0, floor((n - 252 - 1 - 1) / 21)::bigint + 1)) as fold from r where n > 253), g as (select *, 252 + fold * 21 as e from f),
    a as (select fold::int as fold, case when i < e - 1 then 'train' else 'test' end as role, session_date from g where i < e - 1 or (i >= e + 1 and i < e + 1 + 21)),
    b as (select *, row_number() over (partition by fold, role order by session_date desc) as k, count(*) over (partition by fold, role) as n from a)
    select fold, case when role <> 'train' then role when k <= greatest(20, floor(n * 0.2::double)) then 'calibration' else 'core' end as role, session_date from b"""
)
def core_calibration_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward folds with the last fifth of the training sessions set apart for calibration."""
    return selection.core_calibration(scores.walk_forward(views.bars(spark, sf_dir), 252, 21, 21))


_SPLITS = f"""{views.BARS_SQL}, d as (select session_date, row_number() over (order by session_date) - 1 as i, count(*) over () as n from (select distinct session_date from bars)),
  g as (select *, (i >= n * 1 // 6)::int + (i >= n * 2 // 6)::int + (i >= n * 3 // 6)::int + (i >= n * 4 // 6)::int + (i >= n * 5 // 6)::int as g from d),
  pairs as (select a, b from (select unnest(range(0, 6)) as a), (select unnest(range(0, 6)) as b) where a < b), each as (select a || '-' || b as split, i, session_date, g in (a, b) as t from g, pairs),
  near as (select *, max(t::int) over (partition by split order by i rows between 1 preceding and 1 following) = 1 as near from each)"""


@query(
    f"""with {_SPLITS} select split, sum((not t and not near)::int)::bigint as n_train, sum(t::int)::bigint as n_test, 0::bigint as leaks from near group by split"""
)
def purged_split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every choice of two of six groups as test, and how many training sessions touch a test session."""
    return selection.split_leaks(selection.purged_splits(views.bars(spark, sf_dir)))


@query(
    f"""with {views.BARS_SQL}, d as (select distinct session_date from bars), l as (select session_date from d order by 1 desc limit 64), r as (select session_date, row_number() over (order by session_date) as rn from l)
    select min(session_date) as cutoff, max(case when rn = 2 then session_date end) as holdout_start, max(session_date) as holdout_end from r where (select count(*) from d) >= 316"""
)
def rolling_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 63 sessions and the session before them."""
    return selection.rolling_holdout(views.bars(spark, sf_dir))


_DAILY = f"{_CASES}, follow as (select session_date, avg(case when pa >= 0.5 then y_ret else -y_ret end) as ret from cases where y_ret is not null group by session_date)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(c("p") >= 0.5, c("y_ret")).otherwise(-c("y_ret"))
    return bank(spark, sf_dir).where("model = 'momentum'").groupBy("session_date").agg(F.avg(side).alias("ret"))


@query(f"with {_DAILY} select year(session_date)::int as year, {_r('avg(ret)', 'mean_return')} from follow group by all")
def yearly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean daily return of following the first model, by year."""
    return rounded(selection.yearly_returns(_daily(spark, sf_dir)))


@query(
    f"""with {_DAILY}, one as (select count(*) as n, avg(ret) / stddev_samp(ret) * sqrt(252) as sharpe from follow), y as (select avg(ret) as m from follow group by year(session_date)),
    z as (select *, sqrt((1 + 0.5 * sharpe * sharpe) / n) as se, 2 / (pi() * 0.147) + ln(1 - 0.9 * 0.9::double) / 2 as a, ln(1 - 0.9 * 0.9::double) / 0.147 as b from one),
    v as (select *, greatest(sqrt(2) * sqrt(sqrt(a * a - b) - a) * se, 0) as pen from z)
    select n, {_r('sharpe', 'sharpe')}, {_r('pen', 'selection_penalty')}, {_r('sharpe - pen', 'adjusted_sharpe')}, (select count(*) from y) as years, {_r('(select avg((m > 0)::int) from y)', 'positive_year_share')} from v"""
)
def overfit_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio of the daily returns, its penalty for 20 trials, and positive years."""
    return rounded(selection.overfit_figures(_daily(spark, sf_dir), trials=20))


# the cross-section with all its columns ------------------------------------------------------------

_CONTEXT = ("ret_1d", "volatility_20", "volume_ratio_20", "range_pct", "price_vs_sma20")
_FLAGS = {"jp": "asset_class like 'jp\\_%' escape '\\'", "us": "asset_class like 'us\\_%' escape '\\'", "stock": "asset_class like '%\\_stock' escape '\\'", "etf": "asset_class like '%\\_etf' escape '\\'", "reit": "asset_class = 'jp_reit'"}
_MORE = ("market_median_ret_5d", "market_median_ret_20d", "market_median_vol_20d", "market_dispersion_5d", "market_dispersion_20d", "market_dispersion_vs_20d", "market_ret_iqr_1d", "residual_momentum_20d", "residual_volatility_20d", "sector_ret_1d", "relative_strength_1d", "sector_rank")


@query(
    f"""with {_BASE}, {_DAY}, tagged as (select *, asset_class as sector from base),
    rolled as (select *, case when count(median_ret) over w5 = 5 then product(1 + median_ret) over w5 - 1 end as market_median_ret_5d, case when count(median_ret) over w20 = 20 then product(1 + median_ret) over w20 - 1 end as market_median_ret_20d,
      case when count(median_vol) over w20 = 20 then quantile_cont(median_vol, 0.5) over w20 end as market_median_vol_20d, case when count(market_dispersion_1d) over w5 = 5 then quantile_cont(market_dispersion_1d, 0.5) over w5 end as market_dispersion_5d,
      case when count(market_dispersion_1d) over w20 = 20 then quantile_cont(market_dispersion_1d, 0.5) over w20 end as market_dispersion_20d from day
      window w5 as (partition by market_family order by session_date rows between 4 preceding and current row), w20 as (partition by market_family order by session_date rows between 19 preceding and current row)),
    med as (select *, {", ".join(f"quantile_cont({x}, 0.5) over g as m_{x}" for x in _CONTEXT)} from tagged window g as (partition by session_date, market_family)),
    mad as (select *, {", ".join(f"quantile_cont(abs({x} - m_{x}), 0.5) over g as s_{x}" for x in _CONTEXT)} from med window g as (partition by session_date, market_family)),
    x as (select m.*, r.* exclude (session_date, market_family), avg(ret_1d) over s as sector_ret_1d,
      case when ret_1d is not null then (rank() over (partition by session_date, market_family, sector order by ret_1d nulls last) + (count(ret_1d) over (partition by session_date, market_family, sector, ret_1d) - 1) / 2.0::double) / count(ret_1d) over s end as sector_rank
      from mad m join rolled r using (session_date, market_family) window s as (partition by session_date, market_family, sector)),
    y as (select *, market_dispersion_1d / nullif(market_dispersion_20d, 0) - 1 as market_dispersion_vs_20d, ret_20d - market_median_ret_20d as residual_momentum_20d, volatility_20 / nullif(market_median_vol_20d, 0) - 1 as residual_volatility_20d, ret_1d - sector_ret_1d as relative_strength_1d from x)
    select asset_class, symbol, session_date, {", ".join(f"({v})::int::double as asset_is_{k}" for k, v in _FLAGS.items())}, {", ".join(_r(_RZ(x), f"cs_{x}_robust_z") for x in _CONTEXT)}, {", ".join(_r(x, x) for x in _MORE)}
    from y window g as (partition by session_date, market_family)"""
)
def cross_sectional_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the cross-section; the asset class stands for the sector."""
    from tidemark.operators import cross

    out = cross.cross_context(_base(spark, sf_dir).withColumn("sector", c("asset_class")))
    return rounded(out.select(*KEY, *[f"asset_is_{k}" for k in _FLAGS], *[f"cs_{x}_robust_z" for x in _CONTEXT], *_MORE))


@query(
    """with s as (select lag(event_type) over (partition by user_id order by ts, event_id) as a, event_type as b from events), k as (select distinct event_type as t from events), g as (select x.t as from_state, y.t as to_state from k x, k y),
    n as (select g.*, count(s.b) + 1.0 as n from g left join s on s.a = g.from_state and s.b = g.to_state group by all) select from_state, to_state, round(n / sum(n) over (partition by from_state), 6) as share from n"""
)
def smoothed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition shares between a user's events with every pair counted once more."""
    e = views.read(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    states = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a few types
    return rounded(scores.transition_matrix(e, ["user_id"], "o", "event_type", states), 6)


@query(
    """with k as (select list_sort(list(distinct event_type)) as t from events), r as (select *, lag(event_type) over w as a from events window w as (partition by user_id order by ts, event_id)),
    p as (select r.event_id, r.user_id, r.event_type, unnest(k.t) as to_state, r.ts, r.a from r, k),
    h as (select p.event_id, p.event_type, p.to_state, count(q.event_id) + 1.0::double as n from p left join r q on q.user_id = p.user_id and q.a = p.event_type and q.event_type = p.to_state and (q.ts, q.event_id) < (p.ts, p.event_id) group by all),
    f as (select event_id, to_state, n / sum(n) over (partition by event_id) as share from h) select event_id, round(max(case when to_state = (select t[1] from k) then share end), 6) as first_share, round(max(case when to_state = (select t[2] from k) then share end), 6) as second_share from f group by event_id"""
)
def transition_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What followed each event's type before, by user: shares of the first two types in order."""
    e = views.read(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    states = sorted(r[0] for r in e.select("event_type").distinct().collect())
    out = scores.transition_forecasts(e, ["user_id"], "o", "event_type", states)
    return rounded(out.select("event_id", c("forecast")[0].alias("first_share"), c("forecast")[1].alias("second_share")), 6)
