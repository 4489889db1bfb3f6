"""Queries over the driver's tables for the panel operators, each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cols
from tidemark.operators import cross, scores, states, technical, temporal, upkeep
from tidemark.scratch import dealt, ensure_importable, table
from tidemark.sources import views
from tidemark.store import stored

c = F.col
KEY = ["asset_class", "symbol", "session_date"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _off_half(digits: int) -> float:
    """A little over a thousandth of the last decimal: an exact half would round either way by the last bit of a sum."""
    return float(f"1.37e-{digits + 3}")


def rounded(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    """Doubles rounded, so that the order in which floats were added does not show, and moved off exact halves first."""
    return df.select(*[F.round(c(x) + F.lit(_off_half(own.get(x, digits))), own.get(x, digits)).alias(x) if t == "double" else c(x) for x, t in df.dtypes])


def _r(expr: str, name: str, digits: int = 4) -> str:
    """Rounded as Spark rounds: without a negative zero."""
    return f"round(({expr}) + {_off_half(digits)!r}, {digits}) + 0::double as {name}"


def _full(agg: str, x: str, n: int) -> str:
    return f"case when count({x}) over w{n} = {n} then {agg} over w{n} end"


def _div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


_WINDOWS = "window line as (partition by symbol order by session_date), " + ", ".join(
    f"w{n} as (partition by symbol order by session_date rows between {n - 1} preceding and current row)" for n in (3, 5, 10, 14, 19, 20, 60)
)
_Z = lambda x, n: _div(f"{x} - {_full(f'avg({x})', x, n)}", _full(f"stddev_samp({x})", x, n))

_TECH_ONE = f"""
one as (
  select *, {_div('close', 'lag(close) over line')} - 1 as ret_1d, {_div('close', 'lag(close, 5) over line')} - 1 as ret_5d,
         {_div('close', 'lag(close, 20) over line')} - 1 as ret_20d, {_div('close', 'lag(close, 60) over line')} - 1 as ret_60d,
         lag(close) over line as prev, high - lag(high) over line as up, lag(low) over line - low as down, (high + low + close) / 3 as tp,
         row_number() over line as rn, ln(close) as logc, ln(1 + volume) as logv, abs(close) * abs(volume) as dv
  from bars {_WINDOWS}),
two as (
  select *, greatest(close - prev, 0) as gain0, -least(close - prev, 0) as loss0, greatest(high - low, abs(high - prev), abs(low - prev)) as tr,
         case when up > down and up > 0 then up else 0 end as pdm, case when down > up and down > 0 then down else 0 end as mdm,
         sign(coalesce(close - prev, 0)) * volume as flow, case when tp > lag(tp) over line then tp * volume else 0 end as pos,
         case when tp < lag(tp) over line then abs(tp * volume) else 0 end as neg, abs(ret_1d) * volume as arv, abs(ret_1d) / nullif(dv, 0) as illiq,
         lag(ret_1d) over line as retlag, {_div('high - low', 'close')} as range_pct, {_div('close - low', 'high - low')} as close_location,
         case when ret_1d is null then null else least(ret_1d, 0) end as rdown, case when ret_1d is null then null else greatest(ret_1d, 0) end as rup
  from one {_WINDOWS}),
gl as (select *, case when prev is null then null else gain0 end as gain, case when prev is null then null else loss0 end as loss from two)
"""

#: name -> (digits, DuckDB expression over the layer gl)
_TECH = {
    "ret_1d": "ret_1d", "ret_5d": "ret_5d", "ret_20d": "ret_20d", "ret_60d": "ret_60d",
    "close_vs_sma5": f"{_div('close', _full('avg(close)', 'close', 5))} - 1",
    "close_vs_sma20": f"{_div('close', _full('avg(close)', 'close', 20))} - 1",
    "close_vs_sma60": f"{_div('close', _full('avg(close)', 'close', 60))} - 1",
    "rsi_14": f"100 - {_div('100', '1 + ' + _div(_full('avg(gain)', 'gain', 14), _full('avg(loss)', 'loss', 14)))}",
    "stoch_k": _div(f"100 * (close - {_full('min(low)', 'low', 14)})", f"{_full('max(high)', 'high', 14)} - {_full('min(low)', 'low', 14)}"),
    "bb_width": _div(f"4 * {_full('stddev_samp(close)', 'close', 20)}", _full("avg(close)", "close", 20)),
    "atr_pct": _div(_full("avg(tr)", "tr", 14), "close"),
    "mfi_14": f"100 - {_div('100', '1 + ' + _div(_full('sum(pos)', 'pos', 14), _full('sum(neg)', 'neg', 14)))}",
    "volatility_20": _full("stddev_samp(ret_1d)", "ret_1d", 20),
    "volatility_5": _full("stddev_samp(ret_1d)", "ret_1d", 5),
    "volatility_ratio_5_20": _div(_full("stddev_samp(ret_1d)", "ret_1d", 5), _full("stddev_samp(ret_1d)", "ret_1d", 20)),
    "wvma_5": _div(_full("stddev_samp(arv)", "arv", 5), _full("avg(arv)", "arv", 5)),
    "volume_std_ratio_5": _div(_full("stddev_samp(volume)", "volume", 5), "volume"),
    "volume_ratio_20": _div("volume", _full("avg(volume)", "volume", 20)),
    "volume_z20": _Z("volume", 20),
    "dollar_volume_ratio_20": _div("dv", _full("quantile_cont(dv, 0.5)", "dv", 20)),
    "return_z20": _Z("ret_1d", 20),
    "return_skew_20": _full("skewness(ret_1d)", "ret_1d", 20),
    "return_kurtosis_20": _full("kurtosis(ret_1d)", "ret_1d", 20),
    "positive_return_fraction_20": _full("avg(case when ret_1d > 0 then 1.0::double when ret_1d is not null then 0.0::double end)", "ret_1d", 20),
    "up_down_imbalance_20": _full("avg(sign(ret_1d)::double)", "ret_1d", 20),
    "downside_volatility_20": _full("stddev_samp(rdown)", "rdown", 20),
    "upside_volatility_20": _full("stddev_samp(rup)", "rup", 20),
    "return_autocorr_20": "case when count(ret_1d) over w20 = 20 then corr(ret_1d, retlag) over w19 end",
    "return_volume_corr_20": _div(
        f"{_full('avg(ret_1d * volume)', 'ret_1d', 20)} - {_full('avg(ret_1d)', 'ret_1d', 20)} * {_full('avg(volume)', 'volume', 20)}",
        f"{_full('stddev_samp(ret_1d)', 'ret_1d', 20)} * {_full('stddev_samp(volume)', 'volume', 20)}",
    ),
    "trend_slope_20": _full("regr_slope(logc, rn)", "logc", 20),
    "trend_slope_60": _full("regr_slope(logc, rn)", "logc", 60),
    "trend_r2_20": _full("regr_r2(logc, rn)", "logc", 20),
    "trend_r2_60": _full("regr_r2(logc, rn)", "logc", 60),
    "resi_5_pct": _div(f"close - ({_full('regr_intercept(close, rn)', 'close', 5)} + {_full('regr_slope(close, rn)', 'close', 5)} * rn)", "close"),
    "resi_10_pct": _div(f"close - ({_full('regr_intercept(close, rn)', 'close', 10)} + {_full('regr_slope(close, rn)', 'close', 10)} * rn)", "close"),
    "return_log_volume_corr_5": "case when count(case when logv is not null then ret_1d end) over w5 = 5 then corr(ret_1d, logv) over w5 end",
    "return_log_volume_corr_10": "case when count(case when logv is not null then ret_1d end) over w10 = 10 then corr(ret_1d, logv) over w10 end",
    "range_pct": "range_pct",
    "range_z20": _Z("range_pct", 20),
    "drawdown_from_high_20": f"{_div('close', _full('max(close)', 'close', 20))} - 1",
    "distance_from_low_20": f"{_div('close', _full('min(close)', 'close', 20))} - 1",
    "gap_pct": f"{_div('open', 'prev')} - 1",
    "intraday_return": f"{_div('close', 'open')} - 1",
    "close_location": "close_location",
    "close_location_mean_20": _full("avg(close_location)", "close_location", 20),
    "dow_sin": "sin((isodow(session_date) - 1) * (2 * pi() / 7))",
    "dow_cos": "cos((isodow(session_date) - 1) * (2 * pi() / 7))",
    "month_sin": "sin((month(session_date) - 1) * (2 * pi() / 12))",
    "month_cos": "cos((month(session_date) - 1) * (2 * pi() / 12))",
}


#: Decimals of columns that are small, or whose fourth decimal often ends in an exact half.
_DIGITS = {"trend_slope_20": 8, "trend_slope_60": 8, "close_location_mean_20": 8, "atr_pct": 6, "range_pct": 6}


@query(f"with {views.BARS_SQL}, {_TECH_ONE} select asset_class, symbol, session_date, {', '.join(_r(e, n, _DIGITS.get(n, 4)) for n, e in _TECH.items())} from gl {_WINDOWS}")
def technical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing-window features of every bar."""
    out = technical.technical_features(views.bars(spark, sf_dir), only=list(_TECH), flat_as_sql=True)
    return rounded(out.select(*KEY, *_TECH), **_DIGITS)


@query(
    f"""with {views.BARS_SQL}, {_TECH_ONE},
    layer as (select *, {_div('100 * ' + _full('sum(pdm)', 'pdm', 14), _full('sum(tr)', 'tr', 14))} as pdi, {_div('100 * ' + _full('sum(mdm)', 'mdm', 14), _full('sum(tr)', 'tr', 14))} as mdi,
              sum(flow) over (partition by symbol order by session_date rows unbounded preceding) as obv,
              {_div(f"100 * (close - {_full('min(low)', 'low', 14)})", f"{_full('max(high)', 'high', 14)} - {_full('min(low)', 'low', 14)}")} as stoch_k from gl {_WINDOWS}),
    dxs as (select *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) as dx from layer)
    select asset_class, symbol, session_date, {_r(_full('avg(dx)', 'dx', 14), 'adx_14')}, {_r(_Z('obv', 20), 'obv_z20')}, {_r(_full('avg(stoch_k)', 'stoch_k', 3), 'stoch_d')},
           {_r('1000000 * (' + _full('quantile_cont(illiq, 0.5)', 'illiq', 20) + ')', 'amihud_20_e6')} from dxs {_WINDOWS}"""
)
def technical_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that build on other features: ADX, on-balance volume, slow stochastic, illiquidity."""
    out = technical.technical_features(views.bars(spark, sf_dir), only=["adx_14", "obv_z20", "stoch_d", "amihud_20"])
    return rounded(out.select(*KEY, "adx_14", "obv_z20", "stoch_d", (c("amihud_20") * 1e6).alias("amihud_20_e6")))


@query(
    f"""with recursive {views.BARS_SQL},
    numbered as (select *, row_number() over (partition by symbol order by session_date) as rn from bars),
    e(asset_class, symbol, session_date, rn, close, e12, e20, e26) as (
      select asset_class, symbol, session_date, rn, close, close, close, close from numbered where rn = 1
      union all
      select n.asset_class, n.symbol, n.session_date, n.rn, n.close, (1 - 2.0::double / 13) * e.e12 + 2.0::double / 13 * n.close, (1 - 2.0::double / 21) * e.e20 + 2.0::double / 21 * n.close,
             (1 - 2.0::double / 27) * e.e26 + 2.0::double / 27 * n.close from e join numbered n on n.symbol = e.symbol and n.rn = e.rn + 1),
    m as (select *, case when rn >= 26 then e12 - e26 end as macd from e),
    s(symbol, rn, signal) as (
      select symbol, rn, macd from m where rn = 26
      union all
      select m.symbol, m.rn, (1 - 0.2::double) * s.signal + 0.2::double * m.macd from s join m on m.symbol = s.symbol and m.rn = s.rn + 1)
    select asset_class, m.symbol, session_date, {_r('case when m.rn >= 20 then close / e20 - 1 end', 'close_vs_ema20')}, {_r('macd / close', 'macd_pct')},
           {_r('case when m.rn >= 34 then signal / close end', 'macd_signal_pct')} from m left join s on s.symbol = m.symbol and s.rn = m.rn"""
)
def technical_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential means of each instrument."""
    names = ["close_vs_ema20", "macd_pct", "macd_signal_pct"]
    return rounded(technical.technical_features(views.bars(spark, sf_dir), only=names).select(*KEY, *names))


@query(
    f"""with {views.BARS_SQL}, f as (
      select *, lead(close) over w / close - 1 as r1, lead(close, 5) over w / close - 1 as r5, stock_splits <> 0 as sp, coalesce(lead(stock_splits) over w, 0) <> 0 as nsp
      from bars window w as (partition by symbol order by session_date)),
    t as (select *, case when not sp and not nsp then r1 end as target_ret_1d, case when not sp then r5 end as target_ret_5d from f)
    select asset_class, symbol, session_date, {_r('r1', 'raw_price_return_1d')}, {_r('target_ret_1d', 'target_ret_1d')}, {_r('target_ret_5d', 'target_ret_5d')},
           (target_ret_1d > 0)::int as target_up_1d, (target_ret_5d > 0.03)::int as target_up_5d_3pct, (target_ret_5d < -0.03)::int as target_down_5d_3pct from t"""
)
def forward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward returns and direction flags, masked around splits."""
    out = technical.targets(views.bars(spark, sf_dir))
    return rounded(out.select(*KEY, "raw_price_return_1d", "target_ret_1d", "target_ret_5d", "target_up_1d", "target_up_5d_3pct", "target_down_5d_3pct"))


_TS = {
    **{f"ts_ret_{n}": f"close / lag(close, {n}) over line - 1" for n in (1, 2, 3, 5, 10)},
    **{f"ts_return_sign_persistence_{n}": _full("avg(sign(r)::double)", "r", n) for n in (3, 5, 10)},
    **{f"ts_path_return_{n}": f"close / lag(close, {n}) over line - 1" for n in (3, 5, 10)},
    "ts_return_acceleration_1": "r - lag(r) over line",
    "ts_return_acceleration_5": "(close / lag(close, 5) over line - 1) - (close / lag(close, 10) over line - 1) / 2",
    "ts_volatility_3": _full("stddev_samp(r)", "r", 3),
    "ts_volatility_10": _full("stddev_samp(r)", "r", 10),
    "ts_volume_log_change_1": "lv - lag(lv) over line",
    "ts_range_change_1": "rg - lag(rg) over line",
    "ts_close_location_pressure_5": f"{_full('avg(cl)', 'cl', 5)} - {_full('avg(cl)', 'cl', 20)}",
    "ts_return_acceleration_3": "(close / lag(close, 3) over line - 1) - (close / lag(close, 5) over line - 1) / 2",
    "ts_volatility_ratio_3_10": _div(_full("stddev_samp(r)", "r", 3), _full("stddev_samp(r)", "r", 10)),
    "ts_volume_log_change_3": "lv - lag(lv, 3) over line",
    "ts_volume_pressure_5": f"{_full('avg(lv)', 'lv', 5)} - {_full('avg(lv)', 'lv', 20)}",
    "ts_range_pressure_5": f"{_full('avg(rg)', 'rg', 5)} - {_full('avg(rg)', 'rg', 20)}",
    "ts_close_location_change_1": "cl - lag(cl) over line",
}


@query(
    f"""with {views.BARS_SQL}, s as (select *, close / lag(close) over line - 1 as r, ln(1 + greatest(volume, 0)) as lv, (high - low) / nullif(close, 0) as rg,
       case when high <> low then least(greatest((close - low) / (high - low), -1), 2) end as cl from bars {_WINDOWS})
    select asset_class, symbol, session_date, {', '.join(_r(e, n) for n, e in _TS.items())} from s {_WINDOWS}"""
)
def temporal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-session state features."""
    return rounded(states.temporal_state(views.bars(spark, sf_dir)).select(*KEY, *_TS))


_BASE = f"""{views.BARS_SQL}, rets as (select *, close / lag(close) over w - 1 as ret_1d, close / lag(close, 20) over w - 1 as ret_20d, (high - low) / nullif(close, 0) as range_pct,
  case when asset_class like 'jp%' then 'jp' else 'us' end as market_family from bars window w as (partition by symbol order by session_date)),
  base as (select *, case when count(ret_1d) over w = 20 then stddev_samp(ret_1d) over w end as volatility_20,
           case when count(volume) over w = 20 then volume / nullif(avg(volume) over w, 0) end as volume_ratio_20, case when count(close) over w = 20 then close / nullif(avg(close) over w, 0) - 1 end as price_vs_sma20
           from rets window w as (partition by symbol order by session_date rows between 19 preceding and current row))"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bars(spark, sf_dir)
    w = cols.trailing(["asset_class", "symbol"], "session_date", 20)
    lag = lambda n: F.lag("close", n).over(technical.Window.partitionBy("asset_class", "symbol").orderBy("session_date"))
    b = b.withColumns({"ret_1d": cols.ratio(c("close"), lag(1)) - 1, "ret_20d": cols.ratio(c("close"), lag(20)) - 1, "range_pct": cols.ratio(c("high") - c("low"), c("close"))})
    volume = c("volume").cast("double")
    return b.withColumns({
        "volatility_20": cols.rolling(F.stddev_samp, c("ret_1d"), w, 20), "volume_ratio_20": cols.ratio(volume, cols.rolling(F.avg, volume, w, 20)),
        "price_vs_sma20": cols.ratio(c("close"), cols.rolling(F.avg, c("close"), w, 20)) - 1,
    })


_RZ = lambda x: (
    f"case when count({x}) over g < 10 then null when 1.4826 * s_{x} <= 1e-12 then 0 when {x} is null then null else least(greatest(({x} - m_{x}) / (1.4826 * s_{x}), -5), 5) end"
)
_DAY = """day as (
  select session_date, market_family, quantile_cont(volatility_20, 0.5) as median_vol, quantile_cont(ret_1d, 0.5) as median_ret,
         sum(case when ret_1d > 0 then 1 else 0 end) / count(*) as breadth_up, quantile_cont(ret_1d, 0.9) - quantile_cont(ret_1d, 0.1) as market_dispersion_1d,
         quantile_cont(ret_1d, 0.75) - quantile_cont(ret_1d, 0.25) as market_ret_iqr_1d from base group by all)"""


@query(
    f"""with {_BASE}, {_DAY},
    med as (select *, quantile_cont(ret_1d, 0.5) over g as m_ret_1d, quantile_cont(range_pct, 0.5) over g as m_range_pct from base window g as (partition by session_date, market_family)),
    mad as (select *, quantile_cont(abs(ret_1d - m_ret_1d), 0.5) over g as s_ret_1d, quantile_cont(abs(range_pct - m_range_pct), 0.5) over g as s_range_pct from med window g as (partition by session_date, market_family))
    select asset_class, symbol, session_date,
           round(case when ret_1d is not null then (rank() over (partition by session_date, market_family order by ret_1d nulls last) + (count(ret_1d) over (partition by session_date, market_family, ret_1d) - 1) / 2.0::double) / count(ret_1d) over g end, 4) as cs_ret_1d_rank,
           round(case when volatility_20 is not null then (rank() over (partition by session_date, market_family order by volatility_20 desc nulls last) + (count(volatility_20) over (partition by session_date, market_family, volatility_20) - 1) / 2.0::double) / count(volatility_20) over g end, 4) as cs_vol_rank,
           {_r(_RZ('ret_1d'), 'cs_ret_1d_robust_z')}, {_r(_RZ('range_pct'), 'cs_range_pct_robust_z')}, {_r('ret_1d - median_ret', 'ret_vs_market_median')}, {_r('volatility_20 / nullif(median_vol, 0) - 1', 'vol_vs_market_median')}
    from mad join day using (session_date, market_family) window g as (partition by session_date, market_family)"""
)
def cross_sectional_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, robust scores and differences from the market's day."""
    out = cross.cross_context(_base(spark, sf_dir))
    return rounded(out.select(*KEY, "cs_ret_1d_rank", "cs_vol_rank", "cs_ret_1d_robust_z", "cs_range_pct_robust_z", "ret_vs_market_median", "vol_vs_market_median"))


@query(
    f"""with {_BASE}, {_DAY}, rolled as (
      select *, case when count(median_vol) over w60 >= 20 then quantile_cont(median_vol, 0.75) over w60 end as vol_threshold,
             case when count(median_ret) over w20 = 20 then abs(avg(median_ret) over w20) end as drift,
             case when count(market_dispersion_1d) over w20 = 20 then quantile_cont(market_dispersion_1d, 0.5) over w20 end as market_dispersion_20d
      from day window w60 as (partition by market_family order by session_date rows between 59 preceding and current row), w20 as (partition by market_family order by session_date rows between 19 preceding and current row))
    select session_date, market_family, {_r('median_vol', 'median_vol')}, {_r('median_ret', 'median_ret')}, {_r('breadth_up', 'breadth_up')}, {_r('market_dispersion_1d', 'market_dispersion_1d')},
           {_r('market_dispersion_20d', 'market_dispersion_20d')}, {_r('vol_threshold', 'vol_threshold')},
           case when breadth_up between 0.25 and 0.75 then 'balanced' when median_vol >= vol_threshold then 'high_vol' when drift >= 0.005 then 'trend' else 'normal' end as market_regime from rolled"""
)
def market_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily state of each market and its regime."""
    day = cross.daily_market(_base(spark, sf_dir).withColumn("market_family", cols.market_family(c("asset_class"))))
    out = cross.market_regime(day)
    return rounded(out.select("session_date", "market_family", "median_vol", "median_ret", "breadth_up", "market_dispersion_1d", "market_dispersion_20d", "vol_threshold", "market_regime"))


_CLOCK = """timed as (select *, (session_date + interval 16 hour) at time zone 'Asia/Tokyo' at time zone 'UTC' as t_jp, (session_date + interval '16 hours 30 minutes') at time zone 'America/New_York' at time zone 'UTC' as t_us from bars),
  known as (select * exclude (t_jp, t_us), case when asset_class like 'jp%' then t_jp else t_us end as available_at from timed),
  macro_known as (select *, (session_date + interval 18 hour) at time zone 'America/New_York' at time zone 'UTC' as available_at from macro where family = '1-URGENT')"""


_CLOCK_ALL = _CLOCK.replace(" where family = '1-URGENT'", "")


@query(
    f"""with {views.BARS_SQL}, {views.MACRO_SQL}, {_CLOCK_ALL}, each as (select k.*, f.family from known k, (select distinct family from macro where family is not null) f)
    select k.asset_class, k.symbol, k.session_date, k.family, {_r('m.ret_1d', 'macro_ret_1d')}, {_r('m.volatility_20', 'macro_volatility_20')}, {_r('m.close', 'macro_close', 6)}
    from each k asof left join macro_known m on k.family = m.family and k.available_at >= m.available_at"""
)
def market_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every macro series as of each bar's time: one row a bar and family."""
    take = ["ret_1d", "volatility_20", "close"]
    out = temporal.asof_each(views.bars(spark, sf_dir), views.macro(spark, sf_dir), "family", "available_at", take, ["session_date"], "macro")
    out = out.select(*KEY, F.explode("macro").alias("family", "m"))
    return rounded(out.select(*KEY, "family", *[c(f"m.{x}").alias(f"macro_{x}") for x in take]), macro_close=6)


_EVENT_DAYS = "days as (select user_id, cast(ts as date) as session_date, cast(ts as date) + interval 1 day as available_at from events group by all)"


@query(
    f"""with {_EVENT_DAYS}, pairs as (select d.*, e.ts, e.event_type from days d left join events e on e.user_id = d.user_id and e.ts <= d.available_at)
    select cast(user_id as varchar) as symbol, session_date, count(case when ts >= available_at - interval 7 day then 1 end) as n_7d,
           count(case when ts >= available_at - interval 1 day and event_type = 'purchase' then 1 end) as purchases_1d, count(case when ts >= available_at - interval 30 day and event_type = 'error' then 1 end) as errors_30d,
           cast(floor(epoch_us(available_at - max(ts)) / 86400000000) as int) as age_days from pairs group by user_id, session_date, available_at"""
)
def filing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in trailing intervals, both ends inclusive, by form, and the age of the latest."""
    counts = {"n_7d": ("7 days", None), "purchases_1d": ("1 day", c("form") == "purchase"), "errors_30d": ("30 days", c("form") == "error")}
    out = temporal.trailing_counts(views.event_days(spark, sf_dir), views.filings(spark, sf_dir), "symbol", "available_at", counts, last="age_days")
    return out.select("symbol", "session_date", *counts, "age_days")


@query("select user_id, event_type, event_id, ts, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type."""
    e = views.read(spark, sf_dir, "events")
    return upkeep.keep_last(e, ["user_id", "event_type"], [c("ts").desc(), c("event_id").desc()]).select("user_id", "event_type", "event_id", "ts", "value")


@query(
    """with keyed as (select (event_id // 2) % 500 as k, event_id, value from events), both_ as (select k, event_id, value, 0 as n from keyed where event_id % 2 = 0 union all select k, event_id, value * 2, 1 from keyed where event_id % 2 <> 0)
    select k, event_id, value from (select *, row_number() over (partition by k order by n desc, event_id desc) as rn from both_) where rn = 1"""
)
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of all events, odd ids over even ones."""
    e = views.read(spark, sf_dir, "events").select((F.floor(c("event_id") / 2).cast("long") % 500).alias("k"), "event_id", "value")
    return upkeep.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0").withColumn("value", c("value") * 2), ["k"], ["event_id"])


@query(f"with {views.BARS_SQL} select asset_class, symbol, count(distinct session_date) as sessions, min(session_date) as first_session, max(session_date) as last_session, count(distinct year(session_date)) as years from bars group by all")
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per instrument."""
    return views.bars(spark, sf_dir).groupBy("asset_class", "symbol").agg(
        F.count_distinct("session_date").alias("sessions"), F.min("session_date").alias("first_session"), F.max("session_date").alias("last_session"), F.count_distinct(F.year("session_date")).alias("years")
    )


@query(f"with {views.BARS_SQL} select asset_class, symbol, session_date, close from bars where session_date in (select distinct session_date from bars order by 1 desc limit 252)")
def training_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the last 252 sessions."""
    return upkeep.last_sessions(views.bars(spark, sf_dir), 252).select(*KEY, "close")


@query(
    f"""with {views.BARS_SQL}, cut as (select min(d) as cut from (select distinct session_date as d from bars order by 1 desc limit 252)),
    tagged as (select b.*, b.session_date < cut as old from bars b, cut), n as (select count(*) filter (where old) as o, count(*) as a, greatest(0, 20000 - count(*) filter (where not old)) as budget from tagged),
    numbered as (select *, row_number() over (partition by old order by session_date, asset_class, symbol) as rn from tagged),
    strided as (select *, greatest(2, ceil(o / greatest(1, budget))::bigint) as stride from numbered, n)
    select asset_class, symbol, session_date from strided where a <= 20000 or (not old and (budget > 0 or rn > a - o - 20000)) or (old and budget > 0 and (o <= budget or ((rn - 1) % stride = 0 and (rn - 1) // stride >= ceil(o / stride) - budget)))"""
)
def training_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20,000 bars: recent sessions whole, older rows by stride."""
    return upkeep.cap_training(views.bars(spark, sf_dir), 20_000, 252, ["session_date", "asset_class", "symbol"]).select(*KEY)


@query(
    f"""with {views.BARS_SQL}, d as (select count(*) - count(distinct (asset_class, symbol, session_date)) as duplicates from bars)
    select count(*) as n_rows, count(case when not (open > 0 and high > 0 and low > 0 and close > 0 and high >= greatest(open, close, low) and low <= least(open, close, high)) then 1 end) as invalid_bars,
           count(case when close is null then 1 end) as missing_close, count(case when volume < 0 then 1 end) as negative_volume, min(session_date) as first_session, max(session_date) as last_session, any_value(duplicates)::bigint as duplicates from bars, d"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of the price table."""
    return upkeep.quality_report(views.bars(spark, sf_dir), KEY)


@query("select o_orderpriority as family, max(case when o_orderstatus = 'F' then v end) as f_last, max(case when o_orderstatus = 'O' then v end) as o_last, max(case when o_orderstatus = 'P' then v end) as p_last from (select o_orderpriority, o_orderstatus, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) as v from orders group by all) group by all")
def pivot_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long to wide with the last value of each cell."""
    o = views.read(spark, sf_dir, "orders")
    out = o.groupBy(c("o_orderpriority").alias("family")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")))
    return out.select("family", c("F").alias("f_last"), c("O").alias("o_last"), c("P").alias("p_last"))


_CASES = f"""{_BASE}, cases as materialized (
  select *, year(session_date) as fold, case when ret_1d is null then 0.5 else round(1 / (1 + exp(-least(greatest(3 * ret_1d, -50), 50))), 6) end as pa, case when ret_1d is null then 0.5 else round(1 / (1 + exp(-least(greatest(-2 * ret_1d, -50), 50))), 6) end as pb,
         lead(close) over (partition by symbol order by session_date) / close - 1 as y_ret from base),
  bank as materialized (select asset_class, symbol, session_date, fold, market_family, y_ret, (y_ret > 0)::int as y, 'momentum' as model, pa as p from cases where y_ret is not null
           union all select asset_class, symbol, session_date, fold, market_family, y_ret, (y_ret > 0)::int, 'reversal', pb from cases where y_ret is not null)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a case whose outcome is known: context, y_ret, y and the probabilities pa and pb of two models that read only the past return."""
    b = _base(spark, sf_dir)
    line = technical.Window.partitionBy("asset_class", "symbol").orderBy("session_date")
    p = lambda k: F.coalesce(F.round(cols.sigmoid(k * c("ret_1d")), 6), F.lit(0.5))
    b = b.withColumn("y_ret", cols.ratio(F.lead("close").over(line), c("close")) - 1).where("y_ret is not null")
    return b.withColumns({"y": (c("y_ret") > 0).cast("int"), "pa": p(3.0), "pb": p(-2.0)})


def banked(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of predicted(), one for each model, with the columns named in more."""
    both = F.array(F.struct(F.lit("momentum").alias("model"), c("pa").alias("p")), F.struct(F.lit("reversal").alias("model"), c("pb").alias("p")))
    rows = rows.withColumns({"fold": F.year("session_date"), "market_family": cols.market_family(c("asset_class")), "z": F.explode(both)})
    return rows.select(*KEY, "fold", "market_family", "y_ret", "y", "z.model", "z.p", *more)


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of out-of-sample predictions, folds by year; computed once for all queries."""
    return stored(banked(predicted(spark, sf_dir)), "bank")


_LL = "-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))"
_BIN = " + ".join(f"(case when p >= {e!r} then 1 else 0 end)" for e in scores.EDGES[1:])
_HIT = "case when (p >= 0.5) = (y = 1) then 1.0::double else 0.0::double end"


@query(
    f"""with {_CASES}, ranked as (select *, rank() over (partition by fold, model order by p) + (count(*) over (partition by fold, model, p) - 1) / 2.0::double as rk from bank),
    one as (select fold, model, count(*) as n, avg({_LL}) as logloss, avg((p - y) ** 2) as brier, avg({_HIT}) as accuracy, sum(y)::double as n1, sum(case when y = 1 then rk end) as s1 from ranked group by all),
    bins as (select fold, model, {_BIN} as b, count(*) as k, abs(avg(p) - avg(y)) as gap from bank group by all), eces as (select fold, model, sum(k * gap) / sum(k) as ece from bins group by all)
    select fold, model, n, {_r('logloss', 'logloss')}, {_r('brier', 'brier')}, {_r('accuracy', 'accuracy')}, {_r('(s1 - n1 * (n1 + 1) / 2) / nullif(n1 * (n - n1), 0)', 'roc_auc')}, {_r('ece', 'ece')} from one join eces using (fold, model)"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss, Brier score, accuracy, AUC and calibration error of each fold and model."""
    return rounded(scores.binary_metrics(bank(spark, sf_dir), ["fold", "model"]))


@query(
    f"""with {_CASES} select fold, model, asset_class, market_family, count(*) as n, {_r(f'avg({_LL})', 'logloss')}, {_r('avg((p - y) ** 2)', 'brier')}, {_r(f'avg({_HIT})', 'accuracy')} from bank
    group by grouping sets ((model), (model, market_family), (model, asset_class), (model, fold), (model, fold, asset_class)) having count(*) >= 30"""
)
def segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every scope in one pass over grouping sets."""
    dims = ["fold", "model", "asset_class", "market_family"]
    sets = [["model"], ["model", "market_family"], ["model", "asset_class"], ["model", "fold"], ["model", "fold", "asset_class"]]
    return rounded(scores.segment_metrics(bank(spark, sf_dir), dims, sets))


@query(
    f"""with {_CASES}, ranked as (select *, rank() over (partition by session_date, model order by y_ret) + (count(*) over (partition by session_date, model, y_ret) - 1) / 2.0::double as ry, rank() over (partition by session_date, model order by p) + (count(*) over (partition by session_date, model, p) - 1) / 2.0::double as rs from bank)
    select session_date, model, count(*) as n, {_r('corr(ry, rs)', 'rank_ic')} from ranked group by session_date, model having count(*) >= 5 and count(distinct y_ret) >= 2 and count(distinct p) >= 2"""
)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman correlation of prediction and outcome per session and model."""
    rows = bank(spark, sf_dir).select("session_date", "model", "y_ret", "p")
    return rounded(scores.rank_ic(dealt(rows, "session_date", "model"), ["session_date", "model"], "y_ret", "p"))


@query(
    f"""with {_CASES}, s as (select session_date, model, avg({_LL}) as loss from bank group by all),
    z as (select *, -0.5 * coalesce(sum(loss) over (partition by model order by session_date rows between unbounded preceding and 2 preceding), 0) as z from s),
    e as (select *, exp(z - max(z) over (partition by session_date)) as e from z) select session_date, model, {_r('e / sum(e) over (partition by session_date)', 'weight')} from e"""
)
def online_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online expert weights with an outcome delay of one session, as a running sum."""
    s = bank(spark, sf_dir).groupBy("session_date", "model").agg(F.avg(scores.log_loss(c("y"), c("p"))).alias("loss"))
    return rounded(scores.expert_average(s, 0.5, 1).select("session_date", "model", "weight"))


@query(
    f"""with {_CASES}, s as (select session_date, model, avg({_LL}) as loss from bank group by all),
    d as (select session_date, max(case when model = 'momentum' then loss end) as a, max(case when model = 'reversal' then loss end) as b, row_number() over (order by session_date) as rn from s group by session_date),
    """.replace("with ", "with recursive ", 1)
    + f"""f(rn, session_date, wa, wb) as (select rn, session_date, 0.5::double, 0.5::double from d where rn = 1 union all
      select n.rn, n.session_date, 0.95 * (f.wa * exp(-0.5 * coalesce(p.a, 0)) / (f.wa * exp(-0.5 * coalesce(p.a, 0)) + f.wb * exp(-0.5 * coalesce(p.b, 0)))) + 0.025,
             0.95 * (f.wb * exp(-0.5 * coalesce(p.b, 0)) / (f.wa * exp(-0.5 * coalesce(p.a, 0)) + f.wb * exp(-0.5 * coalesce(p.b, 0)))) + 0.025 from f join d p on p.rn = f.rn join d n on n.rn = f.rn + 1)
    select session_date, {_r('wa', 'w_momentum')}, {_r('wb', 'w_reversal')} from f"""
)
def online_experts_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online expert weights with a fixed share."""
    s = bank(spark, sf_dir).groupBy("session_date", "model").agg(F.avg(scores.log_loss(c("y"), c("p"))).alias("loss"))
    out = scores.shared_expert_average(s, 0.5, 0.05, ["momentum", "reversal"])
    return rounded(out.select("session_date", c("weights")[0].alias("w_momentum"), c("weights")[1].alias("w_reversal")))


@query(
    f"""with {_CASES}, cal as (select fold, model, abs(y - p) as score from bank where month(session_date) <= 6), test as (select *, abs(y - p) as score from bank where month(session_date) > 6),
    both_ as (select fold, model, score, 1 as k, null as row_id from cal union all select fold, model, score, 0, symbol || '|' || session_date from test)
    select row_id, fold, model, {_r('(1 + n_above) / (n + 1)', 'p_value', 6)} from (select *, sum(k) over (partition by fold, model order by score desc range unbounded preceding) as n_above, sum(k) over (partition by fold, model) as n from both_) where k = 0"""
)
def conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split conformal p-values by fold and model."""
    rows = bank(spark, sf_dir).withColumns({"score": F.abs(c("y") - c("p")), "row_id": F.concat_ws("|", "symbol", c("session_date").cast("string"))})
    first = F.month("session_date") <= 6
    out = scores.conformal_p_values(rows.where(first), rows.where(~first), ["fold", "model"])
    return rounded(out.select("row_id", "fold", "model", "p_value"), 6)


@query(
    f"""with {_BASE}, w as (select *, list(abs(ret_1d)) filter (where ret_1d is not null) over (partition by symbol order by session_date rows between 252 preceding and 1 preceding) as b from base)
    select asset_class, symbol, session_date, {_r('case when len(b) >= 200 then list_sort(b)[least(ceil((len(b) + 1) * (1 - 0.2::double)), len(b))::int] end', 'half_width')} from w"""
)
def residual_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conservative quantile of the last 252 absolute residuals before each row."""
    out = scores.residual_interval(_base(spark, sf_dir), ["asset_class", "symbol"], "session_date", "ret_1d")
    return rounded(out.select(*KEY, "half_width"))


@query("with s as (select lag(event_type) over (partition by user_id order by ts, event_id) as from_state, event_type as to_state from events), n as (select from_state, to_state, count(*) as n from s where from_state is not null group by all) select *, round(n / sum(n) over (partition by from_state), 6) as share from n")
def markov_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition counts and shares between a user's consecutive events."""
    e = views.read(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return rounded(scores.markov_transitions(e, ["user_id"], "o", "event_type"), 6)


@query(
    f"""with {_CASES}, e as (select symbol, session_date, model, p - y as e, (p >= 0.5) <> (y = 1) as w from bank)
    select a.model as model_a, b.model as model_b, {_r('corr(a.e, b.e)', 'error_corr')}, {_r('sum((a.w and b.w)::int) / sum((a.w or b.w)::int)', 'error_jaccard')}
    from e a join e b on a.symbol = b.symbol and a.session_date = b.session_date and a.model < b.model group by all"""
)
def error_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and overlap of the models' errors."""
    return rounded(scores.error_overlap(bank(spark, sf_dir), KEY))


@query(
    f"""with {_CASES}, m as (select fold, model, avg({_LL}) as logloss from bank group by all), t as (select distinct fold as t from m),
    w as (select t, model, power(0.5, (t - fold) / 2.0::double) as w, logloss from m, t where fold < t), g as (select t, model, sum(w * logloss) / sum(w) as mu, sum(w * logloss * logloss) / sum(w) as q, count(*) as n_prior from w group by all)
    select t as fold, model, round(mu + 0.25 * sqrt(greatest(q - mu * mu, 0)), 4) as score, n_prior from g"""
)
def prior_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each model at each fold from earlier folds only."""
    m = bank(spark, sf_dir).groupBy("fold", "model").agg(F.avg(scores.log_loss(c("y"), c("p"))).alias("logloss"))
    return rounded(scores.prior_fold_score(m))


@query(
    f"""with {views.BARS_SQL}, d as (select distinct session_date from bars), r as (select *, row_number() over (order by session_date) - 1 as i, count(*) over () as n from d),
    f as (select *, unnest(range(0, floor((n - 252 - 1 - 1) / 21)::bigint + 1)) as fold from r where n > 253), g as (select *, 252 + fold * 21 as e from f)
    select fold::int as fold, case when i < e - 1 then 'train' else 'test' end as role, session_date from g where i < e - 1 or (i >= e + 1 and i < e + 1 + 21)"""
)
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purged walk-forward folds over the sessions."""
    return scores.walk_forward(views.bars(spark, sf_dir), 252, 21, 21)


_PRED = f"""{_CASES}, preds as (select asset_class, symbol, session_date, session_date as prediction_date, pa as p_up_1d, ret_1d as expected_return_1d from cases where ret_1d is not null)"""
_PCT = lambda x, d: f"(rank() over (partition by prediction_date, asset_class order by {x} {d}) + (count(*) over (partition by prediction_date, asset_class, {x}) - 1) / 2.0::double) / count(*) over (partition by prediction_date, asset_class)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _base(spark, sf_dir).where("ret_1d is not null")
    p = F.coalesce(F.round(cols.sigmoid(3.0 * c("ret_1d")), 6), F.lit(0.5))
    return b.select(*KEY, c("session_date").alias("prediction_date"), p.alias("p_up_1d"), c("ret_1d").alias("expected_return_1d"), c("available_at").alias("prediction_time"))


@query(
    f"""with {_PRED}, s as (select *, round(0.5 * {_PCT('p_up_1d', 'desc')} + 0.5 * {_PCT('expected_return_1d', 'desc')}, 9) as rank_score from preds)
    select asset_class, symbol, prediction_date, round(rank_score, 6) as rank_score, rank() over (partition by prediction_date, asset_class order by rank_score desc) + (count(*) over (partition by prediction_date, asset_class, rank_score) - 1) / 2.0::double as rank from s"""
)
def cross_sectional_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking of predictions within date and asset class."""
    keys = ["prediction_date", "asset_class"]
    rows = table(_predictions(spark, sf_dir).select(*keys, "symbol", "p_up_1d", "expected_return_1d"), "ranked-predictions")
    out = cross.cross_sectional_rank(dealt(rows, *keys), keys)
    return rounded(out.select("asset_class", "symbol", "prediction_date", "rank_score", "rank"), 6)


@query(
    f"""with {_PRED}, o as (select asset_class, symbol, session_date, stock_splits <> 0 or coalesce(lead(stock_splits) over w, 0) <> 0 as sp, lead(close) over w / close - 1 as r from bars window w as (partition by symbol order by session_date)),
    j as (select p.*, r as outcome from preds p join o using (asset_class, symbol, session_date) where not sp and r is not null), s as (select *, -expected_return_1d as rank_score from j),
    q as (select *, count(*) over (partition by prediction_date) as n, (rank() over (partition by prediction_date order by rank_score) + (count(*) over (partition by prediction_date, rank_score) - 1) / 2.0::double) / count(*) over (partition by prediction_date) as pct from s),
    d as (select prediction_date, max(n) as n, avg(outcome) filter (where pct >= 1 - 0.1::double) - avg(outcome) filter (where pct <= 0.1::double) as gross from q where n >= 20 group by all),
    g as (select *, gross - 2 * cost_bps / 10000 as net from d, (select unnest([0.0::double, 5.0::double, 10.0::double, 20.0::double]) as cost_bps)),
    held as (select *, product(1 + coalesce(net, 0)) over (partition by cost_bps order by prediction_date) as equity from g), k as (select *, equity / nullif(max(equity) over (partition by cost_bps order by prediction_date), 0) - 1 as drawdown from held)
    select prediction_date, cost_bps, n, {_r('gross', 'gross')}, {_r('net', 'net')}, sign(equity)::int as equity_sign, {_r('ln(abs(nullif(equity, 0)))', 'log_equity')}, {_r('ln(1 - drawdown)', 'log_drawdown')} from k"""
)
def backtest_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily long/short returns at four costs."""
    p = _predictions(spark, sf_dir).withColumn("rank_score", -c("expected_return_1d"))
    out = cross.backtest(p, views.bars(spark, sf_dir), sleeve=())
    out = out.withColumns({"equity_sign": F.signum("equity").cast("int"), "log_equity": F.log(F.abs(F.nullif(c("equity"), F.lit(0.0)))), "log_drawdown": F.log(1 - c("drawdown"))})
    return rounded(out.select("prediction_date", "cost_bps", "n", "gross", "net", "equity_sign", "log_equity", "log_drawdown"))


_SHIFT = "(abs(b.q[1] - a.q[1]) + abs(b.q[2] - a.q[2]) + abs(b.q[3] - a.q[3]) + abs(b.q[4] - a.q[4]) + abs(b.q[5] - a.q[5])) / 5 / greatest(a.q[4] - a.q[2], a.s, 1e-8)"


@query(
    f"""with {_BASE}, r as (select unnest(['ret_1d', 'range_pct', 'volatility_20']) as feature, unnest([ret_1d, range_pct, volatility_20]) as x, year(session_date) as yr from base),
    p as (select feature, yr, quantile_cont(x, [0.1, 0.25, 0.5, 0.75, 0.9]) as q, stddev_pop(x) as s, count(x) as n, row_number() over (partition by feature order by yr) as rn from r group by feature, yr)
    select b.yr, {_r(f'avg({_SHIFT})', 'drift')}, count(*) as n_features from p a join p b on a.feature = b.feature and b.rn = a.rn + 1 where a.n >= 20 and b.n >= 20 group by b.yr"""
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution shift of features between each year and the one before."""
    b = _base(spark, sf_dir).withColumn("yr", F.year("session_date"))
    return rounded(scores.drift_between(b, "yr", ["ret_1d", "range_pct", "volatility_20"]))


@query("select event_id, json_extract(props, '$.k')::bigint as k, substr(sha256(event_type || '|' || user_id), 1, 24) as anonymous_id from events")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties and anonymous ids of events."""
    e = views.read(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), cols.anonymous_id(c("event_type"), c("user_id").cast("string")).alias("anonymous_id"))


@query(
    """with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0), d as (
      select q.vec_id as query_id, h.vec_id as neighbour_id, round(list_sum(list_transform(list_zip(q.embedding, h.embedding), lambda z: (z[1]::double - z[2]::double) ** 2)), 6) as distance from q, embeddings h where q.vec_id <> h.vec_id),
    r as (select *, row_number() over (partition by query_id order by distance, neighbour_id) as rank from d) select query_id, neighbour_id, distance, rank from r where rank <= 12"""
)
def case_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 nearest vectors of every 20th vector."""
    from tidemark.operators.retrieval import nearest

    ensure_importable(spark)
    e = views.read(spark, sf_dir, "embeddings")
    return rounded(nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding"), 6)


@query()
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible lines of the web pages."""
    from tidemark.sources.parsers import html_lines

    return html_lines(views.read(spark, sf_dir, "pages"), "page_id", "html")


@query(
    r"""with i as (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1, 's') as items from pages), u as (select page_id, unnest(items) as x, unnest(range(0, len(items))) as row_no from i)
    select page_id, row_no::int as row_no, '' as section, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as cell from u"""
)
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of the web pages, whose lists stand for tables, as these pages have none."""
    from tidemark.sources.parsers import html_table_rows

    pages = views.read(spark, sf_dir, "pages")
    pages = pages.withColumn("html", F.replace(F.replace("html", F.lit("<li>"), F.lit("<tr><td>")), F.lit("</li>"), F.lit("</td></tr>")))
    return html_table_rows(pages, "page_id", "html").select("page_id", "row_no", "section", c("cells")[0].alias("cell"))


@query(
    "select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"
)
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over event time, the streaming aggregate run over the bounded table."""
    from tidemark.streaming.incremental import tumbling

    e = views.read(spark, sf_dir, "events")
    return rounded(tumbling(e, "ts", "1 hour", "10 minutes", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total")))


@query(
    """with g as (select *, case when ts - lag(ts) over w >= interval 30 minute or lag(ts) over w is null then 1 else 0 end as brk from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(brk) over (partition by user_id order by ts, event_id) as sid from g)
    select min(ts) as window_start, max(ts) + interval 30 minute as window_end, user_id, count(*) as n from s group by user_id, sid"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows with a gap of 30 minutes."""
    from tidemark.streaming.incremental import sessions

    return sessions(views.read(spark, sf_dir, "events"), "ts", "30 minutes", "10 minutes", ["user_id"], F.count("*").alias("n"))


@query(
    f"""with {_CASES}, m as (select fold, model, avg({_LL}) as logloss from bank group by all),
    n as (select *, count(*) over (partition by model) as n, row_number() over (partition by model order by fold) as rn from m), w as (select *, case when n >= 3 then 1 + (rn - 1) / (n - 1)::double else 1.0::double end as w from n)
    select model, count(*) as n_folds, {_r('avg(logloss)', 'mean')}, {_r('coalesce(stddev_samp(logloss), 0)', 'std')}, {_r('sum(w * logloss) / sum(w)', 'recent')}, substr(sha256(string_agg(fold::varchar, ',' order by fold::varchar)), 1, 16) as signature,
           {_r('0.5 * avg(logloss) + 0.5 * sum(w * logloss) / sum(w)', 'selection')} from w group by model"""
)
def fold_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, recency-weighted mean and fold signature of each model."""
    from tidemark.operators.evidence import fold_summary

    m = bank(spark, sf_dir).groupBy("fold", "model").agg(F.avg(scores.log_loss(c("y"), c("p"))).alias("logloss"))
    return rounded(fold_summary(m))


@query(
    f"""with {_BASE}, l as (select *, -2 * volatility_20 as lo, 2 * volatility_20 as hi, lead(ret_1d) over (partition by symbol order by session_date) as y from base), m as (select *, greatest(lo - y, 0) + greatest(y - hi, 0) as miss from l where y is not null and lo is not null)
    select asset_class, count(*) as n, {_r('avg((hi - lo) + 2 / 0.2::double * miss)', 'interval_score')}, {_r('avg((miss = 0)::int)', 'coverage')}, {_r('avg(hi - lo)', 'width')}, {_r('avg((miss >= 0.05)::int)', 'severe_miss')} from m group by asset_class"""
)
def interval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, coverage and severe misses of volatility intervals."""
    from tidemark.operators.evidence import interval_metrics

    line = technical.Window.partitionBy("asset_class", "symbol").orderBy("session_date")
    rows = _base(spark, sf_dir).withColumns({"lo": -2 * c("volatility_20"), "hi": 2 * c("volatility_20"), "next": F.lead("ret_1d").over(line)})
    return rounded(interval_metrics(rows, ["asset_class"], "next", "lo", "hi"))


@query(
    f"""with {_PRED}, o as (select asset_class, symbol, session_date, lead(close) over w / close - 1 as y_ret from bars window w as (partition by symbol order by session_date)),
    j as (select p.*, p_up_1d as p, (y_ret > 0)::int as y from preds p join o using (asset_class, symbol, session_date) where y_ret is not null), last as (select distinct session_date from j order by 1 desc limit 20)
    select asset_class, count(*) as n, {_r(f'avg({_LL})', 'logloss')}, {_r(f'avg({_HIT})', 'accuracy')}, count(case when session_date in (select session_date from last) then 1 end) as n_recent from j group by asset_class"""
)
def outcome_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved predictions by asset class, with those of the last 20 sessions counted."""
    from tidemark.operators.audits import resolve

    rows = resolve(_predictions(spark, sf_dir), views.bars(spark, sf_dir)).withColumn("p", c("p_up_1d"))
    last = rows.select(c("session_date").alias("__d")).distinct().orderBy(c("__d").desc()).limit(20)
    rows = rows.join(last, c("session_date") == c("__d"), "left")
    hit = F.avg(F.when((c("p") >= 0.5) == (c("y") == 1), 1.0).otherwise(0.0))
    return rounded(rows.groupBy("asset_class").agg(F.count("*").alias("n"), F.avg(scores.log_loss(c("y"), c("p"))).alias("logloss"), hit.alias("accuracy"), F.count("__d").alias("n_recent")))


@query(
    f"""with {views.BARS_SQL}, e as (select asset_class, symbol, week_start from (select distinct asset_class, symbol from bars), (select distinct date_trunc('week', session_date)::date as week_start from bars)), o as (select distinct asset_class, symbol, date_trunc('week', session_date)::date as week_start from bars)
    select * from e except select * from o"""
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument-weeks without a bar: expected less observed."""
    from tidemark.operators.audits import missing_keys

    b = views.bars(spark, sf_dir).select("asset_class", "symbol", F.trunc("session_date", "week").alias("week_start"))
    span = b.select("week_start").distinct().agg(F.collect_set("week_start").alias("weeks"))  # a date a week
    expected = b.select("asset_class", "symbol").distinct().join(F.broadcast(span)).select("asset_class", "symbol", F.explode("weeks").alias("week_start"))
    return missing_keys(expected, b, ["asset_class", "symbol", "week_start"])
