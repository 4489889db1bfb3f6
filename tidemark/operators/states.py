"""Multi-session state features and per-row regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import clip, ratio, rolling, trailing

c = F.col


def temporal_state(bars: DataFrame, keys: Sequence[str] = ("asset_class", "symbol"), order: str = "session_date") -> DataFrame:
    """Causal changes of return, volatility, volume and range of each instrument, 24 columns."""
    keys = list(keys)
    line = Window.partitionBy(*keys).orderBy(order)
    r = lambda n: trailing(keys, order, n)
    lag = lambda x, n=1: F.lag(x, n).over(line)
    past = {f"ts_ret_{n}": ratio(c("close"), lag("close", n)) - 1 for n in (1, 2, 3, 5, 10)}
    one = bars.withColumns(
        past
        | {
            "__lv": F.log1p(clip(c("volume").cast("double"), low=0.0)),
            "__rg": ratio(c("high") - c("low"), c("close")),
            "__cl": clip(ratio(c("close") - c("low"), c("high") - c("low")), -1.0, 2.0),
        }
    )
    ret = c("ts_ret_1")
    pressure = lambda x: rolling(F.avg, x, r(5), 5) - rolling(F.avg, x, r(20), 20)
    new = {f"ts_path_return_{n}": c(f"ts_ret_{n}") for n in (3, 5, 10)}
    new |= {f"ts_return_sign_persistence_{n}": rolling(F.avg, F.signum(ret), r(n), n) for n in (3, 5, 10)}
    new |= {
        "ts_return_acceleration_1": ret - lag("ts_ret_1"),
        "ts_return_acceleration_3": c("ts_ret_3") - c("ts_ret_5") / 2,
        "ts_return_acceleration_5": c("ts_ret_5") - c("ts_ret_10") / 2,
        "ts_volatility_3": rolling(F.stddev_samp, ret, r(3), 3),
        "ts_volatility_10": rolling(F.stddev_samp, ret, r(10), 10),
        "ts_volatility_ratio_3_10": ratio(rolling(F.stddev_samp, ret, r(3), 3), rolling(F.stddev_samp, ret, r(10), 10)),
        "ts_volume_log_change_1": c("__lv") - lag("__lv"),
        "ts_volume_log_change_3": c("__lv") - lag("__lv", 3),
        "ts_volume_pressure_5": pressure(c("__lv")),
        "ts_range_change_1": c("__rg") - lag("__rg"),
        "ts_range_pressure_5": pressure(c("__rg")),
        "ts_close_location_change_1": c("__cl") - lag("__cl"),
        "ts_close_location_pressure_5": pressure(c("__cl")),
    }
    return one.withColumns(new).drop("__lv", "__rg", "__cl")
