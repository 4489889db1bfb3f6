"""Panel tables built from the driver's star schema, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cols import local_time, ratio

#: Region of a supplier and the asset class it stands for (fixed values).
ASSET_CLASS = {"ASIA": "jp_stock", "MIDDLE EAST": "jp_etf", "AFRICA": "jp_reit", "AMERICA": "us_stock", "EUROPE": "us_etf"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one row (asset_class, symbol, session_date) with OHLCV, splits and the time they are known."""
    # all steps after this one, windows by symbol included, go by symbol: one exchange serves them
    line = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("session_date"), "l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_orderkey", "l_linenumber", "l_partkey"
    ).where("symbol is not null").repartition("symbol")
    price, tie = ratio(F.col("l_extendedprice"), F.col("l_quantity")), F.struct("l_orderkey", "l_linenumber", "l_partkey")
    daily = line.groupBy("symbol", "session_date").agg(
        F.min_by(price, tie).alias("open"),
        F.max(price * (1 + F.col("l_tax"))).alias("high"),
        F.min(price * (1 - F.col("l_discount"))).alias("low"),
        F.max_by(price, tie).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.when(F.max("l_discount") >= 0.10, 1.0).otherwise(0.0).alias("stock_splits"),
    )
    where = (
        read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    names = F.create_map(*[F.lit(x) for kv in ASSET_CLASS.items() for x in kv])
    where = where.select(F.col("s_suppkey").cast("string").alias("s_symbol"), F.element_at(names, F.col("r_name")).alias("asset_class"))
    out = daily.join(where, F.col("symbol") == F.col("s_symbol"))
    close_time = F.when(F.col("asset_class").startswith("jp_"), local_time(F.col("session_date"), "16:00:00", "Asia/Tokyo")).otherwise(
        local_time(F.col("session_date"), "16:30:00", "America/New_York")
    )
    return out.select("asset_class", "symbol", "session_date", close_time.alias("available_at"), "open", "high", "low", "close", "volume", "stock_splits")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro series: family, session_date, close, ret_1d, volatility_20, available_at (18:00 New York)."""
    from tidemark.functions.cols import rolling, trailing

    daily = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.to_date("o_orderdate").alias("session_date")).agg(F.avg("o_totalprice").alias("close"))
    w = trailing(["family"], "session_date", 20)
    line = trailing(["family"], "session_date", 1).rowsBetween(-1, -1)
    out = daily.withColumn("ret_1d", ratio(F.col("close"), F.first("close").over(line)) - 1)
    out = out.withColumn("volatility_20", rolling(F.stddev_samp, F.col("ret_1d"), w, 20))
    return out.withColumn("available_at", local_time(F.col("session_date"), "18:00:00", "America/New_York"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event filings: symbol, form, available_at, event_id."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("symbol"), F.col("event_type").alias("form"), F.col("ts").alias("available_at"), "event_id"
    )


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query times of the filings join: one row a symbol and day, at the day's end."""
    day = F.to_date("ts")
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("symbol"), day.alias("session_date")).agg(
        F.to_timestamp(F.date_add(F.first(day), 1)).alias("available_at"), F.sum("value").alias("close")
    )


BARS_SQL = """
line as (
  select l_suppkey, cast(l_shipdate as date) as session_date, l_quantity, l_discount, l_tax,
         case when l_quantity <> 0 then l_extendedprice / l_quantity end as price, row(l_orderkey, l_linenumber, l_partkey) as tie
  from lineitem),
daily as (
  select l_suppkey, session_date, arg_min(price, tie) as open, max(price * (1 + l_tax)) as high, min(price * (1 - l_discount)) as low,
         arg_max(price, tie) as close, sum(l_quantity) as volume, case when max(l_discount) >= 0.10 then 1.0::double else 0.0::double end as stock_splits
  from line group by all),
bars as (
  select case r_name when 'ASIA' then 'jp_stock' when 'MIDDLE EAST' then 'jp_etf' when 'AFRICA' then 'jp_reit' when 'AMERICA' then 'us_stock' else 'us_etf' end as asset_class,
         cast(l_suppkey as varchar) as symbol, session_date, open, high, low, close, volume, stock_splits
  from daily join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey)
"""

MACRO_SQL = """
series as (select o_orderpriority as family, cast(o_orderdate as date) as session_date, avg(o_totalprice) as close from orders group by all),
rets as (select *, close / lag(close) over (partition by family order by session_date) - 1 as ret_1d from series),
macro as (
  select *, case when count(ret_1d) over w = 20 then stddev_samp(ret_1d) over w end as volatility_20
  from rets window w as (partition by family order by session_date rows between 19 preceding and current row))
"""
