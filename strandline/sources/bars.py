"""OHLCV bars from raw rows, and the canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The canonical columns, required then optional.
REQUIRED = ["source", "symbol", "instrument_type", "timeframe", "timestamp", "open", "high", "low", "close", "volume", "currency", "timezone"]
OPTIONAL = ["bid", "ask", "spread", "spread_bps", "adjusted_close", "corporate_action_flag", "session"]
KEY, ORDER = ["symbol", "session"], ["bar_index"]


def ohlcv(rows: DataFrame, keys: dict[str, Column], price: Column, order: Column) -> DataFrame:
    """One bar for each key: the first, highest, lowest and last price in order, and the number of rows. One partial-aggregated shuffle."""
    return rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of events by type and hour; a session is a date, bar_index the hour."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    keys = {"symbol": F.col("event_type"), "session": F.date_format("ts", "yyyy-MM-dd"), "bar_index": F.hour("ts")}
    return ohlcv(e, keys, F.col("value"), F.struct("ts", "event_id"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of orders by priority and date."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    keys = {"symbol": F.col("o_orderpriority"), "session": F.date_format("o_orderdate", "yyyy-MM-dd")}
    return ohlcv(o, keys, F.col("o_totalprice"), F.col("o_orderkey"))
