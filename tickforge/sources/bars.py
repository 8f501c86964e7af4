"""Adapters that read the shared tables as OHLCV bars, vectors and windows.

Bars have one row per (ticker, Date) with Open, High, Low, Close, Volume. Each adapter is one
aggregation, partial before its shuffle, over pruned columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OHLC = ["Open", "High", "Low", "Close"]
OHLCV = [*OHLC, "Volume"]
KEYS = ["ticker", "Date"]


def ohlcv(rows: DataFrame, ticker, date, price, volume, order) -> DataFrame:
    """Bars from trades: first and last price by ``order``, extremes and summed volume."""
    row = rows.select(ticker.alias("ticker"), date.alias("Date"), price.alias("p"), volume.alias("v"), order.alias("o"))
    return row.groupBy(*KEYS).agg(
        F.min_by("p", "o").alias("Open"),
        F.max("p").alias("High"),
        F.min("p").alias("Low"),
        F.max_by("p", "o").alias("Close"),
        F.sum("v").alias("Volume"),
    )


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: a ticker per flag and status, a bar per ship date."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return ohlcv(
        rows.filter(F.col("l_quantity") != 0),
        F.concat("l_returnflag", "l_linestatus"),
        F.col("l_shipdate"),
        price,
        F.col("l_quantity"),
        F.struct("l_orderkey", "l_linenumber", price.alias("p")),
    )


def event_bars(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    """Events as trades: a ticker per type, a bar per day or hour, volume their number."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ohlcv(rows, F.col("event_type"), F.date_trunc(bucket, "ts"), F.col("value"), F.lit(1.0), F.struct("ts", "event_id"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(real, synthetic) vectors (id, v): embeddings of labels below 5, and the others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cut = rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    return cut.filter("label < 5").drop("label"), cut.filter("label >= 5").drop("label")
