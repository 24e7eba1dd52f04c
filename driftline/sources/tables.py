"""Inputs: tables of a folder, and series made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; only the columns asked for are scanned."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def ranked(df: DataFrame, keys: list[str], order_by: list[str | Column], y: str, tie: list[str] | None = None) -> DataFrame:
    """Keys, x = rank of the row in its series as double, y as double, n = rows of the series."""
    key = Window.partitionBy(*keys)
    place = F.row_number().over(key.orderBy(*order_by, *(tie or [])))
    return df.select(*keys, place.cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.count("*").over(key).alias("n"))


def user_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Values of each user's events by their order: user_id, x, y, n."""
    return ranked(read_table(spark, folder, "events", "event_id", "user_id", "value"), ["user_id"], ["event_id"], "value")


def daily_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """One long series: x = day since 1970, y = mean total price of the day's orders."""
    orders = read_table(spark, folder, "orders", "o_orderdate", "o_totalprice")
    day = F.unix_date(F.to_date("o_orderdate")).cast("double")
    return orders.groupBy(day.alias("x")).agg(F.avg("o_totalprice").alias("y"))


def brand_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Retail prices of each brand's parts by their order: p_brand, x, y, n."""
    return ranked(read_table(spark, folder, "part", "p_partkey", "p_brand", "p_retailprice"), ["p_brand"], ["p_partkey"], "p_retailprice")
