"""The price panel built from the given tables: one bar per (supplier, ship date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.contract import CLOSE, DATE, HIGH, INDUSTRY, LOW, OPEN, SECTOR, TICKER, VOLUME
from panelspark.functions.scalar import ratio
from panelspark.session import table


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Open/close are the first/last unit price by (order, line); line numbers are 1-7."""
    lines = table(spark, folder, "lineitem")
    price = ratio("l_extendedprice", "l_quantity")
    position = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    daily = lines.groupBy("l_suppkey", F.to_date("l_shipdate").alias(DATE)).agg(
        F.min_by(price, position).alias(OPEN), F.max(price).alias(HIGH), F.min(price).alias(LOW),
        F.max_by(price, position).alias(CLOSE), F.sum("l_quantity").alias(VOLUME))
    return daily.select(DATE, F.col("l_suppkey").cast("string").alias(TICKER), OPEN, HIGH, LOW, CLOSE, VOLUME)


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, name, sector (nation) and industry (region); nation and region have 25 and 5 rows."""
    nation = table(spark, folder, "nation").join(
        F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return (table(spark, folder, "supplier")
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").cast("string").alias(TICKER), F.col("s_name").alias("company_name"),
                    F.col("n_name").alias(SECTOR), F.col("r_name").alias(INDUSTRY),
                    F.col("s_acctbal").alias("account_balance")))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return bars(spark, folder).join(
        companies(spark, folder).select(TICKER, SECTOR, INDUSTRY), TICKER, "left")
