"""Synthetic customers, orders and promotions, made inside Spark by arithmetic on ids: the same rows however they are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import MONEY

FIRST_CUSTOMER, UNKNOWN_CUSTOMER = 100_001, 199_001


def _mixed(c: Column, factor: int, modulus: int) -> Column:
    return (c * F.lit(factor) + 12_345) % modulus


def customers(spark: SparkSession, n: int) -> DataFrame:
    k = F.col("id")
    segment = F.when(k % 5 == 0, "Enterprise").when(k % 5 == 1, "Mid-Market").otherwise("SMB")
    return spark.range(n).select((k + FIRST_CUSTOMER).cast("string").alias("customer_id"), F.concat(F.lit("Customer "), k.cast("string")).alias("customer_name"), segment.alias("segment"), F.concat(F.lit("Region "), (k % 4).cast("string")).alias("region"))


def orders(spark: SparkSession, n: int, n_customers: int, orphans_percent: int = 2) -> DataFrame:
    """n orders; of every hundred, `orphans_percent` have customers that don't exist. None is of a Mid-Market customer."""
    k = F.col("id")
    buyer = _mixed(k, 7919, n_customers)
    buyer = F.when(buyer % 5 == 1, (buyer + 1) % n_customers).otherwise(buyer)
    owner = F.when(k % 100 < orphans_percent, UNKNOWN_CUSTOMER + k % 50).otherwise(FIRST_CUSTOMER + buyer)
    status = F.when(k % 10 == 0, "refunded").when(k % 10 == 1, "cancelled").otherwise("completed")
    return spark.range(n).select(
        (k + 1).cast("string").alias("order_id"),
        owner.cast("string").alias("customer_id"),
        F.date_add(F.lit("2025-07-01").cast("date"), _mixed(k, 31, 364).cast("int")).alias("order_date"),
        ((_mixed(k, 104_729, 120_000) + 500).cast(MONEY) / 100).cast(MONEY).alias("amount"),
        status.alias("status"),
    )


def promotions(spark: SparkSession, n_orders: int) -> DataFrame:
    """Every twentieth order has a promotion, every hundredth two."""
    k = F.col("id")
    base = spark.range(n_orders).where(k % 20 == 0)
    both = base.select(k, F.explode(F.when(k % 100 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("part"))
    return both.select(
        F.concat_ws("-", (k + 1).cast("string"), F.col("part").cast("string")).alias("promotion_id"),
        (k + 1).cast("string").alias("order_id"),
        F.concat(F.lit("CODE"), F.col("part").cast("string")).alias("promo_code"),
        ((_mixed(k * F.col("part"), 7907, 6_000) + 100).cast(MONEY) / 100).cast(MONEY).alias("discount_amount"),
    )
