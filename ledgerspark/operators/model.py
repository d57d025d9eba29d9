"""The analysis table: one row for each distinct order, with its discounts and its customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import MONEY
from ..policy import Policy
from .joins import repeats_key, validated_join


class QCFailed(RuntimeError):
    """A hard check failed: no numbers are given."""


def distinct_orders(orders: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Exact duplicates dropped; order_id may still repeat with other values, see `assert_unique`.

    Equal rows meet by their order_id, so that the joins by it need no further exchange.
    """
    return orders.repartition("order_id").distinct() if policy.drop_exact_duplicates else orders


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    if repeats_key(df, key):
        raise QCFailed(f"{key} isn't unique")
    return df


def promotions_per_order(promotions: DataFrame) -> DataFrame:
    """order_id, discount_raw, promo_codes (sorted), n_promos: promotions are summed before any join."""
    return promotions.groupBy("order_id").agg(
        F.sum("discount_amount").cast(MONEY).alias("discount_raw"), F.array_join(F.sort_array(F.collect_list("promo_code")), " + ").alias("promo_codes"), F.count("*").alias("n_promos")
    )


def analysis_table(customers: DataFrame, orders: DataFrame, promotions: DataFrame, policy: Policy = Policy(), check: bool = False) -> DataFrame:
    """The orders' columns, discount_raw, promo_codes, n_promos, customer_name, segment, region, discount, is_known_customer.

    A customer is known by being matched, whatever its name or segment. check=True runs the uniqueness tests first.
    """
    distinct = distinct_orders(orders, policy)
    known = customers.withColumn("is_known_customer", F.lit(True))
    joined = validated_join(distinct, promotions_per_order(promotions), "order_id", validate="one_to_one", check=check)
    joined = validated_join(joined, known, "customer_id", validate="many_to_one", check=check)
    raw = F.coalesce("discount_raw", F.lit(0).cast(MONEY))
    table = joined.withColumn("discount_raw", raw).withColumns(
        {
            "discount": F.least("discount_raw", "amount") if policy.cap_discounts else F.col("discount_raw"),
            "is_known_customer": F.coalesce("is_known_customer", F.lit(False)),
            "segment": F.coalesce("segment", F.lit(policy.unknown_segment)),
        }
    )
    return table if policy.keep_unknown_customers else table.where("is_known_customer")
