"""Answers from the analysis table. Money stays decimal until the last step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import MONEY, as_double, ratio
from ..policy import Policy


def _sum(c) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(28,2)"))


def completed(table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return table.where(F.col("status").isin(*policy.revenue_statuses))


def revenue_totals(table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """orders, gross_revenue, total_discount, net_revenue, promoted_orders, discount_rate."""
    sums = completed(table, policy).agg(F.count("*").alias("orders"), _sum("amount").alias("g"), _sum("discount").alias("d"), F.count_if(F.col("discount") > 0).alias("promoted_orders"))
    return sums.select("orders", as_double(F.col("g")).alias("gross_revenue"), as_double(F.col("d")).alias("total_discount"), as_double(F.col("g") - F.col("d")).alias("net_revenue"), "promoted_orders", ratio(F.col("d"), F.col("g")).alias("discount_rate"))


def status_breakdown(table: DataFrame) -> DataFrame:
    """status, orders, value."""
    return table.groupBy("status").agg(F.count("*").alias("orders"), as_double(_sum("amount")).alias("value"))


def _segments(customers: DataFrame, policy: Policy) -> DataFrame:
    unknown = customers.sparkSession.range(1).select(F.lit(policy.unknown_segment).alias("segment"))
    return customers.select("segment").where(F.col("segment").isNotNull()).union(unknown).distinct()


def revenue_by_segment(table: DataFrame, customers: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """segment, orders, revenue, discounts, net_revenue, pct_of_revenue, avg_order_value, largest first.

    Every segment that a customer has is a row, with zeros if none of its orders counts.
    """
    measured = completed(table, policy).groupBy("segment").agg(F.count("*").alias("orders"), F.sum("amount").alias("revenue"), F.sum("discount").alias("discounts"))
    rows = _segments(customers, policy).join(measured, "segment", "left")
    rows = rows.select("segment", F.coalesce("orders", F.lit(0)).alias("orders"), *(F.coalesce(c, F.lit(0).cast("decimal(28,2)")).alias(c) for c in ("revenue", "discounts")))
    total = F.sum("revenue").over(Window.partitionBy())  # over as many rows as there are segments
    return rows.select(
        "segment",
        "orders",
        as_double(F.col("revenue")).alias("revenue"),
        as_double(F.col("discounts")).alias("discounts"),
        as_double(F.col("revenue") - F.col("discounts")).alias("net_revenue"),
        (ratio(F.col("revenue"), total) * 100).alias("pct_of_revenue"),
        F.coalesce(ratio(F.col("revenue"), F.col("orders")), F.lit(0.0)).alias("avg_order_value"),
    ).orderBy(F.desc("revenue"), "segment")


def segment_checksum(table: DataFrame, customers: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """total_revenue, segments_revenue, is_equal: by exact decimals."""
    done = completed(table, policy)
    parts = _segments(customers, policy).join(done.groupBy("segment").agg(F.sum("amount").alias("r")), "segment").agg(_sum("r").alias("p"))
    both = done.agg(_sum("amount").alias("t")).crossJoin(parts)  # one row by one row
    return both.select(as_double(F.col("t")).alias("total_revenue"), as_double(F.col("p")).alias("segments_revenue"), (F.col("t") == F.col("p")).alias("is_equal"))


def _by_customer(table: DataFrame, policy: Policy, known: bool = True) -> DataFrame:
    rows = completed(table, policy).where(F.col("is_known_customer") == known)
    return rows.groupBy("customer_id", "customer_name", "segment", "region").agg(F.count("*").alias("orders"), F.sum("amount").alias("revenue"), F.sum("discount").alias("discounts"))


def top_customers(table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """rank, customer_id, customer_name, segment, region, orders, revenue, discounts, net_revenue; ties by customer_id."""
    best = _by_customer(table, policy).orderBy(F.desc("revenue"), "customer_id").limit(policy.top_customers)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("revenue"), "customer_id")))
    return ranked.select(
        "rank", "customer_id", "customer_name", "segment", "region", "orders", as_double(F.col("revenue")).alias("revenue"), as_double(F.col("discounts")).alias("discounts"), as_double(F.col("revenue") - F.col("discounts")).alias("net_revenue")
    )


def top_share(table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """top_revenue, total_revenue, share of the top customers."""
    best = _by_customer(table, policy).orderBy(F.desc("revenue"), "customer_id").limit(policy.top_customers).agg(_sum("revenue").alias("b"))
    both = best.crossJoin(completed(table, policy).agg(_sum("amount").alias("t")))
    return both.select(as_double(F.col("b")).alias("top_revenue"), as_double(F.col("t")).alias("total_revenue"), ratio(F.col("b"), F.col("t")).alias("share"))


def rank_gap(table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """last_in, first_out, gap, gap_ratio around the cut of the ranking; null where there are too few customers."""
    n = policy.top_customers
    best = _by_customer(table, policy).orderBy(F.desc("revenue"), "customer_id").limit(n + 1)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("revenue"), "customer_id")))
    at = ranked.agg(F.max(F.when(F.col("rank") == n, F.col("revenue"))).alias("a"), F.max(F.when(F.col("rank") == n + 1, F.col("revenue"))).alias("b"))
    return at.select(as_double(F.col("a")).alias("last_in"), as_double(F.col("b")).alias("first_out"), as_double(F.col("a") - F.col("b")).alias("gap"), ratio(F.col("a") - F.col("b"), F.col("a")).alias("gap_ratio"))


def unmatched_against_top(table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """largest_unmatched, last_in: could an unmatched customer reach the ranking?"""
    unmatched = completed(table, policy).where(~F.col("is_known_customer")).groupBy("customer_id").agg(F.sum("amount").alias("r")).agg(as_double(F.max("r")).alias("largest_unmatched"))
    return unmatched.crossJoin(rank_gap(table, policy).select("last_in"))


def cap_summary(table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """n_stacked, n_capped, n_capped_completed, reduction, reduction_completed, n_unknown over all statuses."""
    over, done = F.col("discount_raw") > F.col("amount"), F.col("status").isin(*policy.revenue_statuses)
    cut = F.col("discount_raw") - F.least("discount_raw", "amount")
    return table.agg(
        F.count_if(F.col("n_promos") > 1).alias("n_stacked"),
        F.count_if(over).alias("n_capped"),
        F.count_if(over & done).alias("n_capped_completed"),
        as_double(_sum(cut)).alias("reduction"),
        as_double(_sum(F.when(done, cut))).alias("reduction_completed"),
        F.count_if(~F.col("is_known_customer")).alias("n_unknown"),
    )


def single_promotions_over_amount(orders: DataFrame, promotions: DataFrame) -> DataFrame:
    """n_single_over: promotions that alone exceed their order's amount."""
    both = promotions.join(orders.distinct().select("order_id", "amount"), "order_id")
    return both.agg(F.count_if(F.col("discount_amount") > F.col("amount")).alias("n_single_over"))


def naive_overstatement(orders: DataFrame, promotions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """What a join before collapsing would say: order_rows, naive_rows, naive_revenue, clean_revenue, overstatement, ratio."""
    is_done = F.col("status").isin(*policy.revenue_statuses)
    naive = orders.join(promotions.select("order_id"), "order_id", "left").agg(F.count("*").alias("naive_rows"), _sum(F.when(is_done, F.col("amount"))).alias("n"))
    clean = orders.distinct().where(is_done).agg(_sum("amount").alias("c"))
    rows = orders.agg(F.count("*").alias("order_rows"))
    return rows.crossJoin(naive).crossJoin(clean).select(  # one row each
        "order_rows", "naive_rows", as_double(F.col("n")).alias("naive_revenue"), as_double(F.col("c")).alias("clean_revenue"), as_double(F.col("n") - F.col("c")).alias("overstatement"), (ratio(F.col("n"), F.col("c")) - 1).alias("overstatement_ratio")
    )


# The labels of the scenario report, in its order.
SCENARIOS = (
    "Baseline (completed only, discounts capped)",
    "Include refunded as revenue (gross bookings)",
    "Drop orders with unknown customer",
    "Discounts uncapped (allow negative net)",
    "Duplicate orders NOT dropped",
)


def scenario_table(table: DataFrame, orders: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """number, scenario, total_revenue, net_revenue, delta_vs_baseline, delta_pct: one pass over the table, one over the raw orders."""
    done, booked, known = F.col("status").isin(*policy.revenue_statuses), F.col("status").isin(*policy.revenue_statuses, "refunded"), F.col("is_known_customer")
    capped, raw = F.col("amount") - F.least("discount_raw", "amount"), F.col("amount") - F.col("discount_raw")

    def total(condition, value):
        return _sum(F.when(condition, value))

    one = table.agg(
        total(done, F.col("amount")).alias("t1"), total(done, capped).alias("n1"), total(booked, F.col("amount")).alias("t2"), total(booked, capped).alias("n2"),
        total(done & known, F.col("amount")).alias("t3"), total(done & known, capped).alias("n3"), total(done, raw).alias("n4"),
    ).withColumn("t4", F.col("t1"))
    two = orders.agg(total(done, F.col("amount")).alias("t5")).withColumn("n5", F.lit(None).cast("decimal(28,2)"))
    rows = one.crossJoin(two).select("t1", F.inline(F.array(*(F.struct(F.lit(k).alias("number"), F.lit(name).alias("scenario"), F.col(f"t{k}").alias("t"), F.col(f"n{k}").alias("n")) for k, name in enumerate(SCENARIOS, 1)))))
    delta = F.col("t") - F.col("t1")
    return rows.select("number", "scenario", as_double(F.col("t")).alias("total_revenue"), as_double(F.col("n")).alias("net_revenue"), as_double(delta).alias("delta_vs_baseline"), (ratio(delta, F.col("t1")) * 100).alias("delta_pct"))
