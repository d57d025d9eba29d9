"""The driver's star schema seen as customers, orders and promotions, with defects put in. As DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids from here on are the overlay's unknown customers.
UNKNOWN_BLOCK = 900_000_000


class Overlay:
    """Tables of one data folder; each is a lazy plan over the Parquet scans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @property
    def customers(self) -> DataFrame:
        nation, region = self.read("nation"), self.read("region")
        places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")  # 25 rows
        c = self.read("customer")
        return c.join(F.broadcast(places), c.c_nationkey == places.n_nationkey).select(
            F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region")
        )

    @property
    def _orders0(self) -> DataFrame:
        buyers = self.read("customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey")
        o = self.read("orders")
        return o.join(buyers, o.o_custkey == buyers.c_custkey).select(
            "o_orderkey",
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.when(F.col("o_orderkey") % 167 == 0, F.lit(UNKNOWN_BLOCK) + F.col("o_custkey")).otherwise(F.col("o_custkey")).cast("string").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "cancelled").when(F.col("o_orderstatus") == "P", "refunded").alias("status"),
        )

    @property
    def orders(self) -> DataFrame:
        o = self._orders0
        return o.union(o.where("o_orderkey % 50 = 0")).drop("o_orderkey")

    @property
    def orders_conflict(self) -> DataFrame:
        o = self._orders0
        changed = o.where("o_orderkey % 2003 = 0").withColumn("amount", (F.col("amount") + 1).cast("decimal(18,2)"))
        return self.orders.union(changed.drop("o_orderkey"))

    @property
    def orders_raw(self) -> DataFrame:
        """All columns as text, with values that don't parse."""
        k, text = F.col("o_orderkey"), F.col("amount").cast("string")
        amount = F.when(k % 101 == 0, "abc").when(k % 103 == 0, F.lit(None)).when(k % 107 == 0, F.concat(F.lit("-"), text)).when(k % 109 == 0, "0.00").otherwise(text)
        day = F.when(k % 211 == 0, "not-a-date").when(k % 223 == 0, "2001-02-30").otherwise(F.col("order_date").cast("string"))
        status = F.when(k % 97 == 0, F.concat(F.lit("  "), F.col("status"), F.lit(" "))).when(k % 89 == 0, F.upper("status")).otherwise(F.col("status"))
        return self._orders0.withColumns({"amount": amount, "order_date": day, "status": status}).drop("o_orderkey")

    @property
    def orders_dirty(self) -> DataFrame:
        """The raw orders with exact duplicates."""
        raw = self.orders_raw
        return raw.union(raw.where("CAST(order_id AS BIGINT) % 50 = 0"))

    @property
    def promotions(self) -> DataFrame:
        price, rate = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
        return (
            self.read("lineitem")
            .where("l_discount >= 0.08 AND l_returnflag = 'R'")
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("promotion_id"),
                F.col("l_orderkey").cast("string").alias("order_id"),
                F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("promo_code"),
                (price * rate).cast("decimal(18,2)").alias("discount_amount"),
            )
        )

    @property
    def promotions_raw(self) -> DataFrame:
        """Discounts as text: some that don't parse, have three decimals or exceed their order; exact duplicates."""
        k, text = F.col("order_id").cast("bigint"), F.col("discount_amount").cast("string")
        value = F.when(k % 13 == 0, "abc").when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.concat(F.lit("-"), text)).when(k % 23 == 0, "0.00").when(k % 29 == 0, F.concat(text, F.lit("9"))).when(k % 31 == 0, "99999999.00")
        raw = self.promotions.withColumn("discount_amount", value.otherwise(text))
        return raw.union(raw.where(k % 7 == 0))


#: The same tables for an oracle: common table expressions, to be followed by a SELECT.
SQL = """
WITH x_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, c_mktsegment AS segment, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), x_orders0 AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS order_id,
         CASE WHEN o_orderkey % 167 = 0 THEN CAST(900000000 + o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
         CAST(o_orderdate AS DATE) AS order_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'cancelled' WHEN 'P' THEN 'refunded' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY'
), x_orders AS (
  SELECT * EXCLUDE (o_orderkey) FROM x_orders0 UNION ALL SELECT * EXCLUDE (o_orderkey) FROM x_orders0 WHERE o_orderkey % 50 = 0
), x_orders_conflict AS (
  SELECT * FROM x_orders UNION ALL
  SELECT order_id, customer_id, order_date, CAST(amount + 1 AS DECIMAL(18,2)), status FROM x_orders0 WHERE o_orderkey % 2003 = 0
), x_orders_raw AS (
  SELECT order_id, customer_id,
         CASE WHEN o_orderkey % 211 = 0 THEN 'not-a-date' WHEN o_orderkey % 223 = 0 THEN '2001-02-30' ELSE CAST(order_date AS VARCHAR) END AS order_date,
         CASE WHEN o_orderkey % 101 = 0 THEN 'abc' WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 107 = 0 THEN '-' || CAST(amount AS VARCHAR)
              WHEN o_orderkey % 109 = 0 THEN '0.00' ELSE CAST(amount AS VARCHAR) END AS amount,
         CASE WHEN o_orderkey % 97 = 0 THEN '  ' || status || ' ' WHEN o_orderkey % 89 = 0 THEN upper(status) ELSE status END AS status
  FROM x_orders0
), x_orders_dirty AS (
  SELECT * FROM x_orders_raw UNION ALL SELECT * FROM x_orders_raw WHERE CAST(order_id AS BIGINT) % 50 = 0
), x_promotions AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS promotion_id, CAST(l_orderkey AS VARCHAR) AS order_id,
         l_returnflag || l_linestatus || l_linenumber AS promo_code,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS discount_amount
  FROM lineitem WHERE l_discount >= 0.08 AND l_returnflag = 'R'
), x_promotions_raw0 AS (
  SELECT promotion_id, order_id, promo_code, CAST(order_id AS BIGINT) AS k,
         CASE WHEN k % 13 = 0 THEN 'abc' WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN '-' || CAST(discount_amount AS VARCHAR) WHEN k % 23 = 0 THEN '0.00'
              WHEN k % 29 = 0 THEN CAST(discount_amount AS VARCHAR) || '9' WHEN k % 31 = 0 THEN '99999999.00' ELSE CAST(discount_amount AS VARCHAR) END AS discount_amount
  FROM x_promotions
), x_promotions_raw AS (
  SELECT * EXCLUDE (k) FROM x_promotions_raw0 UNION ALL SELECT * EXCLUDE (k) FROM x_promotions_raw0 WHERE k % 7 = 0
), d_orders AS (SELECT DISTINCT * FROM x_orders
), per_order AS (
  SELECT order_id, CAST(sum(discount_amount) AS DECIMAL(18,2)) AS discount_raw, string_agg(promo_code, ' + ' ORDER BY promo_code) AS promo_codes, count(*) AS n_promos
  FROM x_promotions GROUP BY order_id
), analysis AS (
  SELECT o.*, coalesce(p.discount_raw, CAST(0 AS DECIMAL(18,2))) AS discount_raw, p.promo_codes, p.n_promos, c.customer_name,
         coalesce(c.segment, 'Unknown') AS segment, c.region, least(coalesce(p.discount_raw, CAST(0 AS DECIMAL(18,2))), o.amount) AS discount,
         c.customer_id IS NOT NULL AS is_known_customer
  FROM d_orders o LEFT JOIN per_order p USING (order_id) LEFT JOIN x_customers c ON o.customer_id = c.customer_id
), done AS (SELECT * FROM analysis WHERE status = 'completed'
), by_customer AS (
  SELECT customer_id, customer_name, segment, region, count(*) AS orders, sum(amount) AS revenue, sum(discount) AS discounts
  FROM done WHERE is_known_customer GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY revenue DESC, customer_id) AS rank FROM by_customer
)
"""
