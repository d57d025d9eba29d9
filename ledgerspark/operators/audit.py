"""What is wrong with raw tables, counted before anything is joined. One aggregate over each table, no loops of jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import as_double, date, identifier, is_padded, money


def counted(df: DataFrame, counts: dict[str, Column], label: str = "column_name", value: str = "n") -> DataFrame:
    """One aggregate over the table, turned into a row for each count."""
    row = df.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(f"c{k}") for k, c in enumerate(counts.values())))
    return row.select(F.inline(F.array(*(F.struct(F.lit(name).alias(label), F.col(f"c{k}").alias(value)) for k, name in enumerate(counts)))))


def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, n_nulls."""
    parts = [counted(df, {c: F.count_if(F.col(c).isNull()) for c in df.columns}, value="n_nulls").select(F.lit(name).alias("table_name"), "column_name", "n_nulls") for name, df in tables.items()]
    return reduce(DataFrame.union, parts)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_duplicates: rows that repeat an earlier one in full."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """value, n."""
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def padded_profile(df: DataFrame) -> DataFrame:
    """column_name, n_padded, of values with white space at an end."""
    return counted(df, {c: F.count_if(is_padded(F.col(c).cast("string"))) for c in df.columns}, value="n_padded")


def money_profile(df: DataFrame, column: str) -> DataFrame:
    """n_unparseable (nulls included), n_null, n_negative, n_zero, min, median (exact), max."""
    v = df.select(F.col(column).alias("raw"), money(F.col(column)).alias("v"))
    return v.agg(
        F.count_if(F.col("v").isNull()).alias("n_unparseable"),
        F.count_if(F.col("raw").isNull()).alias("n_null"),
        F.count_if(F.col("v") < 0).alias("n_negative"),
        F.count_if(F.col("v") == 0).alias("n_zero"),
        as_double(F.min("v")).alias("min_value"),
        F.median(as_double(F.col("v"))).alias("median_value"),
        as_double(F.max("v")).alias("max_value"),
    )


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """n_unparseable (nulls included), first_date, last_date."""
    v = df.select(date(F.col(column).cast("string")).alias("v"))
    return v.agg(F.count_if(F.col("v").isNull()).alias("n_unparseable"), F.min("v").cast("string").alias("first_date"), F.max("v").cast("string").alias("last_date"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """key, n_rows of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def duplicate_conflicts(df: DataFrame, key: str) -> DataFrame:
    """n_duplicated, n_conflicting: repeated keys, and those of which another column has more than one value (nulls aside)."""
    others = [c for c in df.columns if c != key]
    differs = reduce(lambda a, b: a | b, (F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in others), F.lit(False))
    groups = df.groupBy(key).agg(F.count("*").alias("n"), differs.alias("differs")).where("n > 1")
    return groups.agg(F.count("*").alias("n_duplicated"), F.count_if("differs").alias("n_conflicting"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of the child without a parent; those with a null key too."""
    return child.join(parent.select(key).distinct(), key, "left_anti").select(child.columns)


def orphan_summary(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """n_rows, n_distinct_rows, n_keys of the orphans."""
    lost = orphans(child, parent, key)
    rows = lost.groupBy(*lost.columns).agg(F.count("*").alias("_n"))
    return rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct_rows"), F.count_distinct(key).alias("n_keys"))


def histogram_of_counts(df: DataFrame, key: str, many: str, groups: str) -> DataFrame:
    """How many keys (nulls aside) occur how often."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(many)).groupBy(many).agg(F.count("*").alias(groups)).orderBy(many)


def id_ranges(customers: DataFrame, orders: DataFrame, block: int) -> DataFrame:
    """known_min, known_max, unknown_min, unknown_max, n_unknown_ids, all_unknown_in_block (true when there is none)."""
    known = customers.agg(F.min(identifier(F.col("customer_id"))).alias("known_min"), F.max(identifier(F.col("customer_id"))).alias("known_max"))
    ids = orphans(orders, customers, "customer_id").select(identifier(F.col("customer_id")).alias("id")).distinct()
    unknown = ids.agg(
        F.min("id").alias("unknown_min"), F.max("id").alias("unknown_max"), F.count("id").alias("n_unknown_ids"), F.coalesce(F.bool_and(F.col("id") >= block), F.lit(True)).alias("all_unknown_in_block")
    )
    return known.crossJoin(unknown)  # one row by one row


def segment_coverage(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """segment, customers, customers_with_orders, total_orders (any status, exact duplicates aside)."""
    per = orders.distinct().groupBy("customer_id").agg(F.count("*").alias("n"))
    return (
        customers.join(per, "customer_id", "left")
        .groupBy("segment")
        .agg(F.count("*").alias("customers"), F.count_if(F.col("n") > 0).alias("customers_with_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_orders"))
    )


def shape(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_columns, columns."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(", ".join(df.columns)).alias("columns")) for name, df in tables.items()]
    return reduce(DataFrame.union, parts)
