"""Quality control: findings with severities, the row ledger, the gate, health.

Findings are rows: stage, table_name, column_name, check_name, severity, n_rows, n_keys, detail, inferred. What concerns
an inferred table is always `info`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import as_double, date, has_more_decimals, identifier, is_padded, money, strict_date, strict_money, stripped
from ..policy import Policy
from . import audit, metrics
from .model import QCFailed

SEVERITIES = ("info", "warn", "fail")
COLUMNS = ("stage", "table_name", "column_name", "check_name", "severity", "n_rows", "n_keys", "detail", "inferred")
SCHEMA = "stage string, table_name string, column_name string, check_name string, severity string, n_rows long, n_keys long, detail string, inferred boolean"


def finding(stage: str, table: str, column: str, check: str, severity: str, n_rows: Column, n_keys: Column | None = None, detail: Column | None = None, inferred: bool = False) -> Column:
    """One finding as a struct; the only place that severities are set, so inferred ones can't be more than info."""
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    parts = (
        F.lit(stage), F.lit(table), F.lit(column), F.lit(check), F.lit("info" if inferred else severity), F.coalesce(n_rows, F.lit(0)).cast("long"),
        (F.lit(None) if n_keys is None else n_keys).cast("long"), (F.lit(None) if detail is None else detail).cast("string"), F.lit(inferred),
    )
    return F.struct(*(p.alias(c) for p, c in zip(parts, COLUMNS)))


def found(row: DataFrame, findings: list[Column]) -> DataFrame:
    """A one-row aggregate as the findings that have rows."""
    return row.select(F.inline(F.array(*findings))).where("n_rows > 0")


def _money_findings(stage: str, table: str, column: str, zero: str = "warn") -> tuple[dict[str, Column], list[Column]]:
    """Counts over a raw money column, and the findings that they make."""
    raw, value = F.col(column).cast("string"), money(F.col(column))
    checks = {
        "null_value": ("warn", raw.isNull()),
        "unparseable": ("warn", raw.isNotNull() & value.isNull()),
        "negative": ("warn", value < 0),
        "zero": (zero, value == 0),
        "more_than_two_decimals": ("warn", has_more_decimals(raw)),
    }
    counts = {f"{column}_{check}": F.count_if(bad) for check, (_, bad) in checks.items()}
    return counts, [finding(stage, table, column, check, severity, F.col(f"{column}_{check}")) for check, (severity, _) in checks.items()]


def raw_findings(customers: DataFrame, orders: DataFrame, promotions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """What the raw tables (money and dates as text or typed) show; nothing is changed.

    Orders are read for the values, for their keys (duplicates, conflicts, the promotions' orders) and for their
    customers; promotions for the values with their orders, and for their keys.
    """
    stage = "raw"
    amounts, amount_findings = _money_findings(stage, "orders", "amount")
    odd_id = lambda c: F.col(c).isNotNull() & identifier(F.col(c)).isNull()
    per_column = orders.agg(
        *(c.alias(name) for name, c in amounts.items()),
        F.count_if(date(F.col("order_date").cast("string")).isNull()).alias("bad_date"),
        F.count_if(is_padded(F.col("status"))).alias("padded"),
        F.count_if(~F.trim("status").isin(*policy.known_statuses)).alias("odd_status"),
        F.count_if(F.col("customer_id").isNull()).alias("null_key"),
        F.count_if(odd_id("customer_id")).alias("odd_id"),
    )
    # one exchange by the key serves distinct rows and keys
    versions = orders.repartition("order_id").groupBy(*orders.columns).agg(F.count("*").alias("_n"))
    keys = versions.groupBy("order_id").agg(F.sum("_n").alias("n"), F.count("*").alias("versions"), F.max(money(F.col("amount"))).alias("order_amount"))
    discounts, discount_findings = _money_findings(stage, "promotions", "discount_amount", zero="info")
    matched = promotions.join(keys.where("order_id IS NOT NULL").select("order_id", "order_amount", F.lit(True).alias("matched")), "order_id", "left")
    orphan = F.col("matched").isNull()
    per_promotion = matched.agg(
        *(c.alias(name) for name, c in discounts.items()),
        F.count_if(F.col("promo_code").isNull()).alias("no_code"),
        F.count_if(money(F.col("discount_amount")) > F.col("order_amount")).alias("over"),
        F.count_if(orphan).alias("orphans"),
        F.count_distinct(F.when(orphan, F.col("order_id"))).alias("orphan_keys"),
        F.sum(F.when(orphan, money(F.col("discount_amount")))).alias("lost"),
    )
    copies = promotions.repartition("order_id").groupBy(*promotions.columns).agg(F.count("*").alias("_n")).groupBy("order_id").agg(F.sum("_n").alias("n"), F.count("*").alias("versions"))
    stacked = copies.agg(F.sum(F.col("n") - F.col("versions")).alias("copies"), F.count_if(F.col("versions") > 1).alias("k"), F.sum(F.when(F.col("versions") > 1, F.col("versions"))).alias("n"))
    parts = [
        found(
            per_column,
            [
                *amount_findings,
                finding(stage, "orders", "order_date", "unparseable", "warn", F.col("bad_date")),
                finding(stage, "orders", "status", "padded", "info", F.col("padded")),
                finding(stage, "orders", "status", "unexpected_value", "warn", F.col("odd_status")),
                finding(stage, "orders", "customer_id", "null_key", "warn", F.col("null_key")),
                finding(stage, "orders", "customer_id", "not_numeric", "info", F.col("odd_id")),
            ],
        ),
        found(
            keys.agg(F.sum(F.col("n") - F.col("versions")).alias("copies"), F.count_if(F.col("versions") > 1).alias("conflicts")),
            [
                finding(stage, "orders", "order_id", "exact_duplicate", "warn", F.col("copies")),
                finding(stage, "orders", "order_id", "conflicting_duplicate", "fail", F.col("conflicts"), F.col("conflicts")),
            ],
        ),
        found(audit.orphan_summary(orders, customers, "customer_id"), [finding(stage, "orders", "customer_id", "orphan", "warn", F.col("n_rows"), F.col("n_keys"))]),
        found(
            customers.groupBy("customer_id")
            .agg(F.count("*").alias("n"), F.count_if(F.col("customer_name").isNull()).alias("a"), F.count_if(F.col("segment").isNull()).alias("b"))
            .agg(F.count_if(F.col("n") > 1).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")),
            [
                finding(stage, "customers", "customer_id", "repeated_key", "fail", F.col("n"), F.col("n")),
                finding(stage, "customers", "customer_name", "null_value", "info", F.col("a")),
                finding(stage, "customers", "segment", "null_value", "warn", F.col("b")),
            ],
        ),
        found(
            per_promotion,
            [
                *discount_findings,
                finding(stage, "promotions", "discount_amount", "over_amount", "warn", F.col("over")),
                finding(stage, "promotions", "order_id", "orphan", "warn", F.col("orphans"), F.col("orphan_keys"), F.concat(F.lit("lost discount "), F.col("lost").cast("string"))),
                finding(stage, "promotions", "promo_code", "null_value", "info", F.col("no_code")),
            ],
        ),
        found(
            stacked,
            [
                finding(stage, "promotions", "promotion_id", "exact_duplicate", "warn", F.col("copies")),
                finding(stage, "promotions", "order_id", "stacked", "info", F.col("n"), F.col("k")),
            ],
        ),
    ]
    return reduce(DataFrame.union, parts)


#: Rows that the filter stage drops, by rule, first match: name, condition over the raw orders.
def filter_rules() -> dict[str, Column]:
    return {
        "unparseable_amount": money(F.col("amount")).isNull(),
        "unparseable_date": date(F.col("order_date").cast("string")).isNull(),
        "non_positive_amount": money(F.col("amount")) <= 0,
    }


def with_drop_rule(orders: DataFrame) -> DataFrame:
    """The raw orders and `rule`: the first rule that drops the row, else null."""
    rule = F.lit(None).cast("string")
    for name, bad in reversed(filter_rules().items()):
        rule = F.when(bad, name).otherwise(rule)
    return orders.withColumn("rule", rule)


def filtered(orders: DataFrame) -> DataFrame:
    return with_drop_rule(orders).where("rule IS NULL").drop("rule")


def filter_log(orders: DataFrame) -> DataFrame:
    """rule, rows_dropped for every rule, zeros too."""
    marked = with_drop_rule(orders)
    return audit.counted(marked, {name: F.count_if(F.col("rule") == name) for name in filter_rules()}, label="rule", value="rows_dropped")


def cleaned(orders: DataFrame) -> DataFrame:
    """Filtered orders, typed (casts raise on what the filter should have dropped) and stripped."""
    text = lambda c: stripped(F.col(c).cast("string"))
    return orders.select("order_id", "customer_id", strict_date(text("order_date")).alias("order_date"), strict_money(text("amount")).alias("amount"), F.trim("status").alias("status"))


def promotion_rules() -> dict[str, Column]:
    """Promotions that the filter stage drops, by rule."""
    return {"unparseable_discount": money(F.col("discount_amount")).isNull()}


def promotion_log(promotions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """rule, rows_dropped of the promotions: by each rule, then exact duplicates of what is left."""
    (rule, bad), = promotion_rules().items()
    left = promotions.where(~bad)
    copies = audit.duplicate_rows(left).select(F.lit("exact_duplicate").alias("rule"), (F.col("n_duplicates") if policy.drop_exact_duplicates else F.lit(0).cast("long")).alias("rows_dropped"))
    return audit.counted(promotions, {rule: F.count_if(bad)}, label="rule", value="rows_dropped").union(copies)


def cleaned_promotions(promotions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Promotions whose discount parses, typed by a cast that raises, exact duplicates dropped."""
    left = promotions
    for bad in promotion_rules().values():
        left = left.where(~bad)
    left = left.distinct() if policy.drop_exact_duplicates else left
    return left.withColumn("discount_amount", strict_money(stripped(F.col("discount_amount").cast("string"))))


def ledger(raw: DataFrame, kept: DataFrame, distinct: DataFrame, table: DataFrame) -> DataFrame:
    """step, stage, rule, rows_in, rows_out of the orders through the stages; each step takes in what the one before let out."""
    steps = (("ingest", "read", raw, raw), ("filter", "bad values", raw, kept), ("clean", "exact duplicates", kept, distinct), ("transform", "validated joins", distinct, table))
    counts = {id(d): d.agg(F.count("*").alias("n")) for d in (raw, kept, distinct, table)}
    one = reduce(DataFrame.crossJoin, [c.withColumnRenamed("n", f"n{k}") for k, c in enumerate(counts.values())])  # one row each
    at = {i: f"n{k}" for k, i in enumerate(counts)}
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(s).alias("stage"), F.lit(r).alias("rule"), F.col(at[id(a)]).alias("rows_in"), F.col(at[id(b)]).alias("rows_out")) for k, (s, r, a, b) in enumerate(steps)))))


def final_findings(distinct: DataFrame, table: DataFrame, policy: Policy = Policy(), customers: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """Checks of the analysis table: no fan-out, unique orders, cap held. Only what fails or is worth a note.

    With `customers` the segments of their domain must add up to the total revenue; with the `raw` orders the ledger must
    reconcile: what came in, less what each rule drops, less exact duplicates, is what the table holds.
    """
    stage = "final"
    row = table.groupBy("order_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    row = row.crossJoin(distinct.agg(F.count("*").alias("before"))).crossJoin(  # one row each
        table.agg(
            F.count("*").alias("after"),
            F.count_if(F.col("discount") > F.col("amount")).alias("over"),
            F.count_if(~F.col("is_known_customer")).alias("unknown"),
            F.count_if(F.col("discount_raw") > F.col("amount")).alias("capped"),
            F.count_if((F.col("discount") > 0) & ~F.col("status").isin(*policy.revenue_statuses)).alias("promoted_other"),
        )
    )
    checks = [
        finding(stage, "analysis", "order_id", "fan_out", "fail", F.greatest(F.col("after") - F.col("before"), F.lit(0)) if not policy.keep_unknown_customers else F.abs(F.col("after") - F.col("before"))),
        finding(stage, "analysis", "order_id", "repeated_key", "fail", F.col("repeated"), F.col("repeated")),
        finding(stage, "analysis", "discount", "cap_not_held", "fail", F.col("over") if policy.cap_discounts else F.lit(0)),
        finding(stage, "analysis", "discount", "capped", "info", F.col("capped")),
        finding(stage, "analysis", "customer_id", "unknown_customer", "warn", F.col("unknown")),
        finding(stage, "analysis", "status", "promotion_without_revenue", "info", F.col("promoted_other")),
    ]
    if customers is not None:
        sums = metrics.segment_checksum(table, customers, policy)
        detail = F.concat(F.lit("segments "), F.coalesce("segments_revenue", F.lit(0.0)).cast("string"), F.lit(" of "), F.col("total_revenue").cast("string"))
        row = row.crossJoin(sums.select((~F.coalesce("is_equal", F.col("total_revenue").isNull())).cast("long").alias("segments_off"), detail.alias("segments_detail")))
        checks.append(finding(stage, "analysis", "segment", "segments_do_not_add_up", "fail", F.col("segments_off"), None, F.col("segments_detail")))
    if raw is not None and policy.keep_unknown_customers:
        came = with_drop_rule(raw).agg(F.count("*").alias("came"), F.count("rule").alias("dropped"))
        copies = audit.duplicate_rows(cleaned(filtered(raw))).select("n_duplicates")
        row = row.crossJoin(came).crossJoin(copies)
        gone = F.col("dropped") + (F.col("n_duplicates") if policy.drop_exact_duplicates else F.lit(0))
        checks.append(finding(stage, "orders", "order_id", "ledger_does_not_reconcile", "fail", F.abs(F.col("came") - gone - F.col("after"))))
    return found(row, checks)


def by_severity(findings: DataFrame) -> DataFrame:
    """stage, severity, n_findings, n_rows: before against after."""
    return findings.groupBy("stage", "severity").agg(F.count("*").alias("n_findings"), F.sum("n_rows").alias("n_rows"))


def data_health(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """health, n_fail, n_warn, n_info, rows_in, rows_out, retention_pct; `rows` is a ledger."""
    counts = findings.agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES))
    kept = rows.agg(F.max_by("rows_in", -F.col("step")).alias("rows_in"), F.max_by("rows_out", "step").alias("rows_out"))
    label = F.when(F.col("n_fail") > 0, "Blocked").when(F.col("n_warn") > 0, "Needs review").when(F.col("n_info") > 0, "Clean with notes").otherwise("Healthy")
    return counts.crossJoin(kept).select(label.alias("health"), "n_fail", "n_warn", "n_info", "rows_in", "rows_out", (F.try_divide(as_double(F.col("rows_out")), as_double(F.col("rows_in"))) * 100).alias("retention_pct"))


def gate(findings: DataFrame) -> None:
    """Raise if any check failed. An action, on few rows."""
    failed = findings.where("severity = 'fail'").limit(20).collect()
    if failed:
        raise QCFailed("; ".join(f"{r.table_name}.{r.column_name}: {r.check_name} ({r.n_rows})" for r in failed))


def empty(spark: SparkSession) -> DataFrame:
    """No findings: what a run without a table to check starts from."""
    return spark.createDataFrame([], SCHEMA)
