"""Named queries over the overlay of the driver's tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import as_double
from .. import report
from ..operators import audit, infer, joins, metrics, model, qc
from ..policy import CUSTOMERS, ORDERS, PROMOTIONS, Policy, Registry
from ..sources import synth
from ..sources import tables as sources
from ..streaming import incremental
from . import pipeline
from .overlay import SQL, UNKNOWN_BLOCK, Overlay

Query = Callable[[SparkSession, str], DataFrame]

#: Watermarks of the incremental queries: what is written reaches to the first, the batch is read from the second on.
WRITTEN_UNTIL, WATERMARK = date(2001, 6, 1), date(2001, 1, 1)
SYNTH_ORDERS, SYNTH_CUSTOMERS = 200_000, 3_000


def _table(o: Overlay) -> DataFrame:
    return model.analysis_table(o.customers, o.orders, o.promotions)


def _money_out(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: as_double(F.col(c)) for c in columns})


def _analysis(o: Overlay) -> DataFrame:
    t = _table(o).withColumn("order_date", F.col("order_date").cast("string"))
    return _money_out(t, "amount", "discount_raw", "discount")


def _orders_out(df: DataFrame) -> DataFrame:
    return _money_out(df.withColumn("order_date", F.col("order_date").cast("string")), "amount")


def _raw_findings(o: Overlay) -> DataFrame:
    return qc.raw_findings(o.customers, o.orders_dirty, o.promotions)


def _cleaned(o: Overlay) -> DataFrame:
    return qc.cleaned(qc.filtered(o.orders_dirty))


def _final_findings(o: Overlay) -> DataFrame:
    clean = _cleaned(o)
    return qc.final_findings(model.distinct_orders(clean), model.analysis_table(o.customers, clean, o.promotions), customers=o.customers, raw=o.orders_dirty)


def _ledger(o: Overlay) -> DataFrame:
    clean = _cleaned(o)
    return qc.ledger(o.orders_dirty, qc.filtered(o.orders_dirty), clean.distinct(), model.analysis_table(o.customers, clean, o.promotions))


def _written(o: Overlay) -> DataFrame:
    return o.orders.distinct().where(F.col("order_date") < F.lit(WRITTEN_UNTIL))


def _new_rows(o: Overlay) -> DataFrame:
    return _orders_out(incremental.new_rows(o.orders.distinct(), _written(o), WATERMARK))


def _promotion_findings(o: Overlay) -> DataFrame:
    return qc.raw_findings(o.customers, o.orders_dirty, o.promotions_raw).where("table_name = 'promotions'")


def _broken_findings(o: Overlay) -> DataFrame:
    """Checks of an analysis table that lost a segment of the domain, some of its rows and the cap."""
    clean = _cleaned(o)
    table = model.analysis_table(o.customers, clean, o.promotions, Policy(cap_discounts=False)).where(F.pmod(F.col("order_id").cast("bigint"), F.lit(11)) != 0)
    found = qc.final_findings(model.distinct_orders(clean), table, customers=o.customers.where("segment <> 'BUILDING'"), raw=o.orders_dirty)
    return found.where("severity = 'fail'").drop("detail")


def _folder(o: Overlay) -> str:
    """The overlay's raw tables as CSV part files in a folder, an undeclared one as Parquet."""
    folder = sources.scratch(o.spark)
    for name, df in (("customers", o.customers), ("orders", o.orders_dirty), ("promotions", o.promotions_raw)):
        df.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder}/{name}")
    o.read("supplier").select("s_suppkey", "s_name").write.parquet(f"{folder}/suppliers.parquet")
    return folder


def _scanned(o: Overlay, spec) -> DataFrame:
    return sources.table(o.spark, sources.discovered(o.spark, _folder(o))[spec.name], spec)


def _discovered(o: Overlay) -> DataFrame:
    return audit.shape({name: sources.table(o.spark, path, {s.name: s for s in (CUSTOMERS, ORDERS, PROMOTIONS)}.get(name)) for name, path in sources.discovered(o.spark, _folder(o)).items()})


def _partitioned(o: Overlay) -> DataFrame:
    path = sources.scratch(o.spark)
    sources.write_partitioned(_table(o), path)
    return o.spark.read.parquet(path).where("order_month = '1995-03'").groupBy("order_month").agg(F.count("*").alias("n"), as_double(F.sum("amount")).alias("amount"))


def _written_results(o: Overlay) -> DataFrame:
    """Totals as JSON and the status breakdown as CSV, read back as text and numbers."""
    folder = sources.scratch(o.spark)
    sources.write_results({"totals": metrics.revenue_totals(_table(o)), "by_status": metrics.status_breakdown(_table(o))}, folder)
    totals = o.spark.read.json(f"{folder}/totals").select(F.lit("total").alias("status"), "orders", F.col("gross_revenue").alias("value"))
    return totals.unionByName(sources.csv(o.spark, f"{folder}/by_status").select("status", F.col("orders").cast("bigint"), F.col("value").cast("double")))


def _report(o: Overlay) -> DataFrame:
    """The Markdown table of counts by status, a row for each line."""
    lines = report.markdown("Status", metrics.status_breakdown(_table(o)).select("status", "orders", F.lit(0.125).alias("share")).orderBy("status")).rstrip("\n").split("\n")
    return o.spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "n int, line string")


def _visits(o: Overlay) -> DataFrame:
    """An undeclared table: events as text, their customers by the name of the key, days in two formats, some values that don't fit."""
    e, k = o.read("events"), F.col("event_id")
    day = F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "MM/dd/yyyy"))
    return e.select(
        k.cast("string").alias("visit_id"), F.col("user_id").cast("string").alias("customer_id"), F.when(k % 997 == 0, "soon").otherwise(day).alias("day"),
        F.when(k % 991 == 0, "n.a.").otherwise(F.concat(F.lit(" "), (k % 500).cast("string"), F.lit(".50"))).alias("fee"), F.lit("x").alias("note"),
    )


def _visits_inferred(o: Overlay) -> DataFrame:
    visits = _visits(o)
    types, key = infer.inferred_types(visits), infer.inferred_key(visits)
    return o.spark.createDataFrame([(c, t, c == key) for c, t in types.items()], "column_name string, type string, is_key boolean")


def _visits_coerced(o: Overlay) -> DataFrame:
    visits = _visits(o).union(_visits(o).where("visit_id LIKE '%7'"))
    return _money_out(infer.coerced(visits, infer.inferred_types(visits)), "fee").withColumn("day", F.col("day").cast("string"))


def _visits_findings(o: Overlay) -> DataFrame:
    return infer.inferred_findings("visits", _visits(o), Registry(), {"customers": o.customers, "visits": _visits(o)})


def _validated(o: Overlay) -> DataFrame:
    """Which joins with a stated cardinality, and which uniqueness assertions, are refused; rows of those that aren't."""

    def tried(name, make):
        try:
            return name, False, make().count()
        except (joins.CardinalityError, model.QCFailed):
            return name, True, None

    distinct, per = model.distinct_orders(o.orders), model.promotions_per_order(o.promotions)
    rows = [
        tried("one_to_one", lambda: joins.validated_join(distinct, per, "order_id", validate="one_to_one")),
        tried("many_to_one", lambda: joins.validated_join(o.orders, o.customers, "customer_id")),
        tried("fan_out", lambda: joins.validated_join(o.orders, o.promotions, "order_id")),
        tried("duplicates_one_to_one", lambda: joins.validated_join(o.orders, per, "order_id", validate="one_to_one")),
        tried("unique_orders", lambda: model.assert_unique(distinct, "order_id")),
        tried("unique_conflict", lambda: model.assert_unique(o.orders_conflict.distinct(), "order_id")),
    ]
    return o.spark.createDataFrame(rows, "join_name string, refused boolean, n_rows long")


def _run(o: Overlay) -> pipeline.Result:
    return pipeline.run({"customers": o.customers, "orders": o.orders_dirty, "promotions": o.promotions_raw})


def _gate(o: Overlay) -> DataFrame:
    """Whether the numbers are given: of the dirty tables, of orders in conflict, of a folder without promotions."""
    conflict = o.orders_conflict.select(*(F.col(c).cast("string") for c in o.orders_conflict.columns))
    cases = {
        "dirty": {"customers": o.customers, "orders": o.orders_dirty, "promotions": o.promotions_raw},
        "conflict": {"customers": o.customers, "orders": conflict, "promotions": o.promotions_raw},
        "no_promotions": {"customers": o.customers, "orders": o.orders_dirty, "visits": _visits(o)},
    }
    results = {name: pipeline.run(tables) for name, tables in cases.items()}
    return o.spark.createDataFrame([(name, r.blocked, len(r.answers), len(r.others)) for name, r in results.items()], "case_name string, blocked string, n_answers int, n_others int")


def _batches(o: Overlay) -> DataFrame:
    """A backfill, the same again, then all days: through the seven stages into one target."""
    folder, out = sources.scratch(o.spark), []
    early = o.orders_dirty.where(F.col("order_date") < F.lit(str(WRITTEN_UNTIL)))
    for name, orders in (("backfill", early), ("rerun", early), ("new_part", o.orders_dirty)):
        _, b = pipeline.run_batch({"customers": o.customers, "orders": orders, "promotions": o.promotions_raw}, f"{folder}/orders", f"{folder}/state")
        out.append((name, b.rows, b.amount, str(b.watermark), b.changed))
    return o.spark.createDataFrame(out, "batch string, n_rows long, amount double, watermark string, n_changed int")


def _synthetic(spark: SparkSession) -> DataFrame:
    customers, orders, promotions = synth.customers(spark, SYNTH_CUSTOMERS), synth.orders(spark, SYNTH_ORDERS, SYNTH_CUSTOMERS), synth.promotions(spark, SYNTH_ORDERS)
    table = model.analysis_table(customers, orders, promotions)
    return metrics.revenue_by_segment(table, customers)


#: query -> function of the overlay
_QUERIES: dict[str, Callable[[Overlay], DataFrame]] = {
    "table_shapes": lambda o: audit.shape({"customers": o.customers, "orders": o.orders, "promotions": o.promotions}),
    "null_profile": lambda o: audit.null_profile({"customers": o.customers, "orders": o.orders_raw, "promotions": o.promotions}),
    "exact_duplicate_count": lambda o: audit.duplicate_rows(o.orders),
    "value_counts_segment": lambda o: audit.value_counts(o.customers, "segment"),
    "value_counts_region": lambda o: audit.value_counts(o.customers, "region"),
    "value_counts_status": lambda o: audit.value_counts(o.orders, "status"),
    "value_counts_promo": lambda o: audit.value_counts(o.promotions, "promo_code"),
    "whitespace_profile": lambda o: audit.padded_profile(o.orders_raw),
    "amount_profile": lambda o: audit.money_profile(o.orders_raw, "amount"),
    "discount_profile": lambda o: audit.money_profile(o.promotions, "discount_amount"),
    "date_profile": lambda o: audit.date_profile(o.orders_raw, "order_date"),
    "duplicate_key_ids": lambda o: audit.duplicate_keys(o.orders_conflict, "order_id"),
    "duplicate_conflicts": lambda o: audit.duplicate_conflicts(o.orders_conflict, "order_id"),
    "duplicate_rows_of_keys": lambda o: _orders_out(o.orders_conflict.join(audit.duplicate_keys(o.orders_conflict, "order_id"), "order_id", "left_semi")),
    "orphan_orders": lambda o: _orders_out(audit.orphans(o.orders, o.customers, "customer_id")),
    "orphan_order_summary": lambda o: audit.orphan_summary(o.orders, o.customers, "customer_id"),
    "orphan_promotions": lambda o: _money_out(audit.orphans(o.promotions, o.orders, "order_id"), "discount_amount"),
    "promos_per_order_hist": lambda o: audit.histogram_of_counts(o.promotions, "order_id", "n_promos", "n_orders"),
    "promoted_order_status": lambda o: audit.value_counts(o.promotions.join(o.orders.distinct().select("order_id", "status"), "order_id"), "status", keep_null=False),
    "id_range_known_vs_unknown": lambda o: audit.id_ranges(o.customers, o.orders, UNKNOWN_BLOCK),
    "segment_coverage": lambda o: audit.segment_coverage(o.customers, o.orders),
    "naive_fanout_overstatement": lambda o: metrics.naive_overstatement(o.orders, o.promotions),
    "dedup_orders": lambda o: _orders_out(model.distinct_orders(o.orders)),
    "promos_collapsed": lambda o: _money_out(model.promotions_per_order(o.promotions), "discount_raw"),
    "analysis_table": _analysis,
    "cap_summary": lambda o: metrics.cap_summary(_table(o)),
    "single_promotions_over_amount": lambda o: metrics.single_promotions_over_amount(o.orders, o.promotions),
    "unmatched_vs_fifth": lambda o: metrics.unmatched_against_top(_table(o)),
    "status_breakdown": lambda o: metrics.status_breakdown(_table(o)),
    "revenue_totals": lambda o: metrics.revenue_totals(_table(o)),
    "revenue_by_segment": lambda o: metrics.revenue_by_segment(_table(o), o.customers),
    "segment_checksum": lambda o: metrics.segment_checksum(_table(o), o.customers),
    "top5_customers": lambda o: metrics.top_customers(_table(o)),
    "top5_share": lambda o: metrics.top_share(_table(o)),
    "rank_gap_5_6": lambda o: metrics.rank_gap(_table(o)),
    "scenario_table": lambda o: metrics.scenario_table(_table(o), o.orders),
    "findings_raw": _raw_findings,
    "findings_final": _final_findings,
    "ledger": _ledger,
    "qc_before_after": lambda o: qc.by_severity(_raw_findings(o).union(_final_findings(o))),
    "data_health": lambda o: qc.data_health(_raw_findings(o).union(_final_findings(o)), _ledger(o)),
    "filter_stage": lambda o: qc.filter_log(o.orders_dirty),
    "undeclared_profile": lambda o: infer.column_profile(o.read("events")),
    "undeclared_deduped": lambda o: audit.duplicate_rows(o.read("events").select("user_id", "event_type", "event_id").unionAll(o.read("events").select("user_id", "event_type", "event_id"))),
    "inferred_foreign_key": lambda o: _visits_findings(o).where("check_name LIKE 'orphan_of_%'"),
    "inferred_types_and_key": _visits_inferred,
    "undeclared_findings": _visits_findings,
    "undeclared_coerced": _visits_coerced,
    "findings_promotions": _promotion_findings,
    "findings_broken_table": _broken_findings,
    "promotion_filter": lambda o: qc.promotion_log(o.promotions_raw),
    "promotions_clean": lambda o: _money_out(qc.cleaned_promotions(o.promotions_raw), "discount_amount"),
    "csv_customers": lambda o: _scanned(o, CUSTOMERS),
    "csv_orders": lambda o: _scanned(o, ORDERS),
    "csv_promotions": lambda o: _scanned(o, PROMOTIONS),
    "discovered_tables": _discovered,
    "partitioned_month": _partitioned,
    "written_results": _written_results,
    "report_lines": _report,
    "validated_joins": _validated,
    "run_segments": lambda o: _run(o).answers["by_segment"],
    "run_gate": _gate,
    "batches": _batches,
    "incremental_new_rows": _new_rows,
    "incremental_late_rows": lambda o: incremental.late_rows(o.orders.distinct(), _written(o).where(F.pmod(F.col("order_id").cast("bigint"), F.lit(7)) != 0), WATERMARK).agg(F.count("*").alias("n_late")),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: (lambda spark, sf_dir, f=f: f(Overlay(spark, sf_dir))) for name, f in _QUERIES.items()}
    return out | {"synthetic_by_segment": lambda spark, sf_dir: _synthetic(spark)}


_MONEY_PROFILE = """
SELECT count(*) FILTER (v IS NULL) AS n_unparseable, count(*) FILTER (raw IS NULL) AS n_null, count(*) FILTER (v < 0) AS n_negative, count(*) FILTER (v = 0) AS n_zero,
       CAST(min(v) AS DOUBLE) AS min_value, median(CAST(v AS DOUBLE)) AS median_value, CAST(max(v) AS DOUBLE) AS max_value
FROM (SELECT {c} AS raw, TRY_CAST({c} AS DECIMAL(18,2)) AS v FROM {t})
"""
_ORDER_OUT = "order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date, CAST(amount AS DOUBLE) AS amount, status"
_FINDING = "SELECT '{stage}' AS stage, '{t}' AS table_name, '{c}' AS column_name, '{check}' AS check_name, '{severity}' AS severity, CAST(({n}) AS BIGINT) AS n_rows, CAST(({k}) AS BIGINT) AS n_keys, {d} AS detail, false AS inferred"


def _findings(stage: str, rows: list[tuple]) -> str:
    parts = [_FINDING.format(stage=stage, t=t, c=c, check=check, severity=s, n=n, k=more[0] if more else "NULL", d=more[1] if len(more) > 1 else "CAST(NULL AS VARCHAR)") for t, c, check, s, n, *more in rows]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_rows > 0"


def _count(where: str, table: str = "x_orders_dirty") -> str:
    return f"SELECT count(*) FROM {table} WHERE {where}"


_AMOUNT, _DAY = "TRY_CAST(amount AS DECIMAL(18,2))", "TRY_CAST(order_date AS DATE)"
_CONFLICTING = "SELECT count(*) FROM (SELECT order_id FROM (SELECT DISTINCT * FROM x_orders_dirty) GROUP BY order_id HAVING count(*) > 1)"
_RAW = _findings(
    "raw",
    [
        ("orders", "amount", "null_value", "warn", _count("amount IS NULL")),
        ("orders", "amount", "unparseable", "warn", _count(f"amount IS NOT NULL AND {_AMOUNT} IS NULL")),
        ("orders", "amount", "negative", "warn", _count(f"{_AMOUNT} < 0")),
        ("orders", "amount", "zero", "warn", _count(f"{_AMOUNT} = 0")),
        ("orders", "order_date", "unparseable", "warn", _count(f"{_DAY} IS NULL")),
        ("orders", "status", "padded", "info", _count("status <> trim(status)")),
        ("orders", "status", "unexpected_value", "warn", _count("trim(status) NOT IN ('completed', 'refunded', 'cancelled')")),
        ("orders", "customer_id", "null_key", "warn", _count("customer_id IS NULL")),
        ("orders", "order_id", "exact_duplicate", "warn", "SELECT (SELECT count(*) FROM x_orders_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x_orders_dirty))"),
        ("orders", "order_id", "conflicting_duplicate", "fail", _CONFLICTING, _CONFLICTING),
        ("orders", "customer_id", "orphan", "warn", "SELECT count(*) FROM x_orders_dirty ANTI JOIN x_customers USING (customer_id)", "SELECT count(DISTINCT customer_id) FROM x_orders_dirty ANTI JOIN x_customers USING (customer_id)"),
        (
            "promotions", "order_id", "orphan", "warn", "SELECT count(*) FROM x_promotions ANTI JOIN x_orders_dirty USING (order_id)", "SELECT count(DISTINCT order_id) FROM x_promotions ANTI JOIN x_orders_dirty USING (order_id)",
            "(SELECT 'lost discount ' || CAST(sum(discount_amount) AS VARCHAR) FROM x_promotions ANTI JOIN x_orders_dirty USING (order_id))",
        ),
        ("promotions", "discount_amount", "over_amount", "warn", "SELECT count(*) FROM x_promotions JOIN order_amounts USING (order_id) WHERE discount_amount > a"),
        ("promotions", "order_id", "stacked", "info", "SELECT sum(n_promos) FROM per_order WHERE n_promos > 1", "SELECT count(*) FROM per_order WHERE n_promos > 1"),
    ],
)
_DISCOUNT = "TRY_CAST(discount_amount AS DECIMAL(18,2))"
_AMOUNTS = f", order_amounts AS (SELECT order_id, max({_AMOUNT}) AS a FROM x_orders_dirty WHERE order_id IS NOT NULL GROUP BY 1) "
_LOST = "x_promotions_raw ANTI JOIN x_orders_dirty USING (order_id)"
_VERSIONS = "(SELECT order_id, count(*) AS n FROM (SELECT DISTINCT * FROM x_promotions_raw) GROUP BY 1 HAVING count(*) > 1)"
_PROMOTIONS = _findings(
    "raw",
    [
        ("promotions", "discount_amount", "null_value", "warn", _count("discount_amount IS NULL", "x_promotions_raw")),
        ("promotions", "discount_amount", "unparseable", "warn", _count(f"discount_amount IS NOT NULL AND {_DISCOUNT} IS NULL", "x_promotions_raw")),
        ("promotions", "discount_amount", "negative", "warn", _count(f"{_DISCOUNT} < 0", "x_promotions_raw")),
        ("promotions", "discount_amount", "zero", "info", _count(f"{_DISCOUNT} = 0", "x_promotions_raw")),
        ("promotions", "discount_amount", "more_than_two_decimals", "warn", _count("discount_amount SIMILAR TO '-?[0-9]+[.][0-9]{3,}'", "x_promotions_raw")),
        ("promotions", "discount_amount", "over_amount", "warn", f"SELECT count(*) FROM x_promotions_raw JOIN order_amounts USING (order_id) WHERE {_DISCOUNT} > a"),
        ("promotions", "order_id", "orphan", "warn", f"SELECT count(*) FROM {_LOST}", f"SELECT count(DISTINCT order_id) FROM {_LOST}", f"(SELECT 'lost discount ' || CAST(sum({_DISCOUNT}) AS VARCHAR) FROM {_LOST})"),
        ("promotions", "promotion_id", "exact_duplicate", "warn", "SELECT (SELECT count(*) FROM x_promotions_raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x_promotions_raw))"),
        ("promotions", "order_id", "stacked", "info", f"SELECT sum(n) FROM {_VERSIONS}", f"SELECT count(*) FROM {_VERSIONS}"),
    ],
)
_CLEAN_PROMOTIONS = f"SELECT DISTINCT promotion_id, order_id, promo_code, {_DISCOUNT} AS discount_amount FROM x_promotions_raw WHERE {_DISCOUNT} IS NOT NULL"
_STAGES = f""", kept AS (SELECT * FROM x_orders_dirty WHERE {_AMOUNT} > 0 AND {_DAY} IS NOT NULL
), clean AS (SELECT order_id, customer_id, CAST(order_date AS DATE) AS order_date, CAST(amount AS DECIMAL(18,2)) AS amount, trim(status) AS status FROM kept
), d_clean AS (SELECT DISTINCT * FROM clean
), modelled AS (
  SELECT o.*, coalesce(p.discount_raw, CAST(0 AS DECIMAL(18,2))) AS discount_raw, c.customer_id IS NOT NULL AS is_known
  FROM d_clean o LEFT JOIN per_order p USING (order_id) LEFT JOIN x_customers c ON o.customer_id = c.customer_id
)
"""
_FINAL = _findings(
    "final",
    [
        ("analysis", "discount", "capped", "info", _count("discount_raw > amount", "modelled")),
        ("analysis", "customer_id", "unknown_customer", "warn", _count("NOT is_known", "modelled")),
        ("analysis", "status", "promotion_without_revenue", "info", _count("least(discount_raw, amount) > 0 AND status <> 'completed'", "modelled")),
    ],
)
_LEDGER = """
SELECT * FROM (VALUES (0, 'ingest', 'read'), (1, 'filter', 'bad values'), (2, 'clean', 'exact duplicates'), (3, 'transform', 'validated joins')) s(step, stage, rule),
LATERAL (SELECT CASE WHEN step <= 1 THEN (SELECT count(*) FROM x_orders_dirty) WHEN step = 2 THEN (SELECT count(*) FROM kept) ELSE (SELECT count(*) FROM d_clean) END AS rows_in,
                CASE step WHEN 0 THEN (SELECT count(*) FROM x_orders_dirty) WHEN 1 THEN (SELECT count(*) FROM kept) WHEN 2 THEN (SELECT count(*) FROM d_clean) ELSE (SELECT count(*) FROM modelled) END AS rows_out)
"""


def _scenarios() -> str:
    done, booked = "status = 'completed'", "status IN ('completed', 'refunded')"
    rows = [
        (1, "analysis", done, "amount", "amount - discount"),
        (2, "analysis", booked, "amount", "amount - discount"),
        (3, "analysis", f"{done} AND is_known_customer", "amount", "amount - discount"),
        (4, "analysis", done, "amount", "amount - discount_raw"),
        (5, "x_orders", done, "amount", "CAST(NULL AS DECIMAL(18,2))"),
    ]
    parts = " UNION ALL ".join(f"SELECT {k} AS number, '{metrics.SCENARIOS[k - 1]}' AS scenario, sum({a}) FILTER ({w}) AS t, sum({n}) FILTER ({w}) AS n FROM {t}" for k, t, w, a, n in rows)
    return f"""SELECT number, scenario, CAST(t AS DOUBLE) AS total_revenue, CAST(n AS DOUBLE) AS net_revenue, CAST(t - b AS DOUBLE) AS delta_vs_baseline, CAST(t - b AS DOUBLE) / CAST(b AS DOUBLE) * 100 AS delta_pct
FROM ({parts}), (SELECT sum(amount) AS b FROM done)"""


def _columns_of_events() -> str:
    columns = ("event_id", "ts", "user_id", "event_type", "value", "props")
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct FROM events" for c in columns)


_SEGMENTS = """
SELECT segment, orders, CAST(revenue AS DOUBLE) AS revenue, CAST(discounts AS DOUBLE) AS discounts, CAST(revenue - discounts AS DOUBLE) AS net_revenue,
       CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE) * 100 AS pct_of_revenue,
       CASE WHEN orders = 0 THEN 0.0 ELSE CAST(revenue AS DOUBLE) / orders END AS avg_order_value
FROM (
  SELECT s.segment, count(d.order_id) AS orders, coalesce(sum(d.amount), 0) AS revenue, coalesce(sum(d.discount), 0) AS discounts
  FROM (SELECT DISTINCT segment FROM {customers} UNION SELECT 'Unknown') s LEFT JOIN {done} d USING (segment) GROUP BY s.segment
)
"""
_SYNTH = f"""
WITH c AS (SELECT CAST(id + 100001 AS VARCHAR) AS customer_id, CASE id % 5 WHEN 0 THEN 'Enterprise' WHEN 1 THEN 'Mid-Market' ELSE 'SMB' END AS segment FROM range({SYNTH_CUSTOMERS}) t(id)
), b AS (SELECT id, (id * 7919 + 12345) % {SYNTH_CUSTOMERS} AS buyer FROM range({SYNTH_ORDERS}) t(id)
), o AS (
  SELECT id, CAST(id + 1 AS VARCHAR) AS order_id,
         CAST(CASE WHEN id % 100 < 2 THEN 199001 + id % 50 ELSE 100001 + CASE WHEN buyer % 5 = 1 THEN (buyer + 1) % {SYNTH_CUSTOMERS} ELSE buyer END END AS VARCHAR) AS customer_id,
         CAST((id * 104729 + 12345) % 120000 + 500 AS DECIMAL(18,2)) / 100 AS a, CASE id % 10 WHEN 0 THEN 'refunded' WHEN 1 THEN 'cancelled' ELSE 'completed' END AS status FROM b
), p AS (
  SELECT id, sum(CAST(((id * part * 7907 + 12345) % 6000 + 100) AS DECIMAL(18,2))) AS cents
  FROM (SELECT id, unnest(CASE WHEN id % 100 = 0 THEN [1, 2] ELSE [1] END) AS part FROM range({SYNTH_ORDERS}) t(id) WHERE id % 20 = 0) GROUP BY id
), s_done AS (
  SELECT o.order_id, coalesce(c.segment, 'Unknown') AS segment, CAST(a AS DECIMAL(18,2)) AS amount, least(CAST(coalesce(cents, 0) / 100 AS DECIMAL(18,2)), CAST(a AS DECIMAL(18,2))) AS discount
  FROM o LEFT JOIN p USING (id) LEFT JOIN c USING (customer_id) WHERE status = 'completed'
)
""" + _SEGMENTS.format(customers="c", done="s_done")

_VISITS = """, visits AS (
  SELECT CAST(event_id AS VARCHAR) AS visit_id, CAST(user_id AS VARCHAR) AS customer_id,
         CASE WHEN event_id % 997 = 0 THEN 'soon' WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%m/%d/%Y') END AS day,
         CASE WHEN event_id % 991 = 0 THEN 'n.a.' ELSE ' ' || (event_id % 500) || '.50' END AS fee, 'x' AS note
  FROM events
) """


def _visit_findings(orphans_only: bool = False) -> str:
    rows = [
        ("customer_id", "orphan_of_customers", "SELECT count(*) FROM visits ANTI JOIN x_customers USING (customer_id) WHERE customer_id IS NOT NULL"),
        ("day", "unparseable", "SELECT count(*) FROM visits WHERE day = 'soon'"),
        ("fee", "unparseable", "SELECT count(*) FROM visits WHERE fee = 'n.a.'"),
        ("customer_id", "null_value", "SELECT count(*) FROM visits WHERE customer_id IS NULL"),
    ]
    parts = [_FINDING.format(stage="raw", t="visits", c=c, check=check, severity="info", n=n, k="NULL", d="CAST(NULL AS VARCHAR)").replace("false AS inferred", "true AS inferred") for c, check, n in rows[: 1 if orphans_only else None]]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_rows > 0"


#: query -> what follows the overlay's common table expressions
_ORACLE = {
    "table_shapes": """SELECT * FROM (SELECT 'customers' AS table_name, count(*) AS n_rows, 4 AS n_columns, 'customer_id, customer_name, segment, region' AS columns FROM x_customers
UNION ALL SELECT 'orders', count(*), 5, 'order_id, customer_id, order_date, amount, status' FROM x_orders
UNION ALL SELECT 'promotions', count(*), 4, 'promotion_id, order_id, promo_code, discount_amount' FROM x_promotions)""",
    "null_profile": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS n_nulls FROM {t}"
        for name, t, columns in (("customers", "x_customers", "customer_id customer_name segment region"), ("orders", "x_orders_raw", "order_id customer_id order_date amount status"), ("promotions", "x_promotions", "promotion_id order_id promo_code discount_amount"))
        for c in columns.split()
    ),
    "exact_duplicate_count": "SELECT n AS n_rows, d AS n_distinct, n - d AS n_duplicates FROM (SELECT count(*) AS n FROM x_orders), (SELECT count(*) AS d FROM d_orders)",
    "value_counts_segment": "SELECT segment AS value, count(*) AS n FROM x_customers GROUP BY 1",
    "value_counts_region": "SELECT region AS value, count(*) AS n FROM x_customers GROUP BY 1",
    "value_counts_status": "SELECT status AS value, count(*) AS n FROM x_orders GROUP BY 1",
    "value_counts_promo": "SELECT promo_code AS value, count(*) AS n FROM x_promotions GROUP BY 1",
    "whitespace_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} <> trim({c})) AS n_padded FROM x_orders_raw" for c in ("order_id", "customer_id", "order_date", "amount", "status")),
    "amount_profile": _MONEY_PROFILE.format(c="amount", t="x_orders_raw"),
    "discount_profile": _MONEY_PROFILE.format(c="discount_amount", t="x_promotions"),
    "date_profile": f"SELECT count(*) FILTER ({_DAY} IS NULL) AS n_unparseable, CAST(min({_DAY}) AS VARCHAR) AS first_date, CAST(max({_DAY}) AS VARCHAR) AS last_date FROM x_orders_raw",
    "duplicate_key_ids": "SELECT order_id, count(*) AS n_rows FROM x_orders_conflict GROUP BY 1 HAVING count(*) > 1",
    "duplicate_conflicts": "SELECT count(*) AS n_duplicated, count(*) FILTER (d > 1) AS n_conflicting FROM (SELECT order_id, count(DISTINCT amount) AS d FROM x_orders_conflict GROUP BY 1 HAVING count(*) > 1)",
    "duplicate_rows_of_keys": f"SELECT {_ORDER_OUT} FROM x_orders_conflict WHERE order_id IN (SELECT order_id FROM x_orders_conflict GROUP BY 1 HAVING count(*) > 1)",
    "orphan_orders": f"SELECT {_ORDER_OUT} FROM x_orders ANTI JOIN x_customers USING (customer_id)",
    "orphan_order_summary": "SELECT count(*) AS n_rows, (SELECT count(*) FROM d_orders ANTI JOIN x_customers USING (customer_id)) AS n_distinct_rows, count(DISTINCT customer_id) AS n_keys FROM x_orders ANTI JOIN x_customers USING (customer_id)",
    "orphan_promotions": "SELECT promotion_id, order_id, promo_code, CAST(discount_amount AS DOUBLE) AS discount_amount FROM x_promotions ANTI JOIN x_orders USING (order_id)",
    "promos_per_order_hist": "SELECT n_promos, count(*) AS n_orders FROM per_order GROUP BY 1",
    "promoted_order_status": "SELECT status AS value, count(*) AS n FROM x_promotions JOIN d_orders USING (order_id) GROUP BY 1",
    "id_range_known_vs_unknown": f"""SELECT a.*, b.* FROM (SELECT min(CAST(customer_id AS BIGINT)) AS known_min, max(CAST(customer_id AS BIGINT)) AS known_max FROM x_customers) a,
(SELECT min(id) AS unknown_min, max(id) AS unknown_max, count(DISTINCT id) AS n_unknown_ids, coalesce(bool_and(id >= {UNKNOWN_BLOCK}), true) AS all_unknown_in_block
 FROM (SELECT CAST(customer_id AS BIGINT) AS id FROM x_orders ANTI JOIN x_customers USING (customer_id))) b""",
    "segment_coverage": """SELECT segment, count(*) AS customers, count(*) FILTER (n > 0) AS customers_with_orders, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_orders
FROM x_customers LEFT JOIN (SELECT customer_id, count(*) AS n FROM d_orders GROUP BY 1) USING (customer_id) GROUP BY 1""",
    "naive_fanout_overstatement": """SELECT order_rows, naive_rows, CAST(n AS DOUBLE) AS naive_revenue, CAST(c AS DOUBLE) AS clean_revenue, CAST(n - c AS DOUBLE) AS overstatement, CAST(n AS DOUBLE) / CAST(c AS DOUBLE) - 1 AS overstatement_ratio
FROM (SELECT count(*) AS order_rows FROM x_orders), (SELECT count(*) AS naive_rows, sum(amount) FILTER (status = 'completed') AS n FROM x_orders LEFT JOIN x_promotions USING (order_id)), (SELECT sum(amount) AS c FROM done)""",
    "dedup_orders": f"SELECT {_ORDER_OUT} FROM d_orders",
    "promos_collapsed": "SELECT order_id, CAST(discount_raw AS DOUBLE) AS discount_raw, promo_codes, n_promos FROM per_order",
    "analysis_table": """SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date, CAST(amount AS DOUBLE) AS amount, status, CAST(discount_raw AS DOUBLE) AS discount_raw, promo_codes, n_promos,
customer_name, segment, region, is_known_customer, CAST(discount AS DOUBLE) AS discount FROM analysis""",
    "cap_summary": """SELECT count(*) FILTER (n_promos > 1) AS n_stacked, count(*) FILTER (discount_raw > amount) AS n_capped, count(*) FILTER (discount_raw > amount AND status = 'completed') AS n_capped_completed,
CAST(sum(discount_raw - discount) AS DOUBLE) AS reduction, CAST(sum(discount_raw - discount) FILTER (status = 'completed') AS DOUBLE) AS reduction_completed, count(*) FILTER (NOT is_known_customer) AS n_unknown FROM analysis""",
    "single_promotions_over_amount": "SELECT count(*) FILTER (discount_amount > amount) AS n_single_over FROM x_promotions JOIN d_orders USING (order_id)",
    "unmatched_vs_fifth": """SELECT (SELECT CAST(max(r) AS DOUBLE) FROM (SELECT sum(amount) AS r FROM done WHERE NOT is_known_customer GROUP BY customer_id)) AS largest_unmatched,
(SELECT CAST(max(revenue) AS DOUBLE) FROM ranked WHERE rank = 5) AS last_in""",
    "status_breakdown": "SELECT status, count(*) AS orders, CAST(sum(amount) AS DOUBLE) AS value FROM analysis GROUP BY 1",
    "revenue_totals": """SELECT count(*) AS orders, CAST(sum(amount) AS DOUBLE) AS gross_revenue, CAST(sum(discount) AS DOUBLE) AS total_discount, CAST(sum(amount) - sum(discount) AS DOUBLE) AS net_revenue,
count(*) FILTER (discount > 0) AS promoted_orders, CAST(sum(discount) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS discount_rate FROM done""",
    "revenue_by_segment": _SEGMENTS.format(customers="x_customers", done="done"),
    "segment_checksum": """SELECT CAST(t AS DOUBLE) AS total_revenue, CAST(p AS DOUBLE) AS segments_revenue, t = p AS is_equal
FROM (SELECT sum(amount) AS t FROM done), (SELECT sum(r) AS p FROM (SELECT segment, sum(amount) AS r FROM done GROUP BY 1) WHERE segment IN (SELECT segment FROM x_customers UNION SELECT 'Unknown'))""",
    "top5_customers": """SELECT CAST(rank AS INTEGER) AS rank, customer_id, customer_name, segment, region, orders, CAST(revenue AS DOUBLE) AS revenue, CAST(discounts AS DOUBLE) AS discounts, CAST(revenue - discounts AS DOUBLE) AS net_revenue
FROM ranked WHERE rank <= 5""",
    "top5_share": """SELECT CAST(b AS DOUBLE) AS top_revenue, CAST(t AS DOUBLE) AS total_revenue, CAST(b AS DOUBLE) / CAST(t AS DOUBLE) AS share
FROM (SELECT sum(revenue) AS b FROM ranked WHERE rank <= 5), (SELECT sum(amount) AS t FROM done)""",
    "rank_gap_5_6": """SELECT CAST(a AS DOUBLE) AS last_in, CAST(b AS DOUBLE) AS first_out, CAST(a - b AS DOUBLE) AS gap, CAST(a - b AS DOUBLE) / CAST(a AS DOUBLE) AS gap_ratio
FROM (SELECT max(revenue) FILTER (rank = 5) AS a, max(revenue) FILTER (rank = 6) AS b FROM ranked)""",
    "scenario_table": _scenarios(),
    "findings_raw": _AMOUNTS + _RAW,
    "findings_final": _STAGES + _FINAL,
    "ledger": _STAGES + _LEDGER,
    "qc_before_after": _AMOUNTS + _STAGES + f"SELECT stage, severity, count(*) AS n_findings, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM (({_RAW}) UNION ALL ({_FINAL})) GROUP BY 1, 2",
    "data_health": _AMOUNTS + _STAGES
    + f"""SELECT CASE WHEN f > 0 THEN 'Blocked' WHEN w > 0 THEN 'Needs review' WHEN i > 0 THEN 'Clean with notes' ELSE 'Healthy' END AS health, f AS n_fail, w AS n_warn, i AS n_info, rows_in, rows_out, CAST(rows_out AS DOUBLE) / CAST(rows_in AS DOUBLE) * 100 AS retention_pct
FROM (SELECT count(*) FILTER (severity = 'fail') AS f, count(*) FILTER (severity = 'warn') AS w, count(*) FILTER (severity = 'info') AS i FROM (({_RAW}) UNION ALL ({_FINAL}))),
(SELECT count(*) AS rows_in FROM x_orders_dirty), (SELECT count(*) AS rows_out FROM modelled)""",
    "filter_stage": f"""SELECT 'unparseable_amount' AS rule, count(*) AS rows_dropped FROM x_orders_dirty WHERE {_AMOUNT} IS NULL
UNION ALL SELECT 'unparseable_date', count(*) FROM x_orders_dirty WHERE {_AMOUNT} IS NOT NULL AND {_DAY} IS NULL
UNION ALL SELECT 'non_positive_amount', count(*) FROM x_orders_dirty WHERE {_AMOUNT} <= 0 AND {_DAY} IS NOT NULL""",
    "undeclared_profile": _columns_of_events(),
    "undeclared_deduped": "SELECT 2 * count(*) AS n_rows, count(DISTINCT event_id) AS n_distinct, 2 * count(*) - count(DISTINCT event_id) AS n_duplicates FROM events",
    "inferred_foreign_key": _VISITS + _visit_findings(orphans_only=True),
    "inferred_types_and_key": "SELECT * FROM (VALUES ('visit_id', 'string', true), ('customer_id', 'string', false), ('day', 'date', false), ('fee', 'money', false), ('note', 'string', false)) t(column_name, type, is_key)",
    "undeclared_findings": _VISITS + _visit_findings(),
    "undeclared_coerced": _VISITS
    + """SELECT DISTINCT visit_id, customer_id, CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y'))::DATE AS VARCHAR) AS day,
CAST(TRY_CAST(trim(fee) AS DECIMAL(18,2)) AS DOUBLE) AS fee, note FROM visits""",
    "findings_promotions": _AMOUNTS + _PROMOTIONS,
    "findings_broken_table": _STAGES
    + """, broken AS (SELECT m.*, coalesce(c.segment, 'Unknown') AS segment FROM modelled m LEFT JOIN x_customers c USING (customer_id) WHERE CAST(order_id AS BIGINT) % 11 <> 0)
SELECT 'final' AS stage, table_name, column_name, check_name, 'fail' AS severity, CAST(n AS BIGINT) AS n_rows, CAST(NULL AS BIGINT) AS n_keys, false AS inferred FROM (
SELECT 'analysis' AS table_name, 'order_id' AS column_name, 'fan_out' AS check_name, (SELECT count(*) FROM d_clean) - (SELECT count(*) FROM broken) AS n
UNION ALL SELECT 'analysis', 'discount', 'cap_not_held', (SELECT count(*) FROM broken WHERE discount_raw > amount)
UNION ALL SELECT 'analysis', 'segment', 'segments_do_not_add_up', (SELECT CAST(count(*) > 0 AS BIGINT) FROM broken WHERE segment = 'BUILDING' AND status = 'completed')
UNION ALL SELECT 'orders', 'order_id', 'ledger_does_not_reconcile', (SELECT count(*) FROM modelled) - (SELECT count(*) FROM broken)) WHERE n > 0""",
    "promotion_filter": f"""SELECT 'unparseable_discount' AS rule, count(*) AS rows_dropped FROM x_promotions_raw WHERE {_DISCOUNT} IS NULL
UNION ALL SELECT 'exact_duplicate', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x_promotions_raw WHERE {_DISCOUNT} IS NOT NULL)) FROM x_promotions_raw WHERE {_DISCOUNT} IS NOT NULL""",
    "promotions_clean": f"SELECT * REPLACE (CAST(discount_amount AS DOUBLE) AS discount_amount) FROM ({_CLEAN_PROMOTIONS})",
    "csv_customers": "SELECT * FROM x_customers",
    "csv_orders": "SELECT * FROM x_orders_dirty",
    "csv_promotions": "SELECT * FROM x_promotions_raw",
    "discovered_tables": """SELECT 'customers' AS table_name, count(*) AS n_rows, 4 AS n_columns, 'customer_id, customer_name, segment, region' AS columns FROM x_customers
UNION ALL SELECT 'orders', count(*), 5, 'order_id, customer_id, order_date, amount, status' FROM x_orders_dirty
UNION ALL SELECT 'promotions', count(*), 4, 'promotion_id, order_id, promo_code, discount_amount' FROM x_promotions_raw
UNION ALL SELECT 'suppliers', count(*), 2, 's_suppkey, s_name' FROM supplier""",
    "partitioned_month": "SELECT '1995-03' AS order_month, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM analysis WHERE strftime(order_date, '%Y-%m') = '1995-03' HAVING count(*) > 0",
    "written_results": """SELECT 'total' AS status, count(*) AS orders, CAST(sum(amount) AS DOUBLE) AS value FROM done
UNION ALL SELECT status, count(*), CAST(sum(amount) AS DOUBLE) FROM analysis GROUP BY 1""",
    "report_lines": """SELECT * FROM (VALUES (0, '## Status'), (1, ''), (2, '| status | orders | share |'), (3, '|---|---|---|')) t(n, line)
UNION ALL SELECT CAST(3 + row_number() OVER (ORDER BY status) AS INTEGER), '| ' || status || ' | ' || format('{:,}', count(*)) || ' | 12.50% |' FROM analysis GROUP BY status""",
    "validated_joins": """SELECT 'one_to_one' AS join_name, false AS refused, (SELECT count(*) FROM d_orders) AS n_rows UNION ALL SELECT 'many_to_one', false, (SELECT count(*) FROM x_orders)
UNION ALL SELECT 'fan_out', (SELECT count(*) > count(DISTINCT order_id) FROM x_promotions), NULL
UNION ALL SELECT 'duplicates_one_to_one', (SELECT count(*) > count(DISTINCT order_id) FROM x_orders), NULL
UNION ALL SELECT 'unique_orders', false, (SELECT count(*) FROM d_orders) UNION ALL SELECT 'unique_conflict', (SELECT count(*) > 0 FROM x_orders0 WHERE o_orderkey % 2003 = 0), NULL""",
    "run_segments": _STAGES
    + f""", clean_promotions AS ({_CLEAN_PROMOTIONS}), per_clean AS (SELECT order_id, CAST(sum(discount_amount) AS DECIMAL(18,2)) AS discount_raw FROM clean_promotions GROUP BY 1
), run_done AS (
  SELECT o.order_id, o.amount, coalesce(c.segment, 'Unknown') AS segment, least(coalesce(p.discount_raw, CAST(0 AS DECIMAL(18,2))), o.amount) AS discount
  FROM d_clean o LEFT JOIN per_clean p USING (order_id) LEFT JOIN x_customers c ON o.customer_id = c.customer_id WHERE o.status = 'completed'
) """
    + _SEGMENTS.format(customers="x_customers", done="run_done"),
    "run_gate": """SELECT 'dirty' AS case_name, '' AS blocked, 6 AS n_answers, 0 AS n_others
UNION ALL SELECT 'conflict', CASE WHEN n > 0 THEN 'orders.order_id: conflicting_duplicate (' || n || ')' ELSE '' END, CASE WHEN n > 0 THEN 0 ELSE 6 END, 0 FROM (SELECT count(*) AS n FROM x_orders0 WHERE o_orderkey % 2003 = 0)
UNION ALL SELECT 'no_promotions', 'the transform needs promotions', 0, 1""",
    "batches": _STAGES
    + f""", early AS (SELECT * FROM d_clean WHERE order_date < DATE '{WRITTEN_UNTIL}'), late AS (SELECT * FROM d_clean WHERE order_date >= (SELECT max(order_date) FROM early) AND order_id NOT IN (SELECT order_id FROM early))
SELECT 'backfill' AS batch, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount, CAST(max(order_date) AS VARCHAR) AS watermark, 0 AS n_changed FROM early
UNION ALL SELECT 'rerun', 0, 0.0, CAST(max(order_date) AS VARCHAR), 0 FROM early
UNION ALL SELECT 'new_part', count(*), CAST(coalesce(sum(amount), 0) AS DOUBLE), CAST(greatest((SELECT max(order_date) FROM early), coalesce(max(order_date), (SELECT max(order_date) FROM early))) AS VARCHAR), 0 FROM late""",
    "incremental_new_rows": f"SELECT {_ORDER_OUT} FROM d_orders WHERE order_date >= DATE '{WATERMARK}' AND order_date >= DATE '{WRITTEN_UNTIL}'",
    "incremental_late_rows": f"SELECT count(*) AS n_late FROM d_orders WHERE order_date < DATE '{WATERMARK}' AND CAST(order_id AS BIGINT) % 7 = 0",
}


def oracle_sql() -> dict[str, str]:
    return {name: SQL + query for name, query in _ORACLE.items()} | {"synthetic_by_segment": _SYNTH}


