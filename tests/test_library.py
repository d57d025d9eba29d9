"""Unit tests of casts, audits, joins, the model, metrics, quality control and batches on small frames."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark import report
from ledgerspark.functions import casts
from ledgerspark.operators import audit, infer, joins, metrics, model, qc
from ledgerspark.plans import pipeline
from ledgerspark.policy import Policy, Registry
from ledgerspark.sources import synth, tables
from ledgerspark.streaming import incremental

CUSTOMERS = "customer_id string, customer_name string, segment string, region string"
ORDERS = "order_id string, customer_id string, order_date date, amount decimal(18,2), status string"
RAW = "order_id string, customer_id string, order_date string, amount string, status string"
PROMOS = "promotion_id string, order_id string, promo_code string, discount_amount decimal(18,2)"
DAY = date(2025, 7, 1)


def values(df, f):
    return [r[0] for r in df.select(f).collect()]


def column(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "x string")


def customers(spark, rows=(("1", "A", "SMB", "N"), ("2", "B", "Enterprise", "S"), ("3", "C", "Mid-Market", "N"))):
    return spark.createDataFrame(list(rows), CUSTOMERS)


def orders(spark, rows):
    return spark.createDataFrame([(i, c, d, Decimal(str(a)), s) for i, c, d, a, s in rows], ORDERS)


def promotions(spark, rows=()):
    return spark.createDataFrame([(i, o, c, Decimal(str(a))) for i, o, c, a in rows], PROMOS)


def test_money_strings(spark):
    texts = ["12", " 12 ", "1,234", "", "1e3", "inf", "NaN", "12d", "1_000", "12.345", "$5", "-3", None]
    got = values(column(spark, texts), casts.money(F.col("x")))
    assert got == [Decimal("12.00"), Decimal("12.00"), None, None, Decimal("1000.00"), None, None, None, None, Decimal("12.35"), None, Decimal("-3.00"), None]
    assert values(column(spark, ["12.345", "12.30", "abc"]), casts.has_more_decimals(F.col("x"))) == [True, False, False]


def test_date_strings(spark):
    texts = ["2025-07-01", "2025-7-1", " 2025-07-01", "2025-02-30", "2025-07-01 00:00:00", "20250701", "2025", None]
    assert values(column(spark, texts), casts.date(F.col("x"))) == [DAY, DAY, None, None, None, None, None, None]
    assert values(column(spark, ["2025-07-01", "07/01/2025", "01.07.2025", "x"]), casts.mixed_date(F.col("x"))) == [DAY, DAY, DAY, None]


def test_padding_of_any_script(spark):
    texts = ["x", "\t x\n", " x", "x　", None]
    assert values(column(spark, texts), casts.is_padded(F.col("x"))) == [False, True, True, True, False]
    assert values(column(spark, texts), casts.stripped(F.col("x")))[:4] == ["x"] * 4


def test_null_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,region\nNA,NA\nn/a,x\nNone,y\n,z\nkept,w\n")
    df = tables.csv(spark, str(tmp_path / "t.csv"), keep_tokens=("region",))
    assert sorted((r.a or "", r.region) for r in df.collect()) == [("", "NA"), ("", "x"), ("", "y"), ("", "z"), ("kept", "w")]


def test_orphans_keep_null_keys(spark):
    child, parent = column(spark, ["a", None, None, "b"]), column(spark, ["a", None])
    assert sorted(str(r.x) for r in audit.orphans(child, parent, "x").collect()) == ["None", "None", "b"]


def test_duplicates_and_conflicts(spark):
    df = spark.createDataFrame([("1", 10, None), ("1", 10, None), ("2", 10, 1), ("2", 11, 1), ("3", 1, 1)], "k string, a int, b int")
    assert tuple(audit.duplicate_rows(df).first()) == (5, 4, 1)
    assert tuple(audit.duplicate_conflicts(df, "k").first()) == (2, 1)
    assert tuple(audit.duplicate_rows(df.limit(0)).first()) == (0, 0, 0)


def test_validated_join_raises(spark):
    left, twice = column(spark, ["a", "b"]), column(spark, ["a", "a"])
    with pytest.raises(joins.CardinalityError):
        joins.validated_join(left, twice, "x")
    with pytest.raises(joins.CardinalityError):
        joins.validated_join(column(spark, [None, None]), left, "x", validate="one_to_one")
    assert joins.validated_join(twice, left, "x").count() == 2


def test_stacked_promotions_are_summed_and_capped(spark):
    t = model.analysis_table(customers(spark), orders(spark, [("o", "1", DAY, 50, "completed")]), promotions(spark, [("p", "o", "Z", 30), ("q", "o", "A", 40)]), check=True).first()
    assert (t.discount_raw, t.discount, t.promo_codes, t.n_promos) == (Decimal("70.00"), Decimal("50.00"), "A + Z", 2)


def test_match_is_by_row_not_by_name(spark):
    t = model.analysis_table(customers(spark, [("1", None, None, "N")]), orders(spark, [("o", "1", DAY, 5, "completed"), ("p", "9", DAY, 5, "completed")]), promotions(spark))
    assert {r.order_id: (r.is_known_customer, r.segment) for r in t.collect()} == {"o": (True, "Unknown"), "p": (False, "Unknown")}


def test_policy_alternatives(spark):
    args = customers(spark), orders(spark, [("o", "1", DAY, 50, "completed")] * 2 + [("p", "9", DAY, 5, "refunded")]), promotions(spark, [("x", "o", "A", 60)])
    assert model.analysis_table(*args, Policy(drop_exact_duplicates=False)).count() == 3
    assert model.analysis_table(*args, Policy(keep_unknown_customers=False)).count() == 1
    uncapped = metrics.revenue_totals(model.analysis_table(*args, Policy(cap_discounts=False))).first()
    assert uncapped.net_revenue == -10.0
    both = Policy(revenue_statuses=("completed", "refunded"))
    assert metrics.revenue_totals(model.analysis_table(*args, both), both).first().gross_revenue == 55.0


def test_ties_rank_by_id_and_short_rankings_have_no_gap(spark):
    six = [(str(k), f"N{k}", "SMB", "R") for k in range(1, 7)]
    t = model.analysis_table(customers(spark, six), orders(spark, [(f"o{k}", str(k), DAY, 10, "completed") for k in (6, 3, 1, 5, 2, 4)]), promotions(spark))
    assert [(r["rank"], r.customer_id) for r in metrics.top_customers(t).orderBy("rank").collect()] == [(k, str(k)) for k in range(1, 6)]
    assert tuple(metrics.rank_gap(t).first()) == (10.0, 10.0, 0.0, 0.0)
    assert tuple(metrics.rank_gap(t.where("customer_id < 3")).first()) == (None, None, None, None)


def test_empty_orders_and_zero_totals(spark):
    t = model.analysis_table(customers(spark), orders(spark, []), promotions(spark))
    assert tuple(metrics.revenue_totals(t).first()) == (0, 0.0, 0.0, 0.0, 0, None)
    rows = metrics.revenue_by_segment(t, customers(spark)).collect()
    assert sorted(r.segment for r in rows) == ["Enterprise", "Mid-Market", "SMB", "Unknown"]
    assert all(r.orders == 0 and r.pct_of_revenue is None and r.avg_order_value == 0 for r in rows)
    zero = model.analysis_table(customers(spark), orders(spark, [("o", "1", DAY, 0, "completed")]), promotions(spark))
    row = metrics.revenue_by_segment(zero, customers(spark)).where("segment = 'SMB'").first()
    assert (row.orders, row.pct_of_revenue, row.avg_order_value) == (1, None, 0.0)


def test_metamorphic_properties(spark):
    c, o, p = synth.customers(spark, 50), synth.orders(spark, 2_000, 50), synth.promotions(spark, 2_000)
    base = metrics.revenue_totals(model.analysis_table(c, o, p)).first()
    assert metrics.revenue_totals(model.analysis_table(c, o.union(o.limit(300)), p)).first() == base
    assert metrics.revenue_totals(model.analysis_table(c.repartition(7), o.repartition(5), p.repartition(3))).first() == base
    uncapped = metrics.revenue_totals(model.analysis_table(c, o, p, Policy(cap_discounts=False))).first()
    assert uncapped.net_revenue <= base.net_revenue <= base.gross_revenue
    assert metrics.segment_checksum(model.analysis_table(c, o, p), c).first().is_equal
    more = c.union(spark.createDataFrame([("x", "X", "New", "N")], CUSTOMERS))
    before, after = (metrics.revenue_by_segment(model.analysis_table(d, o, p), d).collect() for d in (c, more))
    assert {r.segment for r in after} - {r.segment for r in before} == {"New"}
    assert o.count() == 2_000 and audit.orphan_summary(o, c, "customer_id").first().n_rows == 40


def raw_tables(spark, rows, promos=()):
    return {"customers": customers(spark), "orders": spark.createDataFrame(rows, RAW), "promotions": promotions(spark, promos)}


CLEAN = [("1", "1", "2025-07-01", "10.00", "completed"), ("2", "2", "2025-07-02", "20.00", "refunded")]
DIRTY = [*CLEAN, CLEAN[0], ("3", "99", "2025-07-01", "5.00", "completed"), ("4", "1", "not-a-date", "5.00", "completed"), ("5", "1", "2025-07-01", "-5.00", "completed"), ("6", "1", "2025-07-01", "0", "completed"), ("7", "1", "2025-07-01", "abc", "completed")]


def test_clean_batch_is_healthy(spark):
    r = pipeline.run(raw_tables(spark, CLEAN))
    assert r.health.first().health == "Healthy" and not r.blocked
    assert r.answers["totals"].first().gross_revenue == 10.0
    assert r.health.first().retention_pct == 100.0


def test_dirty_batch_needs_review(spark):
    r = pipeline.run(raw_tables(spark, DIRTY, [("p", "1", "A", 12)]))
    checks = {(f.table_name, f.column_name, f.check_name): f.n_rows for f in r.findings.collect()}
    assert checks[("orders", "amount", "unparseable")] == checks[("orders", "amount", "negative")] == checks[("orders", "amount", "zero")] == 1
    assert checks[("orders", "order_date", "unparseable")] == checks[("orders", "customer_id", "orphan")] == checks[("orders", "order_id", "exact_duplicate")] == 1
    assert checks[("analysis", "discount", "capped")] == 1
    assert r.health.first().health == "Needs review"
    assert r.answers["totals"].first().gross_revenue == 15.0
    steps = r.ledger.orderBy("step").collect()
    assert [(s.rows_in, s.rows_out) for s in steps] == [(8, 8), (8, 4), (4, 3), (3, 3)]
    assert all(a.rows_out == b.rows_in for a, b in zip(steps, steps[1:]))
    with pytest.raises(model.QCFailed):
        pipeline.run(raw_tables(spark, DIRTY), Policy(on_bad_value="fail"), raise_on_fail=True)


def test_conflicting_duplicate_blocks_the_numbers(spark):
    conflict = [*DIRTY, ("1", "1", "2025-07-01", "11.00", "completed")]
    r = pipeline.run(raw_tables(spark, conflict))
    assert r.blocked and not r.answers
    assert r.health.first().health == "Blocked"
    assert r.findings.where("check_name = 'conflicting_duplicate' AND severity = 'fail'").count() == 1
    with pytest.raises(model.QCFailed):
        pipeline.run(raw_tables(spark, conflict), raise_on_fail=True)


def test_undeclared_tables_only_inform(spark):
    tickets = spark.createDataFrame([("t1", "1", "2025-07-01", "5", "a"), ("t1", "1", "2025-07-01", "5", "a"), ("t2", "77", "2025-07-02", "6", None)], "ticket_id string, customer_id string, opened_on string, minutes string, note string")
    r = pipeline.run(raw_tables(spark, CLEAN) | {"support_tickets": tickets})
    mine = {f.check_name: f for f in r.findings.where("table_name = 'support_tickets'").collect()}
    assert mine["exact_duplicate"].n_rows == 1 and mine["orphan_of_customers"].n_rows == 1 and mine["null_value"].n_rows == 1
    assert all(f.severity == "info" and f.inferred for f in mine.values())
    assert r.answers["totals"].first().gross_revenue == 10.0
    types = infer.inferred_types(tickets)
    assert types == {"ticket_id": "string", "customer_id": "string", "opened_on": "date", "minutes": "money", "note": "string"}
    assert r.others["support_tickets"].count() == 2


def test_inferred_keys_own_their_columns(spark):
    df = spark.createDataFrame([("r1", "o1"), ("r2", "o1")], "return_id string, order_id string")
    assert infer.inferred_key(df) == "return_id"
    registry = Registry()
    registry.add_inferred("returns", "return_id")
    assert registry.owners("return_id") == ["returns"] and registry.owners("order_id") == ["orders"]


def test_missing_table_is_refused(spark):
    """The transform doesn't run; undeclared tables are looked at all the same."""
    tickets = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", None)], "ticket_id string, text string")
    r = pipeline.run({"customers": customers(spark), "orders": customers(spark), "tickets": tickets})
    assert r.blocked == "the transform needs promotions" and not r.answers and set(r.others) == {"tickets"}
    assert {f.check_name for f in r.findings.collect()} >= {"exact_duplicate", "null_value"} and r.health.count() == 1
    with pytest.raises(model.QCFailed, match="promotions"):
        pipeline.run({"customers": customers(spark)}, raise_on_fail=True)


def test_raw_promotions_are_checked_and_cleaned(spark):
    raw = spark.createDataFrame([("p", "1", "A", "abc"), ("q", "1", "B", "2.00"), ("q", "1", "B", "2.00"), ("r", "2", "C", " 99.999 "), ("s", "9", "D", "-1")], "promotion_id string, order_id string, promo_code string, discount_amount string")
    r = pipeline.run(raw_tables(spark, CLEAN) | {"promotions": raw})
    assert r.blocked == "" and r.answers["totals"].first().total_discount == 2.0
    found = {(f.column_name, f.check_name): f.n_rows for f in r.findings.collect() if f.table_name == "promotions"}
    assert found == {("discount_amount", "unparseable"): 1, ("discount_amount", "negative"): 1, ("discount_amount", "more_than_two_decimals"): 1, ("discount_amount", "over_amount"): 1, ("order_id", "orphan"): 1, ("promotion_id", "exact_duplicate"): 1, ("order_id", "stacked"): 2}
    assert {x.rule: x.rows_dropped for x in r.promotion_log.collect()} == {"unparseable_discount": 1, "exact_duplicate": 1}
    assert r.health.first().health == "Needs review"


def test_versions_of_a_key_block_a_batch(spark, tmp_path):
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    with pytest.raises(model.QCFailed, match="several versions"):
        incremental.run_batch(spark, orders(spark, [("a", "1", DAY, 10, "completed"), ("a", "1", DAY, 11, "completed")]), target, state)
    assert incremental.run_batch(spark, orders(spark, [("a", "1", DAY, 10, "completed")] * 2), target, state).rows == 1
    again = incremental.run_batch(spark, orders(spark, [("a", "1", DAY, 12, "completed"), ("b", "1", DAY, 3, "completed")]), target, state)
    assert (again.rows, again.amount, again.changed) == (1, 3.0, 1)


def test_types_are_inferred_from_the_whole_table(spark):
    late = spark.range(30_000).selectExpr("cast(id as string) AS visit_id", "CASE WHEN id < 15000 THEN '5' ELSE 'word' END AS fee")
    assert infer.inferred_types(late)["fee"] == "string"


def test_folder_of_files_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "customers.csv").write_text("customer_id,customer_name,segment,region\n1,A,SMB,N\n2,B,Enterprise,S\n")
    (tmp_path / "in" / "orders").mkdir()
    for k, row in enumerate(CLEAN):
        (tmp_path / "in" / "orders" / f"part-{k}.csv").write_text("order_id,customer_id,order_date,amount,status\n" + ",".join(row) + "\n")
    (tmp_path / "in" / "promotions.csv").write_text("promotion_id,order_id,promo_code,discount_amount\np,1,A,2.50\n")
    r = pipeline.run_folder(spark, str(tmp_path / "in"), out=str(tmp_path / "out"))
    assert r.answers["totals"].first().net_revenue == 7.5
    assert spark.read.parquet(str(tmp_path / "out" / "analysis")).where("order_month = '2025-07'").count() == 2
    text = report.markdown("Segments", r.answers["by_segment"])
    assert "| SMB | 1 | 10.00 |" in text and "SMB" in report.text(r.answers["by_segment"])
    assert '"gross_revenue": 10.0' in report.as_json({"totals": r.answers["totals"]})


def test_incremental_batches(spark, tmp_path):
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    first = orders(spark, [("1", "1", date(2025, 7, 1), 10, "completed"), ("2", "1", date(2025, 7, 3), 5, "completed")])
    assert incremental.run_batch(spark, first, target, state) == incremental.Batch(2, 15.0, date(2025, 7, 3))
    assert incremental.run_batch(spark, first, target, state).rows == 0
    later = first.union(orders(spark, [("3", "1", date(2025, 7, 3), 7, "completed"), ("4", "1", date(2025, 7, 2), 9, "completed")]))
    assert incremental.run_batch(spark, later, target, state) == incremental.Batch(1, 7.0, date(2025, 7, 3))
    written = spark.read.parquet(target)
    assert [r.order_id for r in incremental.late_rows(later, written, date(2025, 7, 3)).collect()] == ["4"]
    assert incremental.run_batch(spark, later, target, state, Policy(lookback_days=5)).rows == 1


def test_stream_takes_new_files_once(spark, tmp_path):
    source, target, state, checkpoint = (str(tmp_path / x) for x in ("source", "target", "state", "checkpoint"))
    for k, n in ((1, 1), (2, 0)):
        if n:
            orders(spark, [(str(k), "1", DAY, 10, "completed")]).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ORDERS).parquet(source)
        query = incremental.start_stream(stream, target, state, checkpoint)
        assert query.awaitTermination(120)
        assert spark.read.parquet(target).count() == 1


def test_severity_of_inferred_findings_is_info():
    with pytest.raises(ValueError):
        qc.finding("raw", "t", "c", "x", "fatal", F.lit(1))
    with pytest.raises(ValueError):
        Policy(on_bad_value="ignore")
