"""Rows the sample lacks."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terraced import schemas
from terraced.functions import columns as fn
from terraced.plans import source_products as sp
from terraced.plans import transaction_domain as td
from terraced.sources import exports, landing

DAY = datetime(2026, 3, 1)


def source_frames(spark):
    def frame(table, rows):
        return spark.createDataFrame(rows, schemas.SOURCE[table])

    customers = frame("customers", [(1, "C1", "One", "EMEA", "a", DAY), (2, "C2", "Two", "EMEA", "b", DAY), (3, "C3", "Three", "AMER", "b", DAY)])
    orders = frame("orders", [("O1", 1, "paid", "web", "s", DAY), ("O2", 1, "paid", "web", "s", DAY), ("O3", 2, "created", "web", "s", DAY), ("O9", 77, "paid", "web", "s", DAY)])
    items = frame("order_items", [("I1", "O1", "S", "P", 2, D("1.25")), ("I2", "O1", "S", "P", 1, D("0.50")), ("I3", "O9", "S", "P", 1, D("9.00")), ("I4", "gone", "S", "P", 1, D("5.00"))])
    return customers, orders, items


def test_exports_keep_empty_customers_and_drop_empty_orders(spark):
    customers, orders, items = source_frames(spark)
    rows = {r.customer_id: r for r in exports.raw_customers_export(customers, orders, items).collect()}
    assert (rows["C1"].order_count, rows["C1"].total_order_value) == (2, D("3.00"))
    assert (rows["C2"].order_count, rows["C2"].total_order_value) == (1, D("0.00"))
    assert (rows["C3"].order_count, rows["C3"].total_order_value, rows["C3"].first_order_at) == (0, D("0.00"), None)
    exported = exports.raw_orders_export(orders, customers, items).collect()
    assert [(r.order_id, r.customer_id, r.item_count, r.order_total) for r in exported] == [("O1", "C1", 2, D("3.00"))]
    lines = exports.raw_order_items_export(items, orders).collect()
    assert sorted((r.item_id, r.line_total) for r in lines) == [("I1", D("2.50")), ("I2", D("0.50")), ("I3", D("9.00"))]


def raw_orders(spark, rows):
    return spark.createDataFrame(rows, schemas.MIRROR["ext_orders_raw"])


def test_bands_at_their_thresholds_and_null(spark, as_of):
    totals = ["150.00", "149.99", "75.00", "74.99", None]
    rows = [(f"O{n}", "C", "  paid ", D(1), D(t) if t else None, "2026-03-07T10:00:00+02:00", "b") for n, t in enumerate(totals)]
    clean = sp.orders_clean(raw_orders(spark, rows), as_of).orderBy("order_id").collect()
    assert [r.order_value_band for r in clean] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]
    assert {r.order_status for r in clean} == {"PAID"}
    assert {str(r.order_created_at) for r in clean} == {"2026-03-07 10:00:00"}


def test_rate_amount_and_customer_thresholds(spark, as_of):
    taxes = [("T1", "n", "Emea", D("0.2000"), None, None, "b"), ("T2", "n", " emea", D("0.1000"), None, None, "b"), ("T3", "n", "x", D("0.0999"), None, None, "b"), ("T4", "n", "x", None, None, None, "b")]
    rows = sp.taxes_clean(spark.createDataFrame(taxes, schemas.MIRROR["ext_taxes_raw"]), as_of).orderBy("tax_code").collect()
    assert [r.rate_band for r in rows] == ["HIGH", "STANDARD", "REDUCED", "REDUCED"]
    assert [r.jurisdiction for r in rows] == ["EMEA", "EMEA", "X", "X"]
    depot = [(f"D{n}", "C", "d", "load", D(a) if a else None, None, "s", None, "b") for n, a in enumerate(["70.00", "40.00", "39.99", None])]
    rows = sp.depot_transactions_clean(spark.createDataFrame(depot, schemas.MIRROR["ext_depot_transactions_raw"]), as_of)
    assert [r.amount_band for r in rows.orderBy("transaction_id").collect()] == ["HIGH", "MEDIUM", "LOW", "LOW"]
    people = [(f"C{n}", "n", "r", "s", D(1), D(v), None, None, None, "b") for n, v in enumerate(["400.00", "150.00", "149.99"])]
    rows = sp.customers_clean(spark.createDataFrame(people, schemas.MIRROR["ext_customers_raw"]), as_of)
    assert [r.customer_value_band for r in rows.orderBy("customer_id").collect()] == ["HIGH_VALUE", "MEDIUM_VALUE", "LOW_VALUE"]


def test_text_in_a_number_raises(spark, as_of):
    raw = raw_orders(spark, [("O", "C", "paid", D(1), D(1), None, "b")]).withColumn("order_total", F.lit("abc"))
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        sp.orders_clean(raw, as_of).collect()


def test_fact_fills_orders_without_items(spark, as_of):
    orders = sp.orders_clean(raw_orders(spark, [("O1", "C1", "paid", D(1), D(10), "2026-03-07T10:00:00", "b"), ("O2", None, None, D(0), None, None, "b")]), as_of).drop("cleaned_at")
    lines = spark.createDataFrame([("O1", D("4.00")), ("O1", D("6.00"))], "order_id string, line_total decimal(38,2)")
    customers = td.dim_customers(sp.customer_order_summary(orders))
    fact = td.fct_order_revenue_star(orders, td.items_per_order(lines), customers, td.dim_order_status(orders), as_of)
    rows = {r.order_id: r for r in fact.collect()}
    assert len(rows) == 2
    assert (rows["O1"].item_rows, rows["O1"].item_revenue) == (2, D("10.00"))
    assert (rows["O2"].item_rows, rows["O2"].item_revenue, rows["O2"].customer_sk, rows["O2"].status_sk) == (0, D("0.00"), None, None)


def test_iso_text_keeps_microseconds_only_when_there(spark):
    rows = spark.sql("SELECT explode(array(timestamp'2026-03-07 10:00:00', timestamp'2026-03-07 10:00:00.012')) AS t")
    assert sorted(r[0] for r in rows.select(fn.iso_text(F.col("t"))).collect()) == ["2026-03-07T10:00:00+00:00", "2026-03-07T10:00:00.012000+00:00"]


def test_mirror_drops_nothing_it_was_not_given(spark, as_of):
    export = exports.raw_taxes_export(spark.createDataFrame([(1, "T", "n", "j", D("0.1"), DAY, DAY)], schemas.SOURCE["taxes"]))
    [row] = landing.mirror(landing.stamped("raw_taxes", export, as_of), "ext_taxes_raw").collect()
    assert (row.effective_at, row.rate, row.load_batch) == ("2026-03-01T00:00:00+00:00", D("0.1000"), "postgres-seed-20260307T120000Z")


def test_names(spark):
    rows = spark.createDataFrame([("Feature/ABC--12",), ("__x__",), ("PRD_done",), ("PRDx",)], "s string")
    got = rows.select(fn.slug(F.col("s")), fn.prefixed(F.col("s"))).collect()
    assert [r[0] for r in got] == ["feature_abc_12", "x", "prd_done", "prdx"]
    assert [r[1] for r in got] == ["PRD_Feature/ABC--12", "PRD___x__", "PRD_done", "PRD_PRDx"]


def test_padding_never_cuts(spark):
    got = spark.createDataFrame([(7,), (12345,)], "n int").select(fn.padded(F.col("n"), 4)).collect()
    assert [r[0] for r in got] == ["0007", "12345"]


def test_checksum_is_the_posix_one(spark):
    # Printed by the cksum tool for the text and a newline.
    known = {"abc_OWN_feature": 994503885, "SDP_X": 4093027353, "": 3515105045}
    rows = spark.createDataFrame([(k,) for k in known], "s string")
    assert {r.s: r.c for r in rows.select("s", fn.posix_cksum(F.col("s")).alias("c")).collect()} == known


def test_checksum_takes_no_steps_per_bit(spark):
    rows = spark.createDataFrame([("\x00\x00",), ("é€😀",), ("x" * 70_000,)], "s string").select("s", fn.posix_cksum(F.col("s")).alias("c"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "crc32(" in plan and "lambdafunction" not in plan and "namedlambdavariable" not in plan
    assert {r.s: r.c for r in rows.collect()}["é€😀"] == 141826864
    assert rows.filter("c IS NULL").count() == 0
