"""The whole platform over the sample rows, checked against known values."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from terraced import schemas
from terraced.operators import clones, quality
from terraced.plans import build
from terraced.session import scratch_path
from terraced.sources import catalog, landing
from terraced.sources.catalog import Warehouse
from terraced.sources.seed import seed_all

ORDER_TOTALS = (
    "54.00 61.30 132.10 65.70 73.00 155.50 77.40 84.70 178.90 89.10 96.40 202.30 100.80 108.10 225.70 "
    "112.50 119.80 249.10 124.20 131.50 272.50 135.90 143.20 295.90 147.60 154.90 319.30 159.30 166.60 342.70"
).split()
CUSTOMER_TOTALS = "302.40 324.30 677.10 337.50 359.40 747.30 201.60 216.20 451.40 225.00 239.60 498.20".split()


@pytest.fixture(scope="module")
def wh(spark, as_of):
    warehouse = Warehouse(spark, "seedtest_", scratch_path(spark, "warehouse"))
    build.run_all(warehouse, seed_all(spark, as_of), as_of)
    return warehouse


def test_row_counts_of_every_layer(wh):
    expected = {
        ("sdp_orders", "inbound", "ext_orders_raw"): 30,
        ("sdp_orders", "inbound", "ext_order_items_raw"): 60,
        ("sdp_customers", "inbound", "ext_customers_raw"): 12,
        ("sdp_taxes", "inbound", "ext_taxes_raw"): 8,
        ("sdp_depot_transactions", "inbound", "ext_depot_transactions_raw"): 18,
        ("sdp_orders", "core", "customer_order_summary"): 12,
        ("sdp_customers", "access", "customers_region_grain"): 3,
        ("sdp_customers", "access", "customers_segment_grain"): 3,
        ("edp_customers", "core", "dim_regions"): 3,
        ("edp_customers", "core", "dim_segments"): 3,
        ("edp_customers", "core", "fct_customer_value_star"): 12,
        ("edp_customers", "access", "customers_high_value"): 4,
        ("edp_orders", "core", "dim_customers"): 12,
        ("edp_orders", "core", "dim_order_status"): 3,
        ("edp_orders", "core", "fct_order_revenue_star"): 30,
        ("edp_orders", "access", "orders_fulfilled"): 20,
        ("edp_taxes", "access", "taxes_only"): 8,
        ("edp_depot_transactions", "access", "depot_transactions_only"): 18,
    }
    frames = {".".join(k): wh.table(*k) for k in expected}
    report = quality.row_counts(frames, {".".join(k): n for k, n in expected.items()})
    assert report.filter("NOT matches").collect() == []


def test_order_fact_values(wh):
    rows = wh.table("edp_orders", "core", "fct_order_revenue_star").orderBy("order_id").collect()
    assert [r.order_total for r in rows] == [D(v) for v in ORDER_TOTALS]
    assert all(r.item_revenue == r.order_total and r.item_rows == r.item_count for r in rows)
    assert sum(r.order_total for r in rows) == D("4580.00")
    assert rows[0].customer_sk == "f756c275cfad018c33f98a17707b02c8"
    assert {r.order_status: r.status_sk for r in rows} == {
        "CREATED": "98690bf632c29c17c9e4c5a64069903c",
        "PAID": "c4812ee2b789226193ad2511495fa559",
        "SHIPPED": "f314c4adeaa9d772d1a4a3d076fb87a4",
    }
    bands = [r.order_value_band for r in rows]
    assert {b: bands.count(b) for b in set(bands)} == {"HIGH": 12, "MEDIUM": 14, "LOW": 4}
    assert rows[0].load_batch == "postgres-seed-20260307T120000Z"
    assert str(rows[0].order_created_at) == "2026-03-07 11:00:00"


def test_customer_fact_values(wh):
    rows = wh.table("edp_customers", "core", "fct_customer_value_star").orderBy("customer_id").collect()
    assert [r.total_order_value for r in rows] == [D(v) for v in CUSTOMER_TOTALS]
    assert [r.order_count for r in rows] == [3] * 6 + [2] * 6
    assert [r.customer_id for r in rows if r.customer_value_band == "HIGH_VALUE"] == [
        "CUST-0003", "CUST-0006", "CUST-0009", "CUST-0012",
    ]
    assert {r.region: r.region_sk for r in rows} == {
        "EMEA": "0f1c6d45b761226679e0927cc47d24d3",
        "AMER": "102d82f99a6f9cf9056d901bddf67848",
        "APAC": "a2f89a300f983190022374848c4353b0",
    }
    assert {r.segment: r.segment_sk for r in rows} == {
        "ENTERPRISE": "4d4afda25a3f52041ee1b569157130b8",
        "MID-MARKET": "66a696db248fbd62a80ca288b6098f6e",
        "SELF-SERVE": "6449a5e7635013eab126096ee32c20ef",
    }


def test_region_summary_averages_over_customers(wh):
    rows = {r.region: r for r in wh.table("sdp_customers", "access", "customers_region_grain").collect()}
    assert {k: (r.customer_count, r.total_order_count, r.total_order_value, r.avg_customer_value) for k, r in rows.items()} == {
        "EMEA": (4, 10, D("1066.50"), D("266.625")),
        "AMER": (4, 10, D("1139.50"), D("284.875")),
        "APAC": (4, 10, D("2374.00"), D("593.5")),
    }


def test_taxes_and_depot_values(wh):
    taxes = wh.table("edp_taxes", "access", "taxes_only").orderBy("tax_code").collect()
    assert [r.rate for r in taxes] == [D(v) for v in "0.0700 0.0815 0.1000 0.1195 0.2000 0.0450 0.0700 0.0815".split()]
    assert [r.rate_band for r in taxes] == "REDUCED REDUCED STANDARD STANDARD HIGH REDUCED REDUCED REDUCED".split()
    depot = wh.table("edp_depot_transactions", "access", "depot_transactions_only").orderBy("transaction_id").collect()
    assert [r.amount for r in depot] == [D("36.90") + D("1.90") * n for n in range(18)]
    by_type = {}
    for r in depot:
        by_type[r.transaction_type] = by_type.get(r.transaction_type, 0) + r.amount
    assert by_type == {"LOAD": D("306.90"), "UNLOAD": D("318.30"), "TRANSFER": D("329.70")}


def test_items_are_numbered_in_item_order(wh):
    items = wh.table("sdp_orders", "core", "order_items_clean")
    order = items.filter("order_id = 'ORD-00030'").orderBy("line_number").collect()
    assert [(r.item_id, r.line_number) for r in order] == [(f"ITEM-00030-0{n}", n) for n in (1, 2, 3)]
    assert (order[2].sku, order[2].quantity, order[2].unit_price) == ("SKU-319", 1, D("59.10"))
    assert items.agg(F.sum("quantity")).head()[0] == 120


def test_mirror_has_the_declared_types_and_text_moments(wh):
    raw = wh.source("sdp_orders", "ext_orders_raw")
    assert [(f.name, f.dataType) for f in raw.schema] == [(f.name, f.dataType) for f in schemas.MIRROR["ext_orders_raw"]]
    assert raw.filter("order_id = 'ORD-00001'").head().order_created_at == "2026-03-07T11:00:00+00:00"


def test_published_columns(wh):
    for product, table in [("sdp_orders", "orders_order_grain"), ("edp_orders", "orders_complete"), ("edp_customers", "customers_only")]:
        assert wh.table(product, "access", table).columns == schemas.published(table)


def test_all_declared_checks_pass_and_there_are_52(wh):
    results = build.declared_checks(wh)
    assert results.count() == 52
    assert quality.failing(results).collect() == []


def test_a_domain_build_leaves_its_producer_alone(wh, as_of):
    before = {n: wh.table("sdp_taxes", "access", n).inputFiles() for n in ("taxes_grain",)}
    build.build_domain(wh, "taxes", as_of)
    assert {n: wh.table("sdp_taxes", "access", n).inputFiles() for n in before} == before


def test_upstream_contract(wh):
    ok = quality.upstream_contract(wh, {("sdp_taxes", "taxes_grain"): 8, ("sdp_orders", "orders_order_grain"): 31})
    assert {r.relation: r.matches for r in ok.collect()} == {"sdp_taxes.taxes_grain": True, "sdp_orders.orders_order_grain": False}
    with pytest.raises(LookupError, match="sdp_taxes.absent"):
        quality.upstream_contract(wh, {("sdp_taxes", "absent"): 1})


def test_a_domain_build_needs_its_producer(wh, spark, as_of):
    with pytest.raises(LookupError, match="sdp_orders.orders_order_grain"):
        build.build_domain(Warehouse(spark, "nothing_", wh.location), "orders", as_of)
    with pytest.raises(ValueError, match="sdp_taxes.taxes_grain: 8 rows, not 9"):
        build.build_domain(wh, "taxes", as_of, {"taxes_grain": 9})
    build.require_upstream(wh, "all", {"taxes_grain": 8, "orders_order_grain": 30, "customers_region_grain": 3})


def test_listing_reports_and_newest_file(wh, spark):
    place = f"{wh.prefix}landing"
    assert [r.table_name for r in catalog.list_tables(spark, place).collect()] == sorted(schemas.LANDED)
    report = landing.load_report({t: spark.table(f"{place}.{t}") for t in schemas.LANDED})
    assert {r.table_name: r.row_count for r in report.collect()} == {
        "raw_customers": 12, "raw_orders": 30, "raw_order_items": 60, "raw_taxes": 8, "raw_depot_transactions": 18,
    }
    path = f"{wh.location}/{place}.db/raw_taxes"
    [newest] = landing.latest_files({"raw_taxes": path}, spark).collect()
    assert newest.row_count <= 8 and newest.data_files >= 1 and newest.file_name.endswith(".parquet")


def test_clone_is_a_snapshot_and_isolated(wh, spark):
    source = wh.namespace("edp_orders", "core")
    counts = clones.check_clone(wh, source, "fct_order_revenue_star")
    assert counts == {"source_rows": 30, "clone_rows": 30, "source_rows_after": 30, "tables_added": 0}
    assert not catalog.namespace_exists(spark, f"{source}_clone_ci")


def test_clone_ensure_replace_drop_and_purge(wh, spark):
    target = "edp_taxes_ci_clo_own_b1"
    assert clones.apply_clone(wh, "edp_taxes", target, replace=False) == "cloned"
    assert wh.table(target, "inbound", "in_taxes_grain").count() == 8
    wh.table("edp_taxes", "access", "taxes_only").limit(3).write.mode("overwrite").saveAsTable(wh.name(target, "access", "taxes_only"))
    assert clones.apply_clone(wh, "edp_taxes", target, replace=False) == "reused"
    assert wh.table(target, "access", "taxes_only").count() == 3
    assert clones.apply_clone(wh, "edp_taxes", target, replace=True) == "cloned"
    assert wh.table(target, "access", "taxes_only").count() == 8
    assert clones.apply_clone(wh, "edp_taxes", "edp_taxes", replace=True) == "same"
    assert clones.drop_clone(wh, "edp_taxes", "edp_taxes") == 0
    with pytest.raises(LookupError):
        clones.apply_clone(wh, "edp_absent", target, replace=True)
    purged = clones.purge_clones(spark, [f"{wh.prefix}edp_taxes"])
    assert purged == [f"{wh.prefix}{target}__{layer}" for layer in ("access", "core", "inbound")]
    assert wh.table("edp_taxes", "access", "taxes_only").count() == 8


def test_clone_plan_stops_before_any_change(wh, spark):
    rows = [("absent", "sdp_absent", "absent_ci_clo_own_b2"), ("taxes", "sdp_taxes", "sdp_taxes_ci_clo_own_b2")]
    plan = spark.createDataFrame(rows, "key string, source_database string, target_database string")
    with pytest.raises(LookupError, match="sdp_absent"):
        clones.apply_plan(wh, plan, "ensure", {})
    assert not catalog.namespace_exists(spark, wh.namespace("sdp_taxes_ci_clo_own_b2", "core"))
    with pytest.raises(ValueError, match="unknown mode"):
        clones.apply_plan(wh, plan, "swap", {})


def test_landing_refresh_and_purge(spark, as_of):
    wh = Warehouse(spark, "refresh_", scratch_path(spark, "warehouse"))
    frames = landing.export_frames(seed_all(spark, as_of), "taxes")
    landing.land(wh, frames, as_of)
    landed = landing.land(wh, frames, as_of, refresh=True)
    assert landed["raw_taxes"].count() == 8
    assert landing.purge(wh) == 1
    assert landing.purge(wh) == 0


def test_scope_limits_what_is_landed():
    assert landing.in_scope("orders") == ["raw_orders", "raw_order_items"]
    assert landing.in_scope("all") == list(schemas.LANDED)
    with pytest.raises(ValueError):
        build.build_source(None, "shipments", None)


def test_landing_paths():
    assert build.landing_path("dev", "postgres", "raw_taxes") == "landing/dev/postgres/raw_taxes"
    assert build.sandbox_path("proj", "branch", "postgres", "ns") == "landing/ci/proj/branch/postgres/ns"
