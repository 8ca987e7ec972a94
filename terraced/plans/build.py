"""Materialised builds: products written layer by layer into a warehouse, then checked.

Each function is an ordered list of writes for one scope. A layer is always
written from stored tables of the layer below, never in place, so a failed run is
repeated from any layer. A domain reads its producer's ACCESS tables and writes
only its own product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from terraced import schemas
from terraced.operators import quality
from terraced.plans import customer_domain as cd
from terraced.plans import source_products as sp
from terraced.plans import transaction_domain as td
from terraced.plans.order_product import OrderProduct, revenue_created, revenue_fulfilled
from terraced.sources import landing, versions
from terraced.sources.catalog import Warehouse
from terraced.sources.seed import Operational


@dataclass(frozen=True)
class Bands:
    orders: tuple = schemas.ORDER_BANDS
    customers: tuple = schemas.CUSTOMER_BANDS
    rates: tuple = schemas.RATE_BANDS
    amounts: tuple = schemas.AMOUNT_BANDS


# Source products.


def build_sdp_orders(wh: Warehouse, as_of: datetime, bands: Bands = Bands()) -> None:
    product = "sdp_orders"
    orders = sp.orders_clean(wh.source(product, "ext_orders_raw"), as_of, bands.orders)
    orders = wh.write(product, "core", "orders_clean", orders)
    items = sp.order_items_clean(wh.source(product, "ext_order_items_raw"), as_of)
    items = wh.write(product, "core", "order_items_clean", items)
    summary = wh.write(product, "core", "customer_order_summary", sp.customer_order_summary(orders))
    _publish(wh, product, "orders_order_grain", orders, "orders_clean")
    _publish(wh, product, "orders_customer_grain", summary, "customer_order_summary")
    _publish(wh, product, "order_lines_order_grain", items, "order_items_clean")


def build_sdp_customers(wh: Warehouse, as_of: datetime, bands: Bands = Bands()) -> None:
    product = "sdp_customers"
    customers = sp.customers_clean(wh.source(product, "ext_customers_raw"), as_of, bands.customers)
    customers = wh.write(product, "core", "customers_clean", customers)
    _publish(wh, product, "customers_entity_grain", customers, "customers_clean")
    for by in ("region", "segment"):
        core = f"customer_{by}_summary"
        summary = wh.write(product, "core", core, sp.customer_summary(customers, by))
        wh.project(product, "access", f"customers_{by}_grain", summary, wh.name(product, "core", core))


def build_sdp_taxes(wh: Warehouse, as_of: datetime, bands: Bands = Bands()) -> None:
    product = "sdp_taxes"
    taxes = sp.taxes_clean(wh.source(product, "ext_taxes_raw"), as_of, bands.rates)
    taxes = wh.write(product, "core", "taxes_clean", taxes)
    _publish(wh, product, "taxes_grain", taxes, "taxes_clean")


def build_sdp_depot_transactions(wh: Warehouse, as_of: datetime, bands: Bands = Bands()) -> None:
    product = "sdp_depot_transactions"
    clean = sp.depot_transactions_clean(wh.source(product, "ext_depot_transactions_raw"), as_of, bands.amounts)
    transactions = wh.write(product, "core", "depot_transactions_clean", clean)
    _publish(wh, product, "depot_transactions_grain", transactions, "depot_transactions_clean")


def _publish(wh: Warehouse, product: str, grain: str, core: DataFrame, core_table: str) -> None:
    wh.project(product, "access", grain, sp.publish(core, grain), wh.name(product, "core", core_table))


def _inbound(wh: Warehouse, product: str, producer: str, grain: str) -> DataFrame:
    return wh.view(product, "inbound", f"in_{grain}", wh.name(producer, "access", grain))


# Customer domain.


def build_edp_customers(wh: Warehouse, as_of: datetime) -> None:
    product = "edp_customers"

    def core(table: str, model: Callable[[DataFrame], DataFrame], grain: str) -> DataFrame:
        seen = _inbound(wh, product, "sdp_customers", grain)
        return wh.project(product, "core", table, model(seen), wh.name(product, "inbound", f"in_{grain}"))

    customers = core("customers_3nf", cd.customers_3nf, "customers_entity_grain")
    regions = core("regions_3nf", cd.regions_3nf, "customers_region_grain")
    segments = core("segments_3nf", cd.segments_3nf, "customers_segment_grain")
    dim_regions = wh.write(product, "core", "dim_regions", cd.dim_regions(regions))
    dim_segments = wh.write(product, "core", "dim_segments", cd.dim_segments(segments))
    star = cd.fct_customer_value_star(customers, dim_regions, dim_segments, as_of)
    fact = wh.write(product, "core", "fct_customer_value_star", star)
    over = wh.name(product, "core", "fct_customer_value_star")
    wh.project(product, "access", "customers_complete", cd.customers_complete(fact), over)
    wh.project(product, "access", "customers_only", cd.customers_only(fact), over)
    wh.write(product, "access", "customers_high_value", cd.customers_high_value(fact))


def build_edp_taxes(wh: Warehouse) -> None:
    product = "edp_taxes"
    inbound = _inbound(wh, product, "sdp_taxes", "taxes_grain")
    taxes = wh.project(product, "core", "taxes_3nf", cd.taxes_3nf(inbound), wh.name(product, "inbound", "in_taxes_grain"))
    wh.project(product, "access", "taxes_only", cd.taxes_only(taxes), wh.name(product, "core", "taxes_3nf"))


# Transaction domain.


def build_edp_orders(wh: Warehouse, as_of: datetime) -> None:
    product = "edp_orders"

    def core(table: str, model: Callable[[DataFrame], DataFrame], grain: str) -> DataFrame:
        seen = _inbound(wh, product, "sdp_orders", grain)
        return wh.project(product, "core", table, model(seen), wh.name(product, "inbound", f"in_{grain}"))

    orders = core("orders_3nf", td.orders_3nf, "orders_order_grain")
    lines = core("order_lines_3nf", td.order_lines_3nf, "order_lines_order_grain")
    customers = core("customers_3nf", td.customers_3nf, "orders_customer_grain")
    dim_customers = wh.write(product, "core", "dim_customers", td.dim_customers(customers))
    dim_status = wh.write(product, "core", "dim_order_status", td.dim_order_status(orders))
    star = td.fct_order_revenue_star(orders, td.items_per_order(lines), dim_customers, dim_status, as_of)
    fact = wh.write(product, "core", "fct_order_revenue_star", star)
    over = wh.name(product, "core", "fct_order_revenue_star")
    wh.project(product, "access", "orders_complete", td.orders_complete(fact), over)
    wh.project(product, "access", "orders_only", td.orders_only(fact), over)
    wh.write(product, "access", "orders_fulfilled", td.orders_fulfilled(fact))


def build_edp_depot_transactions(wh: Warehouse) -> None:
    product, grain = "edp_depot_transactions", "depot_transactions_grain"
    inbound = _inbound(wh, product, "sdp_depot_transactions", grain)
    over = wh.name(product, "inbound", f"in_{grain}")
    rows = wh.project(product, "core", "depot_transactions_3nf", td.depot_transactions_3nf(inbound), over)
    only, over = td.depot_transactions_only(rows), wh.name(product, "core", "depot_transactions_3nf")
    wh.project(product, "access", "depot_transactions_only", only, over)


def build_source(wh: Warehouse, scope: str, as_of: datetime, bands: Bands = Bands()) -> None:
    """Source product of one scope, or of all."""
    builders = {
        "orders": build_sdp_orders,
        "customers": build_sdp_customers,
        "taxes": build_sdp_taxes,
        "depot_transactions": build_sdp_depot_transactions,
    }
    _side_by_side(wh, scope, lambda name: builders[name](wh, as_of, bands))


# ACCESS tables of its producer that a domain scope reads.
UPSTREAM = {
    "orders": ("orders_order_grain", "orders_customer_grain", "order_lines_order_grain"),
    "customers": ("customers_entity_grain", "customers_region_grain", "customers_segment_grain"),
    "taxes": ("taxes_grain",),
    "depot_transactions": ("depot_transactions_grain",),
}


def require_upstream(wh: Warehouse, scope: str, expected: Mapping[str, int] | None = None) -> None:
    """Raise unless the producer's tables are there and those in ``expected`` (by table) have its rows."""
    needed = [(f"sdp_{s}", table) for s in _scopes(scope) for table in UPSTREAM[s]]
    quality.require_tables(wh, needed)
    counted = {(product, table): expected[table] for product, table in needed if table in (expected or {})}
    if counted:
        quality.require_counts(quality.upstream_contract(wh, counted))


def build_domain(wh: Warehouse, scope: str, as_of: datetime, expected: Mapping[str, int] | None = None) -> None:
    """Domain product of one scope, or of all; the producer's tables are checked, then only read."""
    require_upstream(wh, scope, expected)
    builders = {
        "orders": lambda: build_edp_orders(wh, as_of),
        "customers": lambda: build_edp_customers(wh, as_of),
        "taxes": lambda: build_edp_taxes(wh),
        "depot_transactions": lambda: build_edp_depot_transactions(wh),
    }
    _side_by_side(wh, scope, lambda name: builders[name]())


def run_all(wh: Warehouse, source: Operational, as_of: datetime, scope: str = "all", bands: Bands = Bands()) -> None:
    """Land, mirror and build a scope end to end, then run its declared checks."""
    exported = landing.export_frames(source, scope)

    def one(name: str) -> None:
        tables = {t: exported[t] for t in landing.in_scope(name)}
        landing.mirror_all(wh, landing.land(wh, tables, as_of), name)
        build_source(wh, name, as_of, bands)
        build_domain(wh, name, as_of)

    _side_by_side(wh, scope, one)
    quality.require(declared_checks(wh, scope))


def _side_by_side(wh: Warehouse, scope: str, build_one: Callable[[str], None]) -> None:
    """Build the scopes at the same time: they share no tables, and small writes fill idle executors."""
    scopes = _scopes(scope)
    if len(scopes) == 1:
        return build_one(scopes[0])
    with ThreadPoolExecutor(max_workers=len(scopes)) as pool:
        run = inheritable_thread_target(wh.spark)(build_one)
        for done in [pool.submit(run, name) for name in scopes]:
            done.result()


def build_order_product(wh: Warehouse, name: str, product: OrderProduct) -> None:
    """Store one order product as ``sdp_<name>`` and ``edp_<name>`` and require its checks to pass."""
    sdp, edp = f"sdp_{name}", f"edp_{name}"
    orders = wh.write(sdp, "core", "orders_clean", product.core_orders())
    items = wh.write(sdp, "core", "order_items_clean", product.core_items())
    wh.write(sdp, "access", "orders_order_grain", product.access_orders(orders))
    wh.write(sdp, "access", "order_lines_order_grain", product.access_items(items))
    renamed = "* EXCEPT (published_at), published_at AS sdp_published_at"
    orders = wh.view(edp, "inbound", "in_orders_order_grain", wh.name(sdp, "access", "orders_order_grain"), renamed)
    lines = wh.view(edp, "inbound", "in_order_lines_order_grain", wh.name(sdp, "access", "order_lines_order_grain"), renamed)
    customers = wh.write(edp, "core", "dim_customers", product.dim_customers(orders))
    statuses = wh.write(edp, "core", "dim_order_status", product.dim_order_status(orders))
    fact = wh.write(edp, "core", "fct_order_revenue_star", product.fact_over(orders, lines, customers, statuses))
    wh.write(edp, "access", "order_revenue_created", revenue_created(fact))
    wh.write(edp, "access", "order_revenue_fulfilled", revenue_fulfilled(fact))
    quality.require(order_product_checks(orders, items, customers, statuses, fact))


def order_product_checks(
    orders: DataFrame, items: DataFrame, customers: DataFrame, statuses: DataFrame, fact: DataFrame
) -> DataFrame:
    """The checks an order product declares."""
    return quality.union(
        [
            quality.keys(orders, "core_orders", ["order_id"], ["order_total"]),
            quality.not_null(items, "core_items", ["order_id", "item_id"]),
            quality.keys(customers, "dim_customers", ["customer_sk"]),
            quality.keys(statuses, "dim_order_status", ["status_sk"]),
            quality.keys(fact, "fact", ["order_id"], ["customer_sk", "status_sk"]),
        ]
    )


def reload_sources(wh: Warehouse, source: Operational) -> DataFrame:
    """Replace the five operational tables in one commit, with the rows each write counted."""
    frames = {wh.name("operational", "source", t): df for t, df in source.tables().items()}
    return versions.counts_of(wh.spark, wh.publish(frames, scope=f"{wh.prefix}operational"))


def _scopes(scope: str) -> tuple[str, ...]:
    if scope == "all":
        return schemas.SCOPES
    if scope not in schemas.SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    return (scope,)


# Declared checks, (product, layer, table, not-null columns, unique columns).
DECLARED = [
    ("sdp_orders", "core", "orders_clean", "order_id order_total", "order_id"),
    ("sdp_orders", "core", "order_items_clean", "order_id item_id", ""),
    ("sdp_orders", "core", "customer_order_summary", "customer_id", "customer_id"),
    ("sdp_customers", "core", "customers_clean", "customer_id total_order_value", "customer_id"),
    ("sdp_customers", "core", "customer_region_summary", "region", "region"),
    ("sdp_customers", "core", "customer_segment_summary", "segment", "segment"),
    ("sdp_taxes", "core", "taxes_clean", "tax_code rate", "tax_code"),
    ("sdp_taxes", "access", "taxes_grain", "tax_code", "tax_code"),
    ("sdp_depot_transactions", "core", "depot_transactions_clean", "transaction_id amount", "transaction_id"),
    ("sdp_depot_transactions", "access", "depot_transactions_grain", "transaction_id", "transaction_id"),
    ("edp_customers", "core", "dim_regions", "region_sk", "region_sk"),
    ("edp_customers", "core", "dim_segments", "segment_sk", "segment_sk"),
    ("edp_customers", "core", "fct_customer_value_star", "customer_id region_sk segment_sk", "customer_id"),
    ("edp_taxes", "inbound", "in_taxes_grain", "tax_code", "tax_code"),
    ("edp_taxes", "core", "taxes_3nf", "tax_code", "tax_code"),
    ("edp_taxes", "access", "taxes_only", "tax_code", "tax_code"),
    ("edp_orders", "core", "dim_customers", "customer_sk", "customer_sk"),
    ("edp_orders", "core", "dim_order_status", "status_sk", "status_sk"),
    ("edp_orders", "core", "fct_order_revenue_star", "order_id customer_sk status_sk", "order_id"),
    ("edp_depot_transactions", "inbound", "in_depot_transactions_grain", "transaction_id", "transaction_id"),
    ("edp_depot_transactions", "core", "depot_transactions_3nf", "transaction_id", "transaction_id"),
    ("edp_depot_transactions", "access", "depot_transactions_only", "transaction_id", "transaction_id"),
]


def declared_checks(wh: Warehouse, scope: str = "all", products: Iterable[str] | None = None) -> DataFrame:
    """All declared not-null and unique checks of a scope's products as one frame."""
    wanted = set(products) if products else {f"{kind}_{s}" for kind in ("sdp", "edp") for s in _scopes(scope)}
    return quality.present_and_distinct(
        [
            (f"{product}.{table}", wh.table(product, layer, table), present.split(), distinct.split())
            for product, layer, table, present, distinct in DECLARED
            if product in wanted
        ]
    )


def landing_path(environment: str, system: str, table: str) -> str:
    """Where an environment lands a table of a source system."""
    return f"landing/{environment}/{system}/{table}"


def sandbox_path(project: str, kind: str, system: str, namespace: str) -> str:
    """Where a branch or merge-request sandbox lands a source system."""
    return f"landing/ci/{project}/{kind}/{system}/{namespace}"
