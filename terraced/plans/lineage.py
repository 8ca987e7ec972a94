"""Every relation of the platform over one set of operational tables, without a catalog.

Relations are plain lazy frames. Those read by several others are stored once
(``pin``), as the materialised build stores them as tables.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraced import schemas
from terraced.plans import customer_domain as cd
from terraced.plans import source_products as sp
from terraced.plans import transaction_domain as td
from terraced.plans.order_product import OrderProduct
from terraced.schemas import LANDED
from terraced.session import pin
from terraced.sources import exports, landing
from terraced.sources.seed import Operational


class Lineage:
    def __init__(
        self,
        source: Operational,
        as_of: datetime,
        *,
        order_bands=schemas.ORDER_BANDS,
        customer_bands=schemas.CUSTOMER_BANDS,
        rate_bands=schemas.RATE_BANDS,
        amount_bands=schemas.AMOUNT_BANDS,
    ) -> None:
        self.source = source
        self.as_of = as_of
        self.order_bands = order_bands
        self.customer_bands = customer_bands
        self.rate_bands = rate_bands
        self.amount_bands = amount_bands

    def exported(self, table: str) -> DataFrame:
        return landing.export_of(self.source, table)

    def landed(self, table: str) -> DataFrame:
        return landing.stamped(table, self.exported(table), self.as_of)

    def mirrored(self, table: str) -> DataFrame:
        """The raw mirror rows of a landed table."""
        return landing.mirror(self.landed(table), LANDED[table][0])

    # Source product: orders.

    @cached_property
    def orders_clean(self) -> DataFrame:
        return sp.orders_clean(self.mirrored("raw_orders"), self.as_of, self.order_bands)

    @cached_property
    def stored_totals(self) -> DataFrame:
        return pin(exports.order_totals(self.source.order_items), "order-totals")

    @cached_property
    def stored_orders(self) -> DataFrame:
        """Cleaned orders over stored order totals, themselves stored for the readers above."""
        source = self.source
        export = exports.raw_orders_export(source.orders, source.customers, source.order_items, self.stored_totals)
        raw = landing.mirror(landing.stamped("raw_orders", export, self.as_of), LANDED["raw_orders"][0])
        return pin(sp.orders_clean(raw, self.as_of, self.order_bands), "orders-clean")

    @cached_property
    def order_items_clean(self) -> DataFrame:
        return sp.order_items_clean(self.mirrored("raw_order_items"), self.as_of)

    @cached_property
    def customer_order_summary(self) -> DataFrame:
        return sp.customer_order_summary(self.orders_clean)

    # Source product: customers.

    @cached_property
    def customers_clean(self) -> DataFrame:
        return sp.customers_clean(self.mirrored("raw_customers"), self.as_of, self.customer_bands)

    @cached_property
    def stored_customers(self) -> DataFrame:
        return pin(self.customers_clean, "customers-clean")

    # Source products: taxes, depot transactions.

    @cached_property
    def taxes_clean(self) -> DataFrame:
        return sp.taxes_clean(self.mirrored("raw_taxes"), self.as_of, self.rate_bands)

    @cached_property
    def depot_transactions_clean(self) -> DataFrame:
        return sp.depot_transactions_clean(self.mirrored("raw_depot_transactions"), self.as_of, self.amount_bands)

    # Customer domain.

    @cached_property
    def dim_regions(self) -> DataFrame:
        return cd.dim_regions(cd.regions_3nf(cd.inbound(sp.customer_summary(self.stored_customers, "region"))))

    @cached_property
    def dim_segments(self) -> DataFrame:
        return cd.dim_segments(cd.segments_3nf(cd.inbound(sp.customer_summary(self.stored_customers, "segment"))))

    @cached_property
    def fct_customer_value_star(self) -> DataFrame:
        customers = cd.customers_3nf(cd.inbound(sp.publish(self.stored_customers, "customers_entity_grain")))
        return cd.fct_customer_value_star(
            customers, pin(self.dim_regions, "dim-regions"), pin(self.dim_segments, "dim-segments"), self.as_of
        )

    # Transaction domain.

    @cached_property
    def orders_3nf(self) -> DataFrame:
        return td.orders_3nf(td.inbound(sp.publish(self.stored_orders, "orders_order_grain")))

    @cached_property
    def dim_customers(self) -> DataFrame:
        summary = sp.publish(sp.customer_order_summary(self.stored_orders), "orders_customer_grain")
        return td.dim_customers(td.customers_3nf(td.inbound(summary)))

    @cached_property
    def dim_order_status(self) -> DataFrame:
        return td.dim_order_status(self.orders_3nf)

    @cached_property
    def fct_order_revenue_star(self) -> DataFrame:
        """The fact over the rows of the lines model.

        Rows and revenue of an order do not depend on its line numbers, so they are
        taken from the typed lines, before numbering stores them.
        """
        return td.fct_order_revenue_star(
            self.orders_3nf,
            td.items_per_order(sp.order_items_typed(self.mirrored("raw_order_items"))),
            pin(self.dim_customers, "dim-customers"),
            pin(self.dim_order_status, "dim-order-status"),
            self.as_of,
        )

    @cached_property
    def order_product(self) -> OrderProduct:
        return OrderProduct(
            self.mirrored("raw_orders"),
            self.mirrored("raw_order_items"),
            self.as_of,
            self.order_bands,
        )
