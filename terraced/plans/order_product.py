"""A self-contained order product: one configuration, source to star fact.

It differs from the two-domain build in three ways: rows carry a publishing time
instead of a cleaning time, lines are numbered when published, and the customer
dimension is grouped straight from the orders.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraced import schemas
from terraced.functions.columns import instant, surrogate_key
from terraced.operators.ranking import number_rows
from terraced.plans import source_products as source
from terraced.schemas import published
from terraced.session import pin

_ORDER_COLUMNS = [c for c in published("orders_order_grain") if c != "cleaned_at"]
_LINE_COLUMNS = [c for c in published("order_lines_order_grain") if c != "cleaned_at"]


@dataclass(frozen=True)
class OrderProduct:
    """Relations of one order product over its two raw tables."""

    raw_orders: DataFrame
    raw_items: DataFrame
    as_of: datetime
    bands: tuple = schemas.ORDER_BANDS

    def core_orders(self) -> DataFrame:
        return source.orders_clean(self.raw_orders, self.as_of, self.bands, audit=False).select(*_ORDER_COLUMNS)

    def core_items(self) -> DataFrame:
        return source.order_items_typed(self.raw_items)

    def access_orders(self, orders: DataFrame | None = None) -> DataFrame:
        orders = self.core_orders() if orders is None else orders
        return orders.withColumn("published_at", instant(self.as_of))

    def access_items(self, items: DataFrame | None = None) -> DataFrame:
        items = self.core_items() if items is None else items
        numbered = number_rows(items, "order_id", "item_id", "line_number")
        return numbered.select(*_LINE_COLUMNS, instant(self.as_of).alias("published_at"))

    def inbound_orders(self) -> DataFrame:
        return self.access_orders().withColumnRenamed("published_at", "sdp_published_at")

    def inbound_items(self) -> DataFrame:
        return self.access_items().withColumnRenamed("published_at", "sdp_published_at")

    def dim_customers(self, orders: DataFrame | None = None) -> DataFrame:
        orders = self.inbound_orders() if orders is None else orders
        return orders.groupBy(surrogate_key(F.col("customer_id")).alias("customer_sk"), "customer_id").agg(
            F.min("order_created_at").alias("first_order_at"),
            F.max("order_created_at").alias("latest_order_at"),
            F.count("*").alias("order_count"),
        )

    def dim_order_status(self, orders: DataFrame | None = None) -> DataFrame:
        orders = self.inbound_orders() if orders is None else orders
        return orders.groupBy(surrogate_key(F.col("order_status")).alias("status_sk"), "order_status").agg(
            F.count("*").alias("order_count")
        )

    def fact(self) -> DataFrame:
        """The star fact. Orders and dimensions are stored once, since each is read more than once.

        Lines are read before numbering: the fact sums them and never looks at the number.
        """
        orders = pin(self.inbound_orders(), "product-orders")
        customers = pin(self.dim_customers(orders), "product-customers")
        statuses = pin(self.dim_order_status(orders), "product-statuses")
        return self.fact_over(orders, self.core_items(), customers, statuses)

    def fact_over(self, orders: DataFrame, items: DataFrame, customers: DataFrame, statuses: DataFrame) -> DataFrame:
        """The star fact over given relations; only the columns of the lines that are summed are read."""
        items = items.groupBy("order_id").agg(F.sum("line_total").alias("item_revenue"), F.count("*").alias("item_rows"))
        return (
            orders.drop("sdp_published_at")
            .join(items, on=["order_id"], how="left")
            .join(customers.select("customer_sk", "customer_id"), "customer_id", "left")
            .join(statuses.select("status_sk", "order_status"), "order_status", "left")
            .withColumns(
                {
                    "item_revenue": F.coalesce("item_revenue", F.lit(0)).cast("decimal(38,2)"),
                    "item_rows": F.coalesce("item_rows", F.lit(0)),
                    "modeled_at": instant(self.as_of),
                }
            )
            .select(*published("orders_complete"))
        )


def revenue_created(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("order_status") == schemas.CREATED).select(*published("order_revenue"))


def revenue_fulfilled(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("order_status").isin(*schemas.FULFILLED_STATUSES)).select(*published("order_revenue"))
