"""Export relations over the operational tables: joined, priced and counted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def _line_value() -> Column:
    return F.col("quantity") * F.col("unit_price")


def order_totals(order_items: DataFrame) -> DataFrame:
    """Items reduced to one row per order before any join; a huge order is pre-aggregated per task."""
    return order_items.groupBy("order_id").agg(
        F.count("item_id").alias("item_count"), F.sum(_line_value()).alias("order_value")
    )


def raw_orders_export(
    orders: DataFrame, customers: DataFrame, order_items: DataFrame, totals: DataFrame | None = None
) -> DataFrame:
    """Orders that have items, with their item count and total.

    ``totals`` may hand over ``order_totals`` already stored for another export.
    """
    codes = customers.select("customer_id", "customer_code")
    totals = order_totals(order_items) if totals is None else totals
    return (
        orders.join(totals, "order_id")
        .join(codes, "customer_id")
        .select(
            "order_id",
            F.col("customer_code").alias("customer_id"),
            "status",
            F.col("item_count").cast("int").alias("item_count"),
            F.round("order_value", 2).cast(MONEY).alias("order_total"),
            "order_created_at",
        )
    )


def raw_order_items_export(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items of known orders, priced, stamped with the time of their order."""
    placed = orders.select("order_id", F.col("order_created_at").alias("loaded_at"))
    return order_items.join(placed, "order_id").select(
        "order_id",
        "item_id",
        "sku",
        "quantity",
        "unit_price",
        F.round(_line_value(), 2).cast(MONEY).alias("line_total"),
        "loaded_at",
    )


def raw_customers_export(
    customers: DataFrame, orders: DataFrame, order_items: DataFrame, totals: DataFrame | None = None
) -> DataFrame:
    """Every customer with the number, value and time range of their orders.

    Items are summed per order and orders per customer, so no join multiplies
    rows and no distinct count is needed. An order without items still counts.
    """
    totals = order_totals(order_items) if totals is None else totals
    per_customer = (
        orders.join(totals.select("order_id", "order_value"), "order_id", "left")
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("order_count"),
            F.sum("order_value").alias("value"),
            F.min("order_created_at").alias("first_order_at"),
            F.max("order_created_at").alias("latest_order_at"),
        )
    )
    return customers.join(per_customer, "customer_id", "left").select(
        F.col("customer_code").alias("customer_id"),
        "customer_name",
        "region",
        "segment",
        F.coalesce("order_count", F.lit(0)).cast("int").alias("order_count"),
        F.coalesce(F.round("value", 2), F.lit(0)).cast(MONEY).alias("total_order_value"),
        "first_order_at",
        "latest_order_at",
        F.col("created_at").alias("customer_created_at"),
    )


def raw_taxes_export(taxes: DataFrame) -> DataFrame:
    return taxes.select(
        "tax_code", "tax_name", "jurisdiction", "rate", "effective_at", F.col("created_at").alias("loaded_at")
    )


def raw_depot_transactions_export(depot_transactions: DataFrame, customers: DataFrame) -> DataFrame:
    codes = customers.select("customer_id", "customer_code")
    return depot_transactions.join(codes, "customer_id").select(
        "transaction_id",
        F.col("customer_code").alias("customer_id"),
        "depot_code",
        "transaction_type",
        "amount",
        "transaction_at",
        "source_system",
        F.col("transaction_at").alias("loaded_at"),
    )


def fetch(spark: SparkSession, query: str, parameters: Mapping[str, object], **frames: DataFrame) -> DataFrame:
    """Run SQL with bound ``:parameters`` over ``{named}`` frames; stays distributed."""
    return spark.sql(query, args=dict(parameters), **frames)
