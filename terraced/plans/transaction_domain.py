"""Transaction domain: inbound views -> normalised tables -> dimensions and revenue fact -> ACCESS."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraced.functions.columns import instant, surrogate_key
from terraced.schemas import FULFILLED_STATUSES, published


def inbound(grain: DataFrame) -> DataFrame:
    """A domain sees exactly what the producer publishes."""
    return grain.select("*")


def orders_3nf(order_grain: DataFrame) -> DataFrame:
    return order_grain.drop("cleaned_at")


def order_lines_3nf(lines_grain: DataFrame) -> DataFrame:
    return lines_grain.drop("cleaned_at")


def customers_3nf(customer_grain: DataFrame) -> DataFrame:
    return customer_grain.select("*")


def depot_transactions_3nf(transactions_grain: DataFrame) -> DataFrame:
    return transactions_grain.drop("loaded_at", "cleaned_at")


def dim_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        "first_order_at",
        "latest_order_at",
        "order_count",
        "total_order_value",
        surrogate_key(F.col("customer_id")).alias("customer_sk"),
    )


def dim_order_status(orders: DataFrame) -> DataFrame:
    counted = orders.groupBy("order_status").agg(F.count("*").alias("order_count"))
    return counted.withColumn("status_sk", surrogate_key(F.col("order_status")))


def items_per_order(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id").agg(F.count("*").alias("item_rows"), F.sum("line_total").alias("item_revenue"))


def fct_order_revenue_star(
    orders: DataFrame, items: DataFrame, customers: DataFrame, statuses: DataFrame, as_of: datetime
) -> DataFrame:
    """Orders with their item rows and revenue and the keys of customer and status.

    ``items`` are the lines reduced to one row per order. The dimension joins
    carry no hint: the status table is broadcast because its stored size is
    small, the customer table is shuffled when its size says so, and adaptive
    execution splits a customer that holds many orders.
    """
    return (
        orders.join(items, "order_id", "left")
        .join(customers.select("customer_id", "customer_sk"), "customer_id", "left")
        .join(statuses.select("order_status", "status_sk"), "order_status", "left")
        .select(
            *orders.columns,
            "customer_sk",
            "status_sk",
            F.coalesce("item_rows", F.lit(0)).alias("item_rows"),
            F.coalesce("item_revenue", F.lit(0)).cast("decimal(38,2)").alias("item_revenue"),
            instant(as_of).alias("modeled_at"),
        )
    )


def orders_complete(fact: DataFrame) -> DataFrame:
    return fact.select(*published("orders_complete"))


def orders_fulfilled(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("order_status").isin(*FULFILLED_STATUSES)).select(*published("orders_fulfilled"))


def orders_only(fact: DataFrame) -> DataFrame:
    return fact.select(*published("orders_only"))


def depot_transactions_only(transactions: DataFrame) -> DataFrame:
    return transactions.select(*published("depot_transactions_only"))
