"""Source data products: raw mirror -> cleaned CORE tables -> published ACCESS grains."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraced import schemas
from terraced.functions.columns import band, clean_code, instant
from terraced.operators.ranking import number_rows


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _number(name: str, precision: int, scale: int) -> Column:
    return F.col(name).cast(f"decimal({precision},{scale})").alias(name)


def _wall_clock(name: str) -> Column:
    """Text to a zone-free moment: the written clock time, whatever its offset."""
    return F.to_timestamp_ntz(F.col(name)).alias(name)


def orders_clean(raw: DataFrame, as_of: datetime, bands=schemas.ORDER_BANDS, audit: bool = True) -> DataFrame:
    total = F.col("order_total").cast("decimal(38,2)")
    columns = [
        _text("order_id"),
        _text("customer_id"),
        _number("item_count", 38, 0),
        total.alias("order_total"),
        _text("load_batch"),
        clean_code(F.col("status")).alias("order_status"),
        _wall_clock("order_created_at"),
        band(total, *bands).alias("order_value_band"),
    ]
    return raw.select(*columns, *([instant(as_of).alias("cleaned_at")] if audit else []))


def order_items_typed(raw: DataFrame) -> DataFrame:
    """Items in their final types, not numbered."""
    return raw.select(
        _text("order_id"),
        _text("item_id"),
        _text("sku"),
        _number("quantity", 38, 0),
        _number("unit_price", 38, 2),
        _number("line_total", 38, 2),
        _wall_clock("loaded_at"),
    )


def order_items_clean(raw: DataFrame, as_of: datetime) -> DataFrame:
    """Items numbered within their order by item id."""
    numbered = number_rows(order_items_typed(raw), "order_id", "item_id", "line_number")
    return numbered.withColumn("cleaned_at", instant(as_of))


def customer_order_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.count("*").alias("order_count"),
        F.sum("order_total").alias("total_order_value"),
        F.min("order_created_at").alias("first_order_at"),
        F.max("order_created_at").alias("latest_order_at"),
        F.max("load_batch").alias("latest_load_batch"),
    )


def customers_clean(raw: DataFrame, as_of: datetime, bands=schemas.CUSTOMER_BANDS) -> DataFrame:
    value = F.col("total_order_value").cast("decimal(38,2)")
    return raw.select(
        _text("customer_id"),
        _text("customer_name"),
        _number("order_count", 38, 0),
        value.alias("total_order_value"),
        _text("load_batch"),
        clean_code(F.col("region")).alias("region"),
        clean_code(F.col("segment")).alias("segment"),
        _wall_clock("first_order_at"),
        _wall_clock("latest_order_at"),
        _wall_clock("customer_created_at"),
        band(value, *bands).alias("customer_value_band"),
        instant(as_of).alias("cleaned_at"),
    )


def customer_summary(customers: DataFrame, by: str) -> DataFrame:
    """Customers, orders and value per ``region`` or ``segment``."""
    return customers.groupBy(by).agg(
        F.count("*").alias("customer_count"),
        F.sum("order_count").alias("total_order_count"),
        F.sum("total_order_value").alias("total_order_value"),
        F.avg("total_order_value").alias("avg_customer_value"),
        F.max("cleaned_at").alias("latest_cleaned_at"),
    )


def taxes_clean(raw: DataFrame, as_of: datetime, bands=schemas.RATE_BANDS) -> DataFrame:
    rate = F.col("rate").cast("decimal(12,4)")
    steps, otherwise = bands
    steps = [(F.lit(threshold).cast("decimal(12,4)"), label) for threshold, label in steps]
    return raw.select(
        _text("tax_code"),
        _text("tax_name"),
        rate.alias("rate"),
        _text("load_batch"),
        clean_code(F.col("jurisdiction")).alias("jurisdiction"),
        _wall_clock("effective_at"),
        _wall_clock("loaded_at"),
        band(rate, steps, otherwise).alias("rate_band"),
        instant(as_of).alias("cleaned_at"),
    )


def depot_transactions_clean(raw: DataFrame, as_of: datetime, bands=schemas.AMOUNT_BANDS) -> DataFrame:
    amount = F.col("amount").cast("decimal(12,2)")
    return raw.select(
        _text("transaction_id"),
        _text("customer_id"),
        amount.alias("amount"),
        _text("load_batch"),
        clean_code(F.col("depot_code")).alias("depot_code"),
        clean_code(F.col("transaction_type")).alias("transaction_type"),
        _wall_clock("transaction_at"),
        _wall_clock("loaded_at"),
        band(amount, *bands).alias("amount_band"),
        instant(as_of).alias("cleaned_at"),
    )


def publish(core: DataFrame, name: str) -> DataFrame:
    """The published columns of an ACCESS table, in their published order."""
    return core.select(*schemas.published(name))
