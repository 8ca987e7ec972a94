"""Deterministic sample rows for the five operational tables.

Every generator is a projection over a frame of numbers, so it runs as wide as
that frame is partitioned: ``numbers(spark, 12)`` gives the usual small sample,
and a key column of any table gives one row per key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraced.functions.columns import instant, padded
from terraced.schemas import SOURCE, typed

# Fixed values of the sample.
REGIONS = ("EMEA", "AMER", "APAC")
SEGMENTS = ("enterprise", "mid-market", "self-serve")
STATUSES = ("created", "paid", "shipped")
CHANNELS = ("web", "mobile", "partner")
JURISDICTIONS = ("EMEA", "AMER", "APAC", "LATAM")
RATES = ("0.0450", "0.0700", "0.0815", "0.1000", "0.1195", "0.2000")
DEPOTS = ("DEPOT-A", "DEPOT-B", "DEPOT-C", "DEPOT-D")
TRANSACTION_TYPES = ("load", "unload", "transfer")
SOURCE_SYSTEM = "postgres_sample_seed"
CUSTOMER_COUNT, ORDER_COUNT, TAX_COUNT, TRANSACTION_COUNT = 12, 30, 8, 18


def numbers(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(1, count + 1).select(F.col("id").alias("n"))


def _turn(values: tuple[str, ...], at: Column) -> Column:
    """Round robin: ``at`` 0 gives the first value."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _ago(moment: Column, days: Column | None = None, hours: Column | None = None, mins: Column | None = None) -> Column:
    """``moment`` less whole units; null where that is beyond what a moment can be."""
    micros = F.lit(0).cast("bigint")
    for units, seconds in ((days, 86_400), (hours, 3_600), (mins, 60)):
        if units is not None:
            micros = F.try_add(micros, F.try_multiply(units.cast("bigint"), F.lit(seconds * 1_000_000).cast("bigint")))
    return F.timestamp_micros(F.try_subtract(F.unix_micros(moment), micros))


def _tenths(value: Column) -> Column:
    return (value.cast("decimal(12,0)") / F.lit(10).cast("decimal(2,0)")).cast("decimal(12,2)")


def _shaped(df: DataFrame, table: str) -> DataFrame:
    return df.selectExpr(*typed(SOURCE[table]))


def seed_customers(source: DataFrame, as_of: datetime) -> DataFrame:
    n = F.col("n")
    midnight = F.date_trunc("day", instant(as_of))
    return _shaped(
        source.select(
            n.alias("customer_id"),
            F.concat(F.lit("CUST-"), padded(n, 4)).alias("customer_code"),
            F.concat(F.lit("Customer "), n.cast("string")).alias("customer_name"),
            _turn(REGIONS, n - 1).alias("region"),
            _turn(SEGMENTS, n - 1).alias("segment"),
            _ago(midnight, days=60 - n).alias("created_at"),
        ),
        "customers",
    )


def seed_orders(source: DataFrame, as_of: datetime, customers: int = CUSTOMER_COUNT) -> DataFrame:
    n = F.col("n")
    hour = F.date_trunc("hour", instant(as_of))
    return _shaped(
        source.select(
            F.concat(F.lit("ORD-"), padded(n, 5)).alias("order_id"),
            ((n - 1) % customers + 1).alias("customer_id"),
            _turn(STATUSES, n - 1).alias("status"),
            _turn(CHANNELS, n - 1).alias("sales_channel"),
            F.lit(SOURCE_SYSTEM).alias("source_system"),
            _ago(hour, days=(n - 1) % 10, hours=n).alias("order_created_at"),
        ),
        "orders",
    )


def seed_order_items(source: DataFrame) -> DataFrame:
    """One to three items for each order number."""
    o, i = F.col("n"), F.col("i")
    per_order = ((o - 1) % 3 + 1).cast("int")
    items = source.select("n", F.explode(F.sequence(F.lit(1), per_order)).alias("i"))
    pick = o * 7 + i * 3
    return _shaped(
        items.select(
            F.concat(F.lit("ITEM-"), padded(o, 5), F.lit("-"), padded(i, 2)).alias("item_id"),
            F.concat(F.lit("ORD-"), padded(o, 5)).alias("order_id"),
            F.concat(F.lit("SKU-"), padded(pick % 250 + 100, 3)).alias("sku"),
            F.concat(F.lit("Product "), (pick % 50 + 1).cast("string")).alias("product_name"),
            ((o + i) % 3 + 1).alias("quantity"),
            _tenths((o * 13 + i * 17) % 700 + 150).alias("unit_price"),
        ),
        "order_items",
    )


def seed_taxes(source: DataFrame, as_of: datetime) -> DataFrame:
    n = F.col("n")
    midnight = F.date_trunc("day", instant(as_of))
    return _shaped(
        source.select(
            n.alias("tax_id"),
            F.concat(F.lit("TAX-"), padded(n, 3)).alias("tax_code"),
            F.concat(F.lit("Tax "), n.cast("string")).alias("tax_name"),
            _turn(JURISDICTIONS, n - 1).alias("jurisdiction"),
            _turn(RATES, n).alias("rate"),
            _ago(midnight, days=90 - n).alias("effective_at"),
            _ago(midnight, days=120 - n).alias("created_at"),
        ),
        "taxes",
    )


def seed_depot_transactions(source: DataFrame, as_of: datetime, customers: int = CUSTOMER_COUNT) -> DataFrame:
    n = F.col("n")
    minute = F.date_trunc("minute", instant(as_of))
    return _shaped(
        source.select(
            F.concat(F.lit("DPT-"), padded(n, 5)).alias("transaction_id"),
            ((n - 1) % customers + 1).alias("customer_id"),
            _turn(DEPOTS, n - 1).alias("depot_code"),
            _turn(TRANSACTION_TYPES, n - 1).alias("transaction_type"),
            _tenths((n * 19 + 250) % 900 + 100).alias("amount"),
            _ago(minute, days=(n - 1) % 12, mins=n * 7).alias("transaction_at"),
            F.lit(SOURCE_SYSTEM).alias("source_system"),
        ),
        "depot_transactions",
    )


class Operational:
    """The five operational tables a platform starts from."""

    def __init__(
        self,
        customers: DataFrame,
        orders: DataFrame,
        order_items: DataFrame,
        taxes: DataFrame,
        depot_transactions: DataFrame,
    ) -> None:
        self.customers = customers
        self.orders = orders
        self.order_items = order_items
        self.taxes = taxes
        self.depot_transactions = depot_transactions

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SOURCE}


def seed_all(spark: SparkSession, as_of: datetime) -> Operational:
    return Operational(
        customers=seed_customers(numbers(spark, CUSTOMER_COUNT), as_of),
        orders=seed_orders(numbers(spark, ORDER_COUNT), as_of),
        order_items=seed_order_items(numbers(spark, ORDER_COUNT)),
        taxes=seed_taxes(numbers(spark, TAX_COUNT), as_of),
        depot_transactions=seed_depot_transactions(numbers(spark, TRANSACTION_COUNT), as_of),
    )
