"""Reads a star schema of sales tables as the five operational tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terraced.functions.columns import padded
from terraced.schemas import SOURCE, typed
from terraced.session import size_shuffles, stored_bytes
from terraced.sources.seed import Operational

# Order state letters of the star schema -> order statuses.
STATUS_OF = {"O": "created", "P": "paid", "F": "shipped"}


_schemas: dict[tuple[str, str], StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Its schema is taken from the files once per application."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    table = spark.read.schema(_schemas[known]).parquet(path)
    size_shuffles(spark, stored_bytes(table))
    return table


def _shaped(df: DataFrame, table: str) -> DataFrame:
    return df.selectExpr(*typed(SOURCE[table]))


def customers(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    opened = F.to_timestamp(F.lit("1992-01-01")) + F.make_dt_interval(days=(F.col("c_custkey") % 3650).cast("int"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return _shaped(
        joined.select(
            F.col("c_custkey").alias("customer_id"),
            F.concat(F.lit("CUST-"), padded(F.col("c_custkey"), 7)).alias("customer_code"),
            F.col("c_name").alias("customer_name"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            opened.alias("created_at"),
        ),
        "customers",
    )


def orders(orders_table: DataFrame) -> DataFrame:
    status = F.col("o_orderstatus")
    named = F.coalesce(*[F.when(status == letter, name) for letter, name in STATUS_OF.items()], status)
    return _shaped(
        orders_table.select(
            F.concat(F.lit("ORD-"), padded(F.col("o_orderkey"), 9)).alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            named.alias("status"),
            F.col("o_orderpriority").alias("sales_channel"),
            F.lit("star_schema").alias("source_system"),
            F.col("o_orderdate").alias("order_created_at"),
        ),
        "orders",
    )


def order_items(lineitem: DataFrame) -> DataFrame:
    """A projection of the line table alone.

    The line already carries its price and its part key, so the widest table is
    not shuffled against the part table just to name a product.
    """
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return _shaped(
        lineitem.select(
            F.concat_ws("-", F.lit("ITEM"), *[F.col(p).cast("bigint").cast("string") for p in parts]).alias("item_id"),
            F.concat(F.lit("ORD-"), padded(F.col("l_orderkey"), 9)).alias("order_id"),
            F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku"),
            F.concat(F.lit("Product "), F.col("l_partkey").cast("string")).alias("product_name"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("unit_price"),
        ),
        "order_items",
    )


def taxes(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """One row per supplier nation and rate, effective from its first shipment.

    Lines are reduced to one row per supplier and rate before the join.
    """
    percent = F.round(F.col("l_tax") * 100).cast("int")
    by_supplier = lineitem.groupBy("l_suppkey", percent.alias("percent")).agg(F.min("l_shipdate").alias("first_shipment"))
    by_nation = (
        by_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "percent")
        .agg(F.min("first_shipment").alias("first_shipment"))
    )
    joined = by_nation.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    code = F.concat_ws("-", F.lit("TAX"), F.col("s_nationkey").cast("string"), F.col("percent").cast("string"))
    return _shaped(
        joined.select(
            (F.col("s_nationkey") * 100 + F.col("percent")).alias("tax_id"),
            code.alias("tax_code"),
            F.concat(F.lit("Tax "), F.col("n_name"), F.lit(" "), F.col("percent").cast("string")).alias("tax_name"),
            F.col("r_name").alias("jurisdiction"),
            (F.col("percent").cast("decimal(6,4)") / 100).alias("rate"),
            F.col("first_shipment").alias("effective_at"),
            (F.col("first_shipment") - F.make_dt_interval(days=F.lit(30))).alias("created_at"),
        ),
        "taxes",
    )


def depot_transactions(events: DataFrame) -> DataFrame:
    depot = F.get_json_object("props", "$.k").cast("int") % 4
    return _shaped(
        events.select(
            F.concat(F.lit("DPT-"), padded(F.col("event_id"), 9)).alias("transaction_id"),
            F.col("user_id").alias("customer_id"),
            F.concat(F.lit("depot-"), F.element_at(F.array(*map(F.lit, "abcd")), depot + 1)).alias("depot_code"),
            F.col("event_type").alias("transaction_type"),
            F.col("value").alias("amount"),
            F.col("ts").alias("transaction_at"),
            F.lit("star_schema").alias("source_system"),
        ),
        "depot_transactions",
    )


class StarSchema(Operational):
    """The operational tables over a folder of star-schema tables; each is read when first used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark = spark
        self._folder = folder
        self._read: dict[str, DataFrame] = {}
        self._scanned = 0

    def _table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = read_table(self._spark, self._folder, name)
            self._scanned += stored_bytes(self._read[name])
            size_shuffles(self._spark, self._scanned)
        return self._read[name]

    @cached_property
    def customers(self) -> DataFrame:
        return customers(self._table("customer"), self._table("nation"), self._table("region"))

    @cached_property
    def orders(self) -> DataFrame:
        return orders(self._table("orders"))

    @cached_property
    def order_items(self) -> DataFrame:
        return order_items(self._table("lineitem"))

    @cached_property
    def taxes(self) -> DataFrame:
        return taxes(self._table("lineitem"), self._table("supplier"), self._table("nation"), self._table("region"))

    @cached_property
    def depot_transactions(self) -> DataFrame:
        return depot_transactions(self._table("events"))


def read_operational(spark: SparkSession, folder: str) -> Operational:
    return StarSchema(spark, folder)
