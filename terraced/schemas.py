"""Declared schemas, published column lists and the product registry.

Everything here is a fixed value: names, types and thresholds that have to agree
with the platform whose tables are being rebuilt.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "decimal(6,4)": T.DecimalType(6, 4),
    "decimal(12,2)": T.DecimalType(12, 2),
    "decimal(38,0)": T.DecimalType(38, 0),
    "decimal(38,2)": T.DecimalType(38, 2),
    "decimal(38,4)": T.DecimalType(38, 4),
}


def _struct(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs; needs no session, unlike a DDL string."""
    pairs = [column.split() for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


def typed(schema: T.StructType) -> list[str]:
    """SQL expressions that bring columns to the types of ``schema``."""
    return [f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema]


SOURCE = {
    "customers": _struct(
        "customer_id bigint, customer_code string, customer_name string, region string, segment string, created_at timestamp"
    ),
    "orders": _struct(
        "order_id string, customer_id bigint, status string, sales_channel string, source_system string, order_created_at timestamp"
    ),
    "order_items": _struct(
        "item_id string, order_id string, sku string, product_name string, quantity int, unit_price decimal(12,2)"
    ),
    "taxes": _struct(
        "tax_id bigint, tax_code string, tax_name string, jurisdiction string, rate decimal(6,4), effective_at timestamp, created_at timestamp"
    ),
    "depot_transactions": _struct(
        "transaction_id string, customer_id bigint, depot_code string, transaction_type string, amount decimal(12,2), transaction_at timestamp, source_system string"
    ),
}

# Raw mirror: fixed types, every moment as ISO text.
MIRROR = {
    "ext_orders_raw": _struct(
        "order_id string, customer_id string, status string, item_count decimal(38,0), order_total decimal(38,2), order_created_at string, load_batch string"
    ),
    "ext_order_items_raw": _struct(
        "order_id string, item_id string, sku string, quantity decimal(38,0), unit_price decimal(38,2), line_total decimal(38,2), loaded_at string"
    ),
    "ext_customers_raw": _struct(
        "customer_id string, customer_name string, region string, segment string, order_count decimal(38,0), total_order_value decimal(38,2), first_order_at string, latest_order_at string, customer_created_at string, load_batch string"
    ),
    "ext_taxes_raw": _struct(
        "tax_code string, tax_name string, jurisdiction string, rate decimal(38,4), effective_at string, loaded_at string, load_batch string"
    ),
    "ext_depot_transactions_raw": _struct(
        "transaction_id string, customer_id string, depot_code string, transaction_type string, amount decimal(38,2), transaction_at string, source_system string, loaded_at string, load_batch string"
    ),
}

# Landed table -> (raw mirror table, scope, order of rows within a file, stamped with the load batch).
LANDED = {
    "raw_customers": ("ext_customers_raw", "customers", ["customer_id"], True),
    "raw_orders": ("ext_orders_raw", "orders", ["order_created_at", "order_id"], True),
    "raw_order_items": ("ext_order_items_raw", "orders", ["order_id", "item_id"], False),
    "raw_taxes": ("ext_taxes_raw", "taxes", ["tax_code"], True),
    "raw_depot_transactions": ("ext_depot_transactions_raw", "depot_transactions", ["transaction_at", "transaction_id"], True),
}

SCOPES = ("orders", "customers", "taxes", "depot_transactions")
LAYERS = ("inbound", "core", "access")

# Product key -> what happens when a clone's source is missing.
PRODUCTS = {
    "sdp_orders": "error",
    "sdp_customers": "error",
    "sdp_taxes": "error",
    "sdp_depot_transactions": "error",
    "edp_customers": "error",
    "edp_taxes": "error",
    "edp_orders": "error",
    "edp_depot_transactions": "error",
}

# Band thresholds and labels, highest first, then the label for everything else.
ORDER_BANDS = ([(150, "HIGH"), (75, "MEDIUM")], "LOW")
CUSTOMER_BANDS = ([(400, "HIGH_VALUE"), (150, "MEDIUM_VALUE")], "LOW_VALUE")
RATE_BANDS = ([("0.2", "HIGH"), ("0.1", "STANDARD")], "REDUCED")
AMOUNT_BANDS = ([(70, "HIGH"), (40, "MEDIUM")], "LOW")

ORDER_STATUSES = ("created", "paid", "shipped")
TRANSACTION_TYPES = ("load", "unload", "transfer")
FULFILLED_STATUSES = ("PAID", "SHIPPED")
HIGH_VALUE = "HIGH_VALUE"
CREATED = "CREATED"

# Published column order of the ACCESS tables.
PUBLISHED = {
    "orders_order_grain": "order_id customer_id order_status item_count order_total order_value_band order_created_at load_batch cleaned_at",
    "orders_customer_grain": "customer_id order_count total_order_value first_order_at latest_order_at latest_load_batch",
    "order_lines_order_grain": "order_id item_id sku quantity unit_price line_total line_number loaded_at cleaned_at",
    "customers_entity_grain": "customer_id customer_name region segment order_count total_order_value first_order_at latest_order_at customer_created_at load_batch customer_value_band cleaned_at",
    "taxes_grain": "tax_code tax_name jurisdiction rate rate_band effective_at loaded_at load_batch cleaned_at",
    "depot_transactions_grain": "transaction_id customer_id depot_code transaction_type amount amount_band transaction_at loaded_at load_batch cleaned_at",
    "customers_high_value": "customer_id customer_name region segment order_count total_order_value customer_value_band latest_order_at",
    "customers_only": "customer_id customer_name region segment order_count total_order_value customer_value_band",
    "taxes_only": "tax_code tax_name jurisdiction rate rate_band effective_at",
    "orders_complete": "order_id customer_id customer_sk status_sk order_status item_count order_total item_revenue item_rows order_value_band order_created_at load_batch modeled_at",
    "orders_fulfilled": "order_id customer_id order_status order_total item_revenue order_created_at",
    "orders_only": "order_id customer_id order_status order_total order_created_at",
    "order_revenue": "order_id customer_id customer_sk status_sk order_status order_total item_revenue item_rows order_value_band order_created_at",
    "depot_transactions_only": "transaction_id customer_id depot_code transaction_type amount amount_band transaction_at",
}


def published(name: str) -> list[str]:
    return PUBLISHED[name].split()
