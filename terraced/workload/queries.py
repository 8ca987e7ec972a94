"""Registered queries: every relation and operator over whole given tables.

Each takes ``(spark, folder)``. Queries about storing, cloning or building write
to namespaces of their own in the shared folder and return what was stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraced import schemas
from terraced.functions import columns as fn
from terraced.operators import clones, contracts, maintain, quality, reconcile
from terraced.plans import build, models
from terraced.plans import customer_domain as cd
from terraced.plans import order_product as op
from terraced.plans import source_products as sp
from terraced.plans import transaction_domain as td
from terraced.plans.lineage import Lineage
from terraced.session import configure, pin, scratch_path
from terraced.sources import catalog, exports, landing, seed, versions
from terraced.sources.catalog import Warehouse
from terraced.sources.star_schema import read_operational, read_table
from terraced.streaming.lifecycle import fold_ending_stream, fold_stream, read_event_stream

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime(2026, 3, 7, 12, 0, 0)

# Thresholds that split the given tables into all bands.
BANDS = build.Bands(
    orders=([(7_500_000, "HIGH"), (2_800_000, "MEDIUM")], "LOW"),
    customers=([(67_000_000, "HIGH_VALUE"), (40_000_000, "MEDIUM_VALUE")], "LOW_VALUE"),
    rates=([("0.06", "HIGH"), ("0.03", "STANDARD")], "REDUCED"),
    amounts=schemas.AMOUNT_BANDS,
)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_queries: dict[str, Query] = {}


def _query(run: Query, name: str | None = None) -> Query:
    name = name or run.__name__

    def registered(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(run(configure(spark), folder))

    _queries[name] = registered
    return run


def _relation(name: str, of: Callable[[Lineage], DataFrame]) -> None:
    _query(lambda spark, folder: of(lineage(spark, folder)), name)


def comparable(df: DataFrame) -> DataFrame:
    """Plain result types: decimals as doubles, all integers as bigint, moments without zone."""

    def plain(field: T.StructField) -> str:
        kind = field.dataType
        if isinstance(kind, T.DecimalType):
            return f"CAST(`{field.name}` AS double) AS `{field.name}`"
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            return f"CAST(`{field.name}` AS bigint) AS `{field.name}`"
        if isinstance(kind, T.TimestampType):
            return f"CAST(`{field.name}` AS timestamp_ntz) AS `{field.name}`"
        return f"`{field.name}`"

    return df.selectExpr(*[plain(f) for f in df.schema.fields])


def lineage(spark: SparkSession, folder: str) -> Lineage:
    return Lineage(
        read_operational(spark, folder),
        AS_OF,
        order_bands=BANDS.orders,
        customer_bands=BANDS.customers,
        rate_bands=BANDS.rates,
        amount_bands=BANDS.amounts,
    )


def own_warehouse(spark: SparkSession) -> Warehouse:
    return Warehouse(spark, f"q{uuid.uuid4().hex[:10]}_", scratch_path(spark, "warehouse"))


# ---------------------------------------------------------------- sources


@_query
def fetch_rows(spark: SparkSession, folder: str) -> DataFrame:
    return exports.fetch(
        spark,
        "SELECT order_id, customer_id, order_total, :load_batch AS load_batch FROM {orders} WHERE status = :status",
        {"load_batch": "postgres-seed-20260307T120000Z", "status": "paid"},
        orders=lineage(spark, folder).exported("raw_orders"),
    )


def _numbered(spark: SparkSession, folder: str, table: str, key: str) -> DataFrame:
    return read_table(spark, folder, table).select((F.col(key) + 1).alias("n"))


@_query
def seed_customers(spark: SparkSession, folder: str) -> DataFrame:
    return seed.seed_customers(_numbered(spark, folder, "customer", "c_custkey"), AS_OF)


@_query
def seed_orders(spark: SparkSession, folder: str) -> DataFrame:
    return seed.seed_orders(_numbered(spark, folder, "orders", "o_orderkey"), AS_OF)


@_query
def seed_order_items(spark: SparkSession, folder: str) -> DataFrame:
    return seed.seed_order_items(_numbered(spark, folder, "orders", "o_orderkey"))


@_query
def seed_taxes(spark: SparkSession, folder: str) -> DataFrame:
    return seed.seed_taxes(_numbered(spark, folder, "supplier", "s_suppkey"), AS_OF)


@_query
def seed_depot_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return seed.seed_depot_transactions(_numbered(spark, folder, "events", "event_id"), AS_OF)


@_query
def seed_reload(spark: SparkSession, folder: str) -> DataFrame:
    return build.reload_sources(own_warehouse(spark), read_operational(spark, folder))


@_query
def source_lookup(spark: SparkSession, folder: str) -> DataFrame:
    wh, _ = _landed(spark, folder, "all", mirrored=True)
    names = {m: f"sdp_{owner}" for m, owner, _, _ in schemas.LANDED.values()}
    return landing.load_report({m: wh.source(product, m) for m, product in names.items()})


@_query
def model_lookup(spark: SparkSession, folder: str) -> DataFrame:
    wh = _built(spark, folder, "taxes")
    return wh.table("edp_taxes", "access", "taxes_only")


def _loads(spark: SparkSession, folder: str, table: str, key: str, loads: int = 3, files: int = 4) -> str:
    """A given table landed in several loads of several named files; returns its folder."""
    place = scratch_path(spark, f"loads-{table}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    rows = read_table(spark, folder, table).withColumn("_load", F.pmod(F.col(key), F.lit(loads))).withColumn("_part", F.pmod(F.floor(F.col(key) / loads), F.lit(files)))
    rows.repartition(loads * files, "_load", "_part").write.partitionBy("_load", "_part").parquet(place)
    system = fs_path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    for load in range(loads):  # as many names as files
        for part in range(files):
            for number, found in enumerate(system.globStatus(fs_path(f"{place}/_load={load}/_part={part}/*.parquet")) or []):
                name = fs_path(f"{place}/load-{load}-{part}-{number}.parquet")
                system.rename(found.getPath(), name)
                system.setTimes(name, 1_700_000_000_000 + 60_000 * load + 1_000 * part, -1)
    return place


@_query
def latest_file_per_table(spark: SparkSession, folder: str) -> DataFrame:
    """Newest of twelve files of each of five tables, by name, with its rows."""
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id"}
    return landing.latest_files({t: _loads(spark, folder, t, key) for t, key in keys.items()}, spark)


@_query
def landing_completeness(spark: SparkSession, folder: str) -> DataFrame:
    paths = {t: f"{folder}/{t}.parquet" for t in TABLES}
    paths["returns"] = f"{folder}/returns.parquet"  # absent; shipments has no path at all
    return landing.missing_files(spark, paths, [*TABLES, "returns", "shipments"])


@_query
def catalog_listing(spark: SparkSession, folder: str) -> DataFrame:
    wh, _ = _landed(spark, folder, "all")
    return catalog.list_tables(spark, f"{wh.prefix}landing").select("table_name")


# ---------------------------------------------------------------- exports, landing, mirror


def _landed(spark: SparkSession, folder: str, scope: str, mirrored: bool = False) -> tuple[Warehouse, dict[str, DataFrame]]:
    wh = own_warehouse(spark)
    frames = landing.export_frames(read_operational(spark, folder), scope)
    landed = landing.land(wh, frames, AS_OF)
    return (wh, landing.mirror_all(wh, landed, scope)) if mirrored else (wh, landed)


for _table, (_mirror_table, _owner, _, _) in schemas.LANDED.items():
    _query(lambda spark, folder, t=_table: lineage(spark, folder).exported(t), f"{_table}_export")

    def _land_one(spark: SparkSession, folder: str, table: str = _table) -> DataFrame:
        export = lineage(spark, folder).exported(table)
        return landing.land(own_warehouse(spark), {table: export}, AS_OF)[table]

    def _mirror_one(spark: SparkSession, folder: str, table: str = _table) -> DataFrame:
        mirror_table, owner, _, _ = schemas.LANDED[table]
        landed = _land_one(spark, folder, table)
        return own_warehouse(spark).write(f"sdp_{owner}", "inbound", mirror_table, landing.mirror(landed, mirror_table))

    _query(_land_one, f"land_{_table.removeprefix('raw_')}")
    _query(_mirror_one, f"mirror_{_table.removeprefix('raw_')}")


@_query
def load_report(spark: SparkSession, folder: str) -> DataFrame:
    return landing.load_report(_landed(spark, folder, "all")[1])


@_query
def refresh_landing(spark: SparkSession, folder: str) -> DataFrame:
    """Land orders, then drop and land them again: the counts are those of one load."""
    wh = own_warehouse(spark)
    chosen = landing.export_frames(read_operational(spark, folder), "orders")
    landing.land(wh, chosen, AS_OF)
    return landing.load_report(landing.land(wh, chosen, AS_OF, refresh=True))


@_query
def purge_landing(spark: SparkSession, folder: str) -> DataFrame:
    wh, landed = _landed(spark, folder, "all")
    rows = landing.load_report(landed).agg(F.sum("row_count")).head()[0]
    dropped = landing.purge(wh)
    left = catalog.namespaces(spark).filter(F.col("namespace") == f"{wh.prefix}landing").count()
    return spark.createDataFrame([(rows, dropped, left)], "rows_landed bigint, tables_dropped bigint, namespaces_left bigint")


@_query
def load_batch_stamps(spark: SparkSession, folder: str) -> DataFrame:
    moments = read_table(spark, folder, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ordered_at"))
    per_day = moments.groupBy("ordered_at").agg(F.count("*").alias("orders"))
    return per_day.select("ordered_at", "orders", fn.load_batch(F.col("ordered_at")).alias("load_batch"))


@_query
def iso_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    moment = F.col("ts").cast("timestamp")
    return read_table(spark, folder, "events").select(
        "event_id",
        fn.iso_text(moment).alias("iso_ts"),
        fn.iso_text(F.date_trunc("second", moment)).alias("iso_second"),
        F.to_timestamp_ntz(fn.iso_text(moment)).alias("parsed"),
    )


# ---------------------------------------------------------------- publishing


@_query
def publish_all_or_none(spark: SparkSession, folder: str) -> DataFrame:
    """Five tables published, then failing in a write, in a rule, in an audit and in a move, then published anew."""
    wh = own_warehouse(spark)
    source = read_operational(spark, folder).tables()
    names = {t: wh.name("operational", "source", t) for t in source}
    key = {t: df.columns[0] for t, df in source.items()}
    fewer = {t: df.filter(F.col(key[t]).cast("string").endswith("3")) for t, df in source.items()}
    wh.publish({names[t]: df for t, df in source.items()}, scope=f"{wh.prefix}operational")
    steps = []

    def seen(step: str) -> None:
        counts = landing.load_report({t: spark.table(n) for t, n in names.items()})
        steps.append(counts.withColumn("step", F.lit(step)))

    def failing(step: str, frames: dict[str, DataFrame], **options: object) -> None:
        try:
            wh.publish({names[t]: df for t, df in frames.items()}, scope=f"{wh.prefix}operational", **options)
        except Exception:  # whatever stops it, the tables must be as before
            seen(step)

    broken = dict(fewer)
    broken["taxes"] = fewer["taxes"].withColumn("tax_code", F.raise_error(F.lit("lost connection")).cast("string"))
    failing("1 write fails", broken)
    failing("2 rule fails", fewer, rules={names["taxes"]: quality.Rules(ranges={"rate": F.col("rate") < 0})})
    failing("3 audit fails", fewer, audit=lambda seen_first: quality.not_null(seen_first[names["orders"]].withColumn("gone", F.lit(None)), "orders", ["gone"]))
    blocked = wh.name("operational", "source", "customers")
    failing("4 move fails", {**fewer, "taxes": fewer["taxes"].withColumnRenamed("tax_code", blocked.replace(".", "`"))})
    wh.publish({names[t]: df for t, df in fewer.items()}, scope=f"{wh.prefix}operational")
    seen("5 published")
    return quality.union(steps)


@_query
def load_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Not-null, range and row counts of faulty tables, counted by their writes alone."""
    r = lineage(spark, folder)
    wh = own_warehouse(spark)
    positive = {"quantity": F.col("quantity") > 0, "unit_price": F.col("unit_price") > 0}
    staged = [
        versions.stage(_faulty_orders(r), wh.root, "audit.orders_clean", quality.Rules(present=["order_id", "order_total"])),
        versions.stage(_faulty_items(r), wh.root, "audit.order_items", quality.Rules(["item_id"], positive)),
        versions.stage(r.source.taxes, wh.root, "audit.taxes", quality.Rules(ranges={"rate": F.col("rate") >= 0})),
    ]
    rows = versions.counts_of(spark, staged).select(F.lit("row_count").alias("check_name"), "table_name", F.lit("").alias("column_name"), F.col("row_count").alias("failures"))
    checks = versions.checks_of(spark, staged).withColumn("table_name", F.substring_index("table_name", ".", -1))
    return checks.unionByName(rows)


# ---------------------------------------------------------------- source products

_relation("orders_clean", lambda r: r.orders_clean)
_relation("order_items_clean", lambda r: r.order_items_clean)
_relation("customer_order_summary", lambda r: r.customer_order_summary)
_relation("orders_order_grain", lambda r: sp.publish(r.orders_clean, "orders_order_grain"))
_relation("orders_customer_grain", lambda r: sp.publish(r.customer_order_summary, "orders_customer_grain"))
_relation("order_lines_order_grain", lambda r: sp.publish(r.order_items_clean, "order_lines_order_grain"))
_relation("customers_clean", lambda r: r.customers_clean)


def _summary(r: Lineage, by: str) -> DataFrame:
    return sp.customer_summary(r.customers_clean, by)


def _rounded(df: DataFrame) -> DataFrame:
    """Averages as doubles to four places; the library itself keeps decimals."""
    return df.withColumn("avg_customer_value", F.round(F.col("avg_customer_value").cast("double"), 4))


_relation("customer_region_summary", lambda r: _rounded(_summary(r, "region")))
_relation("customer_segment_summary", lambda r: _rounded(_summary(r, "segment")))
_relation("customers_entity_grain", lambda r: sp.publish(r.customers_clean, "customers_entity_grain"))
_relation("customers_region_grain", lambda r: _rounded(_summary(r, "region").select("*")))
_relation("customers_segment_grain", lambda r: _rounded(_summary(r, "segment").select("*")))
_relation("taxes_clean", lambda r: r.taxes_clean)
_relation("taxes_grain", lambda r: sp.publish(r.taxes_clean, "taxes_grain"))
_relation("depot_transactions_clean", lambda r: r.depot_transactions_clean)
_relation("depot_transactions_grain", lambda r: sp.publish(r.depot_transactions_clean, "depot_transactions_grain"))

# ---------------------------------------------------------------- customer domain


def _in_entity(r: Lineage) -> DataFrame:
    return cd.inbound(sp.publish(r.customers_clean, "customers_entity_grain"))


def _in_taxes(r: Lineage) -> DataFrame:
    return cd.inbound(sp.publish(r.taxes_clean, "taxes_grain"))


_relation("in_customers_entity_grain", _in_entity)
_relation("in_customers_region_grain", lambda r: _rounded(cd.inbound(_summary(r, "region"))))
_relation("in_customers_segment_grain", lambda r: _rounded(cd.inbound(_summary(r, "segment"))))
_relation("in_taxes_grain", _in_taxes)
_relation("customers_3nf", lambda r: cd.customers_3nf(_in_entity(r)))
_relation("regions_3nf", lambda r: _rounded(cd.regions_3nf(cd.inbound(_summary(r, "region")))))
_relation("segments_3nf", lambda r: _rounded(cd.segments_3nf(cd.inbound(_summary(r, "segment")))))
_relation("taxes_3nf", lambda r: cd.taxes_3nf(_in_taxes(r)))
_relation("dim_regions", lambda r: _rounded(cd.dim_regions(cd.regions_3nf(cd.inbound(_summary(r, "region"))))))
_relation("dim_segments", lambda r: _rounded(cd.dim_segments(cd.segments_3nf(cd.inbound(_summary(r, "segment"))))))
_relation("fct_customer_value_star", lambda r: r.fct_customer_value_star)
_relation("customers_complete", lambda r: cd.customers_complete(r.fct_customer_value_star))
_relation("customers_high_value", lambda r: cd.customers_high_value(r.fct_customer_value_star))
_relation("customers_only", lambda r: cd.customers_only(r.fct_customer_value_star))
_relation("taxes_only", lambda r: cd.taxes_only(cd.taxes_3nf(_in_taxes(r))))

# ---------------------------------------------------------------- transaction domain


def _in_orders(r: Lineage) -> DataFrame:
    return td.inbound(sp.publish(r.orders_clean, "orders_order_grain"))


def _in_lines(r: Lineage) -> DataFrame:
    return td.inbound(sp.publish(r.order_items_clean, "order_lines_order_grain"))


def _in_order_customers(r: Lineage) -> DataFrame:
    return td.inbound(sp.publish(r.customer_order_summary, "orders_customer_grain"))


def _in_depot(r: Lineage) -> DataFrame:
    return td.inbound(sp.publish(r.depot_transactions_clean, "depot_transactions_grain"))


_relation("in_orders_order_grain", _in_orders)
_relation("in_orders_customer_grain", _in_order_customers)
_relation("in_order_lines_order_grain", _in_lines)
_relation("in_depot_transactions_grain", _in_depot)
_relation("orders_3nf", lambda r: td.orders_3nf(_in_orders(r)))
_relation("order_lines_3nf", lambda r: td.order_lines_3nf(_in_lines(r)))
_relation("orders_customers_3nf", lambda r: td.customers_3nf(_in_order_customers(r)))
_relation("depot_transactions_3nf", lambda r: td.depot_transactions_3nf(_in_depot(r)))
_relation("dim_customers", lambda r: td.dim_customers(td.customers_3nf(_in_order_customers(r))))
_relation("dim_order_status", lambda r: td.dim_order_status(td.orders_3nf(_in_orders(r))))
_relation("fct_order_revenue_star", lambda r: r.fct_order_revenue_star)
_relation("orders_complete", lambda r: td.orders_complete(r.fct_order_revenue_star))
_relation("orders_fulfilled", lambda r: td.orders_fulfilled(r.fct_order_revenue_star))
_relation("orders_only", lambda r: td.orders_only(r.fct_order_revenue_star))
_relation("depot_transactions_only", lambda r: td.depot_transactions_only(td.depot_transactions_3nf(_in_depot(r))))

# ---------------------------------------------------------------- order product from one configuration

_relation("scaffold_core_orders", lambda r: r.order_product.core_orders())
_relation("scaffold_core_items", lambda r: r.order_product.core_items())
_relation("scaffold_access_orders", lambda r: r.order_product.access_orders())
_relation("scaffold_access_items", lambda r: r.order_product.access_items())
_relation("scaffold_inbound_orders", lambda r: r.order_product.inbound_orders())
_relation("scaffold_inbound_items", lambda r: r.order_product.inbound_items())
_relation("dim_customers_from_orders", lambda r: r.order_product.dim_customers())
_relation("scaffold_dim_order_status", lambda r: r.order_product.dim_order_status())
_relation("scaffold_fct_order_revenue", lambda r: r.order_product.fact())
_relation("order_revenue_created", lambda r: op.revenue_created(r.order_product.fact()))
_relation("order_revenue_fulfilled", lambda r: op.revenue_fulfilled(r.order_product.fact()))

# ---------------------------------------------------------------- name functions


@_query
def slug_names(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", fn.slug(F.col("url")).alias("slug"))


@_query
def prefixed_names(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "PRD_").otherwise("PRD"), F.upper("c_mktsegment"))
    customer = read_table(spark, folder, "customer")
    return customer.select("c_custkey", name.alias("name"), fn.prefixed(name).alias("prefixed"))


@_query
def name_checksums(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", fn.posix_cksum(F.col("url")).alias("checksum"))


@_query
def sandbox_namespaces(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", clones.sandbox_namespace(fn.slug(F.col("url"))).alias("namespace"))


# ---------------------------------------------------------------- checks, over data with known faults


def _faulty_orders(r: Lineage) -> DataFrame:
    """Cleaned orders with some totals lost and some orders delivered twice."""
    orders = r.stored_orders
    lost = orders.withColumn("order_total", F.when(~F.col("order_id").endswith("7"), F.col("order_total")))
    return lost.unionByName(lost.filter(F.col("order_id").endswith("50")))


def _faulty_items(r: Lineage) -> DataFrame:
    """Items of which some lost their quantity sign or belong to no order."""
    items = r.source.order_items
    odd = F.col("sku").endswith("9")
    return items.withColumns(
        {
            "quantity": F.when(odd, -F.col("quantity")).otherwise(F.col("quantity")),
            "order_id": F.when(F.col("sku").endswith("13"), F.concat(F.col("order_id"), F.lit("-X"))).otherwise(F.col("order_id")),
        }
    )


_relation("not_null_check", lambda r: quality.not_null(_faulty_orders(r), "orders_clean", ["order_id", "order_total"]))
_relation("unique_check", lambda r: quality.unique(_faulty_orders(r), "orders_clean", ["order_id"]))
_relation("duplicate_keys", lambda r: quality.duplicates(_faulty_orders(r), "order_id"))


@_query
def relationships_check(spark: SparkSession, folder: str) -> DataFrame:
    r = lineage(spark, folder)
    s = r.source
    return quality.union(
        [
            quality.relationships(s.orders, "orders", "customer_id", s.customers, "customer_id"),
            quality.relationships(_faulty_items(r), "order_items", "order_id", s.orders, "order_id"),
            quality.relationships(s.depot_transactions, "depot_transactions", "customer_id", s.customers, "customer_id"),
        ]
    )


_relation(
    "orphan_keys",
    lambda r: quality.orphans(_faulty_items(r), "order_id", r.source.orders, "order_id"),
)


@_query
def accepted_values_check(spark: SparkSession, folder: str) -> DataFrame:
    s = read_operational(spark, folder)
    return quality.union(
        [
            quality.accepted_values(s.orders, "orders", {"status": schemas.ORDER_STATUSES}),
            quality.accepted_values(
                s.depot_transactions, "depot_transactions", {"transaction_type": (*schemas.TRANSACTION_TYPES, "view", "click")}
            ),
        ]
    )


@_query
def range_check(spark: SparkSession, folder: str) -> DataFrame:
    r = lineage(spark, folder)
    positive = {"quantity": F.col("quantity") > 0, "unit_price": F.col("unit_price") > 0}
    return quality.union(
        [
            quality.in_range(_faulty_items(r), "order_items", positive),
            quality.in_range(r.source.taxes, "taxes", {"rate": F.col("rate") >= 0}),
            quality.in_range(r.source.depot_transactions, "depot_transactions", {"amount": F.col("amount") >= 0}),
        ]
    )


@_query
def key_check(spark: SparkSession, folder: str) -> DataFrame:
    s = read_operational(spark, folder)
    return quality.union(
        [
            quality.keys(s.customers, "customers", ["customer_id", "customer_code"], ["customer_name", "region", "segment"]),
            quality.keys(s.orders, "orders", ["order_id"], ["customer_id", "status"]),
            quality.keys(s.order_items, "order_items", ["item_id"], ["order_id", "sku"]),
            quality.keys(s.taxes, "taxes", ["tax_id", "tax_code"], ["rate"]),
            quality.keys(s.depot_transactions, "depot_transactions", ["transaction_id"], ["customer_id", "amount"]),
        ]
    )


@_query
def keys_at_once(spark: SparkSession, folder: str) -> DataFrame:
    """Presence and uniqueness over all operational tables and faulty orders: one scan each, one shuffle."""
    r = lineage(spark, folder)
    s = r.source
    return quality.present_and_distinct(
        [
            ("customers", s.customers, ["customer_id", "customer_name", "region"], ["customer_id", "customer_code", "segment"]),
            ("orders", s.orders, ["order_id", "customer_id"], ["order_id", "customer_id"]),
            ("order_items", s.order_items, ["item_id", "order_id", "sku"], ["item_id"]),
            ("taxes", s.taxes, ["tax_id", "tax_code", "rate"], ["tax_id", "tax_code"]),
            ("depot_transactions", s.depot_transactions, ["transaction_id", "amount"], ["transaction_id"]),
            ("orders_clean", _faulty_orders(r), ["order_id", "order_total"], ["order_id", "order_total"]),
        ]
    )


@_query
def content_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against a copy that lost some, doubled as many and changed others: equal counts, different content."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    at = F.col("o_orderkey") % 1000
    changed = F.when(at == 5, F.lit("changed")).otherwise(F.col("o_orderpriority"))
    other = orders.withColumn("o_orderpriority", changed).filter(at != 1)
    other = other.unionByName(orders.filter(at == 2)).repartition(F.col("o_custkey"))
    return quality.differing_keys(pin(orders, "parity"), pin(other, "parity"), "o_orderkey")


@_query
def row_count_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Expected counts are the source's; orders without items make the order export fall short."""
    r = lineage(spark, folder)
    expected = landing.load_report(r.source.tables()).select(
        F.col("table_name").alias("relation"), F.col("row_count").alias("expected")
    )
    found = {t.removeprefix("raw_"): df for t, df in landing.export_frames(r.source).items()}
    return quality.row_counts(found, expected)


@_query
def upstream_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Producer grains of the taxes and depot scopes, expected with the source's counts."""
    wh = _built(spark, folder, "taxes", "depot_transactions", domains=False)
    s = read_operational(spark, folder)
    return quality.upstream_contract(
        wh,
        {
            ("sdp_taxes", "taxes_grain"): s.taxes.count(),
            ("sdp_depot_transactions", "depot_transactions_grain"): s.depot_transactions.count() + 1,
        },
    )


@_query
def upstream_contract_all(spark: SparkSession, folder: str) -> DataFrame:
    """All grains that the domains read, each expected with what it is a grain of in the source."""
    wh = _built(spark, folder, "all", domains=False)
    s = read_operational(spark, folder)
    expected = {
        "orders_order_grain": s.orders,
        "orders_customer_grain": s.customers,
        "order_lines_order_grain": s.order_items,
        "customers_entity_grain": s.customers,
        "customers_region_grain": s.customers.select("region").distinct(),
        "customers_segment_grain": s.customers.select("segment").distinct(),
        "taxes_grain": s.taxes,
        "depot_transactions_grain": s.depot_transactions,
    }
    return quality.upstream_contract(
        wh, {(f"sdp_{scope}", t): expected[t].count() for scope, tables in build.UPSTREAM.items() for t in tables}
    )


@_query
def layer_parity(spark: SparkSession, folder: str) -> DataFrame:
    r = lineage(spark, folder)
    _, landed = _landed(spark, folder, "all")
    source = r.source.tables()
    return quality.layer_parity(
        {
            t.removeprefix("raw_"): {"source": source[t.removeprefix("raw_")], "export": df, "landed": landed[t]}
            for t, df in landing.export_frames(r.source).items()
        }
    )


@_query
def scaffold_checks(spark: SparkSession, folder: str) -> DataFrame:
    product = lineage(spark, folder).order_product
    orders = pin(product.core_orders(), "product-orders")
    fact = pin(product.fact(), "product-fact")
    customers, statuses = product.dim_customers(orders), product.dim_order_status(orders)
    return build.order_product_checks(orders, product.core_items(), customers, statuses, fact)


@_query
def declared_checks(spark: SparkSession, folder: str) -> DataFrame:
    """All declared checks of all products, over a complete build."""
    return build.declared_checks(_built(spark, folder, "all"))


# ---------------------------------------------------------------- builds


def _built(spark: SparkSession, folder: str, *scopes: str, domains: bool = True, lean: bool = False) -> Warehouse:
    wh = replace(own_warehouse(spark), lean=lean)
    source = read_operational(spark, folder)
    for scope in scopes:
        landing.mirror_all(wh, landing.land(wh, landing.export_frames(source, scope), AS_OF), scope)
        build.build_source(wh, scope, AS_OF, BANDS)
        if domains:
            build.build_domain(wh, scope, AS_OF)
    return wh


def _relation_counts(wh: Warehouse, products: list[str], layers: tuple[str, ...] = schemas.LAYERS) -> DataFrame:
    frames = {}
    for product in products:
        for layer in layers:
            namespace = wh.namespace(product, layer)
            for table in catalog.table_names(wh.spark, namespace):
                frames[f"{product}.{table}"] = wh.table(product, layer, table)
    return landing.load_report(frames)


@_query
def build_source_products(spark: SparkSession, folder: str) -> DataFrame:
    wh = _built(spark, folder, "all", domains=False)
    return _relation_counts(wh, [f"sdp_{s}" for s in schemas.SCOPES])


@_query
def build_customer_domain(spark: SparkSession, folder: str) -> DataFrame:
    return _relation_counts(_built(spark, folder, "customers", "taxes"), ["edp_customers", "edp_taxes"])


@_query
def build_transaction_domain(spark: SparkSession, folder: str) -> DataFrame:
    wh = _built(spark, folder, "orders", "depot_transactions")
    return _relation_counts(wh, ["edp_orders", "edp_depot_transactions"])


@_query
def build_all(spark: SparkSession, folder: str) -> DataFrame:
    """Source to ACCESS for every scope, with the declared checks required to pass."""
    wh = own_warehouse(spark)
    build.run_all(wh, read_operational(spark, folder), AS_OF, "all", BANDS)
    return _relation_counts(wh, list(schemas.PRODUCTS), ("access",))


@_query
def build_all_lean(spark: SparkSession, folder: str) -> DataFrame:
    """The same build with pure column selections kept as views."""
    wh = replace(own_warehouse(spark), lean=True)
    build.run_all(wh, read_operational(spark, folder), AS_OF, "all", BANDS)
    return _relation_counts(wh, list(schemas.PRODUCTS), ("access",))


@_query
def built_fct_order_revenue_star(spark: SparkSession, folder: str) -> DataFrame:
    """The stored fact of a build."""
    return _built(spark, folder, "orders").table("edp_orders", "core", "fct_order_revenue_star")


@_query
def built_customers_complete(spark: SparkSession, folder: str) -> DataFrame:
    """The published customers of a lean build, read through its views."""
    return _built(spark, folder, "customers", lean=True).table("edp_customers", "access", "customers_complete")


@_query
def selected_builds(spark: SparkSession, folder: str) -> DataFrame:
    """Models built by choice: one with all it needs, a product without its producer, and all that follows one model."""
    wh = own_warehouse(spark)
    source = read_operational(spark, folder)
    for scope in ("customers", "taxes"):
        landing.mirror_all(wh, landing.land(wh, landing.export_frames(source, scope), AS_OF), scope)
    settings = models.Settings(AS_OF, BANDS)
    steps = []

    def built(step: str, names: set[str]) -> None:
        done = models.build_selected(wh, names, settings)
        frames = {n: wh.table(models.MODELS[n].product, models.MODELS[n].layer, models.MODELS[n].table) for n in done}
        level = F.create_map(*[F.lit(v) for at, group in enumerate(models.levels(names)) for n in group for v in (n, at)])
        steps.append(landing.load_report(frames).select(F.lit(step).alias("step"), F.element_at(level, F.col("table_name")).alias("level"), "table_name", "row_count"))

    built("1 with ancestors", models.selected(["+customers_high_value"]))
    own = models.without_producers(models.selected(["+edp_taxes.taxes_only"]), "edp_taxes")
    refused = models.missing_parents(wh, own)
    steps += [spark.createDataFrame([("2 refused", 0, n, 0) for n in refused], "step string, level int, table_name string, row_count bigint")]
    built("3 with descendants", models.selected(["taxes_clean+"], exclude=["taxes_only"]))
    built("4 own models", own)
    return quality.union(steps)


@_query
def environment_layout(spark: SparkSession, folder: str) -> DataFrame:
    """The same product in two environments, each under its own landing path."""
    export = lineage(spark, folder).exported("raw_taxes")
    counts = []
    for environment in ("dev", "prd"):
        place = build.landing_path(environment, "postgres", "")
        wh = own_warehouse(spark)
        wh = Warehouse(spark, wh.prefix, f"{wh.location}/{place.rstrip('/')}")
        landed = landing.land(wh, {"raw_taxes": export}, AS_OF)["raw_taxes"]
        per_file = landed.select(F.col("_metadata.file_path").contains(f"/{place}").alias("in_place"))
        counts.append(per_file.groupBy("in_place").agg(F.count("*").alias("row_count")).withColumn("environment", F.lit(environment)))
    return quality.union(counts)


@_query
def sandbox_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Every scope landed under the path of a branch sandbox, with rows and place per table."""
    place = build.sandbox_path("mesh", "branch", "postgres", "feature_totals")
    own = own_warehouse(spark)
    wh = Warehouse(spark, own.prefix, f"{own.location}/{place}")
    landed = landing.land(wh, landing.export_frames(read_operational(spark, folder)), AS_OF)
    counts = []
    for table, df in landed.items():
        per_file = df.select(F.col("_metadata.file_path").contains(f"/{place}/").alias("in_place"))
        counts.append(per_file.groupBy("in_place").agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(table)))
    return quality.union(counts)


@_query
def refreshed_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Order summaries per customer and per status, followed over lost, changed and new orders."""
    money = F.col("o_totalprice").cast("decimal(38,2)").alias("total")
    before = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", money, F.col("o_orderdate").cast("timestamp").alias("placed"))
    key = F.col("o_orderkey")
    changed = before.filter(key % 10 != 3).select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 10 == 5, "P").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 20 == 5, F.col("total") + 1000).otherwise(F.col("total")).cast("decimal(38,2)").alias("total"),
        "placed",
    )
    new = before.filter(key % 10 == 7).withColumn("o_orderkey", -key - 1).withColumn("placed", F.expr("placed + INTERVAL 1 DAY"))
    after = pin(changed.unionByName(new), "orders-after")
    went, came = maintain.row_changes(before, after, "o_orderkey")
    kept = maintain.Measures("orders", {"total": "total"}, {"first_placed": "placed", "smallest": "total"}, {"last_placed": "placed"})
    found = []
    for group in ("o_custkey", "o_orderstatus"):
        state = pin(maintain.summary_state(before, [group], kept), "summary")
        fresh = maintain.summary(maintain.refresh(state, went, came, after, [group], kept), [group], kept)
        found.append(fresh.withColumn("by", F.lit(group)).withColumn("member", F.col(group).cast("string")).drop(group))
    return quality.union(found)


def _order_product(spark: SparkSession, folder: str) -> Warehouse:
    wh = own_warehouse(spark)
    build.build_order_product(wh, "mesh_orders", lineage(spark, folder).order_product)
    return wh


@_query
def built_order_product_fact(spark: SparkSession, folder: str) -> DataFrame:
    """The stored fact of an order product."""
    return _order_product(spark, folder).table("edp_mesh_orders", "core", "fct_order_revenue_star")


@_query
def built_order_revenue_fulfilled(spark: SparkSession, folder: str) -> DataFrame:
    """The stored table of fulfilled orders of an order product."""
    return _order_product(spark, folder).table("edp_mesh_orders", "access", "order_revenue_fulfilled")


# ---------------------------------------------------------------- clones


@_query
def clone_schema(spark: SparkSession, folder: str) -> DataFrame:
    wh = _built(spark, folder, "depot_transactions")
    counts = clones.check_clone(wh, wh.namespace("edp_depot_transactions", "core"), "depot_transactions_3nf")
    return spark.createDataFrame(list(counts.items()), "measure string, value bigint")


@_query
def clone_schema_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The CORE tables of the order domain with their fact."""
    wh = _built(spark, folder, "orders")
    counts = clones.check_clone(wh, wh.namespace("edp_orders", "core"), "fct_order_revenue_star")
    return spark.createDataFrame(list(counts.items()), "measure string, value bigint")


@_query
def clone_without_copying(spark: SparkSession, folder: str) -> DataFrame:
    """A clone that shares every file until either side changes, and what a sweep leaves."""
    wh = _built(spark, folder, "taxes", domains=False)
    product, target, table = "sdp_taxes", "sdp_taxes_ci_clo_own_b1", ("core", "taxes_clean")
    clones.apply_clone(wh, product, target, replace=False)
    steps = []

    def seen(step: str, swept: int = 0) -> None:
        source, clone = wh.table(product, *table), wh.table(target, *table)
        own = len(set(clone.inputFiles()) - set(source.inputFiles()))
        steps.append((step, source.count(), clone.count(), own > 0, swept))

    seen("1 cloned")
    half = wh.table(target, *table).filter(F.col("tax_code").endswith("1"))
    wh.write(target, *table, half)
    seen("2 clone changed")
    wh.write(product, *table, wh.table(product, *table).limit(0))
    seen("3 source changed")
    seen("4 swept", versions.sweep(spark, wh.root, older_than=0))
    clones.drop_clone(wh, product, target)
    swept = versions.sweep(spark, wh.root, older_than=0)
    left = wh.table(product, "access", "taxes_grain").count()
    steps.append(("5 clone dropped", left, 0, False, swept))
    return spark.createDataFrame(steps, "step string, source_rows bigint, clone_rows bigint, own_files boolean, swept bigint")


@_query
def clone_lean(spark: SparkSession, folder: str) -> DataFrame:
    """A clone of a product with views, after its source was emptied and after it was dropped."""
    wh = _built(spark, folder, "taxes", domains=False, lean=True)
    product, target = "sdp_taxes", "sdp_taxes_ci_clo_own_b1"
    clones.apply_clone(wh, product, target, replace=False)
    wh.write(product, "core", "taxes_clean", pin(wh.table(product, "core", "taxes_clean").limit(0), "emptied"))
    source, clone = wh.table(product, "access", "taxes_grain"), wh.table(target, "access", "taxes_grain")
    steps = [("1 source emptied", source.count(), clone.count())]
    clones.drop_clone(wh, target, product)
    steps.append(("2 source dropped", 0, wh.table(target, "access", "taxes_grain").count()))
    return spark.createDataFrame(steps, "step string, source_rows bigint, clone_rows bigint")


@_query
def clone_product(spark: SparkSession, folder: str) -> DataFrame:
    """Ensure, ensure again, replace, drop; and a source that is not there."""
    wh = _built(spark, folder, "taxes", domains=False)
    product, target = "sdp_taxes", "sdp_taxes_ci_clo_own_b1"

    def rows() -> int:
        present = wh.exists(target, "access", "taxes_grain")
        return wh.table(target, "access", "taxes_grain").count() if present else 0

    steps = []
    steps.append(("1 ensure", clones.apply_clone(wh, product, target, replace=False), rows()))
    steps.append(("2 ensure again", clones.apply_clone(wh, product, target, replace=False), rows()))
    steps.append(("3 replace", clones.apply_clone(wh, product, target, replace=True), rows()))
    steps.append(("4 same", clones.apply_clone(wh, product, product, replace=True), rows()))
    steps.append(("5 drop", str(clones.drop_clone(wh, product, target)), rows()))
    for step, replace in (("6 empty", False), ("7 empty again", False), ("8 empty replace", True)):
        done = clones.apply_clone(wh, "sdp_absent", target, replace=replace, source_missing="create_empty")
        steps.append((step, done, rows()))
    try:
        clones.apply_clone(wh, "sdp_absent", target, replace=False)
    except LookupError:
        steps.append(("9 missing", "error", rows()))
    clones.drop_clone(wh, product, target)
    return spark.createDataFrame(steps, "step string, status string, rows bigint")


@_query
def clone_registry(spark: SparkSession, folder: str) -> DataFrame:
    """A registry's plan ensured twice, replaced and dropped, with the rows each clone publishes after it."""
    wh = _built(spark, folder, "taxes", "depot_transactions", domains=False)
    products = [(1, "taxes", "sdp_taxes"), (2, "depot", "sdp_depot_transactions"), (3, "absent", "sdp_absent"), (4, "unset", None)]
    registry = spark.createDataFrame(products, "position int, key string, source_database string")
    plan = pin(clones.clone_plan(registry, "OWN", F.lit("b1")), "plan")
    grains = {"taxes": "taxes_grain", "depot": "depot_transactions_grain"}
    steps = []
    for step, mode in (("1 ensure", "ensure"), ("2 ensure", "ensure"), ("3 replace", "replace"), ("4 drop", "drop")):
        for key, target, done in clones.apply_plan(wh, plan, mode, {"absent": "create_empty"}):
            there = key in grains and wh.exists(target, "access", grains[key])
            steps.append((step, key, done, wh.table(target, "access", grains[key]).count() if there else 0))
    return spark.createDataFrame(steps, "step string, key string, status string, rows bigint")


@_query
def clone_purge(spark: SparkSession, folder: str) -> DataFrame:
    """Two clones of three namespaces each are purged, the product itself stays."""
    wh = _built(spark, folder, "taxes", domains=False)
    for target in ("sdp_taxes_ci_clo_own_b1", "sdp_taxes_ci_clo_own_b2"):
        clones.apply_clone(wh, "sdp_taxes", target, replace=False)
    purged = clones.purge_clones(spark, [f"{wh.prefix}sdp_taxes"])
    left = wh.table("sdp_taxes", "access", "taxes_grain").agg(F.count("*").alias("source_rows"))
    return left.select(F.lit(len(purged)).cast("bigint").alias("purged"), "source_rows")


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    """A product per customer; long names overrun the limit and pairs of customers share a name."""
    key = F.col("c_custkey")
    shared = F.floor(key / 2).cast("string")
    long_part = F.repeat(F.upper("c_mktsegment"), (key % 13 + 1).cast("int"))
    database = F.when(key % 11 != 0, F.concat_ws("_", F.lit("SDP"), long_part, shared))
    return read_table(spark, folder, "customer").select(
        key.alias("position"), F.col("c_name").alias("key"), database.alias("source_database")
    )


@_query
def clone_plan(spark: SparkSession, folder: str) -> DataFrame:
    return clones.clone_plan(_registry(spark, folder), "OWN", F.lit("feature_rework_of_daily_totals"))


@_query
def clone_name_matches(spark: SparkSession, folder: str) -> DataFrame:
    registry = _registry(spark, folder)
    planned = clones.clone_plan(registry, "OWN", F.lit("b1")).select(F.col("target_database").alias("name"))
    names = planned.unionByName(registry.filter("source_database IS NOT NULL").select(F.col("source_database").alias("name")))
    bases = registry.filter((F.col("position") % 3 == 0) & F.col("source_database").isNotNull())
    return clones.clone_names(names, bases.select(F.col("source_database").alias("base")))


@_query
def missing_objects(spark: SparkSession, folder: str) -> DataFrame:
    required = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_key"))
    existing = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_key"))
    return clones.missing_objects(required, existing.distinct(), "order_key")


# ---------------------------------------------------------------- contracts


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One manifest per part: a model and a test, with gaps of every kind."""
    key = F.col("p_partkey")
    scopes = F.array(*[F.lit(s) for s in ("orders", "Customers", "taxes", "depot_transactions", "shipments")])
    scope = F.element_at(scopes, (key % 5 + 1).cast("int"))
    model = F.struct(
        F.when(key % 10 == 3, "test").otherwise("model").alias("resource_type"),
        F.when(key % 7 == 0, "other").otherwise("producer").alias("package_name"),
        F.when(key % 4 == 0, "private").otherwise("public").alias("access"),
        F.concat(F.lit("model_"), key.cast("string")).alias("name"),
        F.concat(F.lit("DB_"), F.upper("p_type")).alias("database"),
        F.when(key % 9 != 0, "ACCESS").alias("schema"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("T_"), key.cast("string"))).alias("alias"),
        F.concat(F.lit("models/"), scope, F.lit("/m.sql")).alias("path"),
        F.array(F.lit("producer"), F.col("p_brand")).alias("fqn"),
    )
    test = F.struct(
        F.lit("test").alias("resource_type"),
        F.lit("producer").alias("package_name"),
        F.lit("public").alias("access"),
        F.concat(F.lit("test_"), key.cast("string")).alias("name"),
        F.lit("").alias("database"),
        F.lit("ACCESS").alias("schema"),
        F.lit("").alias("alias"),
        F.lit("models/orders/t.sql").alias("path"),
        F.array(F.lit("producer"), F.lit("tests")).alias("fqn"),
    )
    nodes = F.map_from_arrays(F.array(F.concat(F.lit("m."), key), F.concat(F.lit("t."), key)), F.array(model, test))
    return read_table(spark, folder, "part").select(F.to_json(F.struct(nodes.alias("nodes"))).alias("manifest"))


@_query
def public_contract(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.public_contract(contracts.nodes(_manifests(spark, folder)), "producer")


@_query
def read_manifest_gz(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "manifests")
    _manifests(spark, folder).write.option("compression", "gzip").text(path)
    stored = contracts.read_manifests(spark, path, whole_files=False)
    return contracts.public_contract(contracts.nodes(stored), "producer")


@_query
def retarget_contract(spark: SparkSession, folder: str) -> DataFrame:
    targets = {"orders": "DEV_ORDERS", "customers": "DEV_CUSTOMERS", "depot_transactions": "DEV_DEPOT"}
    moved = contracts.retarget(contracts.nodes(_manifests(spark, folder)), targets)
    return moved.select("node_id", "name", "database")


@_query
def unresolved_refs(spark: SparkSession, folder: str) -> DataFrame:
    contract = contracts.public_contract(contracts.nodes(_manifests(spark, folder)), "producer")
    used = read_table(spark, folder, "lineitem").select(F.concat(F.lit("model_"), F.col("l_partkey")).alias("name"))
    return contracts.unresolved(used, contract)


def _manifest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The manifests with sections and fields that no contract schema names."""
    section = F.concat(F.lit('{"metadata":{"format":12,"tags":["brand",null]},'), F.expr("substring(manifest, 2)"))
    unknown = '"meta":{"owners":["a"],"weight":0.25},"resource_type":"model"'
    return _manifests(spark, folder).select(F.regexp_replace(section, '"resource_type":"model"', unknown).alias("manifest"))


@_query
def rewritten_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Whole manifests with new databases, stored as gzip, read back and taken apart to their members."""
    targets = {"orders": "DEV_ORDERS", "customers": "DEV_CUSTOMERS", "depot_transactions": "DEV_DEPOT"}
    path = scratch_path(spark, "manifests")
    contracts.write_manifests(contracts.rewrite_manifests(_manifest_documents(spark, folder), targets), path, whole_files=False)
    stored = contracts.read_manifests(spark, path, whole_files=False)
    document = F.expr("try_variant_get(parse_json(manifest), '$', 'map<string,variant>')")
    sections = stored.select(F.explode(document).alias("section", "content"))
    of_nodes = sections.filter("section = 'nodes'").select(F.expr("explode(try_variant_get(content, '$', 'map<string,variant>')) AS (node_id, node)"))
    fields = of_nodes.select("node_id", F.expr("explode(try_variant_get(node, '$', 'map<string,variant>')) AS (field, value)"))
    others = sections.filter("section <> 'nodes'").select(F.lit("").alias("node_id"), F.col("section").alias("field"), F.col("content").alias("value"))
    return fields.unionByName(others).select("node_id", "field", F.to_json("value").alias("value"))


@_query
def unresolved_text_refs(spark: SparkSession, folder: str) -> DataFrame:
    """References to the producer in a model text per order line, with and without those in SQL comments."""
    contract = pin(contracts.public_contract(contracts.nodes(_manifests(spark, folder)), "producer"), "contract")
    key, order = F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string")
    parts = [
        "select * from {{ ref('producer', 'model_", key, "') }} {# {{ ref('producer', 'gone_", order, "') }} #}\n",
        "-- was {{ ref('producer', 'quiet_", key, "') }}\njoin {{ref(\"own_", order, "\")}} on 'it''s' <> ''\n",
        "{% set text = \"ref('producer', 'said')\" %} {% raw %}{{ ref('producer', 'raw') }}{% endraw %} ref('producer', 'plain')",
    ]
    text = F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])
    texts = read_table(spark, folder, "lineitem").select(text.alias("text"))

    def unresolved(inside: bool) -> DataFrame:
        references = contracts.text_references(texts, in_sql_comments=inside, package="producer")
        return contracts.unresolved_in_texts(references, contract, "producer").withColumn("in_comments", F.lit(inside))

    return quality.union([unresolved(inside) for inside in (True, False)])


# ---------------------------------------------------------------- reconcile


@_query
def snapshot_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_table(spark, folder, "customer").select("c_custkey")
    key = F.col("c_custkey")
    return reconcile.snapshot_reconcile(
        customer.filter(key % 3 != 0), customer.filter(key % 4 != 0), customer.filter(key % 5 != 0), "c_custkey"
    )


@_query
def current_branches(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    branches = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 6 == 0, "main").otherwise(fn.slug(F.col("o_orderpriority"))).alias("branch_name"),
        F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("5_low").alias("default_branch"),
    )
    return reconcile.branch_entries(branches)


@_query
def current_merge_requests(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    requests = read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 7 != 0, fn.slug(F.col("o_orderpriority"))).alias("source_branch"),
        F.when(key % 3 == 0, "release").otherwise("main").alias("target_branch"),
        F.when(key % 5 != 0, key.cast("string")).otherwise("").alias("mr_iid"),
        F.when(key % 2 == 0, F.lit(None).cast("string")).otherwise("main").alias("default_branch"),
    )
    return reconcile.merge_request_entries(requests)


@_query
def change_actions(spark: SparkSession, folder: str) -> DataFrame:
    zero = F.lit(reconcile.ZERO_REVISION)
    kind, revision = F.col("event_type"), F.sha1(F.col("event_id").cast("string"))
    events = read_table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "signup", zero).otherwise(revision).alias("before"),
        F.when(kind == "error", zero).otherwise(revision).alias("after"),
        F.when(kind == "click", "merge").when(kind == "view", "open").alias("request"),
        F.when(kind == "error", "closed").otherwise("opened").alias("state"),
    )
    return events.select(
        "event_id",
        reconcile.change_action(F.col("before"), F.col("after")).alias("change"),
        reconcile.request_action(F.col("request"), F.col("state")).alias("request_change"),
    )


def _change_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "signup", "create").when(kind == "error", "destroy").otherwise("update")
    return events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action"))


@_query
def lifecycle_fold(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.lifecycle_fold(_change_events(read_table(spark, folder, "events")), "user_id")


@_query
def lifecycle_live_keys(spark: SparkSession, folder: str) -> DataFrame:
    state = reconcile.lifecycle_fold(_change_events(read_table(spark, folder, "events")), "user_id")
    return reconcile.live_keys(state, "user_id")


@_query
def lifecycle_fold_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = read_table(spark, folder, "events").schema
    events = read_event_stream(spark, f"{folder.rstrip('/')}/events.parque[t]", schema)
    return fold_stream(_change_events(events), "user_id")


def _raw_changes(events: DataFrame) -> DataFrame:
    """Change events as they arrive: pushes, requests and others, of managed and foreign projects."""
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    zero, revision = F.lit(reconcile.ZERO_REVISION), F.sha1(event.cast("string"))
    feature = F.concat(F.lit("feature-"), (user % 50).cast("string"))
    named = F.when(user % 5 == 0, "main").when(user % 5 == 1, "trunk").otherwise(feature)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("p"), (user % 30).cast("string")).alias("project"),
        F.when(kind.isin("click", "view"), "merge_request")
        .when(event % 10 == 0, "tag_push")
        .when(event % 10 == 1, "repository_update")
        .otherwise("push")
        .alias("kind"),
        F.when(event % 17 != 0, F.concat(F.lit("refs/heads/"), named)).alias("ref"),
        F.when(kind == "signup", zero).otherwise(revision).alias("before"),
        F.when(kind == "error", zero).otherwise(revision).alias("after"),
        F.when(event % 11 != 0, named).alias("source_branch"),
        F.when(event % 3 == 0, "trunk").otherwise("main").alias("target_branch"),
        F.when(event % 13 == 0, "").otherwise((user % 200).cast("string")).alias("mr_iid"),
        F.when(event % 4 == 0, "merge").when(event % 4 == 1, "open").alias("request"),
        F.when(event % 19 == 0, "closed").otherwise("opened").alias("state"),
    )


def _projects(spark: SparkSession, folder: str) -> DataFrame:
    """A project per nation but every sixth; half of them without a named default branch."""
    key = F.col("n_nationkey")
    named = F.when(key % 2 == 0, "").otherwise("trunk")
    nation = read_table(spark, folder, "nation").filter(key % 6 != 5)
    return nation.select(F.concat(F.lit("p"), key.cast("string")).alias("project"), named.alias("default_branch"))


@_query
def sandbox_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Raw change events through the filters to the last action per sandbox."""
    changes = reconcile.sandbox_changes(_raw_changes(read_table(spark, folder, "events")), _projects(spark, folder))
    return reconcile.lifecycle_fold(changes, "sandbox")


@_query
def sandbox_lifecycle_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = read_table(spark, folder, "events").schema
    events = read_event_stream(spark, f"{folder.rstrip('/')}/events.parque[t]", schema)
    return fold_stream(reconcile.sandbox_changes(_raw_changes(events), _projects(spark, folder)), "sandbox")


def _listings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Listings of each project's branches and requests on every fifth day, some without entries, and their entries."""
    events, projects = read_table(spark, folder, "events"), _projects(spark, folder).select("project")
    day, user = F.date_trunc("day", F.col("ts").cast("timestamp")), F.col("user_id")
    project = F.concat(F.lit("p"), (user % 30).cast("string"))
    seen = events.filter(F.dayofmonth("ts") % 5 == 0).select(project.alias("project"), day.alias("taken_at"), user.alias("user"))
    seen = seen.join(projects, "project").distinct()
    kinds = F.explode(F.array(F.lit(reconcile.BRANCH), F.lit(reconcile.REQUEST))).alias("kind")
    seen = seen.select("*", kinds).withColumn("scope", F.concat_ws(":", "project", "kind"))
    feature = F.concat(F.lit("feature-"), (F.col("user") % 50).cast("string"))
    number = (F.col("user") % 200).cast("string")
    entry = F.when(F.col("kind") == reconcile.BRANCH, feature).otherwise(number)
    entries = seen.filter(F.col("user") % 7 < 3).select("scope", F.concat_ws(":", "scope", entry).alias("key"), "taken_at")
    return seen.select("scope", "taken_at").distinct(), entries.distinct()


@_query
def sandbox_state(spark: SparkSession, folder: str) -> DataFrame:
    """Listings and change events merged into one state, in three batches that keep no order and repeat some facts."""
    changes = reconcile.sandbox_changes(_raw_changes(read_table(spark, folder, "events")), _projects(spark, folder))
    listings, entries = _listings(spark, folder)
    facts = pin(reconcile.change_facts(changes).unionByName(reconcile.listing_facts(entries)), "facts")
    batch = F.pmod(F.xxhash64("key", "ts"), F.lit(4))
    announced = F.pmod(F.xxhash64("scope", "taken_at"), F.lit(3))
    state, known = None, None
    for number in (2, 0, 1):
        news = listings.filter(announced == number)
        known = pin(reconcile.newest_listings(news if known is None else news.unionByName(known)), "listings")
        mine = facts.filter((batch == number) | (batch == 3))  # every batch repeats a quarter of the facts
        state = pin(reconcile.merge_state(mine, known, state), "state")
    return state.select("scope", "key", "ts", "event_id", "action")


@_query
def live_sandboxes(spark: SparkSession, folder: str) -> DataFrame:
    """Both state maps, branches and requests, from listings and events at once."""
    changes = reconcile.sandbox_changes(_raw_changes(read_table(spark, folder, "events")), _projects(spark, folder))
    listings, entries = _listings(spark, folder)
    facts = reconcile.change_facts(changes).unionByName(reconcile.listing_facts(entries))
    state = pin(reconcile.merge_state(facts, listings), "state")
    kinds = (reconcile.BRANCH, reconcile.REQUEST)
    return quality.union([reconcile.live_sandboxes(state, kind).withColumn("kind", F.lit(kind)) for kind in kinds])


@_query
def ending_lifecycle_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The fold with state that ends: six days of events a run, some arriving late, the stream restarted each time."""
    place = scratch_path(spark, "arrivals")
    events = _change_events(read_table(spark, folder, "events"))
    late = F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)
    run = F.least(F.floor((F.dayofmonth("ts") - 1) / 6) + late, F.lit(4)).cast("int")
    events.withColumn("run", run).write.partitionBy("run").parquet(f"{place}/sorted")
    arrived, state = f"{place}/arrived", None
    for number in range(5):
        spark.read.parquet(f"{place}/sorted/run={number}").write.parquet(f"{arrived}/{number}")
        stream = read_event_stream(spark, f"{arrived}/*", events.schema)
        state = fold_ending_stream(stream, "user_id", f"{place}/state", timedelta(days=2), fanout=2)
    return state


def queries() -> dict[str, Query]:
    return dict(_queries)
