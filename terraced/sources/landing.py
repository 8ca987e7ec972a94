"""Landing of exported rows, the fixed-schema raw mirror, and reports on both."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraced.functions.columns import instant, iso_text, load_batch
from terraced.operators import quality
from terraced.schemas import LANDED, MIRROR, typed
from terraced.session import folder_exists, pin
from terraced.sources import catalog, exports
from terraced.sources.catalog import Warehouse
from terraced.sources.seed import Operational

_PLACE = "landing"


def export_of(source: Operational, table: str, totals: DataFrame | None = None) -> DataFrame:
    """The export behind a landed table, lazily."""
    if table == "raw_customers":
        return exports.raw_customers_export(source.customers, source.orders, source.order_items, totals)
    if table == "raw_orders":
        return exports.raw_orders_export(source.orders, source.customers, source.order_items, totals)
    if table == "raw_order_items":
        return exports.raw_order_items_export(source.order_items, source.orders)
    if table == "raw_taxes":
        return exports.raw_taxes_export(source.taxes)
    if table == "raw_depot_transactions":
        return exports.raw_depot_transactions_export(source.depot_transactions, source.customers)
    raise ValueError(f"unknown landed table {table!r}")


def export_frames(source: Operational, scope: str = "all") -> dict[str, DataFrame]:
    """Landed table name -> its export, for a scope.

    The order totals behind two of the exports are stored once when both are asked
    for, so the items are scanned and shuffled for them once.
    """
    tables = in_scope(scope)
    both = {"raw_orders", "raw_customers"} <= set(tables)
    totals = pin(exports.order_totals(source.order_items), "order-totals") if both else None
    return {table: export_of(source, table, totals) for table in tables}


def stamped(table: str, export: DataFrame, as_of: datetime) -> DataFrame:
    """The rows as they are landed: with the load batch where the table carries one."""
    _, _, _, has_batch = LANDED[table]
    return export.withColumn("load_batch", load_batch(instant(as_of))) if has_batch else export


def in_scope(scope: str) -> list[str]:
    """Landed tables of a scope; ``all`` means every table."""
    return [table for table, (_, owner, _, _) in LANDED.items() if scope in ("all", owner)]


def land(
    warehouse: Warehouse,
    frames: Mapping[str, DataFrame],
    as_of: datetime,
    *,
    namespace: str = _PLACE,
    refresh: bool = False,
    rules: Mapping[str, quality.Rules] | None = None,
) -> dict[str, DataFrame]:
    """Replace the landed tables in one commit: all of them or, when a write or a rule fails, none.

    ``refresh`` drops the old tables first. ``rules`` by table are counted by the writes.

    Rows are sorted within files only: it keeps the min/max statistics narrow
    without a global sort.
    """
    spark = warehouse.spark
    place = warehouse.ensure(f"{warehouse.prefix}{namespace}")
    rows = {}
    for table, export in frames.items():
        name = f"{place}.{table}"
        if refresh:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        _, _, order, _ = LANDED[table]
        rows[name] = stamped(table, export, as_of).sortWithinPartitions(*order)
    warehouse.publish(rows, rules={f"{place}.{table}": of for table, of in (rules or {}).items()})
    return {table: spark.table(f"{place}.{table}") for table in frames}


def mirror(landed: DataFrame, mirror_table: str) -> DataFrame:
    """Landed rows in the declared raw types and column order, moments as text."""
    moments = [f.name for f in landed.schema if isinstance(f.dataType, T.TimestampType)]
    as_text = landed.withColumns({name: iso_text(F.col(name)) for name in moments})
    return as_text.selectExpr(*typed(MIRROR[mirror_table]))


def mirror_frames(warehouse: Warehouse, landed: Mapping[str, DataFrame], scope: str = "all") -> dict[str, DataFrame]:
    """The raw mirror of a scope by full name, lazily."""
    frames = {}
    for table in in_scope(scope):
        mirror_table, owner, _, _ = LANDED[table]
        frames[warehouse.name(f"sdp_{owner}", "inbound", mirror_table)] = mirror(landed[table], mirror_table)
    return frames


def mirror_all(warehouse: Warehouse, landed: Mapping[str, DataFrame], scope: str = "all") -> dict[str, DataFrame]:
    """Write the raw mirror of a scope in one recorded commit: all of its tables change, or none."""
    frames = mirror_frames(warehouse, landed, scope)
    warehouse.publish(frames, scope=f"{warehouse.prefix}mirror_{scope}")
    return {name.rpartition(".")[2]: warehouse.spark.table(name) for name in frames}


def load_report(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, one job for all tables."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(table).alias("table_name"), "row_count")
        for table, df in frames.items()
    ]
    report = counts[0]
    for count in counts[1:]:
        report = report.unionByName(count)
    return report


def data_files(paths: Mapping[str, str], spark: SparkSession) -> DataFrame:
    """Table, path, time and length of every data file, from listings alone; absent paths have none."""
    found = spark.createDataFrame([], "table_name string, file_path string, modified_at timestamp, length bigint")
    for table, path in paths.items():
        if folder_exists(spark, path):
            listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
            found = found.unionByName(
                listed.select(
                    F.lit(table).alias("table_name"),
                    F.col("path").alias("file_path"),
                    F.col("modificationTime").alias("modified_at"),
                    "length",
                )
            )
    return found


def latest_files(paths: Mapping[str, str], spark: SparkSession) -> DataFrame:
    """Newest data file per table with its row count and the number of data files.

    Only the newest files' rows are counted, and Parquet keeps that count in its footer.
    """
    newest = F.max_by("file_path", F.struct("modified_at", "file_path"))
    per_table = data_files(paths, spark).groupBy("table_name").agg(newest.alias("newest"), F.count("*").alias("data_files"))
    report = spark.createDataFrame([], "table_name string, file_name string, row_count bigint, data_files bigint")
    for table, path, files in per_table.collect():  # one row per table
        rows = spark.read.parquet(path).agg(F.count("*").alias("row_count"))
        report = report.unionByName(
            rows.select(F.lit(table).alias("table_name"), F.lit(path.rpartition("/")[2]).alias("file_name"), "row_count", F.lit(files).alias("data_files"))
        )
    return report


def missing_files(spark: SparkSession, paths: Mapping[str, str], expected: Iterable[str]) -> DataFrame:
    """Expected tables without any data file, also those whose path is absent or empty."""
    wanted = spark.createDataFrame([(t,) for t in expected], "table_name string")
    return wanted.join(data_files(paths, spark).select("table_name"), "table_name", "left_anti")


def purge(warehouse: Warehouse, namespace: str = _PLACE) -> int:
    """Drop the landing namespace; returns how many tables it held."""
    return catalog.drop_namespace(warehouse.spark, f"{warehouse.prefix}{namespace}")
