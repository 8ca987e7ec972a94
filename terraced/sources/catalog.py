"""Names, namespaces and tables of data products in the session catalog.

The catalog has one namespace level, so ``product`` and ``layer`` share a name:
``edp_orders__core.fct_order_revenue_star``. A prefix keeps environments and
sandboxes apart.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraced.operators import quality
from terraced.schemas import LAYERS
from terraced.sources import versions


@dataclass(frozen=True)
class Warehouse:
    """Where one environment keeps its products.

    ``location`` is a folder all executors share; without it the catalog's own
    warehouse folder is used. ``lean`` keeps relations that only select columns of
    a stored one as views, which saves a copy of the table per layer.
    """

    spark: SparkSession
    prefix: str = ""
    location: str | None = None
    lean: bool = False

    def namespace(self, product: str, layer: str) -> str:
        return f"{self.prefix}{product}__{layer}"

    def name(self, product: str, layer: str, table: str) -> str:
        return f"{self.namespace(product, layer)}.{table}"

    def ensure(self, namespace: str) -> str:
        """Create the namespace unless it is there."""
        where = versions.namespace_folder(self.root, namespace)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}` LOCATION '{where}'")
        return namespace

    def ensure_product(self, product: str) -> list[str]:
        return [self.ensure(self.namespace(product, layer)) for layer in LAYERS]

    @property
    def root(self) -> str:
        """Where the versions of its tables and its commits are."""
        return versions.root_of(self.spark, self.location)

    def write(self, product: str, layer: str, table: str, df: DataFrame) -> DataFrame:
        """Materialise ``df`` as a table and continue from the stored copy; a failed write leaves the old table."""
        name = self.name(product, layer, table)
        self.publish({name: df})
        return self.spark.table(name)

    def publish(
        self,
        frames: Mapping[str, DataFrame],
        rules: Mapping[str, quality.Rules] | None = None,
        audit: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None,
        scope: str | None = None,
    ) -> list[versions.Staged]:
        """Write all frames, check them, then name all of them by their keys (``namespace.table``) or none.

        ``rules`` are counted by the writes. ``audit`` sees what was written, by name, before
        anybody else does and returns more checks. Any failure raises and changes nothing. With a
        ``scope`` the commit is recorded, see ``versions.committed``.
        """
        rules = rules or {}
        for name in frames:
            self.ensure(name.partition(".")[0])
        staged: list[versions.Staged] = []
        try:
            for name, df in frames.items():
                staged.append(versions.stage(df, self.root, name, rules.get(name, quality.Rules())))
            broken = [f"{check}({name}.{column}): {n}" for s in staged for check, name, column, n in s.checks if n]
            if broken:
                raise ValueError("failed checks: " + "; ".join(broken))
            if audit:
                quality.require(audit({s.name: versions.frame_of(self.spark, s) for s in staged}))
            versions.commit(self.spark, self.root, staged, scope)
        except Exception:
            versions.discard(self.spark, staged)
            raise
        return staged

    def view(self, product: str, layer: str, table: str, over: str, columns: str = "*") -> DataFrame:
        """A stored view that republishes another product's table, or a selection of its ``columns``."""
        self.ensure(self.namespace(product, layer))
        name = self.name(product, layer, table)
        self.spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM {over}")
        return self.spark.table(name)

    def project(self, product: str, layer: str, table: str, df: DataFrame, over: str) -> DataFrame:
        """Materialise ``df``, a selection of columns of the relation ``over``: a table, or a view when lean.

        The table stands for the version folder of ``over`` with its own columns, so nothing is written twice.
        """
        self.ensure(self.namespace(product, layer))
        name = self.name(product, layer, table)
        if not self.lean:
            shared = versions.select(self.spark, over, name, df)
            return self.spark.table(name) if shared else self.write(product, layer, table, df)
        if self._is_stored(name):
            self.spark.sql(f"DROP TABLE {name}")
        self.spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {', '.join(df.columns)} FROM {over}")
        return self.spark.table(name)

    def _is_stored(self, name: str) -> bool:
        catalog = self.spark.catalog
        return catalog.tableExists(name) and catalog.getTable(name).tableType != "VIEW"

    def table(self, product: str, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.name(product, layer, table))

    def source(self, product: str, table: str) -> DataFrame:
        """Look a source table up by its logical name."""
        return self.table(product, "inbound", table)

    def exists(self, product: str, layer: str, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(product, layer, table))


def namespaces(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").select(F.col("namespace"))


def namespace_exists(spark: SparkSession, namespace: str) -> bool:
    return spark.catalog.databaseExists(namespace)


def list_tables(spark: SparkSession, namespace: str) -> DataFrame:
    """Stored tables and views of a namespace by name; session-only views are left out."""
    return (
        spark.sql(f"SHOW TABLES IN `{namespace}`")
        .filter(~F.col("isTemporary"))
        .select(F.col("namespace").alias("table_namespace"), F.col("tableName").alias("table_name"))
        .orderBy("table_name")
    )


def table_names(spark: SparkSession, namespace: str) -> list[str]:
    """Names only; as many as the namespace has tables."""
    return [row.table_name for row in list_tables(spark, namespace).collect()]


def drop_namespace(spark: SparkSession, namespace: str) -> int:
    """Drop a namespace with all its names; returns how many tables it had. Folders that no other name shares go with the next sweep."""
    if not namespace_exists(spark, namespace):
        return 0
    held = len(table_names(spark, namespace))
    spark.sql(f"DROP DATABASE IF EXISTS `{namespace}` CASCADE")
    return held
