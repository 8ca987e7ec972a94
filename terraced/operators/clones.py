"""Copies of products for isolated work: planning, creating, checking and dropping them.

A clone is a snapshot: later writes to the source do not reach it and writes to
the clone do not reach the source. Nothing is copied: the clone's names stand for the
same version folders, which are never written again. A write to either side makes a
new version and moves that side's name alone. A view becomes a view over the folders it reads
now: re-created with its text it would go on reading the source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraced.functions.columns import posix_cksum
from terraced.schemas import LAYERS
from terraced.sources import catalog, versions
from terraced.sources.catalog import Warehouse

# Fixed values of clone names.
CLONE_MARK = "_CI_CLO_"
NAME_LIMIT = 120
NAMESPACE_BASE = 29
NAMESPACE_LIMIT = 40


def clone_name(base: Column, owner: Column, branch: Column, limit: int = NAME_LIMIT) -> Column:
    """``<base>_CI_CLO_<owner>_<BRANCH>``, cut to ``limit`` with a checksum when too long."""
    lead = F.concat(base, F.lit(CLONE_MARK), owner, F.lit("_"))
    room = F.lit(limit) - F.length(lead)
    token = F.upper(branch)
    checksum = posix_cksum(F.concat_ws("_", base, owner, branch)).cast("string")
    kept = room - F.length(checksum) - 1
    return (
        F.when(room <= 0, F.substring(lead, 1, limit))
        .when(F.length(token) <= room, F.concat(lead, token))
        .when(kept < 1, F.concat(lead, F.substring(checksum, F.lit(1), room)))
        .otherwise(F.concat(lead, F.substring(token, F.lit(1), kept), F.lit("_"), checksum))
    )


def sandbox_namespace(seed: Column) -> Column:
    """Short namespace of a sandbox from its slug: cut base plus checksum."""
    named = F.concat_ws("_", F.substring(seed, 1, NAMESPACE_BASE), posix_cksum(seed).cast("string"))
    squeezed = F.regexp_replace(named, "_+", "_")
    return F.substring(squeezed, 1, NAMESPACE_LIMIT)


def clone_plan(registry: DataFrame, owner: str, branch: Column) -> DataFrame:
    """(source, target) pairs of a registry with ``position, key, source_database``.

    When two products would share a target, the one registered first keeps it.
    """
    named = registry.filter(F.coalesce("source_database", F.lit("")) != "").withColumn(
        "target_database", clone_name(F.col("source_database"), F.lit(owner), branch)
    )
    first = F.min_by(F.struct("key", "source_database"), "position").alias("first")
    return named.groupBy("target_database").agg(first).select(
        F.col("first.key").alias("key"), F.col("first.source_database").alias("source_database"), "target_database"
    )


def clone_names(names: DataFrame, bases: DataFrame) -> DataFrame:
    """Of ``names`` (name) those that are clones of any of ``bases`` (base).

    What stands before a clone mark is the base, so this is an equality join. A
    base may contain the mark itself, hence every place of the mark is tried.
    """
    upper = F.upper("name")
    marks = F.filter(
        F.sequence(F.lit(1), F.length(upper)),
        lambda at: F.substring(upper, at, F.lit(len(CLONE_MARK))) == CLONE_MARK,
    )
    leads = F.transform(marks, lambda at: F.substring(upper, F.lit(1), at - 1))
    possible = names.filter(upper.contains(CLONE_MARK)).select("name", F.explode(leads).alias("base"))
    known = bases.select(F.upper("base").alias("base")).distinct()
    return possible.join(known, "base", "left_semi").select("name").distinct()


def missing_objects(required: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Required keys that do not exist, each once."""
    return required.select(key).distinct().join(existing.select(key), key, "left_anti")


def clone_namespace(warehouse: Warehouse, source: str, target: str) -> list[str]:
    """Replace ``target`` with a clone of ``source``; returns the names cloned. Only the catalog is written."""
    spark = warehouse.spark
    catalog.drop_namespace(spark, target)
    warehouse.ensure(target)
    names = catalog.table_names(spark, source)
    for name in names:
        versions.share(spark, f"{source}.{name}", f"{target}.{name}")
    return names


def check_clone(warehouse: Warehouse, source: str, fact: str, target: str | None = None) -> dict[str, int]:
    """Clone a namespace, compare its fact, write into the clone, drop the clone.

    Returns row counts of source, clone and the source after the clone was
    written to, and the number of tables the write added to the source.
    """
    spark = warehouse.spark
    target = target or f"{source}_clone_ci"
    before = set(clone_namespace(warehouse, source, target))
    counts = {
        "source_rows": spark.table(f"`{source}`.`{fact}`").count(),
        "clone_rows": spark.table(f"`{target}`.`{fact}`").count(),
    }
    if counts["source_rows"] != counts["clone_rows"]:
        raise ValueError(f"clone of {source}.{fact} has {counts['clone_rows']} rows, not {counts['source_rows']}")
    mark = spark.range(1).select(F.current_timestamp().alias("created_at"))
    emptied = spark.table(f"`{source}`.`{fact}`").limit(0)
    warehouse.publish({f"{target}.clone_mutation_check": mark, f"{target}.{fact}": emptied})
    counts["source_rows_after"] = spark.table(f"`{source}`.`{fact}`").count()
    counts["tables_added"] = len(set(catalog.table_names(spark, source)) - before)
    catalog.drop_namespace(spark, target)
    return counts


def _layers_of(warehouse: Warehouse, product: str) -> list[str]:
    return [
        layer for layer in LAYERS if catalog.namespace_exists(warehouse.spark, warehouse.namespace(product, layer))
    ]


def apply_clone(
    warehouse: Warehouse, source: str, target: str, *, replace: bool, source_missing: str = "error"
) -> str:
    """Make ``target`` a clone of product ``source``; returns what was done.

    Without ``replace`` an existing clone is kept. A missing source is an error,
    or gives an empty product when ``source_missing`` is ``create_empty``.
    """
    if source == target:
        return "same"
    there = bool(_layers_of(warehouse, target))
    layers = _layers_of(warehouse, source)
    if not layers:
        if source_missing != "create_empty":
            raise LookupError(f"product {source} is missing; build it before cloning to {target}")
        if there and not replace:
            return "reused_empty"
        drop_clone(warehouse, source, target)
        warehouse.ensure_product(target)
        return "created_empty"
    if there and not replace:
        return "reused"
    drop_clone(warehouse, source, target)
    for layer in layers:
        clone_namespace(warehouse, warehouse.namespace(source, layer), warehouse.namespace(target, layer))
    return "cloned"


def drop_clone(warehouse: Warehouse, source: str, target: str) -> int:
    """Drop the clone's namespaces, never the source's; returns tables dropped."""
    if source == target:
        return 0
    return sum(catalog.drop_namespace(warehouse.spark, warehouse.namespace(target, layer)) for layer in LAYERS)


def apply_plan(warehouse: Warehouse, plan: DataFrame, mode: str, on_missing: Mapping[str, str]) -> list[tuple[str, str, str]]:
    """``ensure``, ``replace`` or ``drop`` every clone of a plan; (key, target, what was done) in order of the keys.

    ``on_missing`` says per key what a missing source means, ``error`` where it does
    not name the key. A source that must be there and is not stops the run before
    anything is changed. A plan has one row per product, so reading it is bounded.
    """
    if mode not in ("ensure", "replace", "drop"):
        raise ValueError(f"unknown mode {mode!r}")
    pairs = sorted((r.key, r.source_database, r.target_database) for r in plan.collect())
    if mode == "drop":
        return [(key, target, f"dropped {drop_clone(warehouse, source, target)}") for key, source, target in pairs]
    absent = [s for key, s, _ in pairs if on_missing.get(key, "error") == "error" and not _layers_of(warehouse, s)]
    if absent:
        raise LookupError(f"products {', '.join(absent)} are missing; build them before cloning")
    return [
        (key, target, apply_clone(warehouse, source, target, replace=mode == "replace", source_missing=on_missing.get(key, "error")))
        for key, source, target in pairs
    ]


def purge_clones(spark: SparkSession, bases: Sequence[str]) -> list[str]:
    """Drop every namespace that is a clone of any base; returns their names in order."""
    names = catalog.namespaces(spark).select(F.col("namespace").alias("name"))
    known = spark.createDataFrame([(b,) for b in bases], "base string")
    found = sorted(row.name for row in clone_names(names, known).collect())
    for name in found:
        catalog.drop_namespace(spark, name)
    return found
