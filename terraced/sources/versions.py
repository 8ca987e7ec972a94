"""Tables as version folders: written first, checked, then named.

A table is an external Parquet table over a folder that is never written again. A new
state goes to a folder of its own; only when everything is written and checked do the
names move, which changes the catalog alone. So a write that fails leaves the old
tables as they were, frames already read keep their folder, and several names can
stand for one folder: that is a clone. Folders no name stands for are swept.

A commit of several tables is one record, a small table of names and folders that
appears as a whole. Names follow it one by one; a move that fails is undone for all of
them and the record is taken back, and ``recover`` brings the names to the newest record after a
driver was lost between the two. Who needs all tables of one commit reads the record with ``committed``.

Spark's own overwrite of a name leaves the folder alone and makes a table of its own; rows are
not to be inserted into a name by other means, since its folder may be shared.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraced.operators import quality
from terraced.session import STORED_CODEC

_COMMITS = "_commits"
_NAMES = "_names"
_VERSION = re.compile(r"[^/\s`']+\.db/[^/\s`']+/v-[0-9a-f]{32}")
_OWN_VIEW = re.compile(r"SELECT (.+) FROM ([^\s()]+)")
_WHOLE_VIEW = re.compile(r"SELECT \* FROM ([^\s()]+)")
_RECORD = "name string, folder string, columns string, row_count bigint"


@dataclass(frozen=True)
class Staged:
    """A written folder that no name stands for yet, and what its write counted."""

    name: str
    folder: str
    columns: str
    row_count: int
    checks: tuple[tuple[str, str, str, int], ...]


def root_of(spark: SparkSession, location: str | None) -> str:
    """Where version folders go: a given folder, or the catalog's own."""
    return (location or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def namespace_folder(root: str, namespace: str) -> str:
    """The catalog's folder for a namespace, apart from the versions, as dropping a namespace may delete it."""
    return f"{root}/{_NAMES}/{namespace}.db"


def stage(df: DataFrame, root: str, name: str, rules: quality.Rules = quality.Rules()) -> Staged:
    """Write a new version of ``name``; the write itself counts rows and broken rules."""
    spark = df.sparkSession
    namespace, _, table = name.partition(".")
    folder = f"{root}/{namespace}.db/{table}/v-{uuid.uuid4().hex}"
    seen = Observation()
    try:
        df.observe(seen, *rules.counts()).write.option("compression", STORED_CODEC).parquet(folder)
    except Exception:
        _delete(spark, folder)
        raise
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    found = seen.get
    return Staged(name, folder, columns, found["row_count"], tuple(rules.results(name, found)))


def frame_of(spark: SparkSession, staged: Staged) -> DataFrame:
    """What a staged version holds."""
    return spark.read.schema(_schema(staged.columns)).parquet(staged.folder)


def _schema(columns: str) -> T.StructType:
    return T.StructType.fromDDL(columns)


def commit(spark: SparkSession, root: str, staged: Sequence[Staged], scope: str | None = None) -> None:
    """Let the names of all staged versions stand for them, or none of them."""
    record = _write_record(spark, root, scope, staged) if scope else None
    undo: list[tuple[str, str | None, str | None]] = []
    try:
        for s in staged:
            undo.append((s.name, *_before(spark, s.name)))
            _point(spark, s.name, s.folder, s.columns)
    except Exception:
        for name, definition, aside in reversed(undo):
            _drop(spark, name)
            if aside:
                spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")
            elif definition:
                spark.sql(definition)
        if record:
            _delete(spark, record)
        raise
    for _, _, aside in undo:
        if aside:
            spark.sql(f"DROP TABLE {aside}")


def discard(spark: SparkSession, staged: Sequence[Staged]) -> None:
    """Delete versions that will not be committed."""
    for s in staged:
        _delete(spark, s.folder)


def committed(spark: SparkSession, root: str, scope: str) -> dict[str, DataFrame]:
    """All tables of the newest commit of a scope by name, read from its record."""
    rows = _newest(spark, root, scope)
    return {r.name: spark.read.schema(_schema(r.columns)).parquet(r.folder) for r in rows}


def recover(spark: SparkSession, root: str, scope: str) -> list[str]:
    """Bring names that fell behind to the newest commit; returns those moved."""
    behind = [r for r in _newest(spark, root, scope) if _version(folder_of(spark, r.name) or "") != _version(r.folder)]
    for r in behind:
        _point(spark, r.name, r.folder, r.columns)
    return [r.name for r in behind]


def share(spark: SparkSession, source: str, target: str) -> None:
    """Let ``target`` stand for what ``source`` stands for now, without copying it.

    A view of this library becomes a view over the folders it reads now; any
    other view, or a table that is no version folder, is stored as a new version beside it.
    """
    frozen = _frozen(spark, source)
    folder = folder_of(spark, source)
    if folder:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(source).schema.fields)
        _point(spark, target, folder, columns)
    elif frozen:
        _drop(spark, target)
        spark.sql(f"CREATE VIEW {target} AS SELECT * FROM {frozen}")
    else:
        made = stage(spark.table(source), root_of(spark, None), target.replace("`", ""))
        _point(spark, target, made.folder, made.columns)


def select(spark: SparkSession, source: str, target: str, chosen: DataFrame) -> bool:
    """Let ``target`` be a table of the columns of ``chosen`` over the folder that ``source`` stands for now.

    ``chosen`` must do nothing but select columns of ``source``: Parquet files are read by column
    name, so the same files hold its rows. Later writes to either name do not reach the other.
    False, and nothing is changed, where ``source`` is no version folder or view of whole ones.
    """
    told = _described(spark, source)
    while told.get("Type") == "VIEW" and (own := _WHOLE_VIEW.fullmatch(told.get("View Text", ""))):
        source = own[1]
        told = _described(spark, source)
    folder = folder_of(spark, source)
    held = {f.name: f.dataType for f in spark.table(source).schema.fields} if folder else {}
    if not folder or any(held.get(f.name) != f.dataType for f in chosen.schema.fields):
        return False
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    commit(spark, "", [Staged(target, folder, columns, 0, ())])
    return True


def folder_of(spark: SparkSession, name: str) -> str | None:
    """The version folder a name stands for."""
    told = _described(spark, name)
    place = told.get("Location", "")
    return place if told.get("Type") == "EXTERNAL" and _VERSION.search(place) else None


def _version(folder: str) -> str:
    """A version folder without its root, which the catalog may write in another way."""
    found = _VERSION.search(folder)
    return found[0] if found else ""


def sweep(spark: SparkSession, root: str, older_than: float = 86_400.0) -> int:
    """Delete version folders under ``root`` that no table, view or newest commit names; returns how many.

    ``older_than`` seconds keep versions that are being written out of it.
    """
    files = _files(spark, root)
    named = set()
    for place in spark.catalog.listDatabases():
        for told in spark.sql(f"SHOW TABLE EXTENDED IN `{place.name}` LIKE '*'").collect():  # one row per table
            named |= set(_VERSION.findall(told.information))
    for folder in files(f"{root}/{_COMMITS}/*"):
        rows = _newest(spark, root, folder.getPath().getName())
        named |= {_version(r.folder) for r in rows}
    swept = 0
    for folder in files(f"{root}/*.db/*/v-*"):
        path = folder.getPath().toString()
        if _version(path) not in named and folder.getModificationTime() / 1000 <= time.time() - older_than:
            _delete(spark, path)
            swept += 1
    return swept


def _files(spark: SparkSession, root: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system: JavaObject = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return lambda pattern: system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)) or []


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    if not spark.catalog.tableExists(name.replace("`", "")):
        return {}
    return {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}  # one row per column


def _before(spark: SparkSession, name: str) -> tuple[str | None, str | None]:
    """What brings a name back: the statement that makes it what it is now, or where its own data was set aside."""
    kind = _described(spark, name).get("Type")
    if kind == "MANAGED":  # made by other means; dropping it would delete its data
        aside = f"{name}_{uuid.uuid4().hex[:8]}"
        spark.sql(f"ALTER TABLE {name} RENAME TO {aside}")
        return None, aside
    return (spark.sql(f"SHOW CREATE TABLE {name}").first()[0] if kind else None), None


def _drop(spark: SparkSession, name: str) -> None:
    kind = _described(spark, name).get("Type")
    if kind:
        spark.sql(f"DROP {'VIEW' if kind == 'VIEW' else 'TABLE'} {name}")


def _point(spark: SparkSession, name: str, folder: str, columns: str) -> None:
    """Let ``name`` stand for ``folder``: a move where the columns are the same, else a new entry.

    The option tells names that share a folder apart, so that one may be overwritten from another.
    """
    if folder_of(spark, name) and spark.table(name).schema.simpleString() == _schema(columns).simpleString():
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
    else:
        _drop(spark, name)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS ('named' '{name}') LOCATION '{folder}'")
    spark.catalog.refreshTable(name)


def _frozen(spark: SparkSession, name: str) -> str | None:
    """What a name reads now as a relation over folders, which later writes do not reach."""
    told = _described(spark, name)
    if told.get("Type") != "VIEW":
        folder = folder_of(spark, name)
        return f"parquet.`{folder}`" if folder else None
    own = _OWN_VIEW.fullmatch(told.get("View Text", ""))
    below = own and _frozen(spark, own[2])
    return f"(SELECT {own[1]} FROM {below})" if below else None


def _records(spark: SparkSession, root: str, scope: str) -> list[str]:
    """Complete records of a scope, oldest first."""
    done = _files(spark, root)(f"{root}/{_COMMITS}/{scope}/*/_SUCCESS")
    return sorted(f.getPath().getParent().toString() for f in done)


def _write_record(spark: SparkSession, root: str, scope: str, staged: Sequence[Staged]) -> str:
    """The record after the newest. Its folder must be new, so of two commits at once one fails."""
    last = _records(spark, root, scope)
    number = int(last[-1].rpartition("/")[2]) + 1 if last else 0
    record = f"{root}/{_COMMITS}/{scope}/{number:012d}"
    rows = [(s.name, s.folder, s.columns, s.row_count) for s in staged]
    spark.createDataFrame(rows, _RECORD).coalesce(1).write.parquet(record)
    return record


def _newest(spark: SparkSession, root: str, scope: str) -> list:
    """Rows of the newest record: each name once, as its last commit had it."""
    found: dict[str, object] = {}
    for record in _records(spark, root, scope)[-1:]:
        found.update({r.name: r for r in spark.read.schema(_RECORD).parquet(record).collect()})  # one row per table
    return list(found.values())


def checks_of(spark: SparkSession, staged: Sequence[Staged]) -> DataFrame:
    """What the writes found, one row per rule."""
    return spark.createDataFrame([c for s in staged for c in s.checks], "check_name string, table_name string, column_name string, failures bigint")


def counts_of(spark: SparkSession, staged: Sequence[Staged]) -> DataFrame:
    """Rows per table as its write counted them; nothing is read again."""
    rows: Mapping[str, int] = {s.name.rpartition(".")[2]: s.row_count for s in staged}
    return spark.createDataFrame(list(rows.items()), "table_name string, row_count bigint").select(F.col("table_name"), F.col("row_count"))
