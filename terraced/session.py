"""Session settings and the shared folder that written intermediates go to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_SETTING = "spark.checkpoint.dir"
_PARTITIONS_SETTING = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SCANNED_PER_PARTITION = 32 * 1024 * 1024
#: Codec of all stored Parquet: about a third less to write and to read again than the default.
STORED_CODEC = "zstd"
_UNKNOWN_SIZE = 1 << 62
_local_folders: dict[str, str] = {}
_given_widths: dict[str, str | None] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on. Safe to call repeatedly.

    * UTC, because the raw mirror writes wall-clock text and reads it back zone-free.
    * AQE with forced skew handling: a hot join key is split even when the split
      costs one more exchange above it (for instance an aggregation on the same key).
    * The first number of shuffle partitions as the caller had it; reading tables
      raises it for what follows, and the next call sets it back.
    """
    app = spark.sparkContext.applicationId
    given = _given_widths.setdefault(app, spark.conf.get(_PARTITIONS_SETTING, None))
    if given is None:
        spark.conf.unset(_PARTITIONS_SETTING)
    else:
        spark.conf.set(_PARTITIONS_SETTING, given)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def stored_bytes(df: DataFrame) -> int:
    """The planner's size of what ``df`` reads: file sizes for tables, nothing is scanned."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scanned_bytes(df: DataFrame) -> int:
    """The planner's sizes of all tables below ``df``; those it does not know count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN_SIZE)


def size_shuffles(spark: SparkSession, scanned: int) -> int:
    """Give shuffles enough partitions for ``scanned`` bytes; returns the number in force.

    Adaptive execution merges small shuffle partitions but never starts with more
    than it was told to, and the default would put terabytes into one task.
    """
    needed = width_for(spark, scanned)
    if needed > _width(spark):
        spark.conf.set(_PARTITIONS_SETTING, str(needed))
    return needed


def width_for(spark: SparkSession, scanned: int) -> int:
    """Partitions for ``scanned`` bytes, at least as many as are set."""
    return max(-(-scanned // _SCANNED_PER_PARTITION), _width(spark))


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get(_PARTITIONS_SETTING, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, in whatever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get(_CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_SETTING} to a folder all executors share")
    app = context.applicationId
    if app not in _local_folders:
        folder = tempfile.mkdtemp(prefix="terraced-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folders[app] = f"file:{folder}"
    return _local_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; never reused, so nothing is overwritten while read."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the copy.

    Use it where one relation feeds several branches of a plan. Unlike a cached
    frame the copy survives lost executors, keeps column pruning and pushdown, and
    gives the planner a true size: a small dimension is broadcast because its
    files are small, a large one is joined by shuffle.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", STORED_CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
