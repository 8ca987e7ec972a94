"""Shards of near-equal bytes by sampled splitters.

Records are ordered by the 64-bit hash of their text, so equal texts are neighbours.
Keys are sampled with a chance in proportion to the record's size, evenly spaced
sample keys become splitters, and each record goes to the range between its
splitters. A range that holds more than its share is cut again by splitters sampled
inside it and by one right after its first key, until none is too full or a too full
one is a single text. Only such a text, larger than a range by itself, is cut into
pieces by a hash of the rows' numbers; all other equal texts share a range. There are many
more ranges than shards; a shard is a run of ranges, cut where the bytes so far are
nearest to its share.

Samples, splitters and the sizes of ranges at the driver are bounded by ``shards``,
``ranges`` and ``sampled`` alone. Records are never gathered: ranges are counted by
partial sums, and places in a shard are numbered over ranges of rows.

Defined results. Null text: no bytes, crc32 of the empty text, size 8. Equal texts go
to one shard unless they are larger than a range, whatever their ids. Repeated rows
get slots of their own. Only id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraced.llm.common import mix64, pin, unit_hash
from terraced.operators.ranking import number_rows

RANGES_PER_SHARD = 64
SAMPLED_PER_RANGE = 30
OVERFULL = 1.5


def shard_documents(
    docs: DataFrame,
    *,
    shards: int = 24,
    ranges: int = RANGES_PER_SHARD,
    sampled: int = SAMPLED_PER_RANGE,
    overhead: int = 8,
    seed: int = 6,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = pin(read, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    share = total / (shards * ranges)
    splitters = _spaced(_sample(rows, sampled / share, seed), shards * ranges - 1)
    while True:
        ranged = rows.select("size", "_key", "_row", _range_of(splitters)("_key", "_row").alias("range"))
        held = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        held = held.toPandas().sort_values("range")  # one row per range
        full = held["bytes"] > OVERFULL * share
        wide = held[full & (held["low"] < held["high"])]
        if wide.empty:
            break
        splitters = np.union1d(splitters, _inside(ranged, wide, share, sampled, seed + len(splitters)))

    pieces = np.ones(len(splitters) + 1, dtype=np.int64)  # of a range; several only where one text overfills it
    pieces[held["range"][full]] = np.ceil(held["bytes"][full] / share)
    if full.any():
        cut = rows.select("size", _range_of(splitters, pieces)("_key", "_row").alias("range")).groupBy("range").agg(F.sum("size").alias("bytes"))
        held = cut.toPandas().sort_values("range")
    upto = np.cumsum(held["bytes"].to_numpy())
    edges = np.concatenate(([0], upto))
    cuts = [int(np.abs(edges - total * k / shards).argmin()) for k in range(1, shards)]
    shard_of = np.zeros(int(pieces.sum()), dtype=np.int32)
    shard_of[held["range"].to_numpy()] = np.searchsorted(cuts, np.arange(len(held)), side="right")

    placed = rows.withColumn("shard", _range_of(splitters, pieces, shard_of)("_key", "_row"))
    placed = placed.select("size", "text_crc32", "shard", F.struct("_key", "doc_id", "_row").alias("_order"))
    return number_rows(placed, "shard", "_order", "slot").select(
        F.col("_order.doc_id").alias("doc_id"), "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot")
    )


def _sample(rows: DataFrame, per_byte: float, seed: int) -> np.ndarray:
    """Keys drawn with a chance of ``per_byte`` times their size, sorted."""
    drawn = rows.filter(unit_hash(seed, F.col("_row")) < F.col("size") * F.lit(per_byte))
    return np.sort(drawn.select("_key").toPandas()["_key"].to_numpy(dtype=np.int64))


def _spaced(keys: np.ndarray, count: int) -> np.ndarray:
    if not len(keys):
        return keys
    at = np.arange(1, count + 1) * len(keys) // (count + 1)
    return np.unique(keys[at])


def _inside(ranged: DataFrame, full: pd.DataFrame, share: float, sampled: int, seed: int) -> np.ndarray:
    """New splitters for the too full ranges, each cut into as many as its bytes are shares, and once after its first key."""
    rows = ranged.filter(F.col("range").isin([int(x) for x in full["range"]]))
    keys = _sample(rows, sampled / share, seed)
    found = [full["low"].to_numpy(dtype=np.int64) + 1]
    for lo, hi, held in zip(full["low"], full["high"], full["bytes"]):
        own = keys[(keys > lo) & (keys <= hi)]
        found.append(_spaced(own, int(np.ceil(held / share)) - 1))
    return np.concatenate(found)


def _range_of(splitters: np.ndarray, pieces: np.ndarray | None = None, then: np.ndarray | None = None):
    """Number of the range of a key, counting the pieces of cut ranges; or what ``then`` has at that number."""
    first = None if pieces is None else np.cumsum(pieces) - pieces

    @F.pandas_udf("int")
    def place(key: pd.Series, row: pd.Series) -> pd.Series:
        at = np.searchsorted(splitters, key.to_numpy(), side="right")
        if pieces is not None:
            with np.errstate(over="ignore"):
                turn = (mix64(row.to_numpy().astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            at = first[at] + (turn * pieces[at] >> 32)
        return pd.Series(at if then is None else then[at]).astype("int32")

    return place
