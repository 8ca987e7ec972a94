"""Packing into length buckets whose borders waste least padding.

A global histogram of lengths is the only thing that reaches the driver. Lengths up
to ``EXACT`` have bins of their own, longer ones ``EXACT / 2`` bins per doubling, so
the histogram has a bound whatever the table holds. Dynamic programming over the
bins finds the borders of at most ``buckets`` buckets with the least padding when
every document is padded to its bucket's border. Inside a bucket, documents in the
order of a hash form batches of ``budget`` padded tokens.

Defined results. A null or empty text has length 0 and is padded to 1. A document
longer than the budget is a batch of its own, whole. Repeated rows are separate
documents. Only id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraced.llm.common import pin, word_count
from terraced.operators.ranking import number_rows

BUCKETS = 32
BUDGET = 65_536
EXACT = 1_024


def bin_of(length: Column) -> Column:
    """The upper end of the histogram bin of a length."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - int(np.log2(EXACT)) + 1)
    wide = (F.ceil(length / width) * width).cast("long")
    return F.when(length <= EXACT, F.greatest(length, F.lit(1))).otherwise(wide).cast("long")


def best_borders(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Borders, a subset of the sorted ``lengths``, with the least total of padded lengths."""
    n = len(lengths)
    if not n:
        return []
    before = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choices = []
    for _ in range(min(buckets, n)):
        after, chosen = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for end in range(1, n + 1):
            tried = cost[:end] + lengths[end - 1] * (before[end] - before[:end])
            chosen[end] = tried.argmin()
            after[end] = tried[chosen[end]]
        choices.append(chosen)
        cost = after
    borders, end = [], n
    for chosen in reversed(choices):
        borders.append(int(lengths[end - 1]))
        end = chosen[end]
        if end == 0:
            break
    return borders[::-1]


def pack(docs: DataFrame, *, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``doc_id``, ``size``, ``bucket`` (padded length), ``batch``, ``place``, ``padding`` for every row.

    ``batch`` counts from 0 in each bucket, ``place`` from 0 in each batch. The
    length is the number of words unless a column expression over ``docs`` is given.
    """
    size = word_count(F.col("text").cast("string")) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("_spread"), F.monotonically_increasing_id().alias("_row"))
    rows = pin(rows.withColumn("_bin", bin_of(F.col("size"))), "pack-rows")
    histogram = rows.groupBy("_bin").agg(F.count("*").alias("n")).orderBy("_bin").collect()  # bounded, see above
    borders = best_borders(np.array([r[0] for r in histogram], dtype=np.int64), np.array([r[1] for r in histogram]), buckets)
    if not borders:
        bucket = F.lit(0).cast("long")
    else:
        bucket = F.element_at(F.filter(F.array(*[F.lit(b).cast("long") for b in borders]), lambda b: b >= F.col("_bin")), 1)
    order = F.struct("_spread", "doc_id", "size", "_row").alias("_order")  # the row's number parts equal rows
    numbered = number_rows(rows.select(bucket.alias("bucket"), order), "bucket", "_order", "_seat")
    numbered = numbered.select(F.col("_order.doc_id").alias("doc_id"), F.col("_order.size").alias("size"), "bucket", (F.col("_seat") - 1).alias("_seat"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    return numbered.select(
        "doc_id",
        "size",
        "bucket",
        F.floor(F.col("_seat") / fit).cast("long").alias("batch"),
        (F.col("_seat") % fit).cast("long").alias("place"),
        (F.col("bucket") - F.col("size")).alias("padding"),
    )
