"""Row numbers within groups that stay balanced when one group is huge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraced.session import pin, scanned_bytes, width_for

_SAMPLED_PER_TASK = 40


def number_rows(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Add ``name`` = 1-based position of each row in its ``group`` by ``order``.

    ``order`` must be unique within a group (it is a key), or ties are numbered
    arbitrarily, as with ``row_number``.

    The rows are shuffled once. A group that holds more than a task's share of a sample is cut
    at evenly spaced sample rows into ranges of about a share each; ranges are numbered
    by themselves and moved by the rows of the group's earlier ranges. The sample
    decides where groups are cut, never what the numbers are. There are at most as many
    cuts as tasks, so the tables of cuts and moves are small, and without a group of that size there are none.
    """
    tasks = width_for(df.sparkSession, scanned_bytes(df))
    cuts = _cuts(df, group, order, tasks)
    if cuts.isEmpty():
        within = F.row_number().over(W.partitionBy(group).orderBy(order))
        return df.withColumn(name, within.cast("bigint"))

    same = F.col(group).eqNullSafe(F.col("_cut_group"))
    passed = F.filter("_cuts", lambda cut: F.coalesce(cut["at"] <= F.col(order), F.lit(False)))
    ranged = df.join(cuts, same, "left").withColumn("_range", F.when(F.col("_cuts").isNotNull(), F.size(passed)).otherwise(0))
    held = df.join(cuts, same).groupBy(F.col("_cut_group").alias("_of_group"), F.size(passed).alias("_of")).agg(F.count("*").alias("_rows"))
    earlier = W.partitionBy("_of_group").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    moves = pin(held.select("_of_group", "_of", F.sum("_rows").over(earlier).alias("_shift")).filter("_shift IS NOT NULL"), "range-shifts")

    within = F.row_number().over(W.partitionBy(group, "_range").orderBy(order))
    of_range = (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_of_group"))
    numbered = ranged.withColumn("_at", within).join(moves, of_range, "left")
    at = (F.col("_at") + F.coalesce("_shift", F.lit(0))).cast("bigint")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], at.alias(name))


def _cuts(df: DataFrame, group: str, order: str, tasks: int) -> DataFrame:
    """``_cut_group`` and ``_cuts`` (ascending values of ``order``) of groups above a task's share of a sample."""
    rows = df.count()
    share = min(1.0, _SAMPLED_PER_TASK * tasks / max(rows, 1))
    keys = df.select(F.col(group).alias("_cut_group"), F.struct(F.col(order).alias("at")).alias("_key"))
    sample = pin(keys.sample(share, seed=1), "number-sample")
    per_task = max(1, sample.count() // tasks)
    pieces = F.ceil(F.col("_held") / per_task)
    large = sample.groupBy(F.col("_cut_group").alias("_large")).agg(F.count("*").alias("_held")).filter(F.col("_held") > per_task)
    placed = sample.join(large, F.col("_cut_group").eqNullSafe(F.col("_large"))).withColumn("_seat", F.row_number().over(W.partitionBy("_cut_group").orderBy("_key")) - 1)
    starts = placed.filter((F.col("_seat") > 0) & (F.floor(F.col("_seat") * pieces / F.col("_held")) != F.floor((F.col("_seat") - 1) * pieces / F.col("_held"))))
    return pin(starts.groupBy("_cut_group").agg(F.array_sort(F.collect_list("_key")).alias("_cuts")), "number-cuts")
