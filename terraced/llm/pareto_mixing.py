"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is its share, by weight, of the wanted total, held at ``most``
times its size; what is cut off is shared again by weight. A target of r times the
source gives every document ``floor(r)`` certain copies. The rest, a budget of
words, is an unequal-probability sample without replacement: a document of size s
is included with probability ``min(1, c * s)``, with c such that the expected words
equal the budget. Pareto order sampling ranks documents by their random odds
divided by their inclusion odds and takes the first ones. The fixed size of the
sample is its words: documents are taken in rank order while they fit, and the
last place goes to the document left over whose size is nearest to the gap, if it
narrows the gap.

The random number of a document is a hash of its id and text, so reruns agree.

Skew. Sizes, the histogram behind c and the running words are partial aggregates.
Running words go over rank buckets, whose number grows with the rows, and only the
bucket in which a source's budget ends is ordered row by row.

Defined results. Null source: a source of its own, last in order. Null and empty
texts have size 0 and no copies beyond the certain ones. Documents of equal rank are
ordered by id and text. Repeated rows are separate documents. Only id, text and
source are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraced.llm.common import pin, unit_hash, word_count

SEED = 20
ROWS_PER_BUCKET = 2_000


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``target`` for each row of ``sizes`` (``source``, ``source_size``), in words.

    Sources in code point order, null last, take the weights in turn. One row per
    source passes through one task here.
    """
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    rows = rows.withColumn("_most", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("_reach", F.col("_most") / F.col("_weight"))
    rows = rows.withColumn("_wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_reach = W.orderBy("_reach", F.col("source").asc_nulls_last())
    held = F.coalesce(F.sum("_most").over(by_reach.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(by_reach.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_wanted") - held) / open_weight)
    # The first source that its level does not fill sets the level of all that are not full.
    level = F.max(F.when(F.col("_level") <= F.col("_reach"), F.col("_level"))).over(everything)
    target = F.least(F.col("_most"), F.coalesce(level * F.col("_weight"), F.col("_most")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``, ``_digest`` for every row.

    ``_digest`` is the hash of the text, to find a row again with its id.
    """
    text = F.col("text").cast("string")
    read = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("_digest"))
    rows = pin(read.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("certain", F.floor(ratio + F.lit(1e-12)))
    plan = pin(plan.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size"))), "mix-plan")
    plan = pin(_with_scale(rows, plan), "mix-scale")

    chance = F.least(F.lit(1.0), F.col("scale") * F.col("size"))
    random = unit_hash(seed, F.col("doc_id"), F.col("_digest"))
    odds = random / (1 - random)
    rank = F.when(chance >= 1, F.lit(0.0)).otherwise(odds * (1 - chance) / chance)
    ranked = _with_plan(rows, plan.select("source", "scale")).filter("size > 0 AND scale > 0")
    buckets = rows.count() // ROWS_PER_BUCKET + 16
    place = (rank / (1 + rank)).alias("_place")
    ranked = ranked.select("source", "doc_id", "size", "_digest", "_row", place, random.alias("_random"))
    ranked = pin(ranked.withColumn("_bucket", F.floor(F.col("_place") * buckets)), "mix-ranked")

    words = ranked.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    so_far = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    ends = _with_plan(words.withColumn("_upto", F.sum("_words").over(so_far)), plan.select("source", "budget"))
    ends = ends.groupBy("source", "budget").agg(
        F.min(F.when(F.col("_upto") > F.col("budget"), F.struct("_bucket", (F.col("_upto") - F.col("_words")).alias("_before")))).alias("_end"),
        F.sum("_words").alias("_all"),
    )
    ends = pin(ends.select("source", "budget", F.col("_end._bucket").alias("_last"), F.coalesce("_end._before", "_all").alias("_before")), "mix-ends")

    reached = _with_plan(ranked, ends)
    rows_of_last = reached.filter(F.col("_bucket") == F.col("_last"))
    in_order = W.partitionBy("source").orderBy("_place", "_random", "doc_id", "_digest", "_row").rowsBetween(W.unboundedPreceding, 0)
    fit = rows_of_last.withColumn("_upto", F.sum("size").over(in_order) + F.col("_before")).filter("_upto <= budget")
    fit = pin(fit.select("source", "_row", "_upto"), "mix-fit")
    filled = fit.groupBy("source").agg(F.max("_upto").alias("_filled"))
    gaps = _with_plan(ends, filled, "left").select("source", "_last", (F.col("budget") - F.coalesce("_filled", "_before")).alias("_gap"))
    left_over = _with_plan(ranked, gaps).filter(F.col("_bucket") >= F.col("_last")).join(fit.select("_row"), "_row", "left_anti")
    miss = F.abs(F.col("size") - F.col("_gap"))
    closing = left_over.filter(miss < F.col("_gap")).groupBy("source").agg(F.min(F.struct(miss.alias("m"), "_place", "doc_id", "_digest", "_row")).alias("c"))
    single = pin(fit.select("_row").unionByName(closing.select(F.col("c._row").alias("_row"))), "mix-single")

    low = reached.filter(F.col("_last").isNull() | (F.col("_bucket") < F.col("_last"))).select("_row")
    extra = low.unionByName(single).withColumn("_extra", F.lit(1))
    found = _with_plan(rows, plan.select("source", "source_size", "target", "certain")).join(extra, "_row", "left")
    copies = (F.col("certain") + F.coalesce("_extra", F.lit(0))).cast("long")
    return found.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_digest"
    )


def _with_plan(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    side = plan.withColumnRenamed("source", "_source")
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source", *[c for c in side.columns if c in rows.columns])


def _with_scale(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``scale``, the c for which the expected words equal the budget.

    Works on the histogram of sizes: going down from the largest size, those above
    are certain, and c is what is left of the budget over the squares below.
    """
    histogram = rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    down = W.partitionBy("source").orderBy(F.col("size").desc())
    sure = F.coalesce(F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    square = F.col("n") * F.col("size").cast("double") * F.col("size")
    below = F.sum(square).over(down.rowsBetween(0, W.unboundedFollowing))
    steps = histogram.select("source", "size", sure.alias("_sure"), below.alias("_below"))
    steps = _with_plan(steps, plan.select("source", "budget")).withColumn("c", (F.col("budget") - F.col("_sure")) / F.col("_below"))
    scales = steps.filter(F.col("c") * F.col("size") <= 1).groupBy("source").agg(F.max("c").alias("scale"))
    return _with_plan(plan, scales, "left").withColumn("scale", F.greatest(F.lit(0.0), F.coalesce("scale", F.lit(0.0))))
