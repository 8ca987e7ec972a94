"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes each
result as Parquet in the shared folder and reads it again for the next stage. All
stages but the last return the columns of their input. Labels are read from
``sf_dir``; what a stage learns it learns from the documents it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraced.llm import length_buckets, pareto_mixing, secret_layers, tensored_minhash, toxicity_grammar
from terraced.llm.common import crc_of_id, pin
from terraced.operators.ranking import number_rows
from terraced.session import configure

CUT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity_grammar.learn(docs, labels, crc_of_id(F.col("doc_id")) % 3 != 1)
    return docs.filter(toxicity_grammar.score_column(F.col("text"), grammar) < CUT)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; ids that several rows share go by the text's hash.

    An id says nothing about a text: different texts under one id stay, one of each group.
    """
    configure(spark)
    repeated = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if not repeated.isEmpty():
        return _one_of_each_text(docs)
    found = tensored_minhash.near_duplicates(docs)
    kept = pin(found.filter("kept").select(F.col("doc_id").alias("_kept"), F.col("_digest").alias("_text")), "kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_text"))
    stays = docs.join(kept.distinct(), same, "left_semi")
    return stays


def _one_of_each_text(docs: DataFrame) -> DataFrame:
    """The same with every row's place by (id, text hash) as its id, where ids alone don't tell rows apart."""
    stored = pin(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    text = F.col("text").cast("string")
    keys = stored.select(F.lit(0).alias("_all"), F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.xxhash64(text).alias("d"), "_row").alias("_key"))
    seats = pin(number_rows(keys, "_all", "_key", "_seat").select(F.col("_key._row").alias("_row"), "_seat"), "seats")
    seated = stored.select("_row", text.alias("text")).join(seats, "_row").select(F.col("_seat").alias("doc_id"), "text")
    kept = tensored_minhash.near_duplicates(pin(seated, "seated")).filter("kept").select(F.col("doc_id").alias("_seat"))
    stays = stored.join(seats.join(kept, "_seat", "left_semi"), "_row", "left_semi")
    return stays.select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text masked and the length set anew."""
    configure(spark)
    masked = docs.withColumn("text", secret_layers.without_secrets(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    configure(spark)
    mixed = pareto_mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("_digest").alias("_text"), "copies")
    mixed = pin(mixed, "mixed")
    digest, source = F.xxhash64(F.col("text").cast("string")), F.col("source").cast("string")
    rows, key = docs, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_text")) & source.eqNullSafe(F.col("_of"))
    if not mixed.groupBy("_id", "_of", "_text").count().filter("count > 1").isEmpty():  # repeated rows take their turns in order
        stored = pin(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
        group = F.struct(F.col("doc_id").alias("i"), source.alias("s"), digest.alias("t")).alias("_who")
        turns = number_rows(stored.select(group, "_row"), "_who", "_row", "_turn").select(F.col("_row").alias("_of_row"), "_turn")
        rows = stored.join(turns, F.col("_row") == F.col("_of_row"))
        same = mixed.select(F.struct(F.col("_id").alias("i"), F.col("_of").alias("s"), F.col("_text").alias("t")).alias("_who"), F.struct("copies", F.monotonically_increasing_id().alias("r")).alias("_by"))
        mixed = number_rows(same, "_who", "_by", "_as").select("_who.i", "_who.s", "_who.t", F.col("_by.copies").alias("copies"), "_as")
        mixed = mixed.toDF("_id", "_of", "_text", "copies", "_as")
        key &= F.col("_turn") == F.col("_as")
    taken = rows.join(mixed.filter("copies > 0"), key)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and place of every row."""
    configure(spark)
    return length_buckets.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Learned weights, minimum hashes and nested decoding are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
