"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraced.llm import (
    collision_projections,
    dual_tree_codes,
    length_buckets,
    licence_diagonals,
    neighbour_quality,
    pareto_mixing,
    perplexity_rules,
    prefix_trie,
    secret_layers,
    splitter_shards,
    tensored_minhash,
    toxicity_grammar,
    url_rules,
)
from terraced.llm.common import crc_of_id
from terraced.session import configure

Query = Callable[[SparkSession, str], DataFrame]

CUT = 0.7


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{table}.parquet")


def op1_pareto_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = pareto_mixing.mix(_read(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_secret_layers(spark: SparkSession, folder: str) -> DataFrame:
    return secret_layers.secrets(_read(spark, folder, "documents"))


def op3_neighbour_quality(spark: SparkSession, folder: str) -> DataFrame:
    learns = crc_of_id(F.col("doc_id")) % 4 != 2
    scored = neighbour_quality.score(_read(spark, folder, "documents"), _read(spark, folder, "labels"), learns)
    return _judged(scored, 4, 2)


def op4_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = tensored_minhash.near_duplicates(_read(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(_read(spark, folder, "pages"))


def op6_splitter_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = splitter_shards.shard_documents(_read(spark, folder, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_perplexity_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = perplexity_rules.judge(_read(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "low", "high"
    )


def op8_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return length_buckets.pack(_read(spark, folder, "documents"))


def op9_collision_projections(spark: SparkSession, folder: str) -> DataFrame:
    return collision_projections.near_duplicates(_read(spark, folder, "embeddings"))


def op10_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    grammar = toxicity_grammar.learn(docs, labels, crc_of_id(F.col("doc_id")) % 3 != 1)
    return _judged(toxicity_grammar.score(docs, grammar), 3, 1)


def op11_dual_tree_codes(spark: SparkSession, folder: str) -> DataFrame:
    return dual_tree_codes.compress(_read(spark, folder, "embeddings"))


def op12_licence_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    found = licence_diagonals.scan(_read(spark, folder, "documents"))
    places = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"]))
    return found.withColumn("spans", F.array_join(places, ","))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(_read(spark, folder, "conversations"))


def _judged(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id",
        (crc_of_id(F.col("doc_id")) % folds == held).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pareto_mixing,
        op2_secret_layers,
        op3_neighbour_quality,
        op4_tensored_minhash,
        op5_url_rules,
        op6_splitter_shards,
        op7_perplexity_rules,
        op8_length_buckets,
        op9_collision_projections,
        op10_toxicity_grammar,
        op11_dual_tree_codes,
        op12_licence_diagonals,
        op13_prefix_trie,
    )
}
