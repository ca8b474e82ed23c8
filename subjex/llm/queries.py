"""Registered queries of the training-data operators: thin calls with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.llm import (bin_packing, chat_format, decision_list, deobfuscate, line_dedup, neighbour_quality, order_minhash, raking, shard_table, spaced_seeds, target_resampling,
                        token_shards, va_clusters)
from subjex.llm.common import table


#: Target shares of tokens: the hot source held down, the smaller languages lifted a little.
MIX = {"source": {"src0": 0.10, "src1": 0.06, "src2": 0.06, "src3": 0.04, "other": 0.74},
       "lang": {"en": 0.56, "de": 0.16, "fr": 0.16, "es": 0.11, "other": 0.01},
       "topic": {"article": 0.87, "brief": 0.02, "figures": 0.09, "table": 0.02}}


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = token_shards.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = neighbour_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = raking.with_copies(table(spark, sf_dir, "documents"), MIX)
    return mixed.select("d.doc_id", "topic", "n_tokens", F.round("rate", 6).alias("rate"), "copies")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.write_and_read(chat_format.format_conversations(turns)))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spaced_seeds.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "best_item", "best_words")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deobfuscate.digest_rows(deobfuscate.find_personal_data(table(spark, sf_dir, "documents")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decision_list.judge(docs, decision_list.learn(docs, table(spark, sf_dir, "labels")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_table.place(docs, {f"shard-{i:02d}": 1 for i in range(64)})
    return shard_table.write_shards(placed).select("doc_id", "slot", "shard")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = target_resampling.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return target_resampling.draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


def op12_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_clusters.with_inertia(*va_clusters.cluster(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, seed=3))


def op13_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bin_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=4096)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_neighbour_quality": op2_neighbour_quality,
    "op3_mixing": op3_mixing,
    "op4_chat_format": op4_chat_format,
    "op5_spaced_seeds": op5_spaced_seeds,
    "op6_personal_data": op6_personal_data,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
    "op11_target_resampling": op11_target_resampling,
    "op12_va_clusters": op12_va_clusters,
    "op13_bin_packing": op13_bin_packing,
}
