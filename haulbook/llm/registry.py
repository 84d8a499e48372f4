"""The operators as queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from haulbook.llm import (
    chat, decontaminate, fingerprints, mixing, near_copies, negatives, oracles, packing, quality, repair, repeats, toxicity,
    urls, warc,
)
from haulbook.llm.common import table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes(table(spark, sf_dir, "documents"))


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op3_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_host_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("shards")  # each copy's shard, behind `taken`


def op7_consistent_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op8_relational_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chats.union(chat.probe(spark)))


def op9_splittable_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_weighted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_tiled_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.digests(table(spark, sf_dir, "embeddings"))


def op12_deepening_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(table(spark, sf_dir, "conversations"))


def op13_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (
        op1_order_minhash, op2_run_length_index, op3_additive_model, op4_host_segmentation,
        op5_positional_index, op6_splitting_tree,
        op7_consistent_sampling, op8_relational_formatting, op9_splittable_reader, op10_weighted_lexicon,
        op11_tiled_negatives, op12_deepening_repair, op13_best_two_fit,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_positional_index": oracles.OP5, "op6_splitting_tree": oracles.OP6,
        "op8_relational_formatting": oracles.OP8, "op9_splittable_reader": oracles.OP9,
        "op11_tiled_negatives": oracles.OP11, "op12_deepening_repair": oracles.OP12,
    }
