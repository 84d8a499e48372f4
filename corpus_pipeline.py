"""From raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir), calls one operator on all of `docs`, and returns a
DataFrame that is written before the next stage reads it. All but the last return the
columns of `documents`; the last returns what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulbook.llm import decontaminate, mixing, near_copies, quality, repeats
from haulbook.llm.common import table
from haulbook.session import fresh_dir


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of the smallest id."""
    return near_copies.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier go from the texts."""
    return repeats.remove(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the shards its copies go to."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("near-duplicates", drop_near_copies),
    ("repeated strings", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("source mix", mix_sources),
]

#: The classifier and the sketches cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
