"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are put in an order drawn from their id and cut into blocks. What the
mix takes of a source is whole epochs of all its blocks and a first part of one more. The
units (epoch, block) of all sources are then dealt to output shards by a binary tree: at each
node a multivariate hypergeometric draw says how many units of each source go left, so every
shard gets an exact quota and the quotas of all shards add up to what the mix takes. Units
are in a drawn order themselves, so consecutive runs of quota length are disjoint samples.
What is taken of a document are its copies in the units that shards have drawn (`dealt`).
Within a shard the documents are sorted by another draw (`shard_rows`).

Only sums per source reach the driver. A document that straddles the end of the taken part
is taken if that brings the source nearer to its target, so the error is at most half a
document's size.

Defined cases: null text has size 0; null source is a source of its own, ordered last; rows
with the same id are separate documents, equal ones are interchangeable; a source of size 0
has target 0; an empty table gives an empty mix. Columns besides doc_id, text and source are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulbook.session import materialize

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Blocks of each source: values of the first hexadecimal digits of the drawn order.
BLOCK_DIGITS = 3
BLOCKS = 16**BLOCK_DIGITS
SHARDS = 64
#: Units among which the generator can draw exactly.
MOST_DRAWN = 10**9
SEED = 20_240_229


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, the drawn order and its block."""
    drawn = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 16)
    return docs.select(
        "doc_id", "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        drawn.alias("drawn"),
        F.conv(F.substring(drawn, 1, BLOCK_DIGITS), 16, 10).cast("int").alias("block"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source its size and target; the excess over `most` times a size is reshared.

    Sources fill up in order of size to weight. One that its share of what is left would
    overfill stops at its limit; the first that does not sets the rate for all others.
    """
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    total, limit = F.sum("source_size").over(every), F.col("source_size") * most
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("words_left", total - F.coalesce(F.sum(limit).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", limit * F.col("weight_left") <= F.col("words_left") * F.col("weight"))
        .withColumn("rate_words", F.min(F.when(~F.col("full"), F.struct(F.row_number().over(filling), "words_left", "weight_left"))).over(every))
        .select(
            "source", "source_size",
            F.when(F.col("full"), limit.cast("double"))
            .otherwise((F.col("weight") * F.col("rate_words.words_left")).cast("double") / F.col("rate_words.weight_left"))
            .alias("target"),
        )
    )


def splitting_tree(units: np.ndarray, shards: int, seed: int = SEED, most: int = MOST_DRAWN) -> np.ndarray:
    """Quotas (shard, source) whose columns add up to `units`, by recursive halving.

    The generator draws from fewer than `most` units. Above that, units are dealt in equal bundles
    by one tree and what is left of each source by another; the sums stay exact.
    """
    units = np.asarray(units, dtype=np.int64)
    bundle = int(units.sum()) // most + 1
    if bundle > 1:
        return bundle * splitting_tree(units // bundle, shards, seed, most) + splitting_tree(units % bundle, shards, seed + 1, most)
    quotas = np.zeros((shards, len(units)), dtype=np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    nodes = [(0, shards, units)]
    while nodes:
        low, high, held = nodes.pop()
        if high - low == 1:
            quotas[low] = held
            continue
        middle, total = (low + high) // 2, int(held.sum())
        exact = total * (middle - low) / (high - low)
        take = int(exact) + int(rng.random() < exact - int(exact))
        left = rng.multivariate_hypergeometric(held, take, method="marginals") if total else held * 0
        nodes += [(middle, high, held - left), (low, middle, left)]
    return quotas


def dealt(quotas: DataFrame) -> DataFrame:
    """The blocks that each shard draws: a row per source and block with its (epoch, shard) pairs.

    `quotas` has a row per source: units, stride, start and the quota of each shard. A shard draws
    the run of places that follows those of the shards before it; place p is unit
    (p * stride + start) mod units, and a unit is a block in an epoch.
    """
    draws = quotas.select(
        "source", "units", "stride", "start",
        F.posexplode("quotas").alias("shard", "quota"), F.col("quotas").alias("all"),
    ).where("quota > 0")
    before = F.aggregate(F.slice("all", 1, F.col("shard")), F.lit(0).cast("long"), lambda held, n: held + n)
    places = draws.withColumn("before", before).withColumn(
        "place", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("quota") - 1))
    )
    unit = (F.col("place") * F.col("stride") + F.col("start")) % F.col("units")
    return (
        places.select("source", "shard", unit.alias("unit"))
        .groupBy("source", (F.col("unit") % BLOCKS).cast("int").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(F.expr(f"cast(unit div {BLOCKS} as int)").alias("epoch"), "shard"))).alias("units"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the shard of each copy."""
    spark = docs.sparkSession
    sized = materialize(sizes(docs), "mix-sizes")
    goals = (
        targets(sized, weights, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
        .withColumn("before", F.coalesce(F.sum("block_size").over(upto), F.lit(0)))
    )
    joined = blocks.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        "b.source", "block", "before", "source_size", "target", "epochs", "rest"
    )
    joined = materialize(joined, "mix-blocks")
    by_source = joined.groupBy("source").agg(
        (F.first("epochs") * BLOCKS + F.coalesce(F.max(F.when(F.col("before") < F.col("rest"), F.col("block") + 1)), F.lit(0))).alias("units")
    ).orderBy(F.col("source").asc_nulls_last()).collect()  # a row per source
    quotas = splitting_tree(np.array([r.units for r in by_source], dtype=np.int64), shards, seed)
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    drawn = dealt(spark.createDataFrame(
        [(r.source, r.units, _stride(rng, r.units), int(rng.integers(1 << 30)), quotas[:, i].tolist()) for i, r in enumerate(by_source)],
        "source string, units long, stride long, start long, quotas array<long>",
    ))
    placed = joined.alias("j").join(
        drawn.alias("e"), F.col("j.source").eqNullSafe(F.col("e.source")) & (F.col("j.block") == F.col("e.block")), "left"
    ).select("j.source", "j.block", "before", "source_size", "target", "epochs", "rest", "units")
    within = Window.partitionBy("source", "block").orderBy("drawn", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sized.withColumn("within", F.sum("size").over(within))
    middle = F.col("before") + F.col("within") - F.col("size") / 2
    # Of a block drawn in the epoch that the target cuts, the documents before the cut are taken.
    taken = F.filter("units", lambda unit: (unit["epoch"] < F.col("epochs")) | (middle < F.col("rest")))
    return (
        ranked.alias("d")
        .join(placed.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block")))
        .withColumn("shards", F.coalesce(F.transform(taken, lambda unit: unit["shard"]), F.array().cast("array<int>")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")
    )


def _stride(rng: np.random.Generator, units: int) -> int:
    """A multiplier without a common factor with the number of units."""
    while True:
        stride = int(rng.integers(1, max(units, 2)))
        if np.gcd(stride, max(units, 1)) == 1:
            return stride


def shard_rows(docs: DataFrame, mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: a row per taken copy with its shard, shuffled within each shard.

    `doc_id` must be unique here. Write it with `partitionBy("shard")`.
    """
    copies = mixed.select("doc_id", F.posexplode("shards").alias("epoch", "shard"))
    return (
        copies.join(docs.select("doc_id", "text", "source"), "doc_id")
        .repartition("shard")
        .sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "doc_id", "epoch"))
    )
