"""Hard-negative mining by Strassen products of anchor and candidate tiles.

Vectors are rounded to integers, and a candidate's score is its integer inner product with the
anchor. `strassen` multiplies tiles of anchors with tiles of candidates: blocks are halved in all
three directions (odd sides padded with zeros) and multiplied with seven products in place of
eight, all in int64, down to small blocks.

Anchors are a stated query set, and each of them meets all rows, so the work grows with both. It is
dealt as a grid: groups of `ANCHORS` anchors against slices of the candidates. Rows go to a
slice once for every group of anchors, so a shuffled row is multiplied with thousands of
anchors. In a task the group's anchors come first; candidates pass by in tiles and leave heaps,
sorted lists of a fixed size (`Heaps`). Heaps are mergeable: those of the slices meet per anchor
in a ranking that Spark cuts in the map tasks first. One pass finds the positives; with their
scores known, a second one finds the negatives of each positive's window.

Defined cases. Rows with a null label, a null vector, or a null or non-finite component take no
part. A null vec_id is no anchor and loses every tie. Repeated rows are rows of their own: a
copy of an anchor is an anchor, and each is a positive of the other. Vectors of unequal length are
compared as if the shorter one ended in zeros. Sums are those of 64-bit integers, modulo 2^64.
An anchor without positives, or a positive with an empty window (always so for a negative
score), gives no rows; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map
from haulbook.session import materialize

POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors of a group, which a task holds; most candidates of a slice, which pass it in tiles.
ANCHORS, SLICE, TILE = 2048, 1 << 18, 2048
#: Sides below which blocks are multiplied directly.
LEAF = 32


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    a = np.pad(a, ((0, n % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, m % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((2 * i, 2 * l), dtype=np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:i, :l] = p
    out[i:, l:] = p
    p = strassen(a21 + a22, b11, leaf)
    out[i:, :l] = p
    out[i:, l:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:i, l:] = p
    out[i:, l:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:i, :l] += p
    out[i:, :l] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:i, :l] -= p
    out[:i, l:] += p
    out[i:, l:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:i, :l] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:n, :m]


class Heaps:
    """For each of `n` owners the best `size` entries (score, id): higher scores first, ties by
    smaller id, unknown ids last."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.owner = self.score = self.id = np.empty(0, dtype=np.int64)
        self.unknown = np.empty(0, dtype=bool)
        #: The worst score that an owner's full heap still holds.
        self.least = np.full(n, np.iinfo(np.int64).min)

    def merge(self, owner: np.ndarray, score: np.ndarray, id: np.ndarray, unknown: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score = np.concatenate([self.owner, owner]), np.concatenate([self.score, score])
        id, unknown = np.concatenate([self.id, id]), np.concatenate([self.unknown, unknown])
        order = np.lexsort((id, unknown, ~score, owner))
        owner, score, id, unknown = owner[order], score[order], id[order], unknown[order]
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        nth = np.arange(len(owner)) - np.repeat(begins, np.diff(np.r_[begins, len(owner)]))
        full = nth == self.size - 1
        self.least[owner[full]] = score[full]
        kept = nth < self.size
        self.owner, self.score, self.id, self.unknown = owner[kept], score[kept], id[kept], unknown[kept]


def prepare(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows that take part: vec_id, label long, vec of long, a number `row` for each and whether
    it is an anchor (vec_id divisible by 100); labels shifted where vec_id is divisible by 7.
    Store the result: the numbers belong to the tasks that gave them."""
    vec = F.col(f"`{vector}`")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return vectors.where(F.col("label").isNotNull() & vec.isNotNull() & sound).select(
        "vec_id", shifted.alias("label"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * scale)).alias("vec"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor"),
    )


def _part(n: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")


def _grid(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Groups of anchors against slices of rows: the group's anchors, then the slice's rows.

    At least as many slices as shuffle partitions, so that all cores multiply."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, math.ceil(anchors.count() / ANCHORS))
    slices = max(tasks, math.ceil(rows.count() / SLICE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(_part(groups).alias("group"), "row", "vec_id", "label", "vec", "windows").withColumn("slice", every(slices))
    right = (
        rows.withColumn("windows", F.lit(None).cast(anchors.schema["windows"].dataType))
        .withColumn("slice", F.pmod(F.xxhash64("row", F.lit("slice")), F.lit(slices)).cast("int"))
        .withColumn("group", every(groups))
    )
    columns = ("group", "slice", "row", "vec_id", "label", "vec", "windows")
    both = left.select(*columns, F.lit(0).alias("kind")).union(right.select(*columns, F.lit(1).alias("kind")))
    # A cell of the grid to a partition, as far as partitions go; cells are even by design.
    return both.repartition(max(tasks, min(groups * slices, 10_000)), "group", "slice").sortWithinPartitions("group", "slice", "kind")


class Tile:
    """Rows of one kind as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.row = batch.column("row").to_numpy()
        self.unknown = batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        self.id = batch.column("vec_id").fill_null(0).to_numpy().astype(np.int64)
        self.label = batch.column("label").to_numpy()
        self.windows = batch.column("windows")
        vec = batch.column("vec")
        sizes = vec.value_lengths().to_numpy().astype(np.int64)
        self.vec = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
        self.vec[np.arange(self.vec.shape[1]) < sizes[:, None]] = vec.flatten().to_numpy()


def products(anchors: Tile, rows: Tile) -> np.ndarray:
    n = min(anchors.vec.shape[1], rows.vec.shape[1])  # what is beyond meets zeros
    return strassen(anchors.vec[:, :n], np.ascontiguousarray(rows.vec[:, :n].T))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tile, Iterator[Tile]]]:
    """The anchors of each cell, and its rows in tiles; read the tiles before the next cell."""
    held: list[pa.RecordBatch] = []

    def runs():
        for batch in batches:
            marks = np.stack([batch.column(n).to_numpy() for n in ("group", "slice", "kind")], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(marks)], strict=True):
                for at in range(start, end, TILE):
                    yield tuple(marks[start]), batch.slice(at, min(TILE, end - at))

    coming = runs()
    following = next(coming, None)
    while following:
        cell, held = following[0][:2], []
        while following and following[0] == (*cell, 0):
            held.append(following[1])
            following = next(coming, None)

        def tiles():
            nonlocal following
            while following and following[0] == (*cell, 1):
                yield Tile(following[1])
                following = next(coming, None)

        if held:
            yield Tile(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), tiles()
        for _ in tiles():  # rows that no anchor asks for
            pass


def _find_positives(size: int):
    def work(batches):
        for anchors, tiles in _cells(batches):
            heaps = Heaps(len(anchors.row), size)
            for tile in tiles:
                scores = products(anchors, tile)
                found = (scores >= heaps.least[:, None]) & (anchors.label[:, None] == tile.label) & (anchors.row[:, None] != tile.row)
                owner, at = np.nonzero(found)
                heaps.merge(owner, scores[owner, at], tile.id[at], tile.unknown[at])
            yield {
                "row": anchors.row[heaps.owner], "anchor_id": anchors.id[heaps.owner],
                "id": pa.array(heaps.id, mask=heaps.unknown), "score": heaps.score,
            }

    return work


def _find_negatives(size: int, low: int, high: int):
    def work(batches):
        for anchors, tiles in _cells(batches):
            lengths = anchors.windows.value_lengths().to_numpy().astype(np.int64)
            windows = anchors.windows.flatten()
            score = windows.field("score").to_numpy()
            # Of each window: its anchor and its bounds, rounded inwards without leaving 64 bits.
            owner = np.repeat(np.arange(len(lengths)), lengths)
            floor = -(-score // 100 * low + -score % 100 * low // 100)
            ceiling = score // 100 * high + score % 100 * high // 100
            heaps = Heaps(len(owner), size)
            for tile in tiles:
                scores = products(anchors, tile)
                least = np.maximum(floor, heaps.least)
                # What may enter a window of its anchor at all.
                bottom, top = np.full(len(lengths), np.iinfo(np.int64).max), np.full(len(lengths), np.iinfo(np.int64).min)
                np.minimum.at(bottom, owner, least)
                np.maximum.at(top, owner, ceiling)
                anchor, at = np.nonzero((scores >= bottom[:, None]) & (scores <= top[:, None]) & (anchors.label[:, None] != tile.label))
                value = scores[anchor, at]
                first = np.cumsum(lengths) - lengths
                for nth in range(int(lengths.max(initial=0))):
                    window = np.where(nth < lengths[anchor], first[anchor] + nth, -1)
                    fits = (window >= 0) & (value >= least[window]) & (value <= ceiling[window]) if len(owner) else window >= 0
                    heaps.merge(window[fits], value[fits], tile.id[at[fits]], tile.unknown[at[fits]])
            of = heaps.owner
            yield {
                "row": anchors.row[owner[of]], "anchor_id": anchors.id[owner[of]],
                "nth": windows.field("nth").take(pa.array(of)), "positive_id": windows.field("id").take(pa.array(of)),
                "positive_score": score[of], "id": pa.array(heaps.id, mask=heaps.unknown), "score": heaps.score,
            }

    return work


def _best(df: DataFrame, size: int, rank: str, *keys: str) -> DataFrame:
    """The heaps of all slices, merged."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= size)


def positives(prepared: DataFrame, size: int = POSITIVES) -> DataFrame:
    """row, anchor_id, nth (from 1), id, score of each anchor's first `size` other rows of its
    label. `prepared` is a stored table."""
    anchors = prepared.where("anchor").withColumn("windows", F.lit(None).cast("array<struct<nth:int,id:long,score:long>>"))
    rows = prepared.drop("anchor")
    found = arrow_map(_grid(anchors, rows), _find_positives(size), "row long, anchor_id long, id long, score long")
    return _best(found, size, "nth", "row")


def mine(
    prepared: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """For each anchor and positive the first negatives within low and high hundredths of the
    positive's score: row, anchor_id, positive_id, rank, negative_id and both scores."""
    windows = positives(prepared, n_positives).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("windows")
    )
    anchors = materialize(prepared.where("anchor").drop("anchor").join(windows, "row"), "anchors")
    schema = "row long, anchor_id long, nth int, positive_id long, positive_score long, id long, score long"
    found = arrow_map(_grid(anchors, prepared.drop("anchor")), _find_negatives(n_negatives, low, high), schema)
    return _best(found, n_negatives, "rank", "row", "nth").select(
        "row", "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def digests(vectors: DataFrame) -> DataFrame:
    return mine(materialize(prepare(vectors), "vectors")).drop("row")
