"""A keyed table that is changed by batches without rewriting it.

Rows lie in buckets by a hash of their key. A bucket is one base folder and, on top of it, the
delta folders of the batches since, each with the whole new rows of the keys it changed. A batch
reads the buckets of its own keys, and of those only the rows it changes go on; it writes one
delta to each such bucket and a new list of live folders. A bucket that has gathered `most`
deltas is merged into a new base on the way. Batches and buckets without common keys never meet.

A read lays the newest delta rows beside the base rows that no delta replaces; with few deltas
Spark broadcasts their keys, and the base is scanned without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulbook.schemas import empty
from haulbook.session import materialize
from haulbook.sources import manifests
from haulbook.sources.manifests import Folder

BASE, DELTA = "base", "delta"


@dataclass
class Change:
    """The rows of the changed keys before and after a batch; new keys are only in `after`."""

    before: DataFrame
    after: DataFrame


@dataclass
class KeyedTable:
    """`key` is unique and not null. Choose `buckets` so that a bucket fits a file of some
    hundred megabytes; it stays the same for the table's life."""

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str
    buckets: int = 32
    most: int = 8

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame, version: int) -> None:
        """The table's first version: all rows, as the base."""
        manifests.commit(self.spark, self.root, version, self._store(rows, BASE, version))

    def read(self, below: int | None = None, version: int | None = None) -> DataFrame:
        """The newest version, or that below a number, or a given one still kept."""
        return self._merged(manifests.live(self.spark, self.root, below, version))

    def lookup(self, keys: Iterable[str]) -> DataFrame:
        """Rows of a few keys: their buckets alone are opened, the keys reach the file scan."""
        wanted = sorted(set(keys))
        asked = self.spark.createDataFrame([(k,) for k in wanted], f"{self.key} string").select(self.bucket()).distinct()
        touched = {r[0] for r in asked.collect()}
        folders = [f for f in manifests.live(self.spark, self.root) if f.bucket in touched]
        return self._merged(folders).where(F.col(self.key).isin(wanted))

    def apply(self, keys: DataFrame, fold: Callable[[DataFrame], DataFrame], version: int) -> Change | None:
        """Changes the rows of `keys` (one column): `fold` gets their present rows and gives the
        new ones, new keys included. Builds on the version below, so a batch that is run again
        does the same again. Nothing is written when there are no keys.
        """
        keys = keys.where(F.col(self.key).isNotNull())
        # At most as many numbers as there are buckets.
        touched = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        if not touched:
            return None
        folders = manifests.live(self.spark, self.root, below=version)
        present = self._merged([f for f in folders if f.bucket in touched])
        before = materialize(present.join(keys, self.key, "left_semi").select(*self.schema.names), "before")
        written = self._store(fold(before), DELTA, version)
        after = self._scan(written).drop("_version")
        folders += written
        full = {b for b in touched if sum(f.bucket == b and f.kind == DELTA for f in folders) >= self.most}
        if full:
            merged = self._store(self._merged([f for f in folders if f.bucket in full]), BASE, version)
            folders = [f for f in folders if f.bucket not in full] + merged
        manifests.commit(self.spark, self.root, version, folders)
        return Change(before, after)

    def retire(self, grace_seconds: float, now: float | None = None) -> list[str]:
        return manifests.retire(self.spark, self.root, grace_seconds, now)

    def _store(self, rows: DataFrame, kind: str, version: int) -> list[Folder]:
        """Writes rows as one folder per bucket they fall into, sorted by key."""
        spread = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        place = f"{kind}-v{version}"
        (
            rows.select(*self.schema.names, F.lit(version).cast("bigint").alias("_version"), self.bucket().alias("bucket"))
            .repartition(spread, "bucket").sortWithinPartitions("bucket", self.key)
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root.rstrip('/')}/{place}")
        )
        stored = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        back = self.spark.read.schema(stored).parquet(f"{self.root.rstrip('/')}/{place}")
        counts = back.groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row per bucket
        return [Folder(r.bucket, kind, f"{place}/bucket={r.bucket}", version, r.n) for r in counts]

    def _scan(self, folders: list[Folder]) -> DataFrame:
        """The rows of some folders, as a scan of each write they belong to, of which Spark
        prunes the other buckets."""
        stored = T.StructType([*self.schema.fields, T.StructField("_version", T.LongType())])
        parts = T.StructType([*stored.fields, T.StructField("bucket", T.IntegerType())])
        buckets: dict[str, set[int]] = {}
        for f in folders:
            buckets.setdefault(f.path.rpartition("/")[0], set()).add(f.bucket)
        scans = [
            self.spark.read.schema(parts).parquet(f"{self.root.rstrip('/')}/{place}")
            .where(F.col("bucket").isin(sorted(own))).drop("bucket")
            for place, own in sorted(buckets.items())
        ]
        return reduce(DataFrame.unionByName, scans) if scans else empty(self.spark, stored)

    def _merged(self, folders: list[Folder]) -> DataFrame:
        changed = {f.bucket for f in folders if f.kind == DELTA}
        quiet = self._scan([f for f in folders if f.bucket not in changed])
        if not changed:
            return quiet.drop("_version")
        bases = self._scan([f for f in folders if f.kind == BASE and f.bucket in changed])
        deltas = self._scan([f for f in folders if f.kind == DELTA])
        newest = (
            deltas.withColumn("_nth", F.row_number().over(W.partitionBy(self.key).orderBy(F.desc("_version"))))
            .where("_nth = 1").drop("_nth")
        )
        kept = bases.join(deltas.select(self.key), self.key, "left_anti").select(*newest.columns)
        return quiet.unionByName(kept).unionByName(newest).drop("_version")
