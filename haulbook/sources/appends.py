"""A table that only grows: a folder per batch, merged as they pile up, with Bloom filters.

Every batch is a folder of its own, written once or written again as it was. When a table has
gathered `most` folders of one size class, they are merged into one; so a row is rewritten about
once each time the table has grown `most` times over, and the number of folders stays near
`most` times the logarithm of the number of batches. Merged folders stay until `retire`.

With an `id`, rows are spread over buckets by a hash of it, and every folder has a Bloom filter
per bucket, itself a table: words of 64 bits, `BITS` bits for an id of which `MARKS` are set.
`unseen` looks a batch's ids up in the filters by an equi-join, opens the buckets of those
folders alone that may hold one of them, and compares only the ids in doubt. What the filters
say is never the answer, so there are no false ones. A batch whose marks outnumber the stored rows
is compared with the stored ids at once: that moves fewer rows than asking the filters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulbook.schemas import empty
from haulbook.session import materialize
from haulbook.sources import manifests
from haulbook.sources.manifests import Folder

ROWS, FILTER = "rows", "filter"
#: Of ids that a folder does not hold, about 6 in a million look as if it did.
BITS, MARKS = 32, 8
WORD = 64
#: So few ids are always looked up in the filters: folders left shut are then worth more.
FEW = 100_000


@dataclass
class AppendTable:
    spark: SparkSession
    root: str
    schema: T.StructType
    id: str | None = None
    buckets: int = 16
    most: int = 8
    #: Folders of data that `unseen` opened last, and how many there were.
    opened: tuple[int, int] = field(default=(0, 0), init=False)
    _staged: list[Folder] = field(default_factory=list, init=False)

    def _path(self, folder: Folder) -> str:
        return f"{self.root.rstrip('/')}/{folder.path}"

    def read(self, below: int | None = None, version: int | None = None) -> DataFrame:
        folders = [f for f in manifests.live(self.spark, self.root, below, version) if f.kind == ROWS]
        if not folders:
            return empty(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._path, folders))

    def append(self, rows: DataFrame, version: int) -> None:
        """Adds a batch and merges what has piled up. The same version again replaces it."""
        self.stage(rows, version)
        self.commit(version)

    def stage(self, rows: DataFrame, version: int) -> DataFrame:
        """Writes a batch that no reader sees before `commit`, and gives what was written."""
        self._staged = self._store(rows, f"batch={version}", version)
        written = [f for f in self._staged if f.kind == ROWS]
        if not written:
            return empty(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._path, written))

    def commit(self, version: int) -> None:
        folders = manifests.live(self.spark, self.root, below=version) + self._staged
        manifests.commit(self.spark, self.root, version, self._tidied(folders, version))

    def retire(self, grace_seconds: float, now: float | None = None) -> list[str]:
        return manifests.retire(self.spark, self.root, grace_seconds, now)

    # --- ids ---------------------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(self.id, F.lit(""))), F.lit(self.buckets)).cast("int")

    def _marks(self, words: Column) -> Column:
        """The bits of an id in a filter of so many words, as (word, mask)."""
        # Small enough to be added up within a long.
        first, step = (F.pmod(F.xxhash64(self.id, F.lit(n)), F.lit(1 << 48)) for n in (1, 2))
        bits = [F.pmod(first + step * i, words * WORD) for i in range(MARKS)]
        return F.array(*[
            F.struct((b / WORD).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (b % WORD).cast("int")).alias("mask"))
            for b in bits
        ])

    def unseen(self, rows: DataFrame, below: int) -> DataFrame:
        """Rows whose id no earlier batch has; those without an id are all new. Ids must not
        repeat within `rows`, and `rows` is read several times: store it first."""
        folders = manifests.live(self.spark, self.root, below=below)
        data = [f for f in folders if f.kind == ROWS and f.rows]
        filters = [f for f in folders if f.kind == FILTER]
        self.opened = (0, len(data))
        if not filters:
            return rows
        asking = rows.where(F.col(self.id).isNotNull()).count()
        if asking > FEW and asking * MARKS > sum(f.rows for f in data):
            self.opened = (len(data), len(data))
            return rows.join(self._ids(data), self.id, "left_anti").select(*rows.columns)
        schema = "bucket int, words long, word long, bits long"
        held = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*map(self._path, filters))
        held = held.withColumn("folder", F.regexp_extract(F.input_file_name(), r"filter-([0-9-]+-[a-z]+)", 1))
        # The sizes that filters have; powers of two, so a few.
        sizes = [r[0] for r in held.select("words").distinct().collect()]
        asked = (
            rows.where(F.col(self.id).isNotNull())
            .select(self.id, self._bucket().alias("bucket"), F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])).alias("words"))
            .select(self.id, "bucket", "words", F.explode(self._marks(F.col("words"))).alias("m"))
            .select(self.id, "bucket", "words", "m.word", "m.mask")
        )
        in_doubt = materialize(
            asked.join(held, ["bucket", "words", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
            .groupBy(self.id, "bucket", "folder").agg(F.count("*").alias("marks")).where(F.col("marks") == MARKS)
            .select(self.id, "bucket", "folder"),
            "in-doubt",
        )
        # At most a row per live folder.
        doubtful = {tuple(r) for r in in_doubt.select("folder", "bucket").distinct().collect()}
        opened = [f for f in data if (self._name(f), f.bucket) in doubtful]
        self.opened = (len(opened), len(data))
        if not opened:
            return rows
        known = self._ids(opened).join(in_doubt.select(self.id).distinct(), self.id, "left_semi")
        return rows.join(known, self.id, "left_anti").select(*rows.columns)

    def _ids(self, folders: list[Folder]) -> DataFrame:
        stored = self.spark.read.schema(self.schema).parquet(*map(self._path, folders))
        return stored.select(self.id).where(F.col(self.id).isNotNull())

    # --- folders -----------------------------------------------------------------------
    @staticmethod
    def _name(folder: Folder) -> str:
        """What a folder's filter is called: its version, and whether it is a merged one."""
        return f"{folder.version}-{folder.path.partition('=')[0]}"

    def _store(self, rows: DataFrame, place: str, version: int) -> list[Folder]:
        target = f"{self.root.rstrip('/')}/{place}"
        rows = rows.select(*self.schema.names)
        if self.id is None:
            rows.write.mode("overwrite").parquet(target)
            n = self.spark.read.schema(self.schema).parquet(target).count()
            return [Folder(0, ROWS, place, version, n)]
        spread = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        (
            rows.withColumn("bucket", self._bucket()).repartition(spread, "bucket")
            .write.mode("overwrite").partitionBy("bucket").parquet(target)
        )
        stored = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        back = self.spark.read.schema(stored).parquet(target)
        counts = {r.bucket: r.n for r in back.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        folders = [Folder(b, ROWS, f"{place}/bucket={b}", version, n) for b, n in sorted(counts.items())]
        if not folders:
            return []
        words = 1 << max(0, math.ceil(math.log2(max(counts.values()) * BITS / WORD)))
        name = f"_filters/filter-{self._name(folders[0])}"
        sized = back.where(F.col(self.id).isNotNull()).select("bucket", self.id, F.lit(words).cast("long").alias("words"))
        (
            sized.select("bucket", "words", F.explode(self._marks(F.col("words"))).alias("m"))
            .groupBy("bucket", "words", F.col("m.word").alias("word")).agg(F.bit_or("m.mask").alias("bits"))
            .write.mode("overwrite").parquet(f"{self.root.rstrip('/')}/{name}")
        )
        return [*folders, Folder(-1, FILTER, name, version, sum(counts.values()))]

    def _tidied(self, folders: list[Folder], version: int) -> list[Folder]:
        """Merges the batches of a size class once there are `most` of them."""
        batches: dict[str, int] = {}
        for f in folders:
            if f.kind == ROWS:
                batches[self._name(f)] = batches.get(self._name(f), 0) + f.rows
        classes: dict[int, list[str]] = {}
        for name, n in batches.items():
            classes.setdefault(int(math.log(n + 1, self.most)), []).append(name)
        full = {name for names in classes.values() if len(names) >= self.most for name in names}
        if not full:
            return folders
        of = lambda f: self._name(f) if f.kind == ROWS else f.path.removeprefix("_filters/filter-")
        merged = [f for f in folders if f.kind == ROWS and self._name(f) in full]
        rows = self.spark.read.schema(self.schema).parquet(*map(self._path, merged))
        if self.id is None:
            rows = rows.hint("rebalance")
        return [f for f in folders if of(f) not in full] + self._store(rows, f"merged={version}", version)
