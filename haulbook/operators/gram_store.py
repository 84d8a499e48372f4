"""The gram index of names as a stored table that follows the directory.

Postings (gram, usdot_number) lie sorted by gram, so that a search's grams, which are pushed into
the file scan, skip every row group but their own. A change of the directory adds a delta: the
postings that the changed carriers gained and those they lost, newest last. Deltas are merged with
each other, and with the postings themselves once they have a quarter as many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulbook.operators.directory import search
from haulbook.operators.search import GRAM, batch_search, gram_index
from haulbook.sources import manifests
from haulbook.sources.deltas import BASE, DELTA, Change
from haulbook.sources.manifests import Folder

POSTINGS = "gram string, usdot_number string, held boolean, _version long"


def term_grams(q: str) -> list[str] | None:
    """The grams of a term that the index can serve; None for digits, wildcards, short terms."""
    term = q.strip()
    low = term.lower()
    if term.isdigit() or len(low) < GRAM or any(ch in term for ch in "%_\\"):
        return None
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


@dataclass
class GramStore:
    spark: SparkSession
    root: str
    #: Deltas that are kept beside each other.
    most: int = 8

    def build(self, carriers: DataFrame, version: int) -> None:
        rows = gram_index(carriers).withColumn("held", F.lit(True))
        manifests.commit(self.spark, self.root, version, [self._store(rows, BASE, version)])

    def update(self, change: Change, version: int) -> None:
        """Follows a change of the directory; the same version again does the same again."""
        named = ("usdot_number", "legal_name", "dba_name")
        signed = change.after.select(*named, F.lit(1).alias("n")).unionByName(change.before.select(*named, F.lit(-1).alias("n")))
        # Most changed carriers keep their names: those cancel out before they become postings.
        renamed = signed.groupBy(*named).agg(F.sum("n").alias("n")).where("n <> 0")
        moved = gram_index(renamed, "n").groupBy("gram", "usdot_number").agg(F.sum("n").alias("n")).where("n <> 0")
        folders = manifests.live(self.spark, self.root, below=version)
        folders.append(self._store(moved.withColumn("held", F.col("n") > 0), DELTA, version))
        deltas, bases = ([f for f in folders if f.kind == kind] for kind in (DELTA, BASE))
        if 4 * sum(f.rows for f in deltas) > sum(f.rows for f in bases):
            folders = [self._store(self._net(folders), "merged", version)._replace(kind=BASE)]
        elif len(deltas) > self.most:
            # Lost postings have to stay until they meet those they take back.
            folders = bases + [self._store(self._newest(deltas), "deltas", version)._replace(kind=DELTA)]
        manifests.commit(self.spark, self.root, version, folders)

    def postings(self, grams: list[str] | None = None, below: int | None = None) -> DataFrame:
        """(gram, usdot_number), of the given grams or all."""
        return self._net(manifests.live(self.spark, self.root, below), grams).select("gram", "usdot_number")

    def search(self, carriers: DataFrame, q: str) -> DataFrame:
        """One term: the same hits as a scan of all names."""
        wanted = term_grams(q)
        if wanted is None:
            return search(carriers, q)
        holders = (
            self.postings(wanted).groupBy("usdot_number").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
        )
        return search(carriers.join(holders.select("usdot_number"), "usdot_number", "left_semi"), q)

    def batch_search(self, carriers: DataFrame, terms: DataFrame) -> DataFrame:
        """Many terms: (term_id, term, usdot_number), by the stored postings."""
        return batch_search(carriers, terms, self.postings())

    def retire(self, grace_seconds: float, now: float | None = None) -> list[str]:
        return manifests.retire(self.spark, self.root, grace_seconds, now)

    def _store(self, rows: DataFrame, kind: str, version: int) -> Folder:
        """Sorted by gram. The rebalancing splits a gram that outgrows a file."""
        place = f"{kind}-v{version}"
        target = f"{self.root.rstrip('/')}/{place}"
        (
            rows.select("gram", "usdot_number", "held", F.lit(version).cast("bigint").alias("_version"))
            .hint("rebalance", "gram").sortWithinPartitions("gram", "usdot_number")
            .write.mode("overwrite").parquet(target)
        )
        return Folder(0, kind, place, version, self.spark.read.schema(POSTINGS).parquet(target).count())

    def _scan(self, folders: list[Folder], grams: list[str] | None) -> DataFrame:
        rows = self.spark.read.schema(POSTINGS).parquet(*[f"{self.root.rstrip('/')}/{f.path}" for f in folders])
        return rows if grams is None else rows.where(F.col("gram").isin(grams))

    def _newest(self, folders: list[Folder], grams: list[str] | None = None) -> DataFrame:
        """The last word on every posting; a merged delta's words are as new as itself."""
        last = F.max_by("held", "_version").alias("held")
        return self._scan(folders, grams).groupBy("gram", "usdot_number").agg(last)

    def _net(self, folders: list[Folder], grams: list[str] | None = None) -> DataFrame:
        if all(f.kind == BASE for f in folders):
            return self._scan(folders, grams)
        return self._newest(folders, grams).where("held")
