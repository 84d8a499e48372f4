"""A directory that is kept by changes: the carriers, their gram index and the statistics.

Every load is a numbered version. It changes the carriers in their buckets, and what changed goes
on to the index and the summary, so neither the directory nor its names are read again. Each part
builds on its version below, so a load that failed half-way and is run again under its number
leaves all three as if it had run once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from haulbook.operators import merges, summaries
from haulbook.operators.gram_store import GramStore
from haulbook.schemas import CARRIERS, SCORES
from haulbook.session import materialize, scratch
from haulbook.sources.appends import AppendTable
from haulbook.sources.deltas import Change, KeyedTable
from haulbook.sources.tables import publish, read_table


@dataclass
class KeptDirectory:
    spark: SparkSession
    root: str
    buckets: int = 32

    @property
    def table(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/carriers", CARRIERS, merges.KEY, self.buckets)

    @property
    def grams(self) -> GramStore:
        return GramStore(self.spark, f"{self.root}/grams")

    @property
    def carriers(self) -> DataFrame:
        return self.table.read()

    @property
    def summary(self) -> DataFrame:
        return read_table(self.spark, f"{self.root}/summary")

    def create(self, carriers: DataFrame, version: int) -> None:
        with scratch(self.spark):
            self.table.create(carriers, version)
            stored = self.table.read(version=version)
            self.grams.build(stored, version)
            self._count(version, summaries.carrier_counts(stored))

    def upsert(self, batch: DataFrame, as_of: str | Column, version: int) -> None:
        """Normalised records, field by field."""
        self._change(batch, lambda known, rows: merges.field_upsert(known, rows, as_of), version)

    def load_census(self, staged: DataFrame, as_of: str | Column, version: int) -> None:
        self._change(staged, lambda known, rows: merges.census_upsert(known, rows, as_of), version)

    def add_children(self, name: str, rows: DataFrame, counts, version: int) -> None:
        """Inspections or violations of known carriers, appended and counted."""
        table = AppendTable(self.spark, f"{self.root}/{name}", rows.schema)
        stored = table.stage(rows, version)
        table.commit(version)
        with scratch(self.spark):
            self._count(version, counts(stored))

    def replace_scores(self, basics: DataFrame, measured: str | Column, version: int) -> None:
        """Carriers in the load get their new scores; a version holds all scores."""
        root = f"{self.root}/scores"
        known = read_table(self.spark, root, SCORES, below=version)
        with scratch(self.spark):
            loaded = materialize(merges.score_rows(basics, self.carriers, measured), "scores")
            touched = basics.select(merges.KEY).distinct()
            change = Change(known.join(touched, merges.KEY, "left_semi"), loaded)
            others = known.join(touched, merges.KEY, "left_anti").select(*SCORES.names)
            publish(others.unionByName(loaded), root, version, merges.KEY)
            self._count(version, summaries.moved(change, summaries.score_counts))

    def _change(self, batch: DataFrame, fold, version: int) -> None:
        with scratch(self.spark):
            rows = materialize(batch, "batch")
            change = self.table.apply(rows.select(merges.KEY).distinct(), lambda known: fold(known, rows), version)
            if change is not None:
                self.grams.update(change, version)
                self._count(version, summaries.moved(change, summaries.carrier_counts))

    def _count(self, version: int, *moves: DataFrame) -> None:
        summaries.keep(self.spark, f"{self.root}/summary", version, *moves)

