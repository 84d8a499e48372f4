"""The clean tables of one data folder, each a lazy DataFrame over the raw feeds."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulbook.functions import cleaning as c
from haulbook.operators import documents, merges, rows, safety, summaries
from haulbook.operators.kept import KeptDirectory
from haulbook.plans import fixtures
from haulbook.schemas import CARRIERS, SUBSCRIBERS, empty
from haulbook.session import fresh_dir
from haulbook.sources import feeds
from haulbook.sources.tables import publish

CENSUS_LOADED = "2024-03-01 00:00:00"
AS_OF = "2024-03-05"
ENRICHED = "2024-03-05 00:00:00"
MEASURED = "2024-02-01"
PRICE_PLANS = {"pri_g": "growth", "pri_s": "standard", "pri_p": "pro", "": "pro"}

_KEPT: dict[tuple[str, str], str] = {}
_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def in_parts(feed: DataFrame, key: Column, parts: int, keys: DataFrame | None = None) -> list[DataFrame]:
    """A feed cut into parts along a numeric key. The cuts are taken from `keys`, if given: the
    table that a joined feed has its key from, so that finding them does not run the joins."""
    keyed = feed.withColumn("_key", key.cast("double"))
    shares = [i / parts for i in range(1, parts)]
    looked_at = keyed if keys is None else keys.select(key.cast("double").alias("_key"))
    cuts = [float("-inf"), *looked_at.approxQuantile("_key", shares, 0.01), float("inf")]
    return [
        keyed.where((F.col("_key") > lo) & (F.col("_key") <= hi)).drop("_key") for lo, hi in zip(cuts, cuts[1:])
    ]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def feed(self, name: str) -> DataFrame:
        return fixtures.feed(self.spark, self.sf_dir, f"fx_{name}")

    @cached_property
    def census(self) -> DataFrame:
        return self.feed("census")

    @cached_property
    def first_load(self) -> DataFrame:
        """The directory after the first census load (active carriers)."""
        staged = rows.clean_census(feeds.active_only(self.census))
        return merges.census_upsert(empty(self.spark, CARRIERS), staged, CENSUS_LOADED)

    @cached_property
    def enrichment(self) -> DataFrame:
        return rows.normalize_enrichment(self.feed("enrichment"))

    @cached_property
    def basics(self) -> DataFrame:
        return rows.clean_basics(self.feed("basics"))

    @property
    def violation_keys(self) -> DataFrame:
        """The key that the violations feed is delivered by, without its joins."""
        return fixtures.base_table(self.spark, self.sf_dir, "lineitem").select(F.col("l_orderkey").alias("tie_1"))

    # The loads, from the raw feeds.
    @property
    def built_carriers(self) -> DataFrame:
        return merges.field_upsert(self.first_load, self.enrichment, ENRICHED)

    @property
    def built_scores(self) -> DataFrame:
        return merges.score_rows(self.basics, self.carriers, MEASURED)

    @property
    def built_inspections(self) -> DataFrame:
        return merges.known_only(rows.clean_inspections(self.feed("inspections")), self.carriers)

    @property
    def built_violations(self) -> DataFrame:
        return merges.known_only(rows.clean_violations(self.feed("violations")), self.carriers)

    # The stored tables that the directory queries read.
    @cached_property
    def carriers(self) -> DataFrame:
        return self._stored("carriers", lambda: self.built_carriers)

    @cached_property
    def scores(self) -> DataFrame:
        return self._stored("scores", lambda: self.built_scores)

    @cached_property
    def inspections(self) -> DataFrame:
        return self._stored("inspections", lambda: self.built_inspections, "usdot_number, inspection_date")

    @cached_property
    def violations(self) -> DataFrame:
        return self._stored("violations", lambda: self.built_violations, "usdot_number, violation_date")

    def _stored(
        self, name: str, build: Callable[[], DataFrame], cluster_by: str = "usdot_number"
    ) -> DataFrame:
        """A table as the loads leave it: published once per application and data folder,
        in ranges of carriers, and read by every query from then on."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            df = build()
            path = publish(df, fresh_dir(self.spark, name), 1, cluster_by)
            _STORED[key] = (path, df.schema)
        path, schema = _STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    def once(self, name: str) -> DataFrame:
        """A table for a query that reads few of its columns, and those once: as stored if it
        is, else straight from its load, so that the other columns are neither joined nor sorted."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        return getattr(self, name if key in _STORED else f"built_{name}")

    @cached_property
    def kept(self) -> KeptDirectory:
        """The same directory kept by changes: a first load, three upserts, and the child
        tables and scores in two deliveries each. Built once per application and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key in _KEPT:
            return KeptDirectory(self.spark, _KEPT[key])
        kept = KeptDirectory(self.spark, fresh_dir(self.spark, "kept"))
        kept.create(self.first_load, 0)
        for n, part in enumerate(in_parts(self.feed("enrichment"), F.col("src_seq"), 3), 1):
            kept.upsert(rows.normalize_enrichment(part), ENRICHED, n)
        for n, part in enumerate(in_parts(self.feed("inspections"), F.col("src_id"), 2), 4):
            known = merges.known_only(rows.clean_inspections(part), kept.carriers)
            kept.add_children("inspections", known, summaries.inspection_counts, n)
        for n, part in enumerate(in_parts(self.feed("violations"), F.col("tie_1"), 2, self.violation_keys), 6):
            known = merges.known_only(rows.clean_violations(part), kept.carriers)
            kept.add_children("violations", known, summaries.violation_counts, n)
        # Some carriers' scores first, then everyone's: the first ones are replaced.
        kept.replace_scores(self.basics.where(F.col("usdot_number") % 3 == 0), "2024-01-01", 8)
        kept.replace_scores(self.basics, MEASURED, 9)
        _KEPT[key] = kept.root
        return kept

    @cached_property
    def totals(self) -> DataFrame:
        return safety.carrier_totals(self.carriers, self.once("inspections"), self.once("violations"))

    @cached_property
    def document_base(self) -> DataFrame:
        counted = safety.with_totals(self.carriers, self.once("inspections"), self.once("violations"))
        return documents.document_base(counted)

    @cached_property
    def requests(self) -> DataFrame:
        return self.feed("requests")

    @cached_property
    def subscribers(self) -> DataFrame:
        return self._subscribers("subscribers")

    @cached_property
    def subscribers_later(self) -> DataFrame:
        return self._subscribers("subscribers_later")

    def _subscribers(self, feed: str) -> DataFrame:
        raw = self.feed(feed).withColumn("api_key_hash", c.api_key_hash("api_key"))
        return raw.select(
            *[
                (F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in SUBSCRIBERS.fields
            ]
        )

    @cached_property
    def ledger(self) -> DataFrame:
        from haulbook.operators.ledger import ledger_rows

        return ledger_rows(self.feed("ledger"))
