"""Merges of clean feeds into the carrier tables, as joins on `usdot_number`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulbook.functions import cleaning as c
from haulbook.functions.slugs import carrier_slug
from haulbook.operators.rows import UPSERT_FIELDS, scored_only, unpivot_measures
from haulbook.schemas import CARRIERS, SCORES

KEY = "usdot_number"

# Columns a census load may fill; the others belong to the richer sources.
CENSUS_FIELDS = (
    "legal_name", "address", "city", "state", "zip", "phone", "operation_type",
    "carrier_classification", "total_vehicles",
)


def newest_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key, the one with the highest `seq`.

    The rank filter lets Spark drop the losers inside each map task, before the shuffle.
    """
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq))))
    return ranked.where("_rn = 1").drop("_rn")


def _as_of(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def census_upsert(carriers: DataFrame, staged: DataFrame, as_of: str | Column) -> DataFrame:
    """Merge a census load: insert the new, and fill fields without ever erasing any.

    The slug stays as first built, `is_active` always follows the load, and a carrier
    that is absent from the load stays exactly as it is.
    """
    now = _as_of(as_of)
    old, new = carriers.alias("o"), newest_per_key(staged, KEY, "src_seq").alias("n")
    is_new, loaded = F.col(f"o.{KEY}").isNull(), F.col(f"n.{KEY}").isNotNull()
    out = {KEY: F.coalesce(f"n.{KEY}", f"o.{KEY}")}
    for f in CARRIERS.names[1:]:
        out[f] = F.coalesce(f"n.{f}", f"o.{f}") if f in CENSUS_FIELDS else F.col(f"o.{f}")
    out["slug"] = F.when(is_new, F.col("n.slug")).otherwise(F.col("o.slug"))
    out["is_active"] = F.when(loaded, F.col("n.is_active")).otherwise(F.col("o.is_active"))
    out["created_at"] = F.when(is_new, now).otherwise(F.col("o.created_at"))
    out["updated_at"] = F.when(loaded, now).otherwise(F.col("o.updated_at"))
    joined = old.join(new, F.col(f"o.{KEY}") == F.col(f"n.{KEY}"), "full_outer")
    return joined.select(*[out[f].alias(f) for f in CARRIERS.names])


def fold_batch(batch: DataFrame, seq: str = "src_seq") -> DataFrame:
    """Records of one carrier in one batch, in input order: the last value of a field wins."""
    return batch.groupBy(KEY).agg(
        *[
            F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f)
            for f in UPSERT_FIELDS
            if f in batch.columns
        ]
    )


def field_upsert(carriers: DataFrame, batch: DataFrame, as_of: str | Column) -> DataFrame:
    """Merge normalised records (incremental or enrichment), field by field.

    A new carrier starts active and gets a slug; a known one keeps both. The slug is that of
    the carrier's first record, as if records came one by one, so it does not depend on how
    they are cut into batches.
    """
    now = _as_of(as_of)
    name = F.col("legal_name") if "legal_name" in batch.columns else F.lit(None).cast("string")
    first = batch.groupBy(KEY).agg(F.min_by(name, "src_seq").alias("_first_name"))
    folded = fold_batch(batch).join(first, KEY)
    old, new = carriers.alias("o"), folded.alias("n")
    is_new, touched = F.col(f"o.{KEY}").isNull(), F.col(f"n.{KEY}").isNotNull()
    out = {KEY: F.coalesce(f"n.{KEY}", f"o.{KEY}")}
    for f in CARRIERS.names[1:]:
        merged = f in UPSERT_FIELDS and f in folded.columns
        out[f] = F.coalesce(f"n.{f}", f"o.{f}") if merged else F.col(f"o.{f}")
    built = carrier_slug(F.coalesce("n._first_name", "o.legal_name"), out[KEY])
    out["slug"] = F.when(touched, F.coalesce(F.col("o.slug"), built)).otherwise(F.col("o.slug"))
    out["is_active"] = F.when(is_new, F.lit(True)).otherwise(F.col("o.is_active"))
    out["created_at"] = F.when(is_new, now).otherwise(F.col("o.created_at"))
    for stamp in ("updated_at", "last_scraped_at"):
        out[stamp] = F.when(touched, now).otherwise(F.col(f"o.{stamp}"))
    joined = old.join(new, F.col(f"o.{KEY}") == F.col(f"n.{KEY}"), "full_outer")
    return joined.select(*[out[f].alias(f) for f in CARRIERS.names])


def known_only(children: DataFrame, carriers: DataFrame) -> DataFrame:
    """Rows whose carrier is in the directory; orphans drop. Child columns only."""
    return children.join(carriers.select(KEY), KEY, "left_semi")


def score_rows(basics: DataFrame, carriers: DataFrame, measured: str | Column) -> DataFrame:
    """Clean basics of known carriers to score rows."""
    day = F.lit(measured).cast("date") if isinstance(measured, str) else measured
    rows = scored_only(unpivot_measures(known_only(basics, carriers)))
    score = c.measure_2dp("measure")
    return rows.where(score.isNotNull()).select(
        KEY,
        "basic_category",
        score.alias("score"),
        F.lit(None).cast("int").alias("percentile"),
        c.alert_label("acute").alias("alert_status"),
        day.alias("measured_date"),
    )


def score_rejects(basics: DataFrame) -> DataFrame:
    """Measures that are numbers but do not fit decimal(8,2)."""
    rows = scored_only(unpivot_measures(basics))
    return rows.where(c.measure_2dp("measure").isNull()).select(
        KEY, "basic_category", F.col("measure").cast("string").alias("measure"),
        F.lit("measure out of range").alias("reason"),
    )


def replace_scores(
    scores: DataFrame, basics: DataFrame, carriers: DataFrame, measured: str | Column
) -> DataFrame:
    """Carriers in the load get their new scores (or none); the others keep theirs."""
    kept = scores.join(basics.select(KEY), KEY, "left_anti").select(*SCORES.names)
    return kept.unionByName(score_rows(basics, carriers, measured))


def batch_keys(rows: DataFrame, key: str = KEY) -> DataFrame:
    return rows.select(key).distinct()


def resolve_batch(rows: DataFrame, carriers: DataFrame) -> DataFrame:
    """A page of child rows against the directory: one semi join, the page read once.

    Spark broadcasts the directory's keys where they are few; the page's own distinct keys
    need not be found first.
    """
    return known_only(rows, carriers)
