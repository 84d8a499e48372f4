"""Scans of landed feed files. Columns and filters reach the file reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulbook.functions.cleaning import dot_order
from haulbook.schemas import FEEDS, LOOKBACK_DAYS, PAGE_SIZE

SOURCE_ID = ":id"


def feed_schema(feed: str, extra: tuple[str, ...] = ()) -> T.StructType:
    """All text: a feed's fields, plus columns that are filtered on but not kept."""
    return T.StructType([T.StructField(n, T.StringType()) for n in FEEDS[feed] + extra])


def read_feed(
    spark: SparkSession, feed: str, path: str, fmt: str = "json", extra: tuple[str, ...] = ()
) -> DataFrame:
    """A feed landed as JSON pages (arrays of flat records) or as Parquet.

    The narrow schema is the column pruning of the JSON case; a field absent from a
    record is null.
    """
    reader = spark.read.schema(feed_schema(feed, extra))
    if fmt == "json":
        # A page is one JSON array, so a file is one split: land many pages, not one.
        reader = reader.option("multiLine", True)
    return select_feed(reader.format(fmt).load(path), feed, extra)


def select_feed(raw: DataFrame, feed: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The feed's own columns, missing ones as null, the source row id as `src_id`."""
    cols = []
    for name in FEEDS[feed] + extra:
        source = "src_id" if name == SOURCE_ID and SOURCE_ID not in raw.columns else name
        target = "src_id" if name == SOURCE_ID else name
        value = F.col(f"`{source}`") if source in raw.columns else F.lit(None)
        cols.append(value.cast("string").alias(target))
    return raw.select(*cols)


def active_only(census: DataFrame, include_inactive: bool = False) -> DataFrame:
    return census if include_inactive else census.where(F.col("status_code") == "A")


def resume_census(census: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows beyond the highest USDOT number staged so far, compared as numbers."""
    reached = staged.agg(F.max(F.col("usdot_number").try_cast("bigint"))).scalar()
    return census.where(
        F.col("dot_number").try_cast("bigint") > F.coalesce(reached, F.lit(0).cast("bigint"))
    )


def resume_by_id(feed: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows beyond the highest source row id staged so far, compared as text."""
    reached = staged.agg(F.max("src_id")).scalar()
    return feed.where(F.col("src_id") > F.coalesce(reached, F.lit("")))


def first_pages(
    feed: DataFrame, pages: int, order: str = "src_id", page_size: int = PAGE_SIZE
) -> DataFrame:
    """A trial run: the first `pages` pages in key order, all of it when 0."""
    if not pages:
        return feed
    key = [dot_order(order), F.col(order)] if order in ("dot_number", "usdot_number") else [F.col(order)]
    return feed.orderBy(*key).limit(pages * page_size)


def new_registrations_since(census: DataFrame, as_of: str, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Active registrations added within the look-back window."""
    since = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyyMMdd")
    return census.where((F.col("add_date") >= since) & (F.col("status_code") == "A"))
