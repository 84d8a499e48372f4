"""Feeds as they are delivered: pages, each a JSON array of flat records, and loads that resume.

Pages are lines of text (or whole files), taken apart inside the tasks that read them, so one
file of many pages is read by many tasks. A page that is not JSON stops the load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulbook.schemas import PAGE_SIZE
from haulbook.sources import manifests
from haulbook.sources.appends import AppendTable
from haulbook.sources.feeds import SOURCE_ID, feed_schema, first_pages, select_feed
from haulbook.sources.tables import publish

MARK = "reached string"


def write_pages(records: DataFrame, path: str, page: Column) -> None:
    """Lands records as pages, a line for each value of `page`; null fields are left out, as the
    source does. Choose `page` so that a page is bounded, as the source's pages are."""
    record = F.struct(*[F.col(f"`{c}`").alias(SOURCE_ID if c == "src_id" else c) for c in records.columns])
    pages = records.groupBy(page.alias("page")).agg(F.to_json(F.collect_list(record)).alias("value"))
    pages.select("value").write.mode("append").text(path)


def read_pages(
    spark: SparkSession, feed: str, path: str, extra: tuple[str, ...] = (), whole_files: bool = False
) -> DataFrame:
    """The records of all pages: the feed's own columns as text, a field a record lacks as null.

    The narrow schema is the column pruning: other fields are skipped by the parser.
    """
    pages = spark.read.text(path, wholetext=whole_files)
    records = F.from_json("value", T.ArrayType(feed_schema(feed, extra)), {"mode": "FAILFAST"})
    return select_feed(pages.select(F.inline(records)), feed, extra)


def reached(table: AppendTable) -> str:
    """The highest source id that the table's newest version holds; empty before the first."""
    known = manifests.versions(table.spark, table.root)
    if not known:
        return ""
    path = f"{table.root.rstrip('/')}/_marks/v{max(known)}"
    return table.spark.read.schema(MARK).parquet(path).first().reached


def load_next(
    feed: DataFrame, table: AppendTable, pages: int = 0, page_size: int = PAGE_SIZE
) -> int:
    """Loads what lies beyond the mark, in the order of the source ids (as text): some pages of
    it, or all when `pages` is 0. Gives the version written.

    The mark is written with the load and counts only once the load does, so a load that was
    stopped half-way leaves neither rows nor a mark, and the next one begins where the last
    complete one ended.
    """
    spark = table.spark
    begin = reached(table)
    version = max(manifests.versions(spark, table.root), default=-1) + 1
    part = first_pages(feed.where(F.col("src_id") > begin), pages, "src_id", page_size)
    stored = table.stage(part, version)
    mark = stored.agg(F.coalesce(F.max("src_id"), F.lit(begin)).alias("reached"))
    publish(mark, f"{table.root.rstrip('/')}/_marks", version)
    table.commit(version)
    return version
