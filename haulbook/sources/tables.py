"""Sinks. A table is a folder of immutable versions and a small list of them.

A new version is written beside the old ones and becomes visible when its line is added
to the list, so readers never see half a load, and a job that is run again only rewrites
its own version.
"""

from __future__ import annotations

import re
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulbook.schemas import empty
from haulbook.session import remove
from haulbook.sources.manifests import children

VERSIONS = T.StructType(
    [T.StructField("version", T.LongType()), T.StructField("path", T.StringType())]
)


def _versions_path(root: str) -> str:
    return f"{root.rstrip('/')}/_list"


def publish(
    df: DataFrame, root: str, version: int, cluster_by: str | None = None, ranges: bool = False,
    blooms: tuple[str, ...] = (), row_group_bytes: int | None = None,
) -> str:
    """Replace the whole table by `df`, as version `version`.

    With `cluster_by` (one or more columns, `a, b`) the rows of a key lie together and
    sorted, so a lookup skips all row groups but its own. The rebalancing shuffle is one
    pass, and adaptive execution splits a key that outgrows a file. `ranges` makes the
    files ranges of the key instead, so that a lookup opens one file; that samples the
    rows first, which for anything but a small table means computing them twice.

    `blooms` names columns that rows are looked up by without lying sorted by them: every row
    group gets a Bloom filter of such a column, and `= value` or `IN (values)` skips the groups
    that hold none. Smaller row groups make a lookup read less.
    """
    path = f"{root.rstrip('/')}/v{version}"
    if cluster_by:
        keys = [k.strip() for k in cluster_by.split(",")]
        df = df.repartitionByRange(*keys) if ranges else df.hint("rebalance", keys[0])
        df = df.sortWithinPartitions(*keys)
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in blooms}
    if row_group_bytes:
        options["parquet.block.size"] = str(row_group_bytes)
    df.write.mode("overwrite").options(**options).parquet(path)
    spark = df.sparkSession
    line = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(path).alias("path"))
    line.write.mode("append").parquet(_versions_path(root))
    return path


def newest_version(spark: SparkSession, root: str, below: int | None = None) -> tuple[int, str] | None:
    """Number and path of the newest version (one row), if there is any."""
    try:
        known = spark.read.schema(VERSIONS).parquet(_versions_path(root))
    except AnalysisException:
        return None
    if below is not None:
        known = known.where(F.col("version") < below)
    row = known.agg(F.max(F.struct("version", "path")).alias("v")).first()
    return (row.v.version, row.v.path) if row.v else None


def read_table(
    spark: SparkSession, root: str, schema: T.StructType | None = None, below: int | None = None
) -> DataFrame:
    """The newest version; an empty table when there is none and a schema is given."""
    newest = newest_version(spark, root, below)
    if newest is None:
        if schema is None:
            raise FileNotFoundError(f"no published version under {root}")
        return empty(spark, schema)
    return spark.read.parquet(newest[1])


def retire_versions(
    spark: SparkSession, root: str, grace_seconds: float, now: float | None = None
) -> list[int]:
    """Removes versions that a newer one replaced longer than the grace ago. Who still reads
    an older version has the grace to finish; the newest one stays."""
    now = time.time() if now is None else now
    done = {}
    for name, _ in children(spark, root):
        if re.fullmatch(r"v-?\d+", name):
            finished = dict(children(spark, f"{root.rstrip('/')}/{name}")).get("_SUCCESS")
            if finished is not None:
                done[int(name[1:])] = finished
    known = sorted(done.items())
    old = [v for (v, _), (_, replaced) in zip(known, known[1:]) if replaced < now - grace_seconds]
    for v in old:
        remove(spark, f"{root.rstrip('/')}/v{v}")
    return old


def replace_snapshot(
    df: DataFrame, root: str, version: int, bounded_run: bool = False, cluster_by: str | None = None
) -> str | None:
    """Replace an itemised table (a rolling window, delivered whole). A bounded trial
    run leaves the table alone."""
    return None if bounded_run else publish(df, root, version, cluster_by)


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "usdot_number") -> None:
    """Store a table hashed and sorted by `key`: later joins and groupings on the key
    with an equally bucketed table need no shuffle."""
    (
        df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        .option("path", path).saveAsTable(table)
    )


def export_profiles(profiles: DataFrame, path: str, fmt: str = "json") -> None:
    """One nested document per carrier, as JSON lines or Parquet."""
    options = {"ignoreNullFields": "false"} if fmt == "json" else {}
    profiles.write.mode("overwrite").options(**options).format(fmt).save(path)


def export_sitemaps(files: DataFrame, path: str) -> None:
    """One text file per sitemap, in a folder named by its number."""
    files.select("file", F.col("xml").alias("value")).write.mode("overwrite").partitionBy("file").text(path)
