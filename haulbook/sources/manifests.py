"""Which folders make up a table, version by version.

A table that changes in part keeps its data in folders that are never written twice, and for
every version a small list of those that are live. A version is there when its list is complete,
so readers see a whole version or the one before; a job that is run again writes its own version
again. Lists hold a row per folder, which the tables bound by merging folders.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession

from haulbook.session import remove

LISTS = "_live"


class Folder(NamedTuple):
    """A live folder: the bucket of keys it holds, what it is, where, and how many rows."""

    bucket: int
    kind: str
    path: str
    version: int
    rows: int


SCHEMA = "bucket int, kind string, path string, version long, rows long"


def children(spark: SparkSession, path: str) -> Iterator[tuple[str, float]]:
    """Names and times of what lies in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at):
        for status in files.listStatus(at):
            yield status.getPath().getName(), status.getModificationTime() / 1000


def commit(spark: SparkSession, root: str, version: int, folders: Iterable[Folder]) -> None:
    """Makes `folders` the table's version `version`."""
    rows = spark.createDataFrame([tuple(f) for f in folders], SCHEMA)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{LISTS}/version={version}")


def versions(spark: SparkSession, root: str) -> dict[int, float]:
    """Complete versions and when they became so; as many as retention keeps."""
    out = {}
    for name, _ in children(spark, f"{root.rstrip('/')}/{LISTS}"):
        if name.startswith("version="):
            done = dict(children(spark, f"{root.rstrip('/')}/{LISTS}/{name}")).get("_SUCCESS")
            if done is not None:
                out[int(name.removeprefix("version="))] = done
    return out


def live(
    spark: SparkSession, root: str, below: int | None = None, version: int | None = None
) -> list[Folder]:
    """The folders of a version: the given one, or the newest (below a number)."""
    known = [v for v in versions(spark, root) if (below is None or v < below) and version in (None, v)]
    if not known:
        return []
    return folders_of(spark, root, max(known))


def folders_of(spark: SparkSession, root: str, version: int) -> list[Folder]:
    path = f"{root.rstrip('/')}/{LISTS}/version={version}"
    return sorted(Folder(*r) for r in spark.read.schema(SCHEMA).parquet(path).collect())


def retire(spark: SparkSession, root: str, grace_seconds: float, now: float | None = None) -> list[str]:
    """Removes versions that were superseded longer than the grace ago, and the folders that
    only they name. Who reads an older version has the grace to finish. The newest version,
    and what a running job writes for a newer one, are never touched."""
    now = time.time() if now is None else now
    known = sorted(versions(spark, root).items())
    old = [v for (v, _), (_, superseded) in zip(known, known[1:]) if superseded < now - grace_seconds]
    if not old:
        return []
    kept = [v for v, _ in known if v not in old]
    named = {f.path for v in kept for f in folders_of(spark, root, v)}
    gone = {f.path for v in old for f in folders_of(spark, root, v)} - named
    # Lists first: a list never names what is gone.
    for v in old:
        remove(spark, f"{root.rstrip('/')}/{LISTS}/version={v}")
    for path in sorted(gone):
        remove(spark, f"{root.rstrip('/')}/{path}")
    return sorted(gone)
