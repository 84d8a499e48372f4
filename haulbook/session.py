"""Session settings and the shared work directory."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A carrier or an API key may own a third of a table: let AQE split its partition.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A side is broadcast when its size is known to be below this; the keys of the whole
    # directory are, so resolving a feed does not shuffle the feed. Beyond it Spark joins
    # by sorting.
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Plans here have hundreds of expressions; recording the call site of each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "haulbook", **extra: str) -> SparkSession:
    """A session with the settings above; `extra` keys use `__` in place of dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    Only where the session names none and runs on one machine (a laptop, a test) is a local
    one made, once per application. On a cluster the setting is required: a folder of the
    driver's own disk would leave each executor with its own part of a table.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(
            f"spark.checkpoint.dir is not set, and master {master} needs a folder that every "
            "executor can reach"
        )
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_DIRS[application]


_SCRATCH: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder, or below the scratch folder."""
    base = _SCRATCH.get() or shared_dir(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is materialised in here is removed at the end; write the results before."""
    path = fresh_dir(spark, "scratch")
    token = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(token)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the file.

    For small results of a long scan that several branches need: the scan runs once, the
    lineage is cut where lost executors cannot lose it, and Spark plans what follows by
    the real size of the file.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_driver(spark: SparkSession) -> None:
    """Has the driver collect the garbage of plans that nobody refers to any more.

    A loop of many small jobs makes much of it; otherwise the heap grows towards its limit, and
    is not given back, though little of it is in use.
    """
    gc.collect()
    spark._jvm.System.gc()
