"""Streaming twins of the loads. Each equals its batch counterpart when it has caught up.

State that a batch builds on (the directory, subscriptions, usage) is kept in versions
numbered by the micro-batch: a batch that is repeated after a failure reads the version
before it and rewrites its own, so it counts once. A batch writes what it changes: deltas to
the buckets of its keys, or a folder of new rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from haulbook.functions.cleaning import month_key
from haulbook.operators.billing import fold_subscriptions, meter, moved_usage, outcomes
from haulbook.operators.kept import KeptDirectory
from haulbook.operators.merges import known_only
from haulbook.operators.rows import clean_violations, map_incremental, normalize_enrichment
from haulbook.schemas import SUBSCRIBERS
from haulbook.session import materialize, scratch
from haulbook.sources.appends import AppendTable
from haulbook.sources.deltas import KeyedTable
from haulbook.sources.tables import publish, read_table


# Buckets of rows that are stored once: values of a hash of the source id.
ID_BUCKETS = 16

USAGE = T.StructType([
    f for f in SUBSCRIBERS.fields if f.name in ("subscription_id", "usage_period_start", "usage_count")
])


def feed_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A landing folder as a stream; without a limit a batch is all that has landed."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def _run(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Work off what has landed, then stop; the next start resumes at the checkpoint."""
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def incremental_census(
    stream: DataFrame, directory: KeptDirectory, checkpoint: str, as_of: str
) -> StreamingQuery:
    """New registrations, read with an overlap, upserted into the directory, its index and its
    statistics. Rows that come again change nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        directory.upsert(normalize_enrichment(map_incremental(batch)), as_of, batch_id)

    return _run(stream, step, checkpoint)


def direct_violations(
    stream: DataFrame, carriers: DataFrame, root: str, checkpoint: str
) -> StreamingQuery:
    """Violations straight into the final table: clean, keep known carriers, append.

    A batch is a folder, replaced when the batch is repeated; small folders are merged.
    """
    schema = known_only(clean_violations(stream), carriers).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = known_only(clean_violations(batch), carriers)
        AppendTable(batch.sparkSession, root, schema).append(rows, batch_id)

    return _run(stream, step, checkpoint)


def once_per_source_row(
    stream: DataFrame, clean: Callable[[DataFrame], DataFrame], root: str, checkpoint: str
) -> StreamingQuery:
    """Append rows whose `src_id` is not stored yet, however often the feed repeats them.

    What was stored first stays, also when the row comes again with other values; of rows of
    one id in a batch one is taken. Rows without an id cannot be told apart and are all
    stored. Bloom filters tell which folders may hold an id of a small batch, and only those are
    opened; a large one is compared with all stored ids (`AppendTable.unseen`).
    """
    schema = clean(stream).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        table = AppendTable(batch.sparkSession, root, schema, "src_id", ID_BUCKETS)
        rows = clean(batch)
        # A row without an id is a group of its own.
        own = F.coalesce("src_id", F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string")))
        pick = W.partitionBy("_own").orderBy(F.xxhash64(*rows.columns))
        rows = rows.withColumn("_own", own).withColumn("_nth", F.row_number().over(pick)).where("_nth = 1").drop("_own", "_nth")
        with scratch(batch.sparkSession):
            table.append(table.unseen(materialize(rows, "rows"), below=batch_id), batch_id)

    return _run(stream, step, checkpoint)


def metered_stream(
    stream: DataFrame, subscribers: Callable[[], DataFrame], state_root: str, out_root: str, checkpoint: str
) -> StreamingQuery:
    """Quota metering of an arriving request log.

    Every micro-batch asks for the subscribers as they are now, so a cancelled, new or
    re-keyed subscriber, or another quota, counts from the next batch on. The state is the
    open period and the count of each subscription, nothing else. A batch is metered as
    a whole by the batch operator, so a busy key is spread like in a batch job.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        used = read_table(spark, state_root, USAGE, below=batch_id).select(
            "subscription_id", F.struct("usage_period_start", "usage_count").alias("used")
        )
        now = subscribers()
        carried = {n: F.when(F.col("used").isNull(), F.col(n)).otherwise(F.col(f"used.{n}")) for n in USAGE.names if n != "subscription_id"}
        now = now.join(used, "subscription_id", "left").withColumns(carried).select(*now.columns)
        with scratch(spark):
            metering = meter(batch, now)
            outcomes(metering).write.mode("overwrite").parquet(f"{out_root.rstrip('/')}/batch={batch_id}")
            moved = moved_usage(metering, now).select(*USAGE.names)
            # Subscriptions that are gone keep their count, should they return.
            gone = used.join(now.select("subscription_id"), "subscription_id", "left_anti")
            publish(moved.unionByName(gone.select("subscription_id", "used.*")), state_root, batch_id)

    return _run(stream, step, checkpoint)


def subscriber_table(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, root, SUBSCRIBERS, "subscription_id")


def subscription_stream(
    stream: DataFrame, price_plans: dict[str, str], root: str, checkpoint: str
) -> StreamingQuery:
    """Subscription events folded into the subscriber table (`subscriber_table`)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            events = materialize(batch, "events")
            named = F.startswith("event_type", F.lit("subscription.")) & (F.col("sub_id") != "")
            keys = events.where(named).select(F.col("sub_id").alias("subscription_id")).distinct()
            subscriber_table(batch.sparkSession, root).apply(
                keys, lambda known: fold_subscriptions(events, price_plans, known), batch_id
            )

    return _run(stream, step, checkpoint)


def monthly_counts_stream(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Inspections per month of a stream of clean inspections, kept up to date.

    The state is one number per month; every trigger publishes the whole small table.
    """
    counts = (
        stream.where(F.col("inspection_date").isNotNull())
        .groupBy(month_key("inspection_date").alias("month"))
        .agg(F.count("*").alias("count"))
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        publish(batch.coalesce(1), root, batch_id)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
