"""The ledger of load runs: appended events, newest state by aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from haulbook.schemas import LEDGER

ERROR_WIDTH = 2000
DUE_HOURS = 24


def ledger_rows(events: DataFrame) -> DataFrame:
    """Run events in ledger form; missing columns are null, messages are cut."""
    names = set(events.columns)
    cols = []
    for field in LEDGER.fields:
        value = F.col(field.name) if field.name in names else F.lit(None)
        if field.name == "error_message":
            value = F.left(value, F.lit(ERROR_WIDTH))
        cols.append(value.cast(field.dataType).alias(field.name))
    return events.select(*cols)


def append_events(events: DataFrame, path: str) -> None:
    ledger_rows(events).write.mode("append").parquet(path)


def run_load(
    raw: DataFrame, process: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None],
    path: str, job_id: int, source: str,
) -> None:
    """Runs a load and enters it in the ledger: that it runs, then what it read and kept, or why
    it failed.

    Both counts are observed while the load writes, so the feed is scanned once. The sink must
    write its rows once, in one action.
    """
    spark = raw.sparkSession
    read, kept = Observation(), Observation()
    counted = raw.observe(read, F.count("*").alias("n"))
    rows = process(counted).observe(kept, F.count("*").alias("n"))

    def enter(seq: int, status: str, **figures) -> None:
        at = {"started_at": F.current_timestamp()} if status == "running" else {"completed_at": F.current_timestamp()}
        columns = {"seq": seq, "job_id": job_id, "source": source, "status": status} | figures
        event = spark.range(1).select(*[F.lit(v).alias(n) for n, v in columns.items()], *[v.alias(n) for n, v in at.items()])
        append_events(event, path)

    enter(2 * job_id, "running")
    try:
        sink(rows)
    except Exception as failure:
        enter(2 * job_id + 1, "failed", error_message=str(failure))
        raise
    enter(2 * job_id + 1, "completed", total_records=read.get["n"], processed_records=kept.get["n"])


def latest_state(ledger: DataFrame) -> DataFrame:
    """The current row of every run: last status, and each figure as last reported."""

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    figures = [n for n in LEDGER.names if n not in ("job_id", "seq")]
    return ledger.groupBy("job_id").agg(*[last(n) for n in figures])


def last_success(ledger: DataFrame) -> DataFrame:
    """Completion time of the newest completed run of every source."""
    done = latest_state(ledger).where(F.col("status") == "completed")
    return done.groupBy("source").agg(
        F.max("job_id").alias("job_id"), F.max_by("completed_at", "job_id").alias("completed_at")
    )


def due_sources(ledger: DataFrame, as_of: str, hours: int = DUE_HOURS) -> DataFrame:
    """Sources never completed, or not within the last `hours`."""
    known = ledger.select("source").distinct()
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("completed_at")
    return known.join(last_success(ledger), "source", "left").select(
        "source", F.col("completed_at").alias("last_completed_at"),
        (F.col("completed_at").isNull() | (age >= hours * 3600)).alias("due"),
    )
