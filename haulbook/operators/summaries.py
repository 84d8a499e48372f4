"""Statistics that follow changes instead of counting anew.

A summary is a small table (measure, key, n): active carriers and all carriers per state, rows of
the child tables, inspections per month, carriers with scores and with alerts. Every count is a
sum over rows, so what a change adds is the count over its rows after less that over its rows
before: a carrier that moves to another state, or becomes inactive, is taken back where it was.
The pages' numbers are read off the summary, whose size is that of the states and months.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulbook.functions.cleaning import month_key
from haulbook.operators import stats
from haulbook.operators.directory import in_us
from haulbook.schemas import US_STATE_CODES
from haulbook.sources.deltas import Change
from haulbook.sources.tables import publish, read_table

SUMMARY = "measure string, key string, n long"
ALL = ""


def carrier_counts(carriers: DataFrame) -> DataFrame:
    """Per state: active carriers, and carriers at all."""
    counted = carriers.groupBy(F.col("state").alias("key")).agg(
        F.count("*").alias("carriers"), F.count_if("is_active").alias("active")
    )
    return counted.unpivot(["key"], ["carriers", "active"], "measure", "n").select("measure", "key", "n").where("n <> 0")


def inspection_counts(inspections: DataFrame) -> DataFrame:
    """Per month; undated ones under no month."""
    month = F.when(F.col("inspection_date").isNotNull(), month_key("inspection_date"))
    return inspections.groupBy(month.alias("key")).agg(F.count("*").alias("n")).select(F.lit("inspections").alias("measure"), "key", "n")


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.agg(F.count("*").alias("n")).select(F.lit("violations").alias("measure"), F.lit(ALL).alias("key"), "n")


def score_counts(scores: DataFrame) -> DataFrame:
    """Scores, carriers with any, and with an alert; `scores` has all rows of its carriers."""
    by_carrier = scores.groupBy("usdot_number").agg(
        F.count("*").alias("scores"), F.max(F.col("alert_status") == "alert").alias("alert")
    )
    counts = by_carrier.agg(
        F.coalesce(F.sum("scores"), F.lit(0)).alias("scores"), F.count("*").alias("scored"), F.count_if("alert").alias("alerts")
    )
    return counts.unpivot([], ["scores", "scored", "alerts"], "measure", "n").select("measure", F.lit(ALL).alias("key"), "n")


def moved(change: Change, counts) -> DataFrame:
    """What a change adds to the counts, and takes back."""
    taken = counts(change.before).withColumn("n", -F.col("n"))
    return fold(counts(change.after), taken)


def fold(*summaries: DataFrame) -> DataFrame:
    """Summaries and moves added up."""
    stacked = reduce(DataFrame.unionByName, summaries)
    return stacked.groupBy("measure", "key").agg(F.sum("n").alias("n")).where("n <> 0").select("measure", "key", "n")


def keep(spark: SparkSession, root: str, version: int, *moves: DataFrame) -> None:
    """Adds moves to the stored summary as version `version`. It builds on the version below,
    so a batch that is run again counts once."""
    before = read_table(spark, root, spark.createDataFrame([], SUMMARY).schema, below=version)
    publish(fold(before, *moves).coalesce(1), root, version)


# --- the numbers of the pages, off a summary --------------------------------------------
def _of(summary: DataFrame, measure: str) -> DataFrame:
    return summary.where(F.col("measure") == measure)


def directory_stats(summary: DataFrame) -> DataFrame:
    total = lambda measure: F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))
    in_state = (F.col("measure") == "carriers") & F.col("key").isin(*US_STATE_CODES)
    return summary.agg(
        total("active").alias("total_carriers"), total("inspections").alias("total_inspections"),
        total("violations").alias("total_violations"), total("scores").alias("total_safety_scores"),
        total("scored").alias("scored_carriers"), total("alerts").alias("carriers_with_alerts"),
        F.count_if(in_state).alias("states"),
    )


def carriers_by_state(summary: DataFrame) -> DataFrame:
    counted = _of(summary, "active").select(F.col("key").alias("state"), F.col("n").alias("count"))
    return in_us(counted).orderBy(F.desc("count"), "state")


def inspections_by_month(summary: DataFrame) -> DataFrame:
    dated = _of(summary, "inspections").where(F.col("key").isNotNull())
    return dated.select(F.col("key").alias("month"), F.col("n").alias("count"))


def home_summary(summary: DataFrame, registrations: DataFrame) -> DataFrame:
    return stats.home_summary(
        directory_stats(summary), stats.top_of(carriers_by_state(summary)),
        stats.fuller_month(inspections_by_month(summary)), registrations,
    )
