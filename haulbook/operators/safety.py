"""Safety records of all carriers at once. Children are grouped before they are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.functions import cleaning as c
from haulbook.operators.ranking import latest_per_carrier

KEY = "usdot_number"
INSPECTIONS_SHOWN = 50
VIOLATIONS_SHOWN = 10

INSPECTION_TIES = ["src_id"]
VIOLATION_TIES = ["violation_code", "tie_1", "tie_2", "tie_3"]


def _ties(rows: DataFrame, wanted: list[str]) -> list[str]:
    """Tie columns the table has, then all its others, so the order is total."""
    first = [t for t in wanted if t in rows.columns]
    return first + [n for n in rows.columns if n not in first and n != KEY]


def latest_inspections(inspections: DataFrame, k: int = INSPECTIONS_SHOWN) -> DataFrame:
    return latest_per_carrier(
        inspections, "inspection_date", k, _ties(inspections, INSPECTION_TIES)
    )


def latest_violations(violations: DataFrame, k: int = VIOLATIONS_SHOWN) -> DataFrame:
    return latest_per_carrier(violations, "violation_date", k, _ties(violations, VIOLATION_TIES))


def _inspection_months(inspections: DataFrame) -> DataFrame:
    month = c.month_key("inspection_date").alias("month")
    return inspections.groupBy(KEY, month).agg(F.count("*").alias("count"))


def monthly_series(inspections: DataFrame) -> DataFrame:
    """(usdot_number, month, count) of dated inspections."""
    return _inspection_months(inspections.where(F.col("inspection_date").isNotNull()))


def inspection_history(inspections: DataFrame) -> DataFrame:
    """Per carrier the total and the series by month, from one pass.

    The first grouping is by carrier and month, so a mega fleet shrinks to its months
    before its rows come together.
    """
    point = F.when(F.col("month").isNotNull(), F.struct("month", "count"))
    return (
        _inspection_months(inspections)
        .groupBy(KEY)
        .agg(
            F.sum("count").alias("inspections_total"),
            F.array_sort(F.collect_list(point)).alias("inspections_monthly"),
        )
    )


def with_totals(carriers: DataFrame, inspections: DataFrame, violations: DataFrame) -> DataFrame:
    """Carriers with their inspections and violations counted, 0 where there are none."""
    i = inspections.groupBy(KEY).agg(F.count("*").alias("inspections_total"))
    v = violations.groupBy(KEY).agg(F.count("*").alias("violations_total"))
    return carriers.join(i, KEY, "left").join(v, KEY, "left").withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in ("inspections_total", "violations_total")}
    )


def carrier_totals(
    carriers: DataFrame, inspections: DataFrame, violations: DataFrame
) -> DataFrame:
    """Inspections and violations per carrier."""
    return with_totals(carriers.select(KEY), inspections, violations)


def any_alert(scores: DataFrame) -> DataFrame:
    return scores.groupBy(KEY).agg(F.bool_or(F.col("alert_status") == "alert").alias("any_alert"))


def score_lists(scores: DataFrame) -> DataFrame:
    """Scores of a carrier as one list (a carrier has one per category and load)."""
    item = F.struct("basic_category", "score", "percentile", "alert_status", "measured_date")
    return scores.groupBy(KEY).agg(F.array_sort(F.collect_list(item)).alias("safety_scores"))


def with_scores(carriers: DataFrame, scores: DataFrame) -> DataFrame:
    joined = carriers.join(score_lists(scores), KEY, "left")
    return joined.withColumn("safety_scores", _or_empty(joined, "safety_scores"))


def _or_empty(df: DataFrame, name: str):
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType))


def _ranked_list(rows: DataFrame, fields: list, name: str) -> DataFrame:
    """Already ranked rows (column `rn`) of a carrier as one list, in rank order."""
    lists = rows.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("rn", F.struct(*fields).alias("item")))).alias("l")
    )
    return lists.select(KEY, F.transform("l", lambda x: x["item"]).alias(name))


def safety_profiles(
    carriers: DataFrame, scores: DataFrame, inspections: DataFrame, violations: DataFrame
) -> DataFrame:
    """One nested safety document per carrier, for the whole directory in one job.

    Every child comes out of its grouping hashed by carrier, so the joins add one
    shuffle of the carriers and none of the children.
    """
    shown_inspections = _ranked_list(
        latest_inspections(inspections),
        [
            "inspection_date", "inspection_type",
            F.lit(None).cast("int").alias("vehicles_inspected"),
            F.lit(None).cast("int").alias("drivers_inspected"),
            "violations_found", "oos_vehicles", "oos_drivers", "state",
        ],
        "inspections",
    )
    shown_violations = _ranked_list(
        latest_violations(violations),
        [
            "violation_code", "violation_description", "violation_date", "oos_indicator",
            "severity_weight",
        ],
        "violations",
    )
    violation_totals = violations.groupBy(KEY).agg(F.count("*").alias("violations_total"))
    joined = carriers.select(KEY, "safety_rating")
    for child in (
        score_lists(scores), shown_inspections, shown_violations,
        inspection_history(inspections), violation_totals,
    ):
        joined = joined.join(child, KEY, "left")
    return joined.select(
        KEY,
        "safety_rating",
        *[
            _or_empty(joined, n).alias(n)
            for n in ("safety_scores", "inspections", "violations")
        ],
        F.coalesce("inspections_total", F.lit(0)).alias("inspections_total"),
        F.coalesce("violations_total", F.lit(0)).alias("violations_total"),
        _or_empty(joined, "inspections_monthly").alias("inspections_monthly"),
    )
