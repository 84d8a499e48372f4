"""Directory statistics. Every aggregate combines inside the map tasks first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.functions.cleaning import col, month_key
from haulbook.operators.directory import in_us, with_state_name
from haulbook.schemas import BAND_WIDTH, US_STATE_CODES


def directory_stats(
    carriers: DataFrame, inspections: DataFrame, violations: DataFrame, scores: DataFrame
) -> DataFrame:
    """Seven counts in one row.

    Each table gives one partial row; the rows are laid under each other and added up.
    """
    us_state = F.when(F.col("state").isin(*US_STATE_CODES), F.col("state"))
    # One row per scored carrier first: both distinct counts come out of one shuffle.
    scored = scores.groupBy("usdot_number").agg(
        F.count("*").alias("n"), F.max(F.col("alert_status") == "alert").alias("alert")
    )
    parts = [
        carriers.groupBy(us_state.alias("us"))
        .agg(F.count_if("is_active").alias("n"))
        .agg(F.sum("n").alias("total_carriers"), F.count("us").alias("states")),
        inspections.agg(F.count("*").alias("total_inspections")),
        violations.agg(F.count("*").alias("total_violations")),
        scored.agg(
            F.sum("n").alias("total_safety_scores"),
            F.count("*").alias("scored_carriers"),
            F.count_if("alert").alias("carriers_with_alerts"),
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    names = (
        "total_carriers", "total_inspections", "total_violations", "total_safety_scores",
        "scored_carriers", "carriers_with_alerts", "states",
    )
    return stacked.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def carriers_by_state(carriers: DataFrame) -> DataFrame:
    """Active carriers per US state, most first."""
    counted = in_us(carriers.where("is_active")).groupBy("state").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "state")


def inspections_by_month(inspections: DataFrame) -> DataFrame:
    dated = inspections.where(F.col("inspection_date").isNotNull())
    return dated.groupBy(month_key("inspection_date").alias("month")).agg(F.count("*").alias("count"))


def latest_month(inspections: DataFrame) -> DataFrame:
    """Of the two newest months the fuller one (the newest may still be filling up)."""
    return fuller_month(inspections_by_month(inspections))


def fuller_month(months: DataFrame) -> DataFrame:
    newest = months.orderBy(F.desc("month")).limit(2)
    best = newest.agg(F.max(F.struct("count", "month")).alias("b"))
    return best.select(
        F.col("b.month").alias("inspections_month"),
        F.coalesce("b.count", F.lit(0)).alias("inspections_last_month"),
    )


def new_registrations(census: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    since = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyyMMdd")
    fresh = census.where((F.col("add_date") >= since) & (F.col("status_code") == "A"))
    return fresh.agg(F.count("dot_number").alias("new_carriers_this_week"))


def alert_share(stats: DataFrame) -> DataFrame:
    """Percent of scored carriers with an alert, its text, and the rest of the hundred."""
    scored, alerts = F.col("scored_carriers"), F.col("carriers_with_alerts")
    pct = F.when(scored > 0, F.floor(100 * alerts / scored + 0.5))
    return stats.select(
        pct.alias("alert_pct"),
        F.when(pct == 0, F.lit("<1")).otherwise(pct.cast("string")).alias("alert_text"),
        (100 - pct).alias("no_alert_pct"),
    )


def key_bounds(rows: DataFrame) -> DataFrame:
    dot = F.col("usdot_number").try_cast("bigint")
    return rows.agg(F.min(dot).alias("min_dot"), F.max(dot).alias("max_dot"))


def band_report(rows: DataFrame, width: int = BAND_WIDTH) -> DataFrame:
    """Rows per band of USDOT numbers, bands counted from the smallest number."""
    dot = F.col("usdot_number").try_cast("bigint")
    lowest = key_bounds(rows).select("min_dot").scalar()
    band = F.floor((dot - lowest) / width)
    return (
        rows.where(dot.isNotNull())
        .groupBy(band.alias("band"))
        .agg(F.count("*").alias("rows"), F.min(dot).alias("min_dot"), F.max(dot).alias("max_dot"))
    )


def ingest_account(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Records read and records kept, side by side."""
    both = raw.agg(F.count("*").alias("total_records")).unionByName(
        processed.agg(F.count("*").alias("processed_records")), allowMissingColumns=True
    )
    return both.agg(
        F.sum("total_records").alias("total_records"),
        F.sum("processed_records").alias("processed_records"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def top_states(carriers: DataFrame, limit: int = 10) -> DataFrame:
    """The states with the most active carriers, with their names."""
    return top_of(carriers_by_state(carriers), limit)


def top_of(by_state: DataFrame, limit: int = 10) -> DataFrame:
    named = with_state_name(by_state).where(F.col("state_name").isNotNull())
    return (
        named.select("state", "state_name", "count").orderBy(F.desc("count"), "state").limit(limit)
    )


def home_summary(
    stats: DataFrame, states: DataFrame, month: DataFrame, registrations: DataFrame
) -> DataFrame:
    """The home page's numbers as one document. Every input is a handful of rows."""
    ranked = states.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("count")).alias("k"), "state", "state_name", "count"))
        ).alias("s")
    ).select(
        F.transform("s", lambda x: F.struct(x["state"], x["state_name"], x["count"])).alias("top_states")
    )
    stacked = (
        stats.select(F.struct("*").alias("stats"))
        .unionByName(alert_share(stats).select(F.struct("*").alias("alerts")), True)
        .unionByName(ranked, True)
        .unionByName(month.select(F.struct("*").alias("month")), True)
        .unionByName(registrations.select(F.struct("*").alias("week")), True)
    )
    parts = ("stats", "alerts", "top_states", "month", "week")
    return stacked.agg(*[F.first(p, ignorenulls=True).alias(p) for p in parts])


def fleet_sanity(
    carriers: DataFrame, totals: DataFrame, ratio: float = 0.01
) -> DataFrame:
    """Fleets that the inspection record does not bear out become unknown.

    Above 1,000 vehicles some inspection is needed; above 5,000 at least `ratio` per
    vehicle. The rule names no ratio, so it is a parameter.
    """
    seen = totals.select("usdot_number", "inspections_total")
    inspected = F.coalesce("inspections_total", F.lit(0))
    fleet = F.col("total_vehicles")
    needed = F.ceil(fleet * F.lit(ratio).cast("decimal(10,6)"))
    doubtful = ((fleet > 1000) & (inspected == 0)) | ((fleet > 5000) & (inspected < needed))
    return (
        carriers.join(seen, "usdot_number", "left")
        .withColumn("total_vehicles", F.when(~F.coalesce(doubtful, F.lit(False)), fleet))
        .drop("inspections_total")
    )


def trend_points(monthly: Column | str) -> Column:
    """A monthly series against its own maximum (at least 1); null for under two points."""
    series = col(monthly)
    top = F.greatest(F.array_max(F.transform(series, lambda p: p["count"])), F.lit(1))
    points = F.transform(series, lambda p: p["count"] / top)
    return F.when(
        F.size(series) >= 2,
        F.struct(
            points.alias("points"),
            F.element_at(series, 1)["month"].alias("first_month"),
            F.element_at(series, -1)["month"].alias("last_month"),
        ),
    )
