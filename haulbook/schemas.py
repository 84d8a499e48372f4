"""Schemas and fixed tables of the carrier data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- raw feeds: every field arrives as text -------------------------------------------
# The names of the feeds' fields.
CENSUS_FIELDS = (
    "dot_number", "legal_name", "phy_street", "phy_city", "phy_state", "phy_zip", "phone",
    "carrier_operation", "business_org_desc", "power_units", "status_code",
)
BASICS_FIELDS = (
    ":id", "dot_number", "insp_total",
    "unsafe_driv_measure", "unsafe_driv_ac", "hos_driv_measure", "hos_driv_ac",
    "driv_fit_measure", "driv_fit_ac", "contr_subst_measure", "contr_subst_ac",
    "veh_maint_measure", "veh_maint_ac",
)
INSPECTION_FIELDS = (
    ":id", "dot_number", "insp_date", "insp_level_id", "report_state", "driver_oos_total",
    "vehicle_oos_total", "unsafe_viol", "fatigued_viol", "dr_fitness_viol",
    "subt_alcohol_viol", "vh_maint_viol", "hm_viol",
)
VIOLATION_FIELDS = (
    ":id", "dot_number", "viol_code", "section_desc", "insp_date", "oos_indicator",
    "severity_weight",
)
FEEDS = {
    "census": CENSUS_FIELDS,
    "basics": BASICS_FIELDS,
    "inspections": INSPECTION_FIELDS,
    "violations": VIOLATION_FIELDS,
}

# --- clean tables ---------------------------------------------------------------------
# The columns' names and types.
CARRIERS = T.StructType(
    [
        T.StructField("usdot_number", T.StringType()),
        T.StructField("mc_number", T.StringType()),
        T.StructField("legal_name", T.StringType()),
        T.StructField("dba_name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("zip", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("operation_type", T.StringType()),
        T.StructField("carrier_classification", T.StringType()),
        T.StructField("total_vehicles", T.IntegerType()),
        T.StructField("total_drivers", T.IntegerType()),
        T.StructField("authority_status", T.StringType()),
        T.StructField("safety_rating", T.StringType()),
        T.StructField("duns_number", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("last_scraped_at", T.TimestampType()),
    ]
)
SCORES = T.StructType(
    [
        T.StructField("usdot_number", T.StringType()),
        T.StructField("basic_category", T.StringType()),
        T.StructField("score", T.DecimalType(8, 2)),
        T.StructField("percentile", T.IntegerType()),
        T.StructField("alert_status", T.StringType()),
        T.StructField("measured_date", T.DateType()),
    ]
)
SUBSCRIBERS = T.StructType(
    [
        T.StructField("subscription_id", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("plan", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("api_key_hash", T.StringType()),
        T.StructField("api_key_prefix", T.StringType()),
        T.StructField("api_key_issued_at", T.TimestampType()),
        T.StructField("monthly_quota", T.IntegerType()),
        T.StructField("usage_count", T.LongType()),
        T.StructField("usage_period_start", T.DateType()),
    ]
)
SUBSCRIPTION_EVENT = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("id", T.StringType()),
                    T.StructField("status", T.StringType()),
                    T.StructField("customer_id", T.StringType()),
                    T.StructField(
                        "items",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(
                                        "price",
                                        T.StructType([T.StructField("id", T.StringType())]),
                                    )
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)
LEDGER = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("usdot_range_start", T.LongType()),
        T.StructField("usdot_range_end", T.LongType()),
        T.StructField("total_records", T.LongType()),
        T.StructField("processed_records", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
    ]
)

SUMMARY_COLUMNS = (
    "usdot_number", "mc_number", "legal_name", "dba_name", "city", "state",
    "operation_type", "total_vehicles", "total_drivers", "safety_rating", "slug",
)
DETAIL_COLUMNS = SUMMARY_COLUMNS + (
    "address", "zip", "phone", "email", "carrier_classification", "authority_status",
    "duns_number", "is_active", "last_scraped_at",
)

# --- fixed values (domain facts, stated as they are) ----------------------------------
MAX_FLEET = 150_000
PAGE_SIZE = 50_000
BAND_WIDTH = 200_000
LOOKBACK_DAYS = 10

OPERATION_NAMES = {
    "A": "Interstate",
    "B": "Intrastate Hazmat",
    "C": "Intrastate Non-Hazmat",
}
# feed column prefix -> category name
BASIC_CATEGORIES = {
    "unsafe_driv": "Unsafe Driving",
    "hos_driv": "HOS Compliance",
    "driv_fit": "Driver Fitness",
    "contr_subst": "Controlled Substances/Alcohol",
    "veh_maint": "Vehicle Maintenance",
}
INSPECTION_COUNTERS = (
    "unsafe_viol", "fatigued_viol", "dr_fitness_viol", "subt_alcohol_viol", "vh_maint_viol",
    "hm_viol",
)
PLAN_QUOTAS = {"growth": 50_000, "standard": 150_000, "pro": 300_000}
DEFAULT_PLAN = "growth"
ACTIVE_STATUSES = ("active", "trialing")
QUOTA_PERIOD_DAYS = 30

STATE_NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho",
    "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky",
    "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri",
    "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "GU": "Guam", "PR": "Puerto Rico", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont",
    "VA": "Virginia", "VI": "U.S. Virgin Islands", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
# The statistics count 52 codes: every named one but Guam and the Virgin Islands.
US_STATE_CODES = tuple(code for code in STATE_NAMES if code not in ("GU", "VI"))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows that the optimizer knows to be empty, so joins with it vanish."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.sql("select 1").where("false").select(*columns)


def constant_table(spark: SparkSession, rows: dict[str, object], key: str, value: str) -> DataFrame:
    """A fixed two-column table as a local relation (no job, no Python rows)."""

    def literal(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    values = ", ".join(f"({literal(k)}, {literal(v)})" for k, v in rows.items())
    return spark.sql(f"select * from values {values} as t({key}, {value})")
