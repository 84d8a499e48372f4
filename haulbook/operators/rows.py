"""Row builders: one raw feed in, clean rows out, a single narrow projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.functions import cleaning as c
from haulbook.functions.slugs import carrier_slug
from haulbook.schemas import BASIC_CATEGORIES, DETAIL_COLUMNS, SUMMARY_COLUMNS

# Target column -> (field names it is read from, in order of preference, width).
TEXT_ALIASES = {
    "mc_number": (("mc_number", "docket_number"), 20),
    "legal_name": (("legal_name",), 255),
    "dba_name": (("dba_name",), 255),
    "address": (("address", "phy_street"), 10_000),
    "city": (("city", "phy_city"), 100),
    "state": (("state", "phy_state"), 10),
    "zip": (("zip", "phy_zip"), 20),
    "phone": (("phone", "telephone"), 50),
    "email": (("email", "email_address"), 255),
    "operation_type": (("operation_type",), 100),
    "carrier_classification": (("carrier_classification",), 100),
    "authority_status": (("authority_status",), 50),
    "safety_rating": (("safety_rating",), 50),
    "duns_number": (("duns_number", "dun_bradstreet_no"), 20),
}
COUNT_ALIASES = {
    "total_vehicles": ("total_vehicles", "power_units", "nbr_power_unit"),
    "total_drivers": ("total_drivers", "driver_total"),
}
UPSERT_FIELDS = tuple(TEXT_ALIASES) + tuple(COUNT_ALIASES)


def _kept(raw: DataFrame, keep: tuple[str, ...]) -> list[Column]:
    return [F.col(k) for k in keep if k in raw.columns]


def clean_census(raw: DataFrame, keep: tuple[str, ...] = ("src_seq",)) -> DataFrame:
    dot, name = c.clean("dot_number", 20), c.clean("legal_name", 255)
    return raw.where(c.valid_dot(dot)).select(
        dot.alias("usdot_number"),
        name.alias("legal_name"),
        c.clean("phy_street", 10_000).alias("address"),
        c.clean("phy_city", 100).alias("city"),
        c.clean("phy_state", 10).alias("state"),
        c.clean("phy_zip", 20).alias("zip"),
        c.clean("phone", 50).alias("phone"),
        c.operation_name("carrier_operation").alias("operation_type"),
        c.clean("business_org_desc", 100).alias("carrier_classification"),
        c.capped_fleet(c.strict_int("power_units")).alias("total_vehicles"),
        carrier_slug(name, dot).alias("slug"),
        c.active_flag("status_code").alias("is_active"),
        *_kept(raw, keep),
    )


def clean_basics(raw: DataFrame, keep: tuple[str, ...] = ("src_id",)) -> DataFrame:
    dot = c.strip("dot_number")
    pairs = []
    for prefix in BASIC_CATEGORIES:
        pairs.append(c.num(f"{prefix}_measure").alias(f"{prefix}_measure"))
        pairs.append(c.flag(f"{prefix}_ac").alias(f"{prefix}_ac"))
    return raw.where(c.valid_dot(dot)).select(
        dot.alias("usdot_number"), c.strict_int("insp_total").alias("insp_total"), *pairs,
        *_kept(raw, keep),
    )


def clean_inspections(raw: DataFrame, keep: tuple[str, ...] = ("src_id",)) -> DataFrame:
    dot = c.strip("dot_number")
    return raw.where(c.valid_dot(dot)).select(
        dot.alias("usdot_number"),
        c.feed_date("insp_date").alias("inspection_date"),
        c.inspection_label("insp_level_id").alias("inspection_type"),
        c.clean("report_state", 10).alias("state"),
        c.strict_int("driver_oos_total").alias("oos_drivers"),
        c.strict_int("vehicle_oos_total").alias("oos_vehicles"),
        c.violation_total().alias("violations_found"),
        *_kept(raw, keep),
    )


def clean_violations(
    raw: DataFrame, keep: tuple[str, ...] = ("src_id", "tie_1", "tie_2", "tie_3")
) -> DataFrame:
    dot = c.strip("dot_number")
    return raw.where(c.valid_dot(dot)).select(
        dot.alias("usdot_number"),
        c.clean("viol_code", 20).alias("violation_code"),
        c.clean("section_desc").alias("violation_description"),
        c.feed_date("insp_date").alias("violation_date"),
        c.flag("oos_indicator").alias("oos_indicator"),
        c.strict_int("severity_weight").alias("severity_weight"),
        *_kept(raw, keep),
    )


def map_incremental(raw: DataFrame, keep: tuple[str, ...] = ("src_seq",)) -> DataFrame:
    """New-registration rows under the names the field upsert knows. No cleaning here."""
    return raw.select(
        F.col("dot_number").alias("usdot_number"),
        F.col("legal_name"),
        F.col("phy_street").alias("address"),
        F.col("phy_city").alias("city"),
        F.col("phy_state").alias("state"),
        F.col("phy_zip").alias("zip"),
        F.col("phone"),
        c.operation_name("carrier_operation").alias("operation_type"),
        F.col("business_org_desc").alias("carrier_classification"),
        c.capped_fleet(c.strict_int("power_units")).alias("total_vehicles"),
        *_kept(raw, keep),
    )


def normalize_enrichment(raw: DataFrame, keep: tuple[str, ...] = ("src_seq",)) -> DataFrame:
    """Records under any of the known field names to carrier columns.

    A field given as a list stands for its first element.
    """
    types = dict(raw.dtypes)
    flat = raw.withColumns(
        {n: c.first_element(n) for n, t in types.items() if t.startswith("array")}
    )
    flat = flat.withColumns({n: F.col(n).cast("string") for n in flat.columns if n not in keep})
    names = flat.columns
    dot = c.clean(c.first_present(names, "usdot_number", "dot_number"), 20)
    return flat.where(c.valid_dot(dot)).select(
        dot.alias("usdot_number"),
        *[c.clean(c.first_present(names, *a), w).alias(t) for t, (a, w) in TEXT_ALIASES.items()],
        *[c.loose_int(c.first_present(names, *a)).alias(t) for t, a in COUNT_ALIASES.items()],
        *_kept(raw, keep),
    )


def rejected_keys(raw: DataFrame, feed: str, width: int | None = None) -> DataFrame:
    """How many rows of a feed had no usable USDOT number, by reason."""
    dot = c.clean("dot_number", width)
    reason = F.when(dot.isNull(), "missing key").otherwise("key not all digits")
    return (
        raw.where(~c.valid_dot(dot))
        .groupBy(F.lit(feed).alias("feed"), reason.alias("reason"))
        .agg(F.count("*").alias("rows"))
    )


def unpivot_measures(basics: DataFrame) -> DataFrame:
    """Five (measure, flag) column pairs to five rows per carrier."""
    rows = [
        F.struct(
            F.lit(category).alias("basic_category"),
            F.col(f"{prefix}_measure").alias("measure"),
            F.col(f"{prefix}_ac").alias("acute"),
        )
        for prefix, category in BASIC_CATEGORIES.items()
    ]
    return basics.select("usdot_number", "insp_total", F.inline(F.array(*rows)))


def scored_only(measures: DataFrame) -> DataFrame:
    return measures.where((F.col("insp_total") > 0) & F.col("measure").isNotNull())


def summary(carriers: DataFrame) -> DataFrame:
    return carriers.select(*SUMMARY_COLUMNS)


def detail(carriers: DataFrame) -> DataFrame:
    return carriers.select(*DETAIL_COLUMNS)
