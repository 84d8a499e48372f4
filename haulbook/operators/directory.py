"""Directory queries: filters, single searches and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulbook.functions import cleaning as c
from haulbook.functions.slugs import dot_from_slug
from haulbook.schemas import STATE_NAMES, US_STATE_CODES, constant_table


def list_carriers(
    carriers: DataFrame,
    state: str | None = None,
    operation_type: str | None = None,
    safety_rating: str | None = None,
    min_vehicles: int | None = None,
    max_vehicles: int | None = None,
) -> DataFrame:
    """Active carriers under the given filters; an empty text argument is no filter."""
    out = carriers.where("is_active")
    if state:
        out = out.where(F.col("state") == F.upper(F.lit(state)))
    if operation_type:
        out = out.where(F.col("operation_type") == operation_type)
    if safety_rating:
        out = out.where(F.col("safety_rating") == safety_rating)
    if min_vehicles is not None:
        out = out.where(F.col("total_vehicles") >= min_vehicles)
    if max_vehicles is not None:
        out = out.where(F.col("total_vehicles") <= max_vehicles)
    return out


def like_pattern(term: str, literal: bool = False) -> str:
    """Contains-pattern of a term. `%` and `_` in it act as wildcards unless `literal`."""
    term = term.replace("\\", "\\\\")
    if literal:
        term = term.replace("%", "\\%").replace("_", "\\_")
    return f"%{term}%"


def search(carriers: DataFrame, q: str, literal: bool = False) -> DataFrame:
    """Digits search the USDOT and MC numbers, anything else the two names.

    Inactive carriers are found too. A blank term matches every carrier with a name.
    """
    if not 1 <= len(q) <= 100:
        raise ValueError("a search term has 1 to 100 characters")
    term = q.strip()
    if term.isdigit():
        return carriers.where((F.col("usdot_number") == term) | (F.col("mc_number") == term))
    pattern = like_pattern(term, literal)
    return carriers.where(F.col("legal_name").ilike(pattern) | F.col("dba_name").ilike(pattern))


def lookup(carriers: DataFrame, keys: DataFrame, key: str = "usdot_number") -> DataFrame:
    """Carriers for a table of USDOT numbers, one row per requested row that hits."""
    return keys.join(carriers, keys[key] == carriers["usdot_number"]).drop(keys[key])


def lookup_misses(carriers: DataFrame, keys: DataFrame, key: str = "usdot_number") -> DataFrame:
    return keys.join(carriers, keys[key] == carriers["usdot_number"], "left_anti")


def lookup_slugs(carriers: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (with a `requested_slug`) and the carrier each leads to.

    An exact slug wins; otherwise the USDOT number at the end of the slug decides.
    """
    exact = carriers.select(
        F.col("slug").alias("requested_slug"), F.col("usdot_number").alias("exact_dot"),
        F.col("slug").alias("exact_slug"),
    )
    by_number = carriers.select(
        F.col("usdot_number").alias("asked_dot"), F.col("usdot_number").alias("number_dot"),
        F.col("slug").alias("number_slug"),
    )
    tried = requests.join(exact, "requested_slug", "left")
    # Requests that need no second look get a key that spreads and can match nothing.
    unmatchable = F.concat(F.lit("#"), F.col("requested_slug"))
    number = F.when(F.col("exact_dot").isNull(), dot_from_slug("requested_slug"))
    return (
        tried.withColumn("asked_dot", F.coalesce(number, unmatchable))
        .join(by_number, "asked_dot", "left")
        .select(
            *requests.columns,
            F.coalesce("exact_dot", "number_dot").alias("usdot_number"),
            F.coalesce("exact_slug", "number_slug").alias("slug"),
        )
        .where(F.col("usdot_number").isNotNull())
    )


def find_slugs(carriers: DataFrame, slugs: list[str]) -> DataFrame:
    """A few slugs, by slug or else by the number at their end: slug asked for, carrier's
    number and slug.

    The values reach the file scan; a table published with `blooms=("slug",)` and clustered by
    USDOT number is read in the row groups of these carriers alone.
    """
    spark = carriers.sparkSession
    asked = spark.createDataFrame([(s,) for s in sorted(set(slugs))], "requested_slug string")
    numbers = [n for s in sorted(set(slugs)) if (n := s.rpartition("-usdot-")[2]).isdigit() and "-usdot-" in s]
    few = carriers.select("usdot_number", "slug")
    held = few.where(F.col("slug").isin(slugs)).unionByName(few.where(F.col("usdot_number").isin(numbers))).distinct()
    return lookup_slugs(held, asked)


def redirects(carriers: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested slugs that are not the canonical one, with where they lead."""
    hits = lookup_slugs(carriers, requests)
    return hits.where(F.col("requested_slug") != F.col("slug"))


def in_us(carriers: DataFrame) -> DataFrame:
    return carriers.where(F.col("state").isin(*US_STATE_CODES))


def state_table(spark: SparkSession) -> DataFrame:
    return constant_table(spark, STATE_NAMES, "state_code", "state_name")


def with_state_name(rows: DataFrame, state: str = "state") -> DataFrame:
    """Adds `state_code` and `state_name`, null where the code has no state page.

    The table is the fixed one of 54 codes, hence the broadcast.
    """
    states = F.broadcast(state_table(rows.sparkSession))
    return rows.join(states, F.upper(c.col(state)) == F.col("state_code"), "left")
