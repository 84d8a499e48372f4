"""Every operator as a runnable query over one data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulbook.functions import cleaning as c
from haulbook.functions import slugs
from haulbook.operators import (
    billing, directory, documents, ledger, merges, ranking, rows, safety, search, stats, summaries,
)
from haulbook.operators.kept import KeptDirectory
from haulbook.plans.tables import AS_OF, CENSUS_LOADED, ENRICHED, MEASURED, PRICE_PLANS, Tables, in_parts
from haulbook.schemas import BASIC_CATEGORIES, CARRIERS, LEDGER, empty
from haulbook.session import fresh_dir
from haulbook.sources import feeds, pages, tables as store
from haulbook.sources.appends import AppendTable
from haulbook.sources.deltas import KeyedTable
from haulbook.streaming import feeds as streams

Query = Callable[[Tables], DataFrame]
REGISTRY: dict[str, Query] = {}

PARTNERS = {
    "insurance": "https://partner.example/insurance", "eld": "",
    "factoring": "https://partner.example/factoring",
    "compliance": "https://partner.example/compliance",
}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Dates, timestamps and decimals as text, so every engine prints them alike."""
    as_text = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("string").alias(f.name)
            if isinstance(f.dataType, as_text) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: comparable(fn(Tables(spark, sf_dir)))

    return {name: runner(fn) for name, fn in REGISTRY.items()}


# --- sources and sinks ----------------------------------------------------------------
for _name in ("census", "basics", "inspections", "violations"):
    _number = {"census": 1, "basics": 2, "inspections": 3, "violations": 4}[_name]
    query(f"s0{_number}_{_name}_scan")(
        lambda t, _name=_name: feeds.select_feed(t.feed(_name), _name)
    )


@query("s05_active_scan")
def _(t: Tables) -> DataFrame:
    return feeds.select_feed(feeds.active_only(t.census), "census")


@query("s06_resume_scan")
def _(t: Tables) -> DataFrame:
    # What an interrupted run left behind: the registrations of the first days.
    done = rows.clean_census(t.census.where("add_date <= '20240102'"))
    return feeds.resume_census(t.census, done).select("src_seq", "dot_number")


# A number that counts a feed's records up, and how far it goes within a page.
PAGED_BY = {"census": ("src_seq", 1000), "basics": ("src_id", 1000), "inspections": ("src_id", 1000), "violations": ("tie_1", 100)}


def _paged(t: Tables, feed: str) -> str:
    """A feed landed as JSON pages of at most a thousand records."""
    path = fresh_dir(t.spark, f"{feed}-pages")
    key, width = PAGED_BY[feed]
    records = feeds.select_feed(t.feed(feed), feed, () if key == "src_id" else (key,))
    pages.write_pages(records, path, F.floor(F.col(key).cast("bigint") / width))
    return path


for _number, _name in enumerate(PAGED_BY, 1):
    query(f"s0{_number}_{_name}_pages")(lambda t, _name=_name: pages.read_pages(t.spark, _name, _paged(t, _name)))


@query("s06_resume_by_id")
def _(t: Tables) -> DataFrame:
    """A load of delivered pages that stops after some of them, and the one that goes on."""
    path = _paged(t, "inspections")
    feed = pages.read_pages(t.spark, "inspections", path)
    table = AppendTable(t.spark, fresh_dir(t.spark, "inspections"), feed.schema)
    pages.load_next(feed, table, pages=2, page_size=250)
    pages.load_next(feed, table)
    return table.read()


@query("s07_bounded_scan")
def _(t: Tables) -> DataFrame:
    trial = feeds.first_pages(t.feed("basics"), pages=2, order="dot_number", page_size=250)
    return trial.select("src_id", "dot_number")


@query("s08_new_registrations")
def _(t: Tables) -> DataFrame:
    fresh = feeds.new_registrations_since(t.census, AS_OF)
    return fresh.select("src_seq", "dot_number", "add_date")


@query("s09_replace_snapshot")
def _(t: Tables) -> DataFrame:
    root = fresh_dir(t.spark, "violations")
    store.replace_snapshot(t.violations.where("oos_indicator"), root, version=1)
    store.replace_snapshot(t.violations, root, version=2, cluster_by="usdot_number, violation_date")
    store.replace_snapshot(t.violations.limit(0), root, version=3, bounded_run=True)
    return store.read_table(t.spark, root)


@query("s10_append_rows")
def _(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "inspections")
    dated = F.col("inspection_date").isNotNull()
    store.append_rows(t.inspections.where(dated), path)
    store.append_rows(t.inspections.where(~dated), path)
    return t.spark.read.parquet(path)


@query("s10_merged_folders")
def _(t: Tables) -> DataFrame:
    """Seven batches, merged by threes; what is superseded is removed at once."""
    table = AppendTable(t.spark, fresh_dir(t.spark, "inspections"), t.inspections.schema, most=3)
    parts = in_parts(t.inspections, F.col("src_id"), 7)
    for version, part in enumerate(parts):
        table.append(part, version)
    table.retire(grace_seconds=0)
    return table.read()


@query("s11_profile_export")
def _(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "profiles")
    profiles = safety.safety_profiles(t.carriers, t.scores, t.inspections, t.violations)
    store.export_profiles(profiles, path)
    back = t.spark.read.schema(profiles.schema).json(path)
    return back.select(
        "usdot_number", "safety_rating", F.size("safety_scores").alias("scores"),
        F.size("inspections").alias("inspections"), F.size("violations").alias("violations"),
        "inspections_total", "violations_total", F.size("inspections_monthly").alias("months"),
    )


@query("s12_row_counts")
def _(t: Tables) -> DataFrame:
    return stats.row_counts(
        {
            "carriers": t.carriers, "inspections": t.once("inspections"), "violations": t.once("violations"),
            "safety_scores": t.once("scores"), "subscribers": t.subscribers,
        }
    )


# --- scalar functions -----------------------------------------------------------------
@query("c01_clean_text")
def _(t: Tables) -> DataFrame:
    return t.census.select(
        "src_seq", c.clean("legal_name", 12).alias("name"), c.clean("phy_city", 100).alias("city")
    )


@query("c02_strict_int")
def _(t: Tables) -> DataFrame:
    return t.census.select("src_seq", c.strict_int("power_units").alias("power_units"))


@query("c03_loose_int")
def _(t: Tables) -> DataFrame:
    return t.feed("enrichment").select(
        "src_seq", c.loose_int("nbr_power_unit").alias("vehicles"), c.loose_int("driver_total").alias("drivers")
    )


@query("c04_num")
def _(t: Tables) -> DataFrame:
    return t.feed("basics").select("src_id", *[c.num(f"{p}_measure").alias(p) for p in BASIC_CATEGORIES])


@query("c05_feed_date")
def _(t: Tables) -> DataFrame:
    return t.feed("inspections").select("src_id", c.feed_date("insp_date").alias("day"))


@query("c06_flag")
def _(t: Tables) -> DataFrame:
    return t.feed("basics").select("src_id", *[c.flag(f"{p}_ac").alias(p) for p in BASIC_CATEGORIES])


@query("c07_valid_key")
def _(t: Tables) -> DataFrame:
    return t.census.select("src_seq", c.valid_dot(c.clean("dot_number", 20)).alias("valid"))


@query("c07_rejected_keys")
def _(t: Tables) -> DataFrame:
    return rows.rejected_keys(t.census, "census", 20).unionByName(
        rows.rejected_keys(t.feed("basics"), "basics")
    )


@query("c08_operation_name")
def _(t: Tables) -> DataFrame:
    return t.census.select("src_seq", c.operation_name("carrier_operation").alias("operation_type"))


@query("c09_fleet_cap")
def _(t: Tables) -> DataFrame:
    return t.census.select("src_seq", c.capped_fleet(c.strict_int("power_units")).alias("vehicles"))


@query("c10_active_flag")
def _(t: Tables) -> DataFrame:
    return t.census.select("src_seq", c.active_flag("status_code").alias("is_active"))


@query("c11_slug")
def _(t: Tables) -> DataFrame:
    return t.census.select(
        "src_seq", slugs.carrier_slug(c.clean("legal_name", 255), "dot_number").alias("slug")
    )


@query("c11_transliterated")
def _(t: Tables) -> DataFrame:
    """Names in Vietnamese, Greek and Cyrillic letters, and with character references."""
    return t.feed("foreign_names").select("src_seq", slugs.slugify("name").alias("slug"))


@query("c12_slug_parse")
def _(t: Tables) -> DataFrame:
    return t.feed("slug_requests").select("request_no", slugs.dot_from_slug("requested_slug").alias("dot"))


@query("c13_first_present")
def _(t: Tables) -> DataFrame:
    raw = t.feed("enrichment")
    return raw.select(
        "src_seq",
        c.first_present(raw.columns, "usdot_number", "dot_number").alias("dot"),
        c.first_present(raw.columns, "phone", "telephone").alias("phone"),
        c.first_present(raw.columns, "email", "email_address").alias("email"),
        c.first_present(raw.columns, "state", "phy_state").alias("state"),
    )


@query("c14_first_element")
def _(t: Tables) -> DataFrame:
    return t.feed("enrichment").select("src_seq", c.first_element("docket_number").alias("docket"))


@query("c15_violation_total")
def _(t: Tables) -> DataFrame:
    return t.feed("inspections").select("src_id", c.violation_total().alias("violations_found"))


@query("c16_inspection_label")
def _(t: Tables) -> DataFrame:
    return t.feed("inspections").select("src_id", c.inspection_label("insp_level_id").alias("label"))


@query("c17_report_state")
def _(t: Tables) -> DataFrame:
    return t.feed("inspections").select("src_id", c.clean("report_state", 10).alias("state"))


@query("c18_violation_fields")
def _(t: Tables) -> DataFrame:
    return rows.clean_violations(t.feed("violations"), keep=("tie_1",)).drop("usdot_number")


@query("c19_month_key")
def _(t: Tables) -> DataFrame:
    return t.feed("inspections").select("src_id", c.month_key(c.feed_date("insp_date")).alias("month"))


@query("c20_alert_label")
def _(t: Tables) -> DataFrame:
    return t.feed("basics").select(
        "src_id", *[c.alert_label(c.flag(f"{p}_ac")).alias(p) for p in BASIC_CATEGORIES]
    )


@query("c21_measure_2dp")
def _(t: Tables) -> DataFrame:
    return t.feed("basics").select(
        "src_id", *[c.measure_2dp(c.num(f"{p}_measure")).alias(p) for p in BASIC_CATEGORIES]
    )


@query("c22_state_argument")
def _(t: Tables) -> DataFrame:
    return directory.list_carriers(t.carriers, state="tx").select("usdot_number", "state")


@query("c23_api_key_hash")
def _(t: Tables) -> DataFrame:
    return t.feed("subscribers").select("subscription_id", c.api_key_hash("api_key").alias("api_key_hash"))


@query("c24_state_name")
def _(t: Tables) -> DataFrame:
    named = directory.with_state_name(t.carriers.withColumn("lowered", F.lower("state")), "lowered")
    return named.select("usdot_number", "state", "state_name")


@query("c25_xml_escape")
def _(t: Tables) -> DataFrame:
    return t.census.select(
        "src_seq",
        c.xml_escape(F.concat(F.coalesce("legal_name", F.lit("<none>")), F.lit(" & \"co\"'s"))).alias("xml"),
    )


@query("c26_thousands")
def _(t: Tables) -> DataFrame:
    return t.census.select("src_seq", c.thousands(c.strict_int("power_units")).alias("vehicles"))


@query("c27_display_defaults")
def _(t: Tables) -> DataFrame:
    return t.carriers.select(
        "usdot_number", c.display_name().alias("name"), c.display_rating().alias("rating")
    )


@query("c27_out_of_service_total")
def _(t: Tables) -> DataFrame:
    return t.inspections.select("src_id", c.out_of_service_total().alias("oos"))


# --- row builders ---------------------------------------------------------------------
query("p01_clean_census")(lambda t: rows.clean_census(t.census))
query("p02_clean_basics")(lambda t: t.basics)
query("p03_clean_inspections")(lambda t: rows.clean_inspections(t.feed("inspections")))
query("p04_clean_violations")(lambda t: rows.clean_violations(t.feed("violations")))
query("p05_map_incremental")(lambda t: rows.map_incremental(t.census))
query("p06_normalize_enrichment")(lambda t: t.enrichment)
query("p07_unpivot_measures")(lambda t: rows.unpivot_measures(t.basics))
query("p08_scored_only")(lambda t: rows.scored_only(rows.unpivot_measures(t.basics)))
query("p09_summary")(lambda t: rows.summary(t.carriers))
query("p10_detail")(lambda t: rows.detail(t.carriers))


# --- filters, searches, lookups -------------------------------------------------------
@query("f01_list_carriers")
def _(t: Tables) -> DataFrame:
    found = directory.list_carriers(
        t.carriers, operation_type="Interstate", safety_rating="", min_vehicles=100, max_vehicles=5000
    )
    return rows.summary(found)


@query("f01_list_rated")
def _(t: Tables) -> DataFrame:
    found = directory.list_carriers(t.carriers, state="ca", safety_rating="Satisfactory")
    return rows.summary(found)


@query("f02_search_number")
def _(t: Tables) -> DataFrame:
    return rows.summary(directory.search(t.carriers, " 100004 ")).unionByName(
        rows.summary(directory.search(t.carriers, "700004"))
    )


query("f03_search_name")(lambda t: rows.summary(directory.search(t.carriers, "#00000_1%llc")))
query("f03_search_plain")(lambda t: rows.summary(directory.search(t.carriers, "dba BUILD")))
query("f03_search_blank")(lambda t: rows.summary(directory.search(t.carriers, "  ")))
query("f04_batch_search")(lambda t: search.batch_search(t.carriers, t.feed("terms")))
query("f04_kept_batch_search")(lambda t: t.kept.grams.batch_search(t.kept.carriers, t.feed("terms")))
query("f05_gram_index")(lambda t: search.gram_index(t.carriers))


@query("f05_indexed_search")
def _(t: Tables) -> DataFrame:
    index = search.gram_index(t.carriers)
    return rows.summary(search.indexed_search(t.carriers, index, "Renamed"))


query("f05_kept_index")(lambda t: t.kept.grams.postings())


@query("f05_kept_search")
def _(t: Tables) -> DataFrame:
    """The index after a first load and three upserts, each followed by deltas."""
    return rows.summary(t.kept.grams.search(t.kept.carriers, "Second Supplier"))


@query("f06_lookup")
def _(t: Tables) -> DataFrame:
    keys = t.feed("basics").select(F.col("dot_number").alias("asked"), "src_id")
    return directory.lookup(t.carriers, keys, "asked").select("src_id", *rows.DETAIL_COLUMNS)


@query("f06_lookup_misses")
def _(t: Tables) -> DataFrame:
    keys = t.feed("basics").select(F.col("dot_number").alias("asked"), "src_id")
    return directory.lookup_misses(t.carriers, keys, "asked")


query("f07_lookup_slug")(lambda t: directory.lookup_slugs(t.carriers, t.feed("slug_requests")))
query("f08_in_us")(lambda t: directory.in_us(t.carriers).select("usdot_number", "state"))
query("f09_redirects")(lambda t: directory.redirects(t.carriers, t.feed("slug_requests")))


# --- joins and merges -----------------------------------------------------------------
query("j01_scores")(lambda t: t.built_scores)
query("j01_score_rejects")(lambda t: merges.score_rejects(t.basics))
query("j02_inspections")(lambda t: t.built_inspections)
query("j03_violations")(lambda t: t.built_violations)


@query("j04_resolve_batch")
def _(t: Tables) -> DataFrame:
    return merges.resolve_batch(rows.clean_violations(t.feed("violations")), t.carriers)


@query("j05_replace_scores")
def _(t: Tables) -> DataFrame:
    # The stored scores: one category of every carrier, from the load before.
    stored = t.carriers.select(
        "usdot_number",
        F.lit("Unsafe Driving").alias("basic_category"),
        F.lit("0.50").cast("decimal(8,2)").alias("score"),
        F.lit(None).cast("int").alias("percentile"),
        F.lit("ok").alias("alert_status"),
        F.lit("2024-01-01").cast("date").alias("measured_date"),
    )
    return merges.replace_scores(stored, t.basics, t.carriers, MEASURED)


@query("j06_census_upsert")
def _(t: Tables) -> DataFrame:
    # A richer directory from before March meets the whole census, inactive rows included.
    early = rows.clean_census(feeds.active_only(t.census.where("add_date < '20240301'")))
    before = merges.census_upsert(empty(t.spark, CARRIERS), early, "2024-02-01 00:00:00")
    richer = merges.field_upsert(before, t.enrichment, "2024-02-15 00:00:00")
    return merges.census_upsert(richer, rows.clean_census(t.census), CENSUS_LOADED)


query("j07_field_upsert")(lambda t: t.built_carriers)


@query("j06_delta_upsert")
def _(t: Tables) -> DataFrame:
    """As j06, with the census load as deltas to the buckets of its carriers."""
    early = rows.clean_census(feeds.active_only(t.census.where("add_date < '20240301'")))
    before = merges.census_upsert(empty(t.spark, CARRIERS), early, "2024-02-01 00:00:00")
    richer = merges.field_upsert(before, t.enrichment, "2024-02-15 00:00:00")
    table = KeyedTable(t.spark, fresh_dir(t.spark, "carriers"), CARRIERS, "usdot_number")
    table.create(richer, 0)
    load = rows.clean_census(t.census)
    table.apply(load.select("usdot_number").distinct(), lambda known: merges.census_upsert(known, load, CENSUS_LOADED), 1)
    return table.read()


query("j07_delta_upsert")(lambda t: t.kept.carriers)


@query("j07_incremental")
def _(t: Tables) -> DataFrame:
    fresh = feeds.new_registrations_since(t.census, AS_OF)
    batch = rows.normalize_enrichment(rows.map_incremental(fresh))
    return merges.field_upsert(t.first_load, batch, ENRICHED)


query("j08_fold_batch")(lambda t: merges.fold_batch(t.enrichment))


@query("j09_newest_per_key")
def _(t: Tables) -> DataFrame:
    return merges.newest_per_key(rows.clean_census(t.census), "usdot_number", "src_seq")


@query("j10_absent_unchanged")
def _(t: Tables) -> DataFrame:
    # A load of inactive rows only: whoever it does not name stays as they are.
    inactive = rows.clean_census(t.census.where("status_code <> 'A'"))
    after = merges.census_upsert(t.first_load, inactive, ENRICHED)
    return after.select("usdot_number", "legal_name", "is_active", "updated_at")


@query("j11_with_scores")
def _(t: Tables) -> DataFrame:
    item = F.transform(
        "safety_scores",
        lambda s: F.concat_ws(":", s["basic_category"], s["score"].cast("string"), s["alert_status"]),
    )
    return safety.with_scores(t.carriers, t.scores).select(
        "usdot_number", F.array_join(F.array_sort(item), "|").alias("scores")
    )


@query("j12_price_plan")
def _(t: Tables) -> DataFrame:
    events = billing.with_plan(t.feed("subscription_events"), PRICE_PLANS)
    return events.select("seq", "price_id", "plan")


@query("j12_first_price")
def _(t: Tables) -> DataFrame:
    return billing.with_plan(billing.parse_events(t.feed("event_bodies")), PRICE_PLANS)


@query("j13_request_subscriber")
def _(t: Tables) -> DataFrame:
    joined = billing.key_access(t.requests, t.subscribers)
    return joined.select("request_id", "subscription_id", "subscription_status")


# --- aggregations ---------------------------------------------------------------------
def _stats(t: Tables) -> DataFrame:
    return stats.directory_stats(t.carriers, t.inspections, t.violations, t.scores)


query("a01_directory_stats")(_stats)
query("a02_carriers_by_state")(lambda t: stats.carriers_by_state(t.carriers))
query("a03_inspections_by_month")(lambda t: stats.inspections_by_month(t.inspections))
query("a01_kept_stats")(lambda t: summaries.directory_stats(t.kept.summary))
query("a02_kept_by_state")(lambda t: summaries.carriers_by_state(t.kept.summary))
query("a03_kept_by_month")(lambda t: summaries.inspections_by_month(t.kept.summary))
query("a04_latest_month")(lambda t: stats.latest_month(t.inspections))
query("a05_new_this_week")(lambda t: stats.new_registrations(t.census, AS_OF))
query("a06_carrier_totals")(lambda t: t.totals)
query("a07_monthly_series")(lambda t: safety.monthly_series(t.inspections))
query("a08_any_alert")(lambda t: safety.any_alert(t.scores))


@query("a09_violation_rate")
def _(t: Tables) -> DataFrame:
    return t.totals.select(
        "usdot_number", c.violation_rate("violations_total", "inspections_total").alias("rate")
    )


query("a10_alert_share")(lambda t: stats.alert_share(_stats(t)))
query("a11_key_bounds")(lambda t: stats.key_bounds(rows.clean_census(t.census)))
query("a12_band_report")(lambda t: stats.band_report(rows.clean_census(t.census), width=300))


@query("a13_ingest_account")
def _(t: Tables) -> DataFrame:
    fresh = feeds.new_registrations_since(t.census, AS_OF)
    return stats.ingest_account(fresh, rows.normalize_enrichment(rows.map_incremental(fresh)))


@query("a13_observed_account")
def _(t: Tables) -> DataFrame:
    """The account that a load's own run leaves in the ledger."""
    path, out = fresh_dir(t.spark, "ledger"), fresh_dir(t.spark, "registrations")
    ledger.run_load(
        feeds.new_registrations_since(t.census, AS_OF), lambda raw: rows.normalize_enrichment(rows.map_incremental(raw)),
        lambda df: df.write.parquet(out), path, job_id=1, source="census",
    )
    done = ledger.latest_state(t.spark.read.schema(LEDGER).parquet(path)).where("status = 'completed'")
    return done.select("total_records", "processed_records")


@query("a14_trend_points")
def _(t: Tables) -> DataFrame:
    history = safety.inspection_history(t.inspections)
    trend = history.select("usdot_number", stats.trend_points("inspections_monthly").alias("t"))
    return trend.where("t is not null").select(
        "usdot_number", F.posexplode("t.points").alias("position", "point"),
        F.col("t.first_month").alias("first_month"), F.col("t.last_month").alias("last_month"),
    )


# --- orders, pages, top lists ---------------------------------------------------------
@query("k01_fleet_order")
def _(t: Tables) -> DataFrame:
    return ranking.fleet_rank(t.carriers).select("rank", "usdot_number", "total_vehicles")


@query("k02_page")
def _(t: Tables) -> DataFrame:
    page = ranking.page_envelope(directory.list_carriers(t.carriers, state="TX"), page=2, per_page=5)
    return page.select(
        F.posexplode_outer("items").alias("position", "item"), "total", "page", "per_page", "pages"
    ).select("position", "item.*", "total", "page", "per_page", "pages")


@query("k02_page_past_end")
def _(t: Tables) -> DataFrame:
    # Far behind the end: answered by rank, with no items but the right total.
    page = ranking.page_envelope(directory.list_carriers(t.carriers), page=5_000, per_page=100, by_rank=True)
    return page.select(F.size("items").alias("items"), "total", "page", "per_page", "pages")


query("k03_top_fleets")(lambda t: ranking.top_fleets(t.carriers, 100))
query("k04_slug_pages")(lambda t: ranking.slug_pages(t.carriers, per_page=100))


@query("k05_latest_inspections")
def _(t: Tables) -> DataFrame:
    return safety.latest_inspections(t.inspections).select(
        "usdot_number", "rn", "src_id", "inspection_date", "inspection_type", "violations_found"
    )


@query("k06_latest_violations")
def _(t: Tables) -> DataFrame:
    return safety.latest_violations(t.violations).select(
        "usdot_number", "rn", "violation_code", "violation_date", "tie_1", "tie_2", "tie_3"
    )


query("k07_top_states")(lambda t: stats.top_states(t.carriers))
query("k08_state_positions")(lambda t: documents.state_positions(t.carriers))
query("k09_last_success")(lambda t: ledger.last_success(t.ledger))
query("u01_union_of_counts")(REGISTRY["s12_row_counts"])


@query("u02_batch_keys")
def _(t: Tables) -> DataFrame:
    return merges.batch_keys(rows.clean_violations(t.feed("violations")))


# --- documents ------------------------------------------------------------------------
@query("d01_profile_parts")
def _(t: Tables) -> DataFrame:
    """The nested profiles, flattened to one line per entry."""
    p = safety.safety_profiles(t.carriers, t.scores, t.inspections, t.violations)

    def line(*values):
        return F.concat_ws(";", *[F.coalesce(v.cast("string"), F.lit("-")) for v in values])

    def entry(part, position, text):
        return F.struct(F.lit(part).alias("part"), position.alias("position"), text.alias("entry"))

    def lines(part, text):
        return F.transform(part, lambda x, i: entry(part, i, text(x)))

    totals = entry(
        "totals", F.lit(0),
        line(F.col("safety_rating"), F.col("inspections_total"), F.col("violations_total")),
    )
    every_line = F.concat(
        F.array(totals),
        lines("safety_scores", lambda s: line(s["basic_category"], s["score"], s["alert_status"])),
        lines(
            "inspections",
            lambda i: line(i["inspection_date"], i["inspection_type"], i["violations_found"], i["state"]),
        ),
        lines(
            "violations", lambda v: line(v["violation_date"], v["violation_code"], v["severity_weight"])
        ),
        lines("inspections_monthly", lambda m: line(m["month"], m["count"])),
    )
    return p.select("usdot_number", F.inline(every_line))


query("d02_answers")(lambda t: documents.answers(t.document_base))


@query("d03_faqs")
def _(t: Tables) -> DataFrame:
    return documents.faqs(t.document_base).select("usdot_number", F.inline("faqs"))


def _json_query(column) -> Query:
    return lambda t: t.document_base.select("usdot_number", column().alias("document"))


query("d04_organization_json")(_json_query(documents.organization_json))
query("d05_breadcrumb_json")(_json_query(documents.breadcrumb_json))
query("d06_faq_json")(_json_query(documents.faq_json))
query("d07_page_metadata")(lambda t: documents.page_metadata(t.document_base))
query("d08_coverage")(lambda t: documents.coverage(t.document_base))


@query("d09_offers")
def _(t: Tables) -> DataFrame:
    offers = documents.ranked_offers(t.document_base, safety.any_alert(t.once("scores")), PARTNERS)
    return offers.select("usdot_number", F.array_join("offers.category", ",").alias("offers"))


query("d10_state_item_lists")(lambda t: documents.state_item_lists(t.carriers))
query("d11_sitemap_urls")(lambda t: documents.sitemap_urls(t.carriers, per_file=400))
query("d11_sitemap_files")(lambda t: documents.sitemap_files(t.carriers, per_file=400))
query("d12_sitemap_index")(lambda t: documents.sitemap_index(t.carriers, per_file=400))
query("d12_sitemap_index_xml")(lambda t: documents.sitemap_index_xml(t.carriers, per_file=400))


@query("d13_fleet_sanity")
def _(t: Tables) -> DataFrame:
    checked = stats.fleet_sanity(t.carriers, t.totals)
    return checked.select("usdot_number", "total_vehicles")


@query("d14_home_summary")
def _(t: Tables) -> DataFrame:
    return _home(stats.home_summary(
        _stats(t), stats.top_states(t.carriers), stats.latest_month(t.inspections),
        stats.new_registrations(t.census, AS_OF),
    ))


@query("d14_kept_home")
def _(t: Tables) -> DataFrame:
    return _home(summaries.home_summary(t.kept.summary, stats.new_registrations(t.census, AS_OF)))


def _home(home: DataFrame) -> DataFrame:
    return home.select(
        "stats.*", "alerts.*", "month.*", "week.*",
        F.array_join(
            F.transform("top_states", lambda s: F.concat_ws(":", s["state"], s["count"].cast("string"))), ","
        ).alias("top_states"),
    )


# --- subscriptions, metering, ledger --------------------------------------------------
def _subscriptions(t: Tables) -> DataFrame:
    return billing.fold_subscriptions(t.feed("subscription_events"), PRICE_PLANS, t.subscribers)


FOLDED = ("subscription_id", "customer_id", "plan", "status", "monthly_quota")
query("b01_subscription_fold")(lambda t: _subscriptions(t).select(*FOLDED))


@query("b02_access")
def _(t: Tables) -> DataFrame:
    return billing.key_access(t.requests, t.subscribers).select("request_id", "access")


@query("b02_bearer_access")
def _(t: Tables) -> DataFrame:
    """The key comes in an `Authorization` header; one of another scheme is no key."""
    scheme = F.when(F.col("request_id") % 13 == 0, "Basic ").when(F.col("request_id") % 2 == 0, "BEARER ").otherwise("Bearer ")
    sent = t.requests.withColumn("authorization", F.concat(scheme, "api_key")).drop("api_key")
    keyed = sent.withColumn("api_key", c.bearer_token("authorization"))
    return billing.key_access(keyed, t.subscribers).select("request_id", "access")


query("b03_metered_requests")(lambda t: billing.metered_requests(t.requests, t.subscribers))


@query("b04_usage_report")
def _(t: Tables) -> DataFrame:
    return billing.usage_report(billing.updated_usage(t.requests, t.subscribers))


@query("b05_ledger_state")
def _(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "ledger")
    events = t.feed("ledger")
    ledger.append_events(events.where("status = 'running'"), path)
    ledger.append_events(events.where("status <> 'running'"), path)
    return ledger.latest_state(t.spark.read.schema(LEDGER).parquet(path))


query("b06_due_sources")(lambda t: ledger.due_sources(t.ledger, "2024-01-31 12:00:00"))


# --- streams --------------------------------------------------------------------------
def _deliver(
    t: Tables, feed: DataFrame, key, label: str, start, deliveries: int = 3, again: bool = False,
    keys: DataFrame | None = None,
) -> None:
    """Lands a feed in several deliveries, in the order of the numeric `key` (see `in_parts`), and
    lets the stream catch up after each; with `again` all of it is delivered once more.

    Every start of the stream resumes at its checkpoint.
    """
    path = fresh_dir(t.spark, label)
    for part in in_parts(feed, key, deliveries, keys) + ([feed] if again else []):
        part.write.mode("append").parquet(path)
        running = start(streams.feed_stream(t.spark, path, feed.schema))
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()


@query("t01_incremental_stream")
def _(t: Tables) -> DataFrame:
    directory, checkpoint = KeptDirectory(t.spark, fresh_dir(t.spark, "directory")), fresh_dir(t.spark, "checkpoint")
    directory.create(t.first_load, version=-1)
    fresh = feeds.new_registrations_since(t.census, AS_OF)
    _deliver(
        t, fresh, F.col("src_seq"), "census-feed",
        lambda s: streams.incremental_census(s, directory, checkpoint, ENRICHED), again=True,
    )
    return directory.carriers


@query("t02_direct_violations_stream")
def _(t: Tables) -> DataFrame:
    out, checkpoint = fresh_dir(t.spark, "violations"), fresh_dir(t.spark, "checkpoint")
    _deliver(
        t, t.feed("violations"), F.col("tie_1"), "violations-feed",
        lambda s: streams.direct_violations(s, t.carriers, out, checkpoint), keys=t.violation_keys,
    )
    return AppendTable(t.spark, out, t.built_violations.schema).read()


@query("t03_once_per_row_stream")
def _(t: Tables) -> DataFrame:
    root, checkpoint = fresh_dir(t.spark, "inspections"), fresh_dir(t.spark, "checkpoint")
    _deliver(
        t, t.feed("inspections"), F.col("src_id"), "inspections-feed",
        lambda s: streams.once_per_source_row(s, rows.clean_inspections, root, checkpoint),
        again=True,
    )
    return AppendTable(t.spark, root, rows.clean_inspections(t.feed("inspections")).schema, "src_id").read()


@query("t04_metering_stream")
def _(t: Tables) -> DataFrame:
    out, state = fresh_dir(t.spark, "metered"), fresh_dir(t.spark, "usage")
    checkpoint = fresh_dir(t.spark, "checkpoint")
    _deliver(
        t, t.requests, F.col("request_id"), "request-feed",
        lambda s: streams.metered_stream(s, lambda: t.subscribers, state, out, checkpoint),
    )
    return t.spark.read.parquet(out).drop("batch")


@query("t04_changing_subscribers_stream")
def _(t: Tables) -> DataFrame:
    """Two deliveries of requests; between them the subscribers change."""
    out, state = fresh_dir(t.spark, "metered"), fresh_dir(t.spark, "usage")
    checkpoint, path = fresh_dir(t.spark, "checkpoint"), fresh_dir(t.spark, "request-feed")
    ends = t.requests.agg(F.min("request_id").alias("low"), F.max("request_id").alias("high")).first()
    middle = (ends.low + ends.high) // 2
    for part, known in (("request_id <= {}", t.subscribers), ("request_id > {}", t.subscribers_later)):
        t.requests.where(part.format(middle)).write.mode("append").parquet(path)
        running = streams.metered_stream(
            streams.feed_stream(t.spark, path, t.requests.schema), lambda known=known: known, state, out, checkpoint
        )
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
    return t.spark.read.parquet(out).drop("batch")


@query("t05_subscription_stream")
def _(t: Tables) -> DataFrame:
    root, checkpoint = fresh_dir(t.spark, "subscriptions"), fresh_dir(t.spark, "checkpoint")
    streams.subscriber_table(t.spark, root).create(t.subscribers, version=-1)
    _deliver(
        t, t.feed("subscription_events"), F.col("seq"), "subscription-feed",
        lambda s: streams.subscription_stream(s, PRICE_PLANS, root, checkpoint),
    )
    return streams.subscriber_table(t.spark, root).read().select(*FOLDED)


@query("t06_monthly_counts_stream")
def _(t: Tables) -> DataFrame:
    root, checkpoint = fresh_dir(t.spark, "months"), fresh_dir(t.spark, "checkpoint")
    _deliver(
        t, t.inspections, F.col("src_id"), "inspection-feed",
        lambda s: streams.monthly_counts_stream(s, root, checkpoint),
    )
    return store.read_table(t.spark, root)
