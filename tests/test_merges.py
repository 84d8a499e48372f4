from datetime import datetime

import pytest
from pyspark.sql import functions as F

from haulbook.operators import merges, rows
from haulbook.plans.tables import AS_OF, Tables
from haulbook.schemas import CARRIERS, SCORES, empty
from haulbook.sources import feeds

DIR = "/root/testdata/sf0.001"
NOW = "2026-07-10 00:00:00"
# The records and expected values below are fixed values: results that must come out alike.


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DIR)


def enrich(spark, *records):
    """Each record a dict under feed names; the order given is the order of arrival."""
    names = sorted({k for r in records for k in r})
    raw = spark.createDataFrame(
        [(i, *[r.get(n) for n in names]) for i, r in enumerate(records)],
        "src_seq long, " + ", ".join(f"{n} string" for n in names),
    )
    return rows.normalize_enrichment(raw)


def test_field_upsert_of_official_record(spark):
    record = {
        "dot_number": "123456", "legal_name": "OFFICIAL FREIGHT LLC", "email_address": "dispatch@example.com",
        "nbr_power_unit": "12", "driver_total": "15", "phy_state": "TX",
    }
    got = merges.field_upsert(empty(spark, CARRIERS), enrich(spark, record), NOW).first()
    assert (got.email, got.total_vehicles, got.total_drivers, got.state) == ("dispatch@example.com", 12, 15, "TX")
    assert got.slug == "official-freight-llc-usdot-123456"
    assert got.is_active and got.last_scraped_at == datetime(2026, 7, 10)


def test_field_upsert_never_erases(spark):
    first = {"dot_number": "123456", "legal_name": "FIRST NAME", "email_address": "a@example.com"}
    one = merges.field_upsert(empty(spark, CARRIERS), enrich(spark, first), NOW)
    two = merges.field_upsert(one, enrich(spark, {"dot_number": "123456", "legal_name": "UPDATED NAME"}), NOW)
    got = two.first()
    assert (got.legal_name, got.email, got.slug) == ("UPDATED NAME", "a@example.com", "first-name-usdot-123456")


def test_bad_keys_are_rejected(spark):
    assert enrich(spark, {"dot_number": "not-a-number"}).count() == 0


def test_fold_takes_the_last_value_of_each_field(spark):
    batch = enrich(
        spark,
        {"dot_number": "1", "legal_name": "A", "phone": "1"},
        {"dot_number": "1", "legal_name": "B", "phone": ""},
        {"dot_number": "1", "email": "x"},
    )
    got = merges.fold_batch(batch).first()
    assert (got.legal_name, got.phone, got.email) == ("B", "1", "x")


def test_upserts_are_idempotent(t, rows_of):
    staged = rows.clean_census(feeds.active_only(t.census))
    again = merges.census_upsert(t.first_load, staged, "2024-03-01 00:00:00")
    assert rows_of(again) == rows_of(t.first_load)
    twice = merges.field_upsert(t.built_carriers, t.enrichment, "2024-03-05 00:00:00")
    assert rows_of(twice) == rows_of(t.built_carriers)
    scores = merges.replace_scores(empty(t.spark, SCORES), t.basics, t.carriers, "2024-02-01")
    assert rows_of(merges.replace_scores(scores, t.basics, t.carriers, "2024-02-01")) == rows_of(scores)


def test_census_upsert_keeps_slug_absent_carriers_and_richer_fields(make_carriers, spark):
    old = make_carriers(
        {"usdot_number": "1", "legal_name": "OLD", "dba_name": "D", "slug": "old-usdot-1", "phone": "9"},
        {"usdot_number": "2", "legal_name": "STAYS", "slug": "stays-usdot-2"},
    )
    raw = spark.createDataFrame(
        [(1, "1", "NEW", None, "I"), (2, "1", "NEWER", None, "I"), (3, "3", "THIRD", "4504505", "A")],
        "src_seq long, dot_number string, legal_name string, power_units string, status_code string",
    )
    for name in ("phy_street", "phy_city", "phy_state", "phy_zip", "phone", "carrier_operation", "business_org_desc"):
        raw = raw.withColumn(name, F.lit(None).cast("string"))
    got = {r.usdot_number: r for r in merges.census_upsert(old, rows.clean_census(raw), NOW).collect()}
    assert (got["1"].legal_name, got["1"].slug, got["1"].dba_name, got["1"].phone) == ("NEWER", "old-usdot-1", "D", "9")
    assert got["1"].is_active is False
    assert (got["2"].is_active, got["2"].updated_at) == (True, None)
    assert (got["3"].slug, got["3"].total_vehicles) == ("third-usdot-3", None)


def test_scores_replace_per_carrier(spark, make_carriers):
    carriers = make_carriers(*[{"usdot_number": d} for d in "1234"])
    fields = [f for f in feeds.FEEDS["basics"] if f != ":id"]
    given = {
        "1": {"insp_total": "3", "hos_driv_measure": "1.005", "hos_driv_ac": "Y"},
        "2": {"insp_total": "0", "hos_driv_measure": "1"},
        "9": {"insp_total": "3", "hos_driv_measure": "1"},
        "4": {"insp_total": "1", "hos_driv_measure": "12345678"},
    }
    raw = spark.createDataFrame(
        [tuple({"dot_number": d, **v}.get(f) for f in fields) for d, v in given.items()],
        ", ".join(f"{f} string" for f in fields),
    )
    basics = rows.clean_basics(raw)
    stored = spark.sql(
        "select d as usdot_number, 'HOS Compliance' as basic_category, cast(9 as decimal(8,2)) as score, "
        "cast(null as int) as percentile, 'ok' as alert_status, date '2024-01-01' as measured_date "
        "from values ('1'), ('2'), ('3') as v(d)"
    )
    got = merges.replace_scores(stored, basics, carriers, "2024-02-01").collect()
    # 2 had no inspection and ends with none, 3 was not in the load, 9 is not in the directory.
    assert sorted((r.usdot_number, str(r.score), r.alert_status) for r in got) == [
        ("1", "1.01", "alert"), ("3", "9.00", "ok"),
    ]
    assert [r.usdot_number for r in merges.score_rejects(basics).collect()] == ["4"]


def test_resume_scans(t):
    assert feeds.resume_census(t.census, rows.clean_census(t.census)).count() == 0
    nothing = rows.clean_census(t.census).limit(0)
    numeric = t.census.where("dot_number rlike '^[0-9]+$'").count()
    assert feeds.resume_census(t.census, nothing).count() == numeric
    ids = t.feed("basics")
    assert feeds.resume_by_id(ids, ids.where("src_id <= '5'")).count() == ids.where("src_id > '5'").count()
    assert feeds.resume_by_id(ids, ids.limit(0)).count() == ids.count()


def test_census_json_pages(spark, tmp_path):
    import json

    page = [
        {"dot_number": "1", "legal_name": "A", "status_code": "A", "add_date": "20240101", "extra": "z"},
        {"dot_number": "2", "status_code": "I"},
    ]
    (tmp_path / "page1.json").write_text(json.dumps(page))
    got = feeds.read_feed(spark, "census", str(tmp_path), extra=("add_date",))
    assert got.columns[-1] == "add_date" and got.count() == 2
    assert feeds.active_only(got).select("dot_number", "phone").collect()[0] == ("1", None)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "p.json").write_text(json.dumps([{":id": "row-1", "dot_number": "5"}]))
    assert feeds.read_feed(spark, "violations", str(tmp_path / "b")).first().src_id == "row-1"


def test_incremental_record(spark):
    raw = spark.createDataFrame(
        [("4600001", "NEW HAULER LLC", "1 NEW RD", "AUSTIN", "TX", "78701", "5125550100", "A", "LLC", "3", "A", "20240301", 1)],
        "dot_number string, legal_name string, phy_street string, phy_city string, phy_state string, phy_zip string, "
        "phone string, carrier_operation string, business_org_desc string, power_units string, status_code string, "
        "add_date string, src_seq long",
    )
    fresh = feeds.new_registrations_since(raw, AS_OF)
    got = merges.field_upsert(
        empty(spark, CARRIERS), rows.normalize_enrichment(rows.map_incremental(fresh)), NOW
    ).first()
    assert (got.legal_name, got.state, got.operation_type, got.total_vehicles) == ("NEW HAULER LLC", "TX", "Interstate", 3)
    assert got.slug == "new-hauler-llc-usdot-4600001"
