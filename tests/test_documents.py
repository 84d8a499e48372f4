import json

import pytest

from haulbook.operators import documents, stats


@pytest.fixture(scope="module")
def base(spark, make_carriers):
    carriers = make_carriers(
        {"usdot_number": "1", "legal_name": "Big O'Hare & Co", "city": "AUSTIN", "state": "TX", "total_vehicles": 1234,
         "total_drivers": 2000, "slug": "big-usdot-1", "address": "1 MAIN", "zip": "78701", "operation_type": "Interstate",
         "authority_status": "AUTHORIZED"},
        {"usdot_number": "2", "city": "CALGARY", "state": "AB", "total_vehicles": 10, "slug": "carrier-usdot-2",
         "operation_type": "Intrastate Hazmat"},
        {"usdot_number": "3", "legal_name": "Tiny", "total_vehicles": 0, "total_drivers": 3, "slug": "tiny-usdot-3",
         "operation_type": "Intrastate Non-Hazmat"},
    )
    totals = spark.createDataFrame(
        [("1", 1500, 2999), ("2", 2, 4)], "usdot_number string, inspections_total long, violations_total long"
    )
    return documents.document_base(carriers.join(totals, "usdot_number", "left").fillna(0, ["inspections_total", "violations_total"]))


def by_dot(df, name):
    return {r.usdot_number: r[name] for r in df.collect()}


def test_answers_leave_out_unknown_parts(base):
    got = by_dot(documents.answers(base), "answer")
    assert got["1"] == (
        "USDOT 1 is the FMCSA registration number for Big O'Hare & Co, a motor carrier based in AUSTIN, TX."
        " The company operates 1,234 vehicles with 2,000 drivers."
        " It has 1,500 roadside inspections and 2,999 violations on record in the last 24 months."
    )
    assert got["2"].startswith("USDOT 2 is the FMCSA registration number for USDOT 2, a motor carrier based in CALGARY, AB.")
    assert " The company operates 10 vehicles. It has 2" in got["2"]
    assert got["3"] == "USDOT 3 is the FMCSA registration number for Tiny."


def test_questions_depend_on_violations_and_status(base):
    got = by_dot(documents.faqs(base), "faqs")
    assert [len(got[d]) for d in "123"] == [3, 3, 2]
    assert got["1"][2].a == "Big O'Hare & Co's registration status is AUTHORIZED according to FMCSA records."
    assert "registered with the FMCSA under USDOT 3" in got["3"][1].a


def test_json_documents(base):
    docs = {r.usdot_number: r for r in documents.carrier_documents(base, "https://s.example").collect()}
    organization = json.loads(docs["1"].organization_json)
    assert organization["url"] == "https://s.example/carrier/big-usdot-1"
    assert organization["address"] == {
        "@type": "PostalAddress", "streetAddress": "1 MAIN", "addressLocality": "AUSTIN", "addressRegion": "TX",
        "postalCode": "78701", "addressCountry": "US",
    }
    assert set(json.loads(docs["3"].organization_json)) == {"@context", "@type", "name", "identifier", "url"}
    crumbs = {d: json.loads(docs[d].breadcrumb_json)["itemListElement"] for d in "123"}
    assert [len(crumbs[d]) for d in "123"] == [3, 2, 2]
    assert crumbs["1"][1] == {"@type": "ListItem", "position": 2, "name": "Texas", "item": "https://s.example/state/tx"}
    assert crumbs["2"][1]["position"] == 2
    assert len(json.loads(docs["3"].faq_json)["mainEntity"]) == 2


def test_coverage(base):
    got = by_dot(documents.coverage(base), "coverage")
    assert got == {
        "1": "Interstate (operates across state lines)", "2": "AB only (Intrastate Hazmat)",
        "3": "Home state only (Intrastate Non-Hazmat)",
    }


def test_offers(base, spark):
    urls = {k: f"https://p.example/{k}" for k in ("insurance", "eld", "factoring", "compliance")}
    alerts = spark.createDataFrame([("3", True)], "usdot_number string, any_alert boolean")
    got = {d: [o.category for o in offers] for d, offers in by_dot(documents.ranked_offers(base, alerts, urls), "offers").items()}
    # 1: large and clean; 2: two violations per inspection; 3: an open alert.
    assert got == {"1": ["insurance", "eld"], "2": ["compliance", "insurance"], "3": ["compliance", "insurance"]}
    calm = alerts.where("false")
    got = by_dot(documents.ranked_offers(base, calm, {**urls, "insurance": ""}), "offers")
    assert [o.category for o in got["3"]] == ["factoring", "eld"]
    assert by_dot(documents.ranked_offers(base, calm, {}), "offers")["1"] == []


def test_state_lists_number_over_pages(make_carriers):
    carriers = make_carriers(
        *[{"usdot_number": str(i), "legal_name": f"C{i}", "state": "TX", "total_vehicles": i, "slug": f"c-usdot-{i}"} for i in range(1, 31)]
    )
    docs = {(r.state, r.page): json.loads(r.document) for r in documents.state_item_lists(carriers).collect()}
    assert len(docs) == 55
    first, second = docs["TX", 1], docs["TX", 2]
    assert (first["numberOfItems"], len(first["itemListElement"]), len(second["itemListElement"])) == (30, 10, 5)
    assert first["itemListElement"][0]["name"] == "C30" and second["itemListElement"][0]["position"] == 26
    assert docs["GU", 1]["itemListElement"] == [] and docs["GU", 1]["numberOfItems"] == 0


def test_sitemap_index_counts_carriers_without_slug(make_carriers):
    carriers = make_carriers({"usdot_number": "1"}, {"usdot_number": "2", "slug": "b-usdot-2"}, {"usdot_number": "3", "is_active": False})
    assert documents.sitemap_index(carriers, per_file=1).count() == 3
    files = {r.file for r in documents.sitemap_files(carriers, per_file=1).collect()}
    assert files == {0, 1}
    assert documents.sitemap_index(carriers.where("false")).count() == 2


def test_fleet_sanity(make_carriers, spark):
    fleets = {"1": 1000, "2": 1001, "3": 5001, "4": 5001, "5": 5000, "6": None}
    carriers = make_carriers(*[{"usdot_number": d, "total_vehicles": v} for d, v in fleets.items()])
    totals = spark.createDataFrame([("3", 50), ("4", 51), ("5", 1)], "usdot_number string, inspections_total long")
    got = by_dot(stats.fleet_sanity(carriers, totals), "total_vehicles")
    assert got == {"1": 1000, "2": None, "3": None, "4": 5001, "5": 5000, "6": None}
