from datetime import date

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulbook.operators import directory, ranking, safety, search, stats
from haulbook.plans.tables import Tables

DIR = "/root/testdata/sf0.001"


def dots(df):
    return [r.usdot_number for r in df.collect()]


def test_list_filters(seed):
    assert sorted(dots(directory.list_carriers(seed, state="tx"))) == ["100001", "100003"]
    assert dots(directory.list_carriers(seed, state="", min_vehicles=5, max_vehicles=5)) == ["100002"]
    assert dots(directory.list_carriers(seed, safety_rating="Satisfactory")) == ["100001"]


def test_pages(seed):
    page = ranking.page_envelope(seed, page=2, per_page=2).first()
    assert (page.pages, page.total, len(page["items"])) == (2, 3, 1)
    past = ranking.page_envelope(seed, page=9, per_page=2).first()
    assert (past.pages, past.total, past["items"]) == (2, 3, [])
    none = ranking.page_envelope(seed.where("false")).first()
    assert (none.pages, none.total, none["items"]) == (1, 0, [])
    with pytest.raises(ValueError):
        ranking.page_envelope(seed, page=0)


def test_page_by_rank_is_the_same_page(seed):
    near = ranking.page_envelope(seed, page=2, per_page=2).first()
    assert ranking.page_envelope(seed, page=2, per_page=2, by_rank=True).first() == near


def test_search(seed, make_carriers):
    assert dots(directory.search(seed, "beta")) == ["100002"]
    assert dots(directory.search(seed, "100001")) == ["100001"]
    odd = make_carriers(
        {"usdot_number": "1", "legal_name": "A_B\\C"}, {"usdot_number": "2", "legal_name": "AxB 100%"},
        {"usdot_number": "3", "dba_name": "axb", "is_active": False}, {"usdot_number": "4"},
    )
    assert sorted(dots(directory.search(odd, "a_b"))) == ["1", "2", "3"]
    assert dots(directory.search(odd, "a_b", literal=True)) == ["1"]
    assert dots(directory.search(odd, "b\\c")) == ["1"]
    assert dots(directory.search(odd, "0%", literal=True)) == ["2"]
    assert sorted(dots(directory.search(odd, " "))) == ["1", "2", "3"]


def test_indexed_search_equals_scan(spark, rows_of):
    carriers = Tables(spark, DIR).carriers
    index = search.gram_index(carriers)
    for term in ("renamed", "CUSTOMER#00000001", "dba", "ab", "#0_0", "no such name", "café"):
        want = rows_of(directory.search(carriers, term).select("usdot_number"))
        assert rows_of(search.indexed_search(carriers, index, term).select("usdot_number")) == want


def test_pairs_of_names_and_terms_do_not_grow_with_their_product(spark, make_carriers, monkeypatch):
    """Terms met names by three characters: a share of all names for each of the terms."""
    monkeypatch.setattr(search, "_matches", lambda name: F.lit(True))
    pairs = {}
    for n in (500, 2000):
        numbers = [i * 48271 % 99_999_989 for i in range(1, n + 1)]
        carriers = make_carriers(*[{"usdot_number": str(i), "legal_name": f"Customer#{x:08d} Hauling"} for i, x in enumerate(numbers)])
        terms = spark.createDataFrame([(i, f"omer#{x:08d}") for i, x in enumerate(numbers)], "term_id long, term string")
        for index in (None, search.gram_index(carriers)):
            pairs[n, index is None] = search.batch_search(carriers, terms, index).count()
    assert all(n <= found < 2 * n for (n, _), found in pairs.items()), pairs


def test_batch_search_by_pieces_of_every_length(spark, make_carriers):
    """Against a comparison of every term with every name."""
    import random
    import re

    rng = random.Random(5)
    name = lambda: rng.choice([None, "", "".join(rng.choices("abAB1# ,éİ", k=rng.randint(1, 14)))])
    names = [(name(), name()) for _ in range(150)]
    carriers = make_carriers(*[{"usdot_number": f"9{i:05d}", "legal_name": a, "dba_name": b} for i, (a, b) in enumerate(names)])
    texts = []
    for _ in range(250):
        text = rng.choice([n for pair in names for n in pair if n])
        start, size = rng.randint(0, len(text)), rng.randint(3, 10)
        text = text[start : start + size]
        if rng.random() < 0.4 and text:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("%_") + text[at + 1 :]
        texts.append(text.upper() if rng.random() < 0.2 and text.isascii() else text)
    texts = [t for t in texts if t.strip() and not t.strip().isdigit()]
    rows = [(i // 2 if i % 5 else 7, t) for i, t in enumerate(texts + texts[:20])]  # ids repeat

    def hits(text):
        text = text.strip(" ").lower()
        pattern = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in text), re.S)
        return [f"9{i:05d}" for i, pair in enumerate(names) if any(pattern.search((n or "").lower()) for n in pair if n is not None)]

    wanted = sorted((i, t, dot) for i, t in rows for dot in hits(t))
    terms = spark.createDataFrame(rows, "term_id long, term string")
    for index in (None, search.gram_index(carriers)):
        assert sorted(tuple(r) for r in search.batch_search(carriers, terms, index).collect()) == wanted


def test_batch_search_equals_single_searches(spark, make_carriers):
    carriers = make_carriers(
        {"usdot_number": "11", "legal_name": "Red Line LLC", "dba_name": "RL"},
        {"usdot_number": "12", "legal_name": "Blue_Line", "mc_number": "11"},
        {"usdot_number": "13", "legal_name": None, "dba_name": "a\\b red"},
        {"usdot_number": "14", "legal_name": "", "dba_name": None},
        {"usdot_number": "15", "mc_number": "15"},
    )
    terms = ["11", " 15 ", "line", "RED", "rl", "l", "%", "_", "r_d", "e%e", "", "e_l%c", "\\b", "zzz", "blue_line", "__", "red line llc"]
    table = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    got = {}
    for r in search.batch_search(carriers, table).collect():
        got.setdefault(r.term_id, []).append(r.usdot_number)
    for i, term in enumerate(terms):
        want = sorted(dots(directory.search(carriers, term or " ")))
        assert sorted(got.get(i, [])) == want, term


def test_lookups(seed, spark):
    keys = spark.createDataFrame([("100001",), ("999999",), ("100001",)], "k string")
    assert dots(directory.lookup(seed, keys, "k")) == ["100001", "100001"]
    assert [r.k for r in directory.lookup_misses(seed, keys, "k").collect()] == ["999999"]
    slugs = spark.createDataFrame(
        [("alpha-freight-usdot-100001",), ("old-usdot-100002",), ("nothing",), ("x-usdot-77",)], "requested_slug string"
    )
    hits = {r.requested_slug: r.slug for r in directory.lookup_slugs(seed, slugs).collect()}
    assert hits == {
        "alpha-freight-usdot-100001": "alpha-freight-usdot-100001", "old-usdot-100002": "beta-logistics-usdot-100002",
    }
    assert [r.requested_slug for r in directory.redirects(seed, slugs).collect()] == ["old-usdot-100002"]


def test_top_and_slug_pages(seed):
    assert dots(ranking.top_fleets(seed, 2)) == ["100001", "100002"]
    assert ranking.slug_page(seed, 0, 2).count() == 2
    assert [r.slug for r in ranking.slug_page(seed, 1, 2).collect()] == ["gamma-haulers-usdot-100003"]


def test_exact_rank_equals_a_global_window(spark):
    carriers = Tables(spark, DIR).carriers
    got = {r.usdot_number: r.rank for r in ranking.fleet_rank(carriers).collect()}
    want = carriers.withColumn("rank", F.row_number().over(W.orderBy(*ranking.fleet_order())))
    assert got == {r.usdot_number: r.rank for r in want.collect()}
    # Keys far apart fall into different buckets.
    far = spark.range(0, 3_000_000, 1001).select(F.col("id").cast("string").alias("usdot_number"))
    ranks = ranking.dot_rank(far).collect()
    assert all(int(r.usdot_number) == (r.rank - 1) * 1001 for r in ranks)


def test_stats_by_state_and_months(seed, spark):
    inspections = spark.createDataFrame(
        [("100001", date(2026, 5, 1)), ("100001", date(2026, 5, 20)), ("100001", date(2026, 6, 3)), ("100002", None)],
        "usdot_number string, inspection_date date",
    )
    violations = inspections.limit(0).withColumnRenamed("inspection_date", "violation_date")
    scores = spark.sql("select '100001' as usdot_number, 'alert' as alert_status where false")
    got = stats.directory_stats(seed, inspections, violations, scores).first()
    assert (got.total_carriers, got.states, got.total_inspections, got.scored_carriers) == (3, 2, 4, 0)
    assert stats.carriers_by_state(seed).first() == ("TX", 2)
    history = {r.usdot_number: r for r in safety.inspection_history(inspections).collect()}
    assert history["100001"].inspections_total == 3
    assert ("2026-05", 2) in [tuple(m) for m in history["100001"].inspections_monthly]
    assert (history["100002"].inspections_total, history["100002"].inspections_monthly) == (1, [])
    assert stats.latest_month(inspections).first() == ("2026-05", 2)
    tie = inspections.where("inspection_date <> '2026-05-01'")
    assert stats.latest_month(tie).first() == ("2026-06", 1)
    assert stats.latest_month(inspections.limit(0)).first() == (None, 0)
    assert stats.alert_share(stats.directory_stats(seed, inspections, violations, scores)).first()[0] is None


def test_profile_of_a_carrier_without_records(seed, spark):
    t = Tables(spark, DIR)
    none = [df.where("false") for df in (t.scores, t.inspections, t.violations)]
    got = safety.safety_profiles(seed, *none).where("usdot_number = '100001'").first()
    assert (got.safety_scores, got.inspections, got.violations, got.inspections_monthly) == ([], [], [], [])
    assert (got.inspections_total, got.violations_total) == (0, 0)


def test_profile_lists_are_the_newest(spark):
    t = Tables(spark, DIR)
    p = safety.safety_profiles(t.carriers, t.scores, t.inspections, t.violations)
    for r in p.collect():
        days = [v.violation_date for v in r.violations]
        assert len(days) == min(10, r.violations_total) and days == sorted(days, reverse=True)
        assert sum(m["count"] for m in r.inspections_monthly) <= r.inspections_total


def test_trend_points(spark):
    df = spark.sql(
        "select array(named_struct('month','2026-01','count',2L), named_struct('month','2026-02','count',4L)) as m "
        "union all select array(named_struct('month','2026-01','count',2L))"
    )
    got = [r.t for r in df.select(stats.trend_points("m").alias("t")).collect()]
    assert sorted([g is None for g in got]) == [False, True]
    full = next(g for g in got if g)
    assert (full.points, full.first_month, full.last_month) == ([0.5, 1.0], "2026-01", "2026-02")
