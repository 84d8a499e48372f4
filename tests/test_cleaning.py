from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from haulbook.functions import cleaning as c
from haulbook.functions.slugs import carrier_slug, dot_from_slug
from haulbook.operators import rows


@pytest.fixture(scope="module")
def apply(spark):
    def run(fn, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_clean(apply):
    got = apply(lambda x: c.clean(x, 5), [None, "", "  ", "\t ab\n", "abcdefgh", " x ", " abcd efgh"])
    assert got == [None, None, None, "ab", "abcde", "x", "abcd "]


def test_strict_int(apply):
    values = [None, "", "12", " 12 ", "12.0", "+7", "-3", "n/a", "1,000", "99999999999", " 5", "0012", "1 2"]
    want = [None, None, 12, 12, None, 7, -3, None, None, None, 5, 12, None]
    assert apply(c.strict_int, values) == want


def test_loose_int(apply):
    assert apply(c.loose_int, ["1,234", " 12 ", "1,2,3", "", None, "x", ","]) == [1234, 12, 123, None, None, None, None]


def test_num_is_exact(apply):
    got = apply(lambda x: c.measure_2dp(c.num(x)), ["1.005", "1.0049999996", "2", "-1.005", "bad", "", None, "nan", "1e2", " .5 ", "9999999"])
    want = ["1.01", "1.00", "2.00", "-1.01", None, None, None, None, "100.00", "0.50", None]
    assert got == [None if w is None else Decimal(w) for w in want]


def test_feed_date(apply):
    values = [
        "05-JAN-24", "5-jan-24", " 05-Jan-24 ", "2024-01-05", "2024-1-5", "2024-01-05T00:00:00.000",
        "31-DEC-68", "01-JAN-69", "29-FEB-96", "30-FEB-24", "2024-02-30", "05-JAN-2024", "2024-01",
        "unknown", "", None, "20240105", "2024-1-5T00:00", "2024-1-5 1",
    ]
    want = [
        date(2024, 1, 5), date(2024, 1, 5), date(2024, 1, 5), date(2024, 1, 5), date(2024, 1, 5), date(2024, 1, 5),
        date(2068, 12, 31), date(1969, 1, 1), date(1996, 2, 29), None, None, None, None,
        None, None, None, None, None, None,
    ]
    assert apply(c.feed_date, values) == want


def test_flag(apply):
    assert apply(c.flag, ["Y", "yes", " TRUE ", "1", "N", "", "0", None]) == [True] * 4 + [False] * 3 + [None]


def test_alert_label_treats_unknown_as_ok(apply):
    assert apply(lambda x: c.alert_label(c.flag(x)), ["Y", "N", None]) == ["alert", "ok", "ok"]


def test_valid_dot(apply):
    values = ["1", "12345678901234567890", "123456789012345678901", "12a", "", None, "-1"]
    assert apply(c.valid_dot, values) == [True, True, False, False, False, False, False]


def test_operation_and_fleet_cap(spark, apply):
    assert apply(c.operation_name, ["A", "B", "C", "X", None]) == [
        "Interstate", "Intrastate Hazmat", "Intrastate Non-Hazmat", None, None,
    ]
    got = apply(lambda x: c.capped_fleet(c.strict_int(x)), ["150000", "150001", "4504505", None])
    assert got == [150000, None, None, None]


def test_slugs(spark):
    pairs = [
        ("ACME Trucking, LLC.", "123456", "acme-trucking-llc-usdot-123456"),
        (None, "99", "carrier-usdot-99"),
        ("???", "1", "carrier-usdot-1"),
        ("Peña's 1,000 & Sons", "7", "pena-s-1000-sons-usdot-7"),
        ("Straße Æro Łódź", "8", "strasse-aero-lodz-usdot-8"),
        ("A &amp; B", "9", "a-b-usdot-9"),
        ("x" * 300, "5", "x" * 200 + "-usdot-5"),
    ]
    df = spark.createDataFrame(pairs, "n string, d string, want string")
    for r in df.select("want", carrier_slug("n", "d").alias("got")).collect():
        assert r.got == r.want


def test_slug_parse(apply):
    values = ["some-carrier-usdot-42", "not-a-carrier-slug", "a-usdot-1-usdot-2", "a-usdot-1-usdot-x", "a-usdot-", None]
    assert apply(dot_from_slug, values) == ["42", None, "2", None, None, None]


def test_bearer_token(apply):
    values = ["Bearer abc", "bearer  abc ", "Basic abc", "Bearer ", "Bearer", None]
    assert apply(c.bearer_token, values) == ["abc", "abc", None, None, None, None]


def test_text_helpers(apply):
    assert apply(c.xml_escape, ["a&b<c>\"d'"]) == ["a&amp;b&lt;c&gt;&quot;d&apos;"]
    assert apply(lambda x: c.thousands(x.cast("int")), ["1234567", "5"]) == ["1,234,567", "5"]
    assert apply(c.month_key, ["2026-05-20"]) == ["2026-05"]


def test_enrichment_takes_first_element_and_aliases(spark):
    schema = "src_seq long, dot_number string, docket_number array<string>, telephone string, power_units string"
    raw = spark.createDataFrame(
        [(1, " 12 ", ["MC1", "MC2"], "5", "200,000"), (2, "13", [], "", "x"), (3, "abc", None, None, None)], schema
    )
    got = {r.usdot_number: r for r in rows.normalize_enrichment(raw).collect()}
    assert set(got) == {"12", "13"}
    # The fleet cap of the census does not apply here.
    assert (got["12"].mc_number, got["12"].phone, got["12"].total_vehicles) == ("MC1", "5", 200000)
    assert (got["13"].mc_number, got["13"].phone, got["13"].total_vehicles) == (None, None, None)
