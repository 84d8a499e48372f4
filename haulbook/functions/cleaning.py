"""Cleaning of raw text fields. Bad text never fails a job: it becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulbook.schemas import INSPECTION_COUNTERS, MAX_FLEET, OPERATION_NAMES

# Fixed value: the characters counted as white space when a field is stripped.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Numbers below this are years of the 1900s when a date has a two-digit year.
CENTURY_PIVOT = 2069


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def clean(c: Column | str, width: int | None = None) -> Column:
    """Strip, cut to `width`, and turn what is empty into null."""
    text = strip(c)
    return blank_to_null(F.left(text, F.lit(width)) if width else text)


WHOLE_NUMBER = "^[+-]?0*[0-9]{1,10}$"
DECIMAL_NUMBER = "^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]{1,3})?$"


def _parsed(c: Column, shape: str, type_: str) -> Column:
    """Cast of what looks like a number, stripped first only where that is needed.

    A cast that fails costs an exception, many times the price of the look: bad text must
    not get that far.
    """
    stripped = strip(c)
    return F.coalesce(
        F.when(c.rlike(shape), c.try_cast(type_)),
        F.when(stripped.rlike(shape), stripped.try_cast(type_)),
    )


def strict_int(c: Column | str) -> Column:
    """Whole-number text to int; '12.0', 'n/a' and '' are null."""
    return _parsed(col(c), WHOLE_NUMBER, "int")


def loose_int(c: Column | str) -> Column:
    """As strict_int, with thousands commas allowed."""
    return _parsed(F.replace(col(c).cast("string"), F.lit(","), F.lit("")), WHOLE_NUMBER, "int")


# Fixed value: the largest number of decimal(38,18).
LARGEST = "99999999999999999999.999999999999999999"


def num(c: Column | str) -> Column:
    """Number text to an exact decimal, wide enough that rounding happens once, later.

    A number beyond that width becomes the largest there is, with its sign: it is no measure
    that fits anywhere, but it is a number, and must reach the rejects as one.
    """
    exact = _parsed(col(c), DECIMAL_NUMBER, "decimal(38,18)")
    rough = _parsed(col(c), DECIMAL_NUMBER, "double")
    largest, smallest = (F.lit(x).cast("decimal(38,18)") for x in (LARGEST, f"-{LARGEST}"))
    beyond = F.when(rough >= 1e20, largest).when(rough <= -1e20, smallest)
    return F.coalesce(exact, beyond)


def feed_date(c: Column | str) -> Column:
    """Dates as `05-JAN-24` or `2024-01-05` (a time part is cut off).

    Cheap shape tests come first: the parser sees only text it can read, so bad dates
    cost no exception each.
    """
    text = F.left(strip(c), F.lit(10))
    short = F.try_to_date(text, "d-MMM-yy")
    short = F.when(F.year(short) >= CENTURY_PIVOT, F.add_months(short, -1200)).otherwise(short)
    # The cast alone would also take a lone year and month, or a day with a time behind it.
    iso_shape = (
        (F.substring(text, 5, 1) == "-") & (F.locate("-", text, 6) > 0)
        & ~F.contains(text, F.lit("T")) & ~F.contains(text, F.lit(" "))
    )
    return F.when(iso_shape, text.try_cast("date")).when(
        text.rlike("^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2}$"), short
    )


def flag(c: Column | str) -> Column:
    """y, yes, true, 1 in any case are true; null stays null; all else is false."""
    return F.lower(strip(c)).isin("y", "yes", "true", "1")


def valid_dot(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("^[0-9]{1,20}$"), F.lit(False))


def dot_order(usdot: Column | str) -> Column:
    """The numeric sort key of a USDOT number (text that does not fit sorts last)."""
    return F.coalesce(col(usdot).try_cast("bigint"), F.lit(2**63 - 1))


def operation_name(c: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for code, name in OPERATION_NAMES.items():
        out = F.when(col(c) == code, F.lit(name)).otherwise(out)
    return out


def capped_fleet(vehicles: Column | str) -> Column:
    """Self-reported fleet sizes beyond any real fleet are typing errors."""
    return F.when(col(vehicles) <= MAX_FLEET, col(vehicles))


def active_flag(status_code: Column | str) -> Column:
    return F.coalesce(col(status_code) == "A", F.lit(False))


def first_present(record_columns: list[str], *aliases: str) -> Column:
    """First alias column that exists and is neither null nor ''."""
    present = [blank_to_null(a) for a in aliases if a in record_columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def first_element(c: Column | str) -> Column:
    return F.get(col(c), F.lit(0))


def violation_total() -> Column:
    """Sum of the six counters of an inspection; bad or missing ones count as 0."""
    total = F.lit(0)
    for name in INSPECTION_COUNTERS:
        total = total + F.coalesce(strict_int(name), F.lit(0))
    return total


def inspection_label(level: Column | str) -> Column:
    return F.when(col(level) != "", F.concat(F.lit("Level "), col(level)))


def month_key(d: Column | str) -> Column:
    return F.substring(col(d).cast("string"), 1, 7)


def alert_label(f: Column | str) -> Column:
    return F.when(F.coalesce(col(f), F.lit(False)), F.lit("alert")).otherwise(F.lit("ok"))


def measure_2dp(c: Column | str) -> Column:
    """Two decimals, half away from zero; null when it does not fit decimal(8,2)."""
    return F.round(col(c), 2).try_cast("decimal(8,2)")


def api_key_hash(key: Column | str) -> Column:
    return F.sha2(col(key), 256)


def bearer_token(authorization: Column | str) -> Column:
    """Key out of an `Authorization: Bearer <key>` header; null when malformed."""
    return blank_to_null(strip(F.regexp_extract(col(authorization), r"(?is)^bearer (.*)$", 1)))


def xml_escape(c: Column | str) -> Column:
    out = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    for raw, escaped in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def thousands(c: Column | str) -> Column:
    return F.format_number(col(c), 0)


def display_name(legal_name: Column | str = "legal_name", usdot: Column | str = "usdot_number") -> Column:
    return F.coalesce(col(legal_name), F.concat(F.lit("USDOT "), col(usdot)))


def display_rating(rating: Column | str = "safety_rating") -> Column:
    return F.coalesce(blank_to_null(rating), F.lit("Not Rated"))


def out_of_service_total(vehicles: Column | str = "oos_vehicles", drivers: Column | str = "oos_drivers") -> Column:
    return F.coalesce(col(vehicles), F.lit(0)) + F.coalesce(col(drivers), F.lit(0))


def violation_rate(violations: Column | str, inspections: Column | str) -> Column:
    """Violations per inspection, 0 for the never inspected."""
    v, i = col(violations).cast("double"), col(inspections).cast("double")
    return F.when(i > 0, v / i).otherwise(F.lit(0.0))
