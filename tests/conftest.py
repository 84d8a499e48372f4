import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from haulbook.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tests",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows_of():
    """Rows as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def make_carriers(spark):
    """Carriers from partial records; what is not given is null."""
    from haulbook.schemas import CARRIERS

    def make(*records):
        full = []
        for r in records:
            row = dict.fromkeys(CARRIERS.names) | {"is_active": True} | r
            full.append(tuple(row[n] for n in CARRIERS.names))
        return spark.createDataFrame(full, CARRIERS)

    return make


@pytest.fixture(scope="session")
def seed(make_carriers):
    base = [
        ("100001", "Alpha Freight", "TX", 50, "Satisfactory", "alpha-freight-usdot-100001"),
        ("100002", "Beta Logistics", "CA", 5, "Conditional", "beta-logistics-usdot-100002"),
        ("100003", "Gamma Haulers", "TX", None, None, "gamma-haulers-usdot-100003"),
    ]
    names = ("usdot_number", "legal_name", "state", "total_vehicles", "safety_rating", "slug")
    return make_carriers(*[dict(zip(names, b)) for b in base])
