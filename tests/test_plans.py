"""What the plans must and must not contain, whatever the data."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from haulbook.operators import documents, merges, ranking, rows, safety, search
from haulbook.plans import tables
from haulbook.plans.registry import REGISTRY
from haulbook.plans.tables import Tables

DIR = "/root/testdata/sf0.001"
STREAMS_AND_SINKS = ("t0", "s09", "s10", "s11", "b05")


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DIR)


def plan(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("name", [n for n in REGISTRY if not n.startswith(STREAMS_AND_SINKS)])
def test_no_pairing_of_everything_and_no_python(t, name):
    text = plan(REGISTRY[name](t))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", text)


@pytest.mark.parametrize("latest", [safety.latest_inspections, safety.latest_violations])
def test_newest_rows_are_cut_before_the_shuffle(t, latest):
    text = plan(latest(t.violations if latest is safety.latest_violations else t.inspections))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Partial") > text.index("Exchange")


def test_dedup_is_cut_before_the_shuffle(t):
    text = plan(merges.newest_per_key(rows.clean_census(t.census), "usdot_number", "src_seq"))
    assert text.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_files(t):
    found = t.carriers.where("is_active and state = 'TX'").select("usdot_number")
    text = plan(found, "formatted")
    assert "EqualTo(state,TX)" in text
    assert re.search(r"ReadSchema: struct<usdot_number:string,state:string,is_active:boolean>", text)


def test_top_list_takes_no_global_sort(t):
    text = plan(ranking.top_fleets(t.carriers, 10))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_rank_sorts_rows_by_bucket_only(t):
    text = plan(ranking.dot_rank(t.carriers.select("usdot_number")))
    for line in text.splitlines():
        if "SinglePartition" in line:
            # Only the bucket counts come together in one task.
            below = text[text.index(line) :]
            assert "HashAggregate" in below.splitlines()[1]


def test_search_joins_on_grams(t):
    text = plan(search.batch_search(t.carriers, t.feed("terms")))
    assert "gram" in text and "NestedLoop" not in text


def test_postings_are_never_broadcast(t):
    """They are some 25 times the names, whatever Spark estimates."""
    text = plan(search.batch_search(t.carriers, t.feed("terms")))
    assert re.search(r"SortMergeJoin \[gram#\d+\], \[gram#\d+\], Inner", text)
    stored = plan(search.batch_search(t.carriers, t.feed("terms"), search.gram_index(t.carriers)))
    assert re.search(r"SortMergeJoin \[gram#\d+\], \[gram#\d+\], Inner", stored)


@pytest.mark.parametrize("name", ["a09_violation_rate", "d09_offers", "s12_row_counts", "u01_union_of_counts"])
def test_counting_stores_no_children(t, monkeypatch, name):
    """Counts need a column or none of the child tables, which are not stored for them."""
    monkeypatch.setattr(tables, "_STORED", {})
    REGISTRY[name](Tables(t.spark, DIR))
    assert {key[2] for key in tables._STORED} <= {"carriers"}


def test_profile_shuffles_carriers_once(t):
    p = safety.safety_profiles(t.carriers, t.scores, t.inspections, t.violations)
    assert plan(p.select(F.col("usdot_number"))).count("Exchange") <= 8


def scans(df):
    return plan(df).count("FileScan parquet")


def test_tables_are_scanned_once(t):
    base = documents.document_base(safety.with_totals(t.carriers, t.inspections, t.violations))
    assert scans(base) == 3  # carriers, inspections, violations
    assert scans(merges.resolve_batch(t.violations, t.carriers)) == 2
    # Rows and bucket counts of one ranking, and the totals.
    assert scans(documents.state_item_lists(t.carriers)) == 3
