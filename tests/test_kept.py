"""Tables and statistics that are kept by changes: equal to those made anew, and only touched in part."""

import os
import re

import pytest
from pyspark.sql import functions as F

from haulbook.operators import directory, gram_store, search, stats, summaries
from haulbook.operators.gram_store import GramStore
from haulbook.operators.kept import KeptDirectory
from haulbook.schemas import CARRIERS
from haulbook.session import fresh_dir
from haulbook.sources import appends, manifests, tables
from haulbook.sources.appends import ROWS, AppendTable
from haulbook.sources.deltas import DELTA, KeyedTable

PAIR = "k string, v long"


def files(root):
    """Data files below a folder with the time of their last change."""
    return {
        os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
        for d, _, names in os.walk(root) for n in names if n.endswith(".parquet") and manifests.LISTS not in d
    }


@pytest.fixture
def table(spark):
    schema = spark.createDataFrame([], PAIR).schema
    made = KeyedTable(spark, fresh_dir(spark, "pairs"), schema, "k", buckets=8, most=3)
    made.create(spark.createDataFrame([(str(i), i) for i in range(200)], PAIR), 0)
    return made


def spark_buckets(table, *keys):
    return table.spark.createDataFrame([(k,) for k in keys], "k string").select(table.bucket()).collect()


def put(table, rows, version):
    new = table.spark.createDataFrame(rows, PAIR)

    def fold(known):
        return known.select("k").join(new, "k", "right").select("k", "v")

    return table.apply(new.select("k"), fold, version)


def test_a_batch_writes_its_buckets_only(spark, table):
    before = files(table.root)
    change = put(table, [("5", -5), ("new", 1)], 1)
    after = files(table.root)
    assert {p: t for p, t in after.items() if p in before} == before
    numbers = spark.createDataFrame([("5",), ("new",)], "k string").select(table.bucket()).distinct()
    touched = {f"bucket={r[0]}" for r in numbers.collect()}
    assert {p.split("/")[-2] for p in set(after) - set(before)} == touched
    assert {tuple(r) for r in change.before.collect()} == {("5", 5)}
    assert {tuple(r) for r in change.after.collect()} == {("5", -5), ("new", 1)}
    assert table.read().count() == 201
    assert table.read(version=0).where("k = '5'").first().v == 5


def test_versions_repeat_merge_and_retire(spark, table):
    want = {str(i): i for i in range(200)}
    for version in range(1, 6):
        rows = [(str(7 * version), -version), ("same", version), (f"n{version}", 0)]
        for _ in range(1 + (version == 3)):  # a batch that failed late is run again
            put(table, rows, version)
        want |= dict(rows)
        assert dict(map(tuple, table.read().collect())) == want
    deltas = {}
    for f in manifests.live(spark, table.root):
        deltas[f.bucket] = deltas.get(f.bucket, 0) + (f.kind == DELTA)
    assert max(deltas.values()) < table.most
    old = table.read(version=2)
    assert table.retire(grace_seconds=3600) == [] and old.count() == 203
    gone = table.retire(grace_seconds=0)
    assert gone and not any(os.path.exists(f"{table.root}/{p}") for p in gone)
    assert list(manifests.versions(spark, table.root)) == [5]
    assert dict(map(tuple, table.read().collect())) == want


def test_empty_batches_and_null_keys(table):
    assert put(table, [], 1) is None
    assert put(table, [(None, 3)], 2) is None
    assert table.read().count() == 200


def test_lookup_opens_the_buckets_of_its_keys(table):
    put(table, [("3", 33)], 1)
    found = table.lookup(["3", "missing"])
    assert [tuple(r) for r in found.collect()] == [("3", 33)]
    plan = found._jdf.queryExecution().toString()
    assert "In(k, [3,missing])" in plan
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    opened = {int(n) for f in filters for n in re.findall(r"\d+", re.sub(r"bucket#\d+", "", f))}
    assert filters and opened <= {r[0] for r in spark_buckets(table, "3", "missing")}


def test_published_versions_are_retired(spark):
    root = fresh_dir(spark, "versions")
    for n in range(3):
        tables.publish(spark.range(n + 1), root, n)
    held = tables.read_table(spark, root, below=2)
    assert tables.retire_versions(spark, root, grace_seconds=3600) == []
    assert held.count() == 2
    assert tables.retire_versions(spark, root, grace_seconds=0) == [0, 1]
    assert tables.read_table(spark, root).count() == 3
    assert not os.path.exists(f"{root}/v0")


# --- the gram index ----------------------------------------------------------------------
def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_index_follows_the_directory(spark, make_carriers):
    def named(n, name, dba=None):
        return {"usdot_number": str(n), "legal_name": name, "dba_name": dba}

    first = [named(i, f"Carrier number {i}") for i in range(60)]
    root = fresh_dir(spark, "directory")
    table = KeyedTable(spark, f"{root}/carriers", CARRIERS, "usdot_number", buckets=4)
    store = GramStore(spark, f"{root}/grams", most=2)
    table.create(make_carriers(*first), 0)
    store.build(table.read(), 0)
    batches = [
        [named(1, "Renamed"), named(2, "Carrier number 2", "Also renamed")],
        [named(1, None), named(99, "New renamed")],
        [named(1, "Renamed again")],
        [named(i, f"Other {i}") for i in range(20, 60)],
    ]
    for version, rows in enumerate(batches, 1):
        new = make_carriers(*rows)
        for _ in range(1 + (version == 2)):
            change = table.apply(new.select("usdot_number"), lambda known, new=new: new, version)
            store.update(change, version)
        assert same(store.postings(), search.gram_index(table.read()))
        for term in ("renamed", "number 4", "re%ed"):
            found = {r.usdot_number for r in store.search(table.read(), term).collect()}
            assert found == {r.usdot_number for r in directory.search(table.read(), term).collect()}
    assert {f.kind for f in manifests.live(spark, store.root)} == {"base"}  # much had changed
    assert store.retire(0)
    assert same(store.postings(), search.gram_index(table.read()))


def test_search_scans_only_its_grams(spark, make_carriers):
    rows = [{"usdot_number": str(i), "legal_name": f"Name {i:05d} words"} for i in range(3000)]
    store = GramStore(spark, fresh_dir(spark, "grams"))
    store.build(make_carriers(*rows), 0)
    asked = store.postings(["299", "998"])
    plan = asked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(gram, [299,998])" in plan.partition("PushedFilters")[2]
    assert asked.count() == sum(("299" in f"{i:05d}") + ("998" in f"{i:05d}") for i in range(3000))


# --- folders of single batches ------------------------------------------------------------
def test_folders_stay_few_and_older_readers_whole(spark, rows_of):
    table = AppendTable(spark, fresh_dir(spark, "appended"), spark.range(0).schema, most=3)
    for version in range(9):
        if version == 5:
            older = table.read()
        for _ in range(1 + (version == 5)):
            table.append(spark.range(version * 10, version * 10 + 10), version)
    live = [f for f in manifests.live(spark, table.root) if f.kind == ROWS]
    assert len(live) <= 4
    assert rows_of(table.read()) == rows_of(spark.range(90))
    table.retire(grace_seconds=3600)
    assert older.count() == 50
    stored = len(files(table.root))
    table.retire(grace_seconds=0)
    assert len(files(table.root)) < stored
    assert rows_of(table.read()) == rows_of(spark.range(90))


def test_only_doubtful_folders_are_opened(spark):
    schema = spark.createDataFrame([], "id string, n long").schema
    table = AppendTable(spark, fresh_dir(spark, "ids"), schema, "id", buckets=4, most=50)

    def batch(low, high):
        return spark.range(low, high).selectExpr("concat('row-', id) as id", "id as n")

    for version in range(4):
        rows = batch(version * 500, version * 500 + 500)
        fresh = table.unseen(rows, below=version)
        assert fresh.count() == 500 and table.opened[0] <= 1  # a filter may err, rarely
        table.append(fresh, version)
    # Ids of the second batch: its folders alone are opened, and nothing is new.
    assert table.unseen(batch(500, 1000), below=4).count() == 0
    assert 4 <= table.opened[0] <= 6 and table.opened[1] == 16
    # One old id and one new one: one bucket of one folder.
    mixed = spark.createDataFrame([("row-777", 0), ("row-9999", 1), (None, 2)], "id string, n long")
    assert sorted(r.n for r in table.unseen(mixed, below=4).collect()) == [1, 2]
    assert table.opened[0] <= 2


def test_marks_of_a_large_batch_are_not_spread_out(spark, monkeypatch):
    table = AppendTable(spark, fresh_dir(spark, "ids"), spark.createDataFrame([], "id string, n long").schema, "id", buckets=2)
    table.append(spark.range(50).selectExpr("if(id = 7, null, concat('row-', id)) as id", "id as n"), 0)
    rows = spark.range(60).selectExpr("if(id % 20 = 7, null, concat('row-', id)) as id", "id as n").cache()
    monkeypatch.setattr(appends, "FEW", 40, raising=False)
    # The filters' answers would be stored.
    monkeypatch.setattr(appends, "materialize", None)
    assert sorted(r.n for r in table.unseen(rows, below=1).collect()) == [7, 27, 47, *range(50, 60)]
    assert table.opened == (2, 2)


def test_ids_are_found_in_merged_folders(spark):
    schema = spark.createDataFrame([], "id string, n long").schema
    table = AppendTable(spark, fresh_dir(spark, "ids"), schema, "id", buckets=2, most=2)
    for version in range(5):
        rows = spark.range(version * 7, version * 7 + 7).selectExpr("cast(id as string) as id", "id as n")
        table.append(table.unseen(rows, below=version), version)
    again = spark.range(0, 40).selectExpr("cast(id as string) as id", "id as n")
    assert sorted(r.n for r in table.unseen(again, below=5).collect()) == [35, 36, 37, 38, 39]
    assert table.read().count() == 35


def test_names_that_stay_become_no_postings(spark, make_carriers, rows_of, monkeypatch):
    kept = KeptDirectory(spark, fresh_dir(spark, "kept"), buckets=4)
    kept.create(make_carriers(*[{"usdot_number": str(i), "legal_name": f"Name {i}"} for i in range(40)]), 0)
    spread, index = [], search.gram_index
    monkeypatch.setattr(gram_store, "gram_index", lambda df, *a: spread.append(df.count()) or index(df, *a))
    batch = spark.range(40).selectExpr("id as src_seq", "cast(id as string) as usdot_number", "if(id = 3, 'Other', null) as legal_name", "'5' as phone")
    kept.upsert(batch, "2024-01-01 00:00:00", 1)
    assert sum(spread) == 2  # the one carrier's old name and its new one
    assert kept.carriers.where("phone = '5'").count() == 40
    wanted = index(kept.carriers)
    assert rows_of(kept.grams.postings().select(*wanted.columns)) == rows_of(wanted)


# --- statistics ----------------------------------------------------------------------------
def test_counts_follow_moves(spark, make_carriers, rows_of):
    def carrier(n, state, active=True):
        return {"usdot_number": str(n), "legal_name": f"N{n}", "state": state, "is_active": active}

    kept = KeptDirectory(spark, fresh_dir(spark, "kept"), buckets=4)
    kept.create(make_carriers(*[carrier(i, ("TX", "CA", None, "ON")[i % 4], i % 5 > 0) for i in range(40)]), 0)
    staged = "usdot_number string, legal_name string, state string, is_active boolean, src_seq long, slug string, address string, city string, zip string, phone string, operation_type string, carrier_classification string, total_vehicles int"
    loads = [
        [("0", "TX", True), ("1", "NY", True), ("2", "GU", False), ("77", "AL", True)],
        [("77", "AL", False), ("1", None, True), ("3", "TX", False)],
        [(str(i), "TX", False) for i in range(0, 40, 4)],  # Texas is empty but for moves
    ]
    for version, rows in enumerate(loads, 1):
        full = [(k, f"N{k}", s, a, i, f"n-usdot-{k}", *[None] * 7) for i, (k, s, a) in enumerate(rows)]
        batch = spark.createDataFrame(full, staged)
        for _ in range(1 + (version == 2)):
            kept.load_census(batch, "2024-03-01 00:00:00", version)
        none = spark.createDataFrame([], "usdot_number string, alert_status string, inspection_date date")
        assert rows_of(summaries.carriers_by_state(kept.summary)) == rows_of(stats.carriers_by_state(kept.carriers))
        want = stats.directory_stats(kept.carriers, none, none, none).first().asDict()
        assert summaries.directory_stats(kept.summary).first().asDict() == want


def test_moves_read_no_base(spark, make_carriers):
    rows = [{"usdot_number": str(i), "state": "TX", "legal_name": "A"} for i in range(50)]
    kept = KeptDirectory(spark, fresh_dir(spark, "kept"), buckets=4)
    kept.create(make_carriers(*rows), 0)
    new = make_carriers({"usdot_number": "7", "state": "CA", "legal_name": "A"})
    change = kept.table.apply(new.select("usdot_number"), lambda known: new, 1)
    moved = summaries.moved(change, summaries.carrier_counts)
    assert not any("/base-" in p for p in moved.inputFiles())
    assert {tuple(r) for r in moved.collect()} == {
        ("active", "TX", -1), ("active", "CA", 1), ("carriers", "TX", -1), ("carriers", "CA", 1),
    }


def test_children_are_written_once(spark, seed, monkeypatch):
    """Counting them reads what was appended, not a copy."""
    from haulbook.operators import kept as module

    copies = []
    monkeypatch.setattr(module, "materialize", lambda df, label: copies.append(label) or df)
    kept = KeptDirectory(spark, fresh_dir(spark, "kept"), buckets=4)
    kept.create(seed, 0)
    rows = spark.createDataFrame([("100001", "c1"), ("100002", "c2")], "usdot_number string, violation_code string")
    for _ in range(2):  # run again under its number, it counts once
        kept.add_children("violations", rows, summaries.violation_counts, 1)
    assert copies == []
    assert [r.n for r in kept.summary.where("measure = 'violations'").collect()] == [2]
