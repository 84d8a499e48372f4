"""What must not depend on how a feed is cut into batches, and what changes between them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from haulbook.functions import cleaning as c
from haulbook.operators import billing, merges, rows
from haulbook.plans import oracles
from haulbook.plans.registry import REGISTRY
from haulbook.plans.tables import Tables
from haulbook.session import fresh_dir, scratch
from haulbook.streaming import feeds as streams

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DIR)


def test_subscribers_change_between_batches(t):
    name = "t04_changing_subscribers_stream"
    con = duckdb.connect()
    for table in ("events",):
        con.execute(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    con.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    want = sorted((dict(zip(columns, r)) for r in con.fetchall()), key=lambda r: r["request_id"])
    df = REGISTRY[name](t)
    got = sorted((r.asDict() for r in df.collect()), key=lambda r: r["request_id"])
    for r in [*got, *want]:
        r["req_date"], r["period_start"] = str(r["req_date"]), str(r["period_start"])
    assert got == want
    assert {401, 403, 200, 429} <= {r["outcome"] for r in got}


def _batch(spark, *records):
    return spark.createDataFrame(records, "src_seq long, usdot_number string, legal_name string, phone string")


def test_slug_is_that_of_the_first_record(spark, make_carriers, rows_of):
    known = make_carriers({"usdot_number": "5", "legal_name": "Known", "slug": "known-usdot-5"})
    first = (1, "77", "First Name", None), (2, "88", None, "1")
    second = (3, "77", "Second Name", "2"), (4, "88", "Late Name", None), (5, "5", "Other", None)
    at = "2024-01-01 00:00:00"
    once = merges.field_upsert(known, _batch(spark, *first, *second), at)
    twice = merges.field_upsert(merges.field_upsert(known, _batch(spark, *first), at), _batch(spark, *second), at)
    slugs = {r.usdot_number: (r.slug, r.legal_name) for r in once.collect()}
    assert slugs["77"] == ("first-name-usdot-77", "Second Name")
    assert slugs["5"] == ("known-usdot-5", "Other")
    assert rows_of(once) == rows_of(twice)


def test_stored_once_by_id(spark, rows_of):
    schema = "src_id string, usdot_number string, day date"
    deliveries = (
        [("a", "1", "2024-01-31"), ("a", "1", "2024-01-31"), (None, "6", "2024-01-01"), (None, "7", "2024-01-01")],
        [("a", "1", "2024-02-01"), ("b", "2", "2024-02-01"), (None, "6", "2024-01-01")],
    )
    path, root, checkpoint = (fresh_dir(spark, x) for x in ("feed", "stored", "checkpoint"))
    for d in deliveries:
        df = spark.createDataFrame(d, "src_id string, usdot_number string, day string").withColumn("day", F.col("day").cast("date"))
        df.write.mode("append").parquet(path)
        q = streams.once_per_source_row(streams.feed_stream(spark, path, df.schema), lambda b: b, root, checkpoint)
        q.awaitTermination()
        assert q.exception() is None
    got = spark.read.parquet(root).select("src_id", "usdot_number", F.col("day").cast("string"))
    assert schema and rows_of(got) == sorted(
        [("a", "1", "2024-01-31"), ("b", "2", "2024-02-01"), (None, "6", "2024-01-01"), (None, "6", "2024-01-01"), (None, "7", "2024-01-01")],
        key=repr,
    )


def test_no_number_is_lost(spark, t):
    texts = ["1e25", "-1e25", "1e999", "1e-999", "99999999999999999999", "x", "inf", "5"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select(c.num("x").alias("n"))
    got = [None if r.n is None else float(r.n) for r in df.collect()]
    assert got == [1e20, -1e20, 1e20, 0.0, 1e20, None, None, 5.0]
    rejects = merges.score_rejects(t.basics)
    assert rejects.where(F.col("measure").cast("double") >= 1e20).count() > 0
    assert rejects.where(F.col("measure") == "-3000000.500000000000000000").count() > 0
    fits = merges.score_rows(t.basics, t.carriers.unionByName(t.carriers.limit(0)), "2024-02-01")
    assert fits.where(F.abs("score") > 999999).count() == 0


def test_usage_needs_no_single_requests(t, monkeypatch):
    monkeypatch.setattr(billing, "_cut_ids", None)  # called for outcomes only
    assert billing.updated_usage(t.requests, t.subscribers).count() == t.subscribers.count()


def test_scratch_is_removed(spark):
    import os

    with scratch(spark) as path:
        spark.range(3).write.parquet(fresh_dir(spark, "x"))
        assert os.listdir(path)
    assert not os.path.exists(path)
    assert rows is not None
