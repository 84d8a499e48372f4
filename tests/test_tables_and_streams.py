import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from haulbook.operators import documents, rows, safety
from haulbook.plans.registry import REGISTRY
from haulbook.plans.tables import Tables
from haulbook.session import fresh_dir, materialize, shared_dir
from haulbook.sources import tables as store

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DIR)


def test_shared_dir_follows_the_session(spark):
    class Conf:
        def get(self, key, default):
            return "/shared/folder/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert fresh_dir(Session(), "x").startswith("/shared/folder/x-")
    assert shared_dir(spark) == shared_dir(spark)


def test_versions(spark, rows_of):
    root = fresh_dir(spark, "versions")
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, root)
    a, b = spark.range(3), spark.range(5)
    assert store.read_table(spark, root, a.schema).count() == 0
    store.publish(a, root, 1)
    store.publish(b, root, 2, cluster_by="id", ranges=True)
    store.publish(b, root, 2, cluster_by="id")
    assert rows_of(store.read_table(spark, root)) == rows_of(b)
    assert rows_of(store.read_table(spark, root, below=2)) == rows_of(a)
    assert store.replace_snapshot(a, root, 3, bounded_run=True) is None
    assert store.read_table(spark, root).count() == 5


def test_bucketed_tables_join_without_shuffle(spark, t):
    for name, df in (("b_carriers", t.carriers), ("b_scores", t.scores)):
        store.save_bucketed(df, name, fresh_dir(spark, name), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("b_carriers").join(spark.table("b_scores"), "usdot_number")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().toString()
        assert joined.count() == t.scores.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table b_carriers")
        spark.sql("drop table b_scores")


def test_profiles_round_trip(spark, t, rows_of):
    p = safety.safety_profiles(t.carriers, t.scores, t.inspections, t.violations)
    for fmt in ("json", "parquet"):
        path = fresh_dir(spark, "profiles")
        store.export_profiles(p, path, fmt)
        assert rows_of(spark.read.schema(p.schema).format(fmt).load(path)) == rows_of(p)


def test_sitemap_files(spark, t):
    files = documents.sitemap_files(t.carriers, per_file=60)
    path = fresh_dir(spark, "sitemaps")
    store.export_sitemaps(files, path)
    back = {r.file: r.value for r in spark.read.text(path).collect()}
    assert back == {r.file: r.xml for r in files.collect()}
    listed = t.carriers.where("is_active").count()
    assert sum(x.count("<loc>") for n, x in back.items() if n > 0) == listed


def test_materialize(spark):
    assert materialize(spark.range(4).where("id > 1"), "some").agg(F.sum("id")).first()[0] == 5


@pytest.mark.parametrize(
    "stream, batch",
    [
        ("t01_incremental_stream", "j07_incremental"),
        ("t02_direct_violations_stream", "j03_violations"),
        ("t04_metering_stream", "b03_metered_requests"),
        ("t05_subscription_stream", "b01_subscription_fold"),
        ("t06_monthly_counts_stream", "a03_inspections_by_month"),
    ],
)
def test_stream_equals_batch(t, rows_of, stream, batch):
    got, want = REGISTRY[stream](t), REGISTRY[batch](t)
    assert rows_of(got.select(*sorted(got.columns))) == rows_of(want.select(*sorted(want.columns)))


def test_repeated_source_rows_are_stored_once(t, rows_of):
    got = REGISTRY["t03_once_per_row_stream"](t)
    want = rows.clean_inspections(t.feed("inspections"))
    assert rows_of(got.select(*want.columns)) == rows_of(want)


def test_violations_stream_stores_no_other_table(spark, rows_of, monkeypatch):
    """Neither the batch load's table nor the joins of the feed are needed for its schema and cuts."""
    t = Tables(spark, DIR)
    monkeypatch.setattr(Tables, "violations", property(lambda self: pytest.fail("stored for its schema")))
    looked_at, cuts = [], DataFrame.approxQuantile
    monkeypatch.setattr(DataFrame, "approxQuantile", lambda df, *a: looked_at.append(df) or cuts(df, *a))
    got = REGISTRY["t02_direct_violations_stream"](t)
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("Join") for df in looked_at] == [0]
    assert rows_of(got) == rows_of(t.built_violations.select(*got.columns))
