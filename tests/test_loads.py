"""Pages, loads that resume, loads that account for themselves, lookups that skip, slugs."""

import pytest
from pyspark.sql import functions as F

from haulbook.functions.slugs import slugify
from haulbook.operators import directory, ledger
from haulbook.schemas import LEDGER
from haulbook.session import fresh_dir
from haulbook.sources import pages, tables
from haulbook.sources.appends import AppendTable

FIELDS = ("src_id", "dot_number", "insp_date")


@pytest.fixture(scope="module")
def landed(spark):
    rows = [(f"row-{i:04d}", str(i), 'a "quoted"\n line, é' if i % 7 else None) for i in range(300)]
    path = fresh_dir(spark, "pages")
    records = spark.createDataFrame(rows, "src_id string, dot_number string, insp_date string").withColumn("unknown", F.lit(1))
    pages.write_pages(records, path, F.floor(F.col("dot_number").cast("int") / 40))
    return path, rows


def test_pages_are_taken_apart_in_tasks(spark, landed, rows_of):
    path, rows = landed
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == 8 and all(x.startswith('[{":id":') for x in lines)
    feed = pages.read_pages(spark, "inspections", path)
    assert rows_of(feed.select(*FIELDS)) == sorted(rows, key=repr)
    assert "unknown" not in feed.columns


def test_a_page_that_is_not_json_stops_the_load(spark):
    path = fresh_dir(spark, "pages")
    spark.createDataFrame([('[{":id":"1"}]',), ('[{":id":"2",',)], "value string").write.text(path)
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        pages.read_pages(spark, "inspections", path).collect()


def test_loads_resume_where_the_last_complete_one_ended(spark, landed, rows_of):
    path, rows = landed
    feed = pages.read_pages(spark, "inspections", path)
    table = AppendTable(spark, fresh_dir(spark, "loaded"), feed.schema)
    assert pages.reached(table) == ""
    assert pages.load_next(feed, table, pages=1, page_size=100) == 0
    assert (table.read().count(), pages.reached(table)) == (100, "row-0099")
    # A load that wrote rows and its mark, but was stopped before it counted.
    begun = feed.where("src_id > 'row-0099'").limit(50)
    table.stage(begun, 1)
    tables.publish(spark.createDataFrame([("row-9999",)], "reached string"), f"{table.root}/_marks", 1)
    assert (table.read().count(), pages.reached(table)) == (100, "row-0099")
    assert pages.load_next(feed, table, pages=1, page_size=100) == 1
    pages.load_next(feed, table)
    pages.load_next(feed, table)  # nothing is left
    assert pages.reached(table) == "row-0299"
    assert rows_of(table.read().select(*FIELDS)) == sorted(rows, key=repr)


def test_a_load_accounts_for_itself(spark):
    path, out = fresh_dir(spark, "ledger"), fresh_dir(spark, "out")
    raw = spark.range(100).repartition(4)
    ledger.run_load(raw, lambda df: df.where("id % 3 = 0"), lambda df: df.write.parquet(out), path, 1, "census")

    def fail(df):
        raise ValueError("no disk")

    with pytest.raises(ValueError):
        ledger.run_load(raw, lambda df: df, fail, path, 2, "census")
    states = {r.job_id: r for r in ledger.latest_state(spark.read.schema(LEDGER).parquet(path)).collect()}
    assert (states[1].status, states[1].total_records, states[1].processed_records) == ("completed", 100, 34)
    assert (states[2].status, states[2].error_message, states[2].total_records) == ("failed", "no disk", None)
    assert states[1].started_at <= states[1].completed_at


def scanned(df):
    """Rows that the file scans of a query gave on."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if "FileSourceScan" in node.getClass().getSimpleName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_lookups_skip_row_groups(spark, make_carriers):
    n = 40_000
    template = make_carriers({"usdot_number": "x"}).drop("usdot_number", "slug")
    many = spark.range(n).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("usdot_number"),
        F.concat(F.lit("carrier-"), F.sha2(F.col("id").cast("string"), 256), F.lit("-usdot-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("slug"),
    ).crossJoin(F.broadcast(template))
    root = fresh_dir(spark, "carriers")
    tables.publish(many.repartition(8, "usdot_number"), root, 1, blooms=("slug", "usdot_number"), row_group_bytes=64 << 10)
    stored = tables.read_table(spark, root)
    wanted = [r.slug for r in stored.where("usdot_number in ('00000007', '00031234')").collect()]
    assert len(wanted) == 2
    assert scanned(stored.where(F.col("slug").isin(wanted))) < n / 2
    plain = fresh_dir(spark, "carriers")
    tables.publish(many.repartition(8, "usdot_number"), plain, 1, row_group_bytes=64 << 10)
    assert scanned(tables.read_table(spark, plain).where(F.col("slug").isin(wanted))) == n
    asked = [wanted[0], "former-usdot-00000011", "no-such", "gone-usdot-99999999"]
    found = {(r.requested_slug, r.usdot_number) for r in directory.find_slugs(stored, asked).collect()}
    assert found == {(wanted[0], wanted[0][-8:]), ("former-usdot-00000011", "00000011")}


@pytest.mark.parametrize("name, slug", [
    ("Nguyễn", "nguyen"), ("Nguyễn", "nguyen"), ("Αθήνα Ξένη", "athena-xene"), ("Объект Ёлка Чай", "obekt-elka-chai"),
    ("O&#39;Brien", "obrien"), ("O'Brien", "o-brien"), ("O&#x27;Brien", "obrien"), ("&#65;&#098;", "ab"), ("Caf&#233;", "cafe"),
    ("x&#55296;y&#9999999;z", "x-y-z"), ("&#", ""), ("ﬁne Ｗｉｄｅ", "fine-wide"), ("日本", ""), ("İstanbul", "istanbul"),
    ("AT&amp;T", "at-t"), ("plain 1,000", "plain-1000"), ("&#x1F600; ok", "ok"), ("a&#38;#39;b", "a-39-b"),
])
def test_slugs(spark, name, slug):
    assert spark.createDataFrame([(name,)], "n string").select(slugify("n").alias("s")).first().s == slug
