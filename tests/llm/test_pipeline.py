from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from haulbook.session import fresh_dir

DIR = "/root/testdata/sf0.001"


def test_stages_on_planted_documents(spark, sample):
    """Planted copies, passages and benchmark texts go; clean documents stay."""
    docs = sample("documents")
    clean = docs.orderBy(F.length("text").desc()).select("text").first().text
    item = sample("benchmark").orderBy("item_id").first().text
    passage = clean[:800]
    extra = [
        (10_001, clean + " tail", "en", "src0", 0), (10_002, item, "en", "src1", 0), (10_003, None, "en", None, None), (10_004, "", "en", "src1", 0),
        (10_005, " ".join(f"fresh{i} words" for i in range(80)) + ". " + passage, "en", "src2", 0),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        path = fresh_dir(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    quality, near, cut, decontaminated, mixed = (seen[n] for n, _ in cp.STAGES)
    assert set(near) <= set(quality) and set(cut) == set(near) and set(decontaminated) <= set(cut)
    assert 10_001 not in near and 10_002 not in decontaminated
    if 10_005 in cut:
        assert passage not in cut[10_005].text and "fresh79" in cut[10_005].text
    assert set(mixed) == set(decontaminated)
    good = {r.doc_id for r in sample("labels").where("quality = 1").collect()}
    assert len(good & set(quality)) >= 0.98 * len(good)


def test_run_is_registered_and_repeatable(spark):
    a, b = cp.run(spark, DIR), cp.run(spark, DIR)
    assert Counter(map(tuple, a.select("doc_id", "taken").collect())) == Counter(map(tuple, b.select("doc_id", "taken").collect()))
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5


def test_empty_documents(spark, sample):
    docs = sample("documents").where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.collect() == []
        docs = docs if "text" in docs.columns else docs
