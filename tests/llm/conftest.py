import duckdb
import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash
    with names the operators use inside."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        return df.withColumns({n: F.lit("extra") for n in ("doc", "row", "k1", "ranges", "score", "size", "tid", "id", "class", "y", "drawn")})

    return make


@pytest.fixture(scope="session")
def labels(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sample(spark):
    """A given table, as rows of a dictionary."""
    return lambda name: spark.read.parquet(f"{DIR}/{name}.parquet")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return con
