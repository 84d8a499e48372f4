"""Times the headline jobs and prints one JSON line.

The raw feeds are derived from the given tables and landed as files first, untimed, as a
download would leave them. The loads then go from the landed files to the stored tables,
and the queries read those. Every result is consumed in full (no-op sink). One untimed
pass over the smallest data warms the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulbook.operators import directory, documents, ranking, rows, safety
from haulbook.plans.registry import REGISTRY
from haulbook.plans.tables import Tables
from haulbook.session import build_session, fresh_dir

WARM_UP_DIR = "/root/testdata/sf0.001"

FEEDS = (
    "census", "enrichment", "basics", "inspections", "violations", "subscribers", "requests",
    "subscription_events", "terms", "slug_requests",
)
# A stored table -> the name of its load.
LOADS = {
    "carriers": "load_census", "scores": "load_basics", "inspections": "load_inspections",
    "violations": "load_violations",
}
# name -> registered query
REGISTERED = {
    "census_upsert": "j06_census_upsert",
    "replace_scores": "j05_replace_scores",
    "batch_name_search": "f04_batch_search",
    "slug_lookup": "f07_lookup_slug",
    "directory_stats": "a01_directory_stats",
    "carriers_by_state": "a02_carriers_by_state",
    "latest_inspections": "k05_latest_inspections",
    "latest_violations": "k06_latest_violations",
    "state_listings": "d10_state_item_lists",
    "sitemaps": "d11_sitemap_files",
    "home_summary": "d14_home_summary",
    "subscription_fold": "b01_subscription_fold",
    "quota_metering": "b03_metered_requests",
}


class LandedTables(Tables):
    """The tables over feeds that were landed as files."""

    def __init__(self, spark: SparkSession, landing: str):
        super().__init__(spark, landing)

    def feed(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}")


def land(spark: SparkSession, sf_dir: str) -> str:
    landing = fresh_dir(spark, "landing")
    for name in FEEDS:
        feed = Tables(spark, sf_dir).feed(name)
        feed.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{landing}/{name}")
    return landing


def _documents(t: Tables) -> DataFrame:
    return documents.carrier_documents(t.document_base)


def _search(t: Tables) -> DataFrame:
    found = directory.search(t.carriers, "dba BUILD")
    return rows.summary(ranking.by_fleet(found)).limit(25)


DIRECT: dict[str, Callable[[Tables], DataFrame]] = {
    "name_search": _search,
    "top_fleets": lambda t: ranking.top_fleets(t.carriers, 1000),
    "safety_profiles": lambda t: safety.safety_profiles(
        t.carriers, t.scores, t.inspections, t.violations
    ),
    "carrier_documents": _documents,
}


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def run(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], int]:
    seconds: dict[str, float] = {}
    landing = land(spark, sf_dir)

    def timed(name: str, job: Callable[[], object]) -> None:
        started = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - started, 3)

    for table, name in LOADS.items():
        timed(name, lambda table=table: getattr(LandedTables(spark, landing), table))
    jobs = {name: REGISTRY[key] for name, key in REGISTERED.items()} | DIRECT
    for name, job in jobs.items():
        timed(name, lambda job=job: consume(job(LandedTables(spark, landing))))
    return seconds, spark.read.parquet(f"{landing}/violations").count()


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM_UP_DIR) and os.path.abspath(sf_dir) != WARM_UP_DIR:
        run(spark, WARM_UP_DIR)
    seconds, violations = run(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "violations_per_second": round(violations / seconds["load_violations"]),
            }
        )
    )
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
