"""Orders, pages, top lists and ranks.

Exact ranks over a whole table never sort it in one task. Rows are counted per coarse
bucket of the order (a table of few rows), the counts are summed up to one offset per
bucket, and only inside a bucket is a row number drawn. A bucket holds at most
`DOT_BUCKET` consecutive USDOT numbers, so no task depends on the size of the table or
of its largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulbook.functions.cleaning import dot_order
from haulbook.operators.rows import summary
from haulbook.schemas import PAGE_SIZE

DOT_BUCKET_BITS = 16

NO_FLEET = -(2**40)


def fleet_key() -> Column:
    """Ascending sort key for: most vehicles first, unknown fleets last."""
    return -F.coalesce(F.col("total_vehicles").cast("bigint"), F.lit(NO_FLEET))


def fleet_order() -> list[Column]:
    return [
        F.desc_nulls_last("total_vehicles"), dot_order("usdot_number").asc(), F.asc("usdot_number")
    ]


def by_fleet(carriers: DataFrame) -> DataFrame:
    return carriers.orderBy(*fleet_order())


def dot_bucket() -> Column:
    return F.shiftright(dot_order("usdot_number"), DOT_BUCKET_BITS)


def exact_rank(
    rows: DataFrame,
    buckets: list[Column],
    order: list[Column],
    group: tuple[str, ...] = (),
    name: str = "rank",
) -> DataFrame:
    """1-based rank within `group` (the whole table when empty).

    `buckets` are non-null ascending sort keys, coarser than `order` and agreeing with it.
    """
    keys = [f"_b{i}" for i in range(len(buckets))]
    bucketed = rows.withColumns(dict(zip(keys, buckets, strict=True)))
    before = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    if group:
        before = W.partitionBy(*group).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    # Without a group this window runs in one task, over one row per bucket.
    offsets = (
        bucketed.groupBy(*group, *keys)
        .agg(F.count("*").alias("_n"))
        .select(*group, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(*group, *keys).orderBy(*order)
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*group, *keys])
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop(*keys, "_rn", "_offset")
    )


def fleet_rank(carriers: DataFrame, group: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    return exact_rank(carriers, [fleet_key(), dot_bucket()], fleet_order(), group, name)


def dot_rank(carriers: DataFrame, name: str = "rank") -> DataFrame:
    order = [dot_order("usdot_number").asc(), F.asc("usdot_number")]
    return exact_rank(carriers, [dot_bucket()], order, name=name)


def page_rows(carriers: DataFrame, page: int, per_page: int, by_rank: bool = False) -> DataFrame:
    """One page in fleet order.

    A top-n heap holds all rows up to the page's end, which suits the first pages. With
    `by_rank` rows are ranked instead: for callers that go far behind, as its cost does not
    grow with the page's number. Both give the same page.
    """
    first = (page - 1) * per_page
    if not by_rank:
        return by_fleet(carriers).offset(first).limit(per_page)
    ranked = fleet_rank(carriers)
    wanted = ranked.where(F.col("rank").between(first + 1, first + per_page))
    return wanted.orderBy("rank").drop("rank")


def page_envelope(
    carriers: DataFrame, page: int = 1, per_page: int = 25, by_rank: bool = False
) -> DataFrame:
    """One row: the page's items in order, and the total over all pages."""
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page starts at 1 and per_page lies between 1 and 100")
    items = summary(page_rows(carriers, page, per_page, by_rank))
    # The sort key travels with the item, so the order survives the aggregation.
    item = F.struct(
        fleet_key().alias("k1"), dot_order("usdot_number").alias("k2"),
        F.struct(*items.columns).alias("item"),
    )
    total = carriers.agg(F.count("*")).scalar()
    return (
        items.agg(F.array_sort(F.collect_list(item)).alias("sorted"))
        .select(F.transform("sorted", lambda x: x["item"]).alias("items"), total.alias("total"))
        .select(
            "items", "total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"),
            F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint").alias("pages"),
        )
    )


def listed(carriers: DataFrame) -> DataFrame:
    """Carriers that have a public page."""
    return carriers.where(F.col("is_active") & F.col("slug").isNotNull())


def top_fleets(carriers: DataFrame, limit: int = 1000) -> DataFrame:
    if not 1 <= limit <= 10_000:
        raise ValueError("limit lies between 1 and 10000")
    return summary(by_fleet(listed(carriers)).limit(limit))


def slug_pages(carriers: DataFrame, per_page: int = PAGE_SIZE) -> DataFrame:
    """(page, position, slug) of every listed carrier, in key order; pages start at 0."""
    if not 1 <= per_page <= PAGE_SIZE:
        raise ValueError(f"per_page lies between 1 and {PAGE_SIZE}")
    ranked = dot_rank(listed(carriers).select("usdot_number", "slug"))
    index = F.col("rank") - 1
    return ranked.select(
        F.floor(index / per_page).alias("page"),
        (index % per_page).alias("position"),
        "slug",
    )


def slug_page(carriers: DataFrame, page: int, per_page: int = PAGE_SIZE) -> DataFrame:
    rows = slug_pages(carriers, per_page).where(F.col("page") == page)
    return rows.orderBy("position").select("slug")


def latest_per_carrier(rows: DataFrame, day: str, k: int, ties: list[str]) -> DataFrame:
    """The `k` newest rows of every carrier.

    The rank filter is a plain constant, so Spark cuts each carrier to `k` rows inside
    every map task already: however many rows a mega fleet has, the task that ends up
    with it sees no more than k per map task.
    """
    order = [F.desc_nulls_last(day), *[F.asc_nulls_last(t) for t in ties]]
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy("usdot_number").orderBy(*order)))
    return ranked.where(F.col("rn") <= k)
