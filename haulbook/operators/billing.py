"""Subscriptions, access decisions and quota metering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulbook.functions import cleaning as c
from haulbook.schemas import (
    ACTIVE_STATUSES, DEFAULT_PLAN, PLAN_QUOTAS, QUOTA_PERIOD_DAYS, SUBSCRIBERS,
    SUBSCRIPTION_EVENT, constant_table, empty,
)
from haulbook.session import materialize

USAGE_ENDPOINT = "/api/v1/usage"
# Single requests are looked at in slices of 2^16 consecutive ids.
SLICE_BITS = 16


def parse_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Event JSON to (seq, event_type, sub_id, status, customer_id, price_id).

    The price is the first non-empty one among the items.
    """
    event = raw.select("seq", F.from_json(body, SUBSCRIPTION_EVENT).alias("e"))
    prices = F.filter(F.col("e.data.items.price.id"), lambda p: p != "")
    return event.select(
        "seq",
        F.col("e.event_type").alias("event_type"),
        F.col("e.data.id").alias("sub_id"),
        F.col("e.data.status").alias("status"),
        F.col("e.data.customer_id").alias("customer_id"),
        F.get(prices, F.lit(0)).alias("price_id"),
    )


def with_plan(events: DataFrame, price_plans: dict[str, str]) -> DataFrame:
    """Adds `plan` by price id; unknown or missing prices mean the entry plan.

    Configured prices are a handful, hence the broadcast; empty ids are not configured.
    """
    configured = {price: plan for price, plan in price_plans.items() if price}
    if not configured:
        return events.withColumn("plan", F.lit(DEFAULT_PLAN))
    prices = constant_table(events.sparkSession, configured, "price_id", "plan")
    return events.join(F.broadcast(prices), "price_id", "left").withColumn(
        "plan", F.coalesce("plan", F.lit(DEFAULT_PLAN))
    )


def plan_quota(plan: Column | str) -> Column:
    out = F.lit(PLAN_QUOTAS[DEFAULT_PLAN])
    for name, quota in PLAN_QUOTAS.items():
        out = F.when(c.col(plan) == name, F.lit(quota)).otherwise(out)
    return out


def fold_subscriptions(
    events: DataFrame, price_plans: dict[str, str], existing: DataFrame | None = None
) -> DataFrame:
    """Subscription events, in order of `seq`, onto the known subscriptions.

    A quota moves only with the plan: whoever was on the plan of all the new events
    keeps the quota they had, even a custom one. If any event named another plan, the
    last change set the quota, and that is the quota of the last plan.
    """
    relevant = with_plan(
        events.where(F.startswith("event_type", F.lit("subscription.")) & (F.col("sub_id") != "")),
        price_plans,
    )
    customer = c.blank_to_null("customer_id")
    folded = relevant.groupBy(F.col("sub_id").alias("subscription_id")).agg(
        F.max_by(F.coalesce(c.blank_to_null("status"), F.lit("active")), "seq").alias("status"),
        F.max_by(customer, F.when(customer.isNotNull(), F.col("seq"))).alias("customer_id"),
        F.max_by("plan", "seq").alias("plan"),
        F.min("plan").alias("lowest"),
        F.max("plan").alias("highest"),
    )
    if existing is None:
        existing = empty(folded.sparkSession, SUBSCRIBERS)
    old, new = existing.alias("o"), folded.alias("n")
    key = "subscription_id"
    known, touched = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    same_plan = (F.col("n.lowest") == F.col("o.plan")) & (F.col("n.highest") == F.col("o.plan"))
    out = {n: F.col(f"o.{n}") for n in existing.columns}
    out[key] = F.coalesce(f"n.{key}", f"o.{key}")
    for n in ("status", "customer_id", "plan"):
        out[n] = F.coalesce(f"n.{n}", f"o.{n}")
    out["email"] = F.when(known, F.col("o.email")).otherwise(F.lit(""))
    out["monthly_quota"] = F.when(
        touched & ~F.coalesce(known & same_plan, F.lit(False)), plan_quota("n.plan")
    ).otherwise(F.col("o.monthly_quota"))
    out["usage_count"] = F.coalesce("o.usage_count", F.lit(0))
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[out[n].alias(n) for n in existing.columns])


def key_access(requests: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Requests with their subscriber and `access`: 401, 403, or 200 for a usable key."""
    subs = subscribers.select(
        F.col("api_key_hash"), "subscription_id", F.col("status").alias("subscription_status")
    )
    usable = F.col("subscription_status").isin(*ACTIVE_STATUSES)
    joined = requests.withColumn("api_key_hash", _spreading_hash("api_key")).join(
        subs, "api_key_hash", "left"
    )
    access = F.when(F.col("subscription_id").isNull(), 401).when(~usable, 403).otherwise(200)
    return joined.drop("api_key_hash").withColumn("access", access)


def _stripped_keys(requests: DataFrame) -> DataFrame:
    return requests.withColumn("api_key", c.blank_to_null(c.strip("api_key")))


def _spreading_hash(key: str) -> Column:
    """The key's hash; requests without a key get ones that spread and match nothing."""
    keyless = F.concat(F.lit("#"), F.col("request_id").cast("string"))
    return F.coalesce(c.api_key_hash(c.blank_to_null(c.strip(key))), keyless)


@dataclass
class Metering:
    """Daily use per key and the quota periods of a request log."""

    requests: DataFrame  # the log, keys stripped
    days: DataFrame  # one row per (api_key, req_date)
    per_day: DataFrame  # billed days with what the quota has left for them
    periods: DataFrame  # one row per (subscription_id, period_start)


def meter(requests: DataFrame, subscribers: DataFrame) -> Metering:
    """Quota arithmetic on daily counts instead of on requests.

    The log is first counted per key and day. Periods follow from the days with a billed
    request: one starts on the first such day at least 30 days after the last start. A
    running sum of the daily counts tells days that fit the quota from days beyond it.
    However busy a key, its rows never have to come together.

    The daily counts are written out here, by one pass over the log. Who needs the outcome
    of single requests asks `outcomes` next, which looks at the days on which a quota runs out;
    who needs the periods only (`moved_usage`) reads no more of the log.
    """
    billed = F.col("endpoint") != USAGE_ENDPOINT
    requests = _stripped_keys(requests)
    days = (
        requests.where(F.col("api_key").isNotNull())
        .groupBy("api_key", "req_date")
        .agg(F.count_if(billed).alias("billed"))
        .withColumn("api_key_hash", c.api_key_hash("api_key"))
    )
    days = materialize(days, "request-days")
    subs = subscribers.select(
        "api_key_hash", "subscription_id", F.col("status").alias("subscription_status"),
        "monthly_quota", "usage_period_start", "usage_count",
    )
    usable = F.col("subscription_status").isin(*ACTIVE_STATUSES)
    days = days.join(subs, "api_key_hash", "left").withColumn(
        "access",
        F.when(F.col("subscription_id").isNull(), 401).when(~usable, 403).otherwise(200),
    )
    counted = days.where((F.col("access") == 200) & (F.col("billed") > 0))
    starts = (
        counted.groupBy("subscription_id")
        .agg(
            F.array_sort(F.collect_set("req_date")).alias("dates"),
            F.max("usage_period_start").alias("open_start"),
        )
        .select("subscription_id", _period_starts("dates", "open_start").alias("starts"))
    )
    begun = F.coalesce(
        F.array_max(F.filter("starts", lambda s: s <= F.col("req_date"))), F.get("starts", F.lit(0))
    )
    per_day = counted.join(starts, "subscription_id").withColumn("period_start", begun)
    earlier = (
        W.partitionBy("subscription_id", "period_start")
        .orderBy("req_date", "api_key")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    carried = F.when(
        F.col("period_start") == F.col("usage_period_start"), F.col("usage_count")
    ).otherwise(F.lit(0))
    per_day = (
        per_day.withColumn("carried", F.coalesce(carried, F.lit(0)))
        .withColumn("used_before", F.col("carried") + F.coalesce(F.sum("billed").over(earlier), F.lit(0)))
        .withColumn("left_today", F.greatest(F.col("monthly_quota") - F.col("used_before"), F.lit(0)))
    )
    per_day = materialize(per_day, "metered-days")
    periods = per_day.groupBy("subscription_id", "period_start").agg(
        F.sum("billed").alias("requested"), F.max("carried").alias("carried"),
        F.max("monthly_quota").alias("monthly_quota"),
    )
    periods = periods.withColumn(
        "used",
        F.greatest(
            F.least(F.col("carried") + F.col("requested"), F.col("monthly_quota")), F.col("carried")
        ),
    )
    return Metering(
        requests=requests,
        days=days.select("api_key", "req_date", "subscription_id", "access"),
        per_day=per_day,
        periods=periods,
    )


def _period_starts(dates: str, open_start: str) -> Column:
    """Fold of sorted request days into period starts; a period open from before leads."""
    opening = F.when(F.col(open_start).isNotNull(), F.array(open_start)).otherwise(
        F.array().cast("array<date>")
    )

    def step(starts: Column, day: Column) -> Column:
        last = F.get(starts, F.size(starts) - 1)
        due = last.isNull() | (F.datediff(day, last) >= QUOTA_PERIOD_DAYS)
        return F.when(due, F.concat(starts, F.array(day))).otherwise(starts)

    return F.aggregate(dates, opening, step)


def _cut_ids(requests: DataFrame, per_day: DataFrame) -> DataFrame:
    """Per day on which a quota runs out, the id of the last request it still covered.

    At most one day per period. Its requests are counted per slice of consecutive ids,
    and numbered only in the slice that holds the last covered one. Ids are unique, so a
    slice has no more rows than ids, however busy the key is.
    """
    days = per_day.where((F.col("left_today") > 0) & (F.col("left_today") < F.col("billed"))).select(
        "api_key", "req_date", "left_today"
    )
    rows = (
        requests.where(F.col("endpoint") != USAGE_ENDPOINT)
        .select("api_key", "req_date", "request_id")
        .join(days, ["api_key", "req_date"])
        .withColumn("slice", F.shiftright("request_id", SLICE_BITS))
        .select("api_key", "req_date", "slice", "request_id", "left_today")
    )
    rows = materialize(rows, "quota-end-days")
    running = W.partitionBy("api_key", "req_date").orderBy("slice")
    slices = (
        rows.groupBy("api_key", "req_date", "slice", "left_today")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(running.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("before", F.col("upto") - F.col("n"))
        .where((F.col("before") < F.col("left_today")) & (F.col("upto") >= F.col("left_today")))
        .select("api_key", "req_date", "slice", (F.col("left_today") - F.col("before")).alias("take"))
    )
    within = W.partitionBy("api_key", "req_date", "slice").orderBy("request_id")
    return (
        rows.select("api_key", "req_date", "slice", "request_id")
        .join(slices, ["api_key", "req_date", "slice"])
        .withColumn("rn", F.row_number().over(within))
        .where(F.col("rn") == F.col("take"))
        .select("api_key", "req_date", F.col("request_id").alias("cut_id"))
    )


def outcomes(metering: Metering) -> DataFrame:
    """Every request with its outcome: 200, 401, 403 or 429, and its quota period."""
    cuts = _cut_ids(metering.requests, metering.per_day)
    verdict = metering.per_day.join(cuts, ["api_key", "req_date"], "left").select(
        "api_key", "req_date", "period_start", "left_today", "cut_id",
    )
    days = metering.days.join(verdict, ["api_key", "req_date"], "left").withColumnRenamed("api_key", "_key")
    keyless = F.concat(F.lit("#"), F.col("request_id").cast("string"))
    keyed = metering.requests.withColumn("_key", F.coalesce("api_key", keyless))
    joined = keyed.join(days, ["_key", "req_date"], "left")
    is_usage = F.col("endpoint") == USAGE_ENDPOINT
    covered = (F.col("left_today") > 0) & (
        F.col("cut_id").isNull() | (F.col("request_id") <= F.col("cut_id"))
    )
    outcome = (
        F.when(F.coalesce("access", F.lit(401)) != 200, F.coalesce("access", F.lit(401)))
        .when(is_usage | covered, 200)
        .otherwise(429)
    )
    return joined.select(
        "request_id", "req_date", "subscription_id", "endpoint", outcome.alias("outcome"),
        F.when(~is_usage, F.col("period_start")).alias("period_start"),
    )


def metered_requests(requests: DataFrame, subscribers: DataFrame) -> DataFrame:
    return outcomes(meter(requests, subscribers))


def moved_usage(metering: Metering, subscribers: DataFrame) -> DataFrame:
    """Subscribers with their usage state moved on past the metered requests."""
    latest = metering.periods.groupBy("subscription_id").agg(
        F.max(F.struct("period_start", "used")).alias("last")
    )
    joined = subscribers.join(latest, "subscription_id", "left")
    return joined.withColumns(
        {
            "usage_period_start": F.coalesce("last.period_start", "usage_period_start"),
            "usage_count": F.coalesce("last.used", "usage_count", F.lit(0)),
        }
    ).select(*subscribers.columns)


def updated_usage(requests: DataFrame, subscribers: DataFrame) -> DataFrame:
    return moved_usage(meter(requests, subscribers), subscribers)


def usage_report(subscribers: DataFrame) -> DataFrame:
    return subscribers.select(
        "subscription_id", "plan", "status", "monthly_quota",
        F.coalesce("usage_count", F.lit(0)).alias("usage_count"),
        F.greatest(
            F.col("monthly_quota") - F.coalesce("usage_count", F.lit(0)), F.lit(0)
        ).alias("remaining"),
        F.col("usage_period_start").alias("period_start"),
    )
