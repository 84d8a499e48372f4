import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from haulbook.operators import billing, ledger
from haulbook.plans.tables import PRICE_PLANS
from haulbook.schemas import SUBSCRIBERS


def subscriber(spark, *records):
    base = {"email": "buyer@example.com", "plan": "growth", "status": "active", "monthly_quota": 5, "usage_count": 0}
    full = []
    for r in records:
        row = dict.fromkeys(SUBSCRIBERS.names) | base | r
        full.append(tuple(row[n] for n in SUBSCRIBERS.names))
    df = spark.createDataFrame(full, SUBSCRIBERS)
    # Tests name the plain key; what is stored is its hash.
    return df.withColumn("api_key_hash", F.sha2("api_key_hash", 256))


def request_log(spark, requests):
    return spark.createDataFrame(requests, "request_id long, req_date date, api_key string, endpoint string")


def replay(requests, subscribers):
    """One request after the other, in arrival order."""
    state = {s["api_key_hash"]: {"status": "active", "monthly_quota": 5, "usage_count": 0} | s for s in subscribers}
    out = {}
    for rid, day, key, endpoint in sorted(requests):
        s = state.get(key)
        if s is None:
            out[rid] = 401
        elif s["status"] not in ("active", "trialing"):
            out[rid] = 403
        elif endpoint == billing.USAGE_ENDPOINT:
            out[rid] = 200
        else:
            start = s.get("usage_period_start")
            if start is None or (day - start).days >= 30:
                s["usage_period_start"], s["usage_count"] = day, 0
            if s["usage_count"] >= s["monthly_quota"]:
                out[rid] = 429
            else:
                s["usage_count"] += 1
                out[rid] = 200
    return out, state


@pytest.mark.parametrize("bits", [1, 16])
def test_metering_equals_a_replay(spark, monkeypatch, bits):
    monkeypatch.setattr(billing, "SLICE_BITS", bits)
    rng = random.Random(7)
    subs = [
        # The first key makes a third of all requests.
        {"subscription_id": "s0", "api_key_hash": "k0", "monthly_quota": 120},
        {"subscription_id": "s1", "api_key_hash": "k1", "monthly_quota": 1},
        {"subscription_id": "s2", "api_key_hash": "k2", "monthly_quota": 7, "status": "trialing",
         "usage_count": 4, "usage_period_start": date(2023, 12, 20)},
        {"subscription_id": "s3", "api_key_hash": "k3", "status": "canceled"},
        {"subscription_id": "s4", "api_key_hash": "k4", "monthly_quota": 3,
         "usage_count": 9, "usage_period_start": date(2024, 1, 1)},
        {"subscription_id": "s5", "api_key_hash": "k5", "monthly_quota": 0},
        {"subscription_id": "s6", "api_key_hash": "k6"},
    ]
    requests, day, rid = [], date(2024, 1, 1), 0
    for _ in range(1200):
        rid += rng.choice([1, 1, 1, 40])
        day += timedelta(days=rng.choice([0] * 12 + [1]))
        key = rng.choice(["k0"] * 5 + ["k1", "k2", "k3", "k4", "k5", "gone", None, ""])
        requests.append((rid, day, key, rng.choice(["/api/v1/carriers"] * 4 + [billing.USAGE_ENDPOINT])))
    want, state = replay([(r, d, k or None, e) for r, d, k, e in requests], subs)
    log, table = request_log(spark, requests), subscriber(spark, *subs)
    got = {r.request_id: r.outcome for r in billing.metered_requests(log, table).collect()}
    assert got == want
    usage = {r.subscription_id: r for r in billing.updated_usage(log, table).collect()}
    for s in state.values():
        r = usage[s["subscription_id"]]
        assert (r.usage_period_start, r.usage_count) == (s.get("usage_period_start"), s.get("usage_count", 0))


def test_quota_blocks_and_usage_calls_are_free(spark):
    day = date(2026, 7, 1)
    log = request_log(
        spark, [(1, day, "k", "/c"), (2, day, "k", billing.USAGE_ENDPOINT), (3, day, "k", "/c"), (4, day, "k", "/c")]
    )
    subs = subscriber(spark, {"subscription_id": "s", "api_key_hash": "k", "monthly_quota": 2})
    assert {r.request_id: r.outcome for r in billing.metered_requests(log, subs).collect()} == {1: 200, 2: 200, 3: 200, 4: 429}
    report = billing.usage_report(billing.updated_usage(log, subs)).first()
    assert (report.usage_count, report.remaining, report.period_start) == (2, 0, day)


def test_period_rolls_over_after_30_days(spark):
    today = date(2026, 7, 31)
    subs = subscriber(
        spark, {"subscription_id": "s", "api_key_hash": "k", "monthly_quota": 1, "usage_count": 1,
                "usage_period_start": today - timedelta(days=31)},
    )
    log = request_log(spark, [(1, today, "k", "/c")])
    assert billing.metered_requests(log, subs).first().outcome == 200
    after = billing.updated_usage(log, subs).first()
    assert (after.usage_count, after.usage_period_start) == (1, today)


def events(spark, *records):
    names = ("seq", "event_type", "sub_id", "status", "customer_id", "price_id")
    rows = [tuple({"seq": i, "event_type": "subscription.updated"}.get(n) if n not in r else r[n] for n in names) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "seq long, event_type string, sub_id string, status string, customer_id string, price_id string")


def test_event_bodies_and_plans(spark):
    def body(items):
        return json.dumps({"event_type": "subscription.created", "data": {"id": "s", "status": "active", "customer_id": "c", "items": items}})

    bodies = [
        body([{"price": {"id": "pri_p"}}]), body([{"price": {}}, {"price": {"id": ""}}, {"price": {"id": "pri_s"}}]),
        body([{"price": {"id": "pri_future"}}]), body([]), '{"event_type":"subscription.created"}',
        body([{"price": {"id": ""}}]), "garbage",
    ]
    raw = spark.createDataFrame(list(enumerate(bodies)), "seq long, body string")
    got = {r.seq: r.plan for r in billing.with_plan(billing.parse_events(raw), PRICE_PLANS).collect()}
    assert got == {0: "pro", 1: "standard", 2: "growth", 3: "growth", 4: "growth", 5: "growth", 6: "growth"}


def test_subscription_fold(spark):
    old = subscriber(
        spark, {"subscription_id": "same", "plan": "pro", "monthly_quota": 777, "customer_id": "c0"},
        {"subscription_id": "away", "plan": "pro", "monthly_quota": 777}, {"subscription_id": "still", "monthly_quota": 9},
    )
    batch = events(
        spark,
        {"sub_id": "same", "price_id": "pri_p", "status": "past_due"},
        {"sub_id": "away", "price_id": "pri_s"}, {"sub_id": "away", "price_id": "pri_p"},
        {"sub_id": "new", "price_id": "pri_s", "customer_id": "c1"}, {"sub_id": "new", "price_id": "pri_s", "status": "canceled"},
        {"sub_id": "new", "event_type": "transaction.completed", "price_id": "pri_p"}, {"sub_id": None}, {"sub_id": ""},
    )
    got = {r.subscription_id: r for r in billing.fold_subscriptions(batch, PRICE_PLANS, old).collect()}
    assert set(got) == {"same", "away", "still", "new"}
    # A custom quota outlives events on the same plan, but not a change and back.
    assert (got["same"].monthly_quota, got["same"].status, got["same"].customer_id) == (777, "past_due", "c0")
    assert (got["away"].monthly_quota, got["away"].plan) == (300_000, "pro")
    assert (got["new"].monthly_quota, got["new"].status, got["new"].customer_id, got["new"].email) == (150_000, "canceled", "c1", "")
    assert got["still"].monthly_quota == 9 and got["still"].email == "buyer@example.com"
    fresh = billing.fold_subscriptions(batch.where("sub_id = 'new'"), PRICE_PLANS).first()
    assert fresh.monthly_quota == 150_000


def test_ledger(spark):
    log = spark.sql(
        "select * from values "
        "(1L, 1L, 'a', 'running', null, null, timestamp '2026-07-01 00:00:00', null), "
        "(1L, 2L, 'a', 'completed', 10L, null, null, timestamp '2026-07-01 01:00:00'), "
        "(2L, 3L, 'a', 'running', null, null, timestamp '2026-07-02 00:00:00', null), "
        "(2L, 4L, 'a', 'failed', null, repeat('x', 3000), null, timestamp '2026-07-02 01:00:00'), "
        "(3L, 5L, 'b', 'running', null, null, timestamp '2026-07-02 00:00:00', null) "
        "as v(job_id, seq, source, status, total_records, error_message, started_at, completed_at)"
    )
    rows = ledger.ledger_rows(log)
    state = {r.job_id: r for r in ledger.latest_state(rows).collect()}
    assert (state[1].status, state[1].total_records, str(state[1].started_at)) == ("completed", 10, "2026-07-01 00:00:00")
    assert (state[2].status, len(state[2].error_message)) == ("failed", 2000)
    due = {at: {r.source: r.due for r in ledger.due_sources(rows, at).collect()} for at in ("2026-07-02 00:59:59", "2026-07-02 01:00:00")}
    assert due == {"2026-07-02 00:59:59": {"a": False, "b": True}, "2026-07-02 01:00:00": {"a": True, "b": True}}
