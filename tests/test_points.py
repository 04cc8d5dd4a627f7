from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slotwise.operators import points
from slotwise.operators.spread import running_totals
from slotwise.sources import seeds
from tests.conftest import rows

NOW = dt.datetime(2001, 7, 15, 12)
LEDGER = (
    "id STRING, user_id LONG, reservation_id LONG, transaction_type STRING, amount LONG, status STRING, "
    "available_from TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ, related_user_id LONG, created_at TIMESTAMP_NTZ"
)


def line(id, user, amount, status="available", start=None, end=None, kind="earned_service", reservation=None, at=NOW):
    return (id, user, reservation, kind, amount, status, start, end, None, at)


def test_award_golden_values_and_no_second_award(spark, tables):
    booked = [(1, 7, 200_000, "completed"), (2, 7, 400_000, "completed"), (3, 7, 300_000, "completed"),
              (4, 7, 39, "completed"), (5, 7, 100_000, "confirmed"), (6, 7, 100_000, "completed")]
    t = tables(
        reservations=(booked, "id LONG, user_id LONG, total_amount LONG, status STRING"),
        point_transactions=([line("x", 7, 2500, reservation=6)], LEDGER),
        system_settings=seeds.settings(spark),
    )
    got = points.award_service_points(t, NOW)
    assert rows(got.select("reservation_id", "amount")) == [(1, 5000), (2, 7500), (3, 7500), (4, 0)]
    assert {r.available_from for r in got.collect()} == {NOW + dt.timedelta(days=7)}


def test_award_without_settings_uses_fixed_rules(spark, tables):
    t = tables(
        reservations=([(1, 7, 400_000, "completed")], "id LONG, user_id LONG, total_amount LONG, status STRING"),
        point_transactions=([], LEDGER),
        system_settings=seeds.settings(spark).filter("setting_key = 'none'"),
    )
    assert points.award_service_points(t, NOW).first().amount == 7500


def test_balance_boundaries(spark):
    second = dt.timedelta(seconds=1)
    ledger = spark.createDataFrame(
        [
            line("a", 1, 10, start=NOW), line("b", 1, 20, start=NOW + second), line("c", 1, 40, end=NOW),
            line("d", 1, 80, end=NOW + second), line("e", 1, 160), line("f", 1, -5), line("g", 1, 320, "pending"),
        ],
        LEDGER,
    )
    assert rows(points.ledger_balances(ledger, NOW)) == [(1, 310, 10 + 80 + 160 - 5)]
    assert rows(points.point_balances(ledger, NOW)) == [(1, 630, 5, 245, 320)]


def test_maturation(spark):
    past, future = NOW - dt.timedelta(days=1), NOW + dt.timedelta(days=1)
    ledger = spark.createDataFrame(
        [
            line("a", 1, 1, "pending", NOW), line("b", 1, 1, "pending", future), line("c", 1, 1, "pending", past, NOW),
            line("d", 1, 1, "available", past, NOW), line("e", 1, 1, "available", past, future),
            line("f", 1, 1, "used", past, past), line("g", 1, 1, "pending"),
        ],
        LEDGER,
    )
    got = dict(rows(points.points_maturation(ledger, NOW).select("id", "status")))
    assert got == {
        "a": "available", "b": "pending", "c": "expired", "d": "expired", "e": "available", "f": "used", "g": "pending",
    }


def test_running_totals_of_one_large_user(spark):
    """One key with a third of all rows, many equal moments and some without a moment."""
    rng = random.Random(5)
    start = dt.datetime(2001, 1, 1)
    data = []
    for i in range(1200):
        user = 0 if i % 3 == 0 else rng.randrange(1, 40)
        moment = None if i % 50 == 0 else start + dt.timedelta(hours=rng.randrange(24 * 9))
        data.append((f"r{i:05d}", user, moment, rng.randrange(-50, 100)))
    df = spark.createDataFrame(data, "id STRING, user_id INT, at TIMESTAMP_NTZ, amount INT")
    got = {
        r.id: (r.balance, r.n, r.final)
        for r in running_totals(
            df, "user_id", "at", "id", {"balance": F.col("amount"), "n": F.lit(1)}, finals={"final": "n"}
        ).collect()
    }
    want = {}
    for user in {d[1] for d in data}:
        own = sorted((d for d in data if d[1] == user), key=lambda d: (d[2] is not None, d[2] or start, d[0]))
        total = 0
        for n, d in enumerate(own, 1):
            total += d[3]
            want[d[0]] = (total, n, len(own))
    assert got == want


def test_history_pages_and_tabs(spark):
    ledger = spark.createDataFrame(
        [line(f"{i:03d}", 1, 10 if i % 2 else -1, at=NOW + dt.timedelta(minutes=i)) for i in range(70)], LEDGER
    )
    assert points.points_history(ledger, page=0).count() == 30
    assert points.points_history(ledger, page=2).count() == 10
    newest = points.points_history(ledger, page=0).orderBy(F.desc("created_at")).first()
    assert (newest.id, newest.balance_after) == ("069", 35 * 10 - 35)
    used = points.points_history(ledger, tab="used")
    assert used.count() == 35 and used.filter("page = 0").count() == 30


def brute_force(requests, funds):
    left = dict(funds)
    result = {}
    for request, user, _at, amount in sorted(requests, key=lambda r: (r[2], r[0])):
        ok = 0 < amount <= left.get(user, 0)
        if ok:
            left[user] -= amount
        result[request] = ok
    return result


def test_redemption_is_sequential(spark):
    """The rounds give what deciding one by one gives."""
    rng = random.Random(11)
    funds = {u: rng.choice([0, 1, 7, 100, 5000]) for u in range(12)}
    requests = []
    for i in range(600):
        user = 0 if i % 3 == 0 else rng.randrange(14)
        when = dt.datetime(2001, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 6))
        requests.append((i, user, when, rng.choice([-1, 0, 1, 2, 3, 50, 60, 99, 400, 2600, rng.randrange(1, 5000)])))
    funds[0] = 5000
    asked = spark.createDataFrame(requests, "request_id INT, user_id INT, requested_at TIMESTAMP_NTZ, amount LONG")
    held = spark.createDataFrame(list(funds.items()), "user_id INT, available_points LONG")
    got = {r.request_id: r.accepted for r in points.point_redemption(asked, held).collect()}
    assert got == brute_force(requests, funds)


def test_rejected_request_costs_nothing(spark):
    start = dt.datetime(2001, 1, 1)
    asked = spark.createDataFrame(
        [(1, 1, start, 60), (2, 1, start + dt.timedelta(1), 50), (3, 1, start + dt.timedelta(2), 40)],
        "request_id INT, user_id INT, requested_at TIMESTAMP_NTZ, amount LONG",
    )
    held = spark.createDataFrame([(1, 100)], "user_id INT, available_points LONG")
    got = points.point_redemption(asked, held)
    assert rows(got.select("request_id", "accepted")) == [(1, True), (2, False), (3, True)]
