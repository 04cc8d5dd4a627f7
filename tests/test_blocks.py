"""Orders over very large groups: block sums, first come first served, and the one-scan funnel."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from slotwise.operators import analytics, outreach
from slotwise.operators.spread import first_come, in_blocks, running_totals
from tests.conftest import rows

DAY = dt.datetime(2001, 7, 1)


def test_one_users_single_day_is_spread_over_all_tasks(spark):
    """A user with a third of all rows, all at one instant, so that only the ids can be cut."""
    data = [(f"r{i:05d}", 0 if i % 3 == 0 else i, DAY, 1) for i in range(9000)]
    df = spark.createDataFrame(data, "id STRING, user_id INT, at TIMESTAMP_NTZ, amount INT")
    blocks = in_blocks(df, "user_id", "at", "id", 12)
    own = {r["__block"]: r["count"] for r in blocks.filter("user_id = 0").groupBy("__block").count().collect()}
    assert len(own) >= 4 and max(own.values()) < 1500
    got = {r.id: (r.n, r.all) for r in running_totals(df, "user_id", "at", "id", {"n": F.lit(1)}, {"all": "n"}, blocks=12).collect()}
    assert all(got[f"r{i:05d}"] == ((i // 3 + 1, 3000) if i % 3 == 0 else (1, 1)) for i in range(9000))


def test_block_sums_of_null_keys_moments_and_values(spark):
    r = random.Random(2)
    data = [
        (f"r{i:04d}", r.choice((None, 1, 1, 2)), r.choice((None, DAY, DAY + dt.timedelta(hours=1), DAY - dt.timedelta(days=3))), r.choice((None, 1, -2, 5)))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "id STRING, k INT, at TIMESTAMP_NTZ, v INT")
    got = {x.id: (x.s, x.n) for x in running_totals(df, "k", "at", "id", {"s": F.coalesce("v", F.lit(0)), "n": F.lit(1)}, blocks=9).collect()}
    want = {}
    for k in (None, 1, 2):
        s = 0
        own = sorted((d for d in data if d[1] == k), key=lambda d: (d[2] is not None, d[2] or DAY, d[0]))
        for n, d in enumerate(own, 1):
            s += d[3] or 0
            want[d[0]] = (s, n)
    assert got == want


def test_first_come_first_served(spark):
    r = random.Random(3)
    room = {"a": 100, "b": 7, "c": 0, "d": 50, "e": 1000}
    data = [
        (i, k, r.choice((None, *(DAY + dt.timedelta(hours=6 * h) for h in range(12)))), room[k])
        for i, k in enumerate(r.choice("aaaabcde") for _ in range(900))
    ]
    data += [(1000 + i, "d", DAY + dt.timedelta(days=9), 50) for i in range(60)]
    df = spark.createDataFrame(data, "id INT, k STRING, at TIMESTAMP_NTZ, room INT")
    got = {x.id: x.wins for x in first_come(df, "k", "at", "id", "room").collect()}
    want = {}
    for k in ("a", "b", "d"):
        own = sorted((d for d in data if d[1] == k), key=lambda d: (d[2] is not None, d[2] or DAY, d[0]))
        want |= {d[0]: n < room[k] for n, d in enumerate(own)}
    assert got == want


def brute_claims(claims, usages, limits):
    total, own, out = {}, {}, {}
    for p, u in usages:
        total[p] = total.get(p, 0) + 1
        own[p, u] = own.get((p, u), 0) + 1
    pair, of_promotion = {}, {}
    for claim, p, u, _, at in sorted(claims, key=lambda c: (c[4], c[0])):
        if p not in limits:
            out[claim] = "unknown"
            continue
        limit, per_user = limits[p]
        pair[p, u] = pair.get((p, u), 0) + 1
        used = own.get((p, u), 0) if u is not None else 0
        if per_user is not None and used + pair[p, u] > per_user:
            out[claim] = "used up by user"
            continue
        of_promotion[p] = of_promotion.get(p, 0) + 1
        out[claim] = "used up" if limit is not None and total.get(p, 0) + of_promotion[p] > limit else None
    return out


def test_claims_against_limits(spark, tables):
    """One promotion with most claims on one day, users who ask often, and limits of every kind."""
    r = random.Random(6)
    limits = {1: (40, 3), 2: (None, 2), 3: (5, None), 4: (0, 9), 5: (10_000, 10_000), 6: (3, 1)}
    usages = [(r.choice((1, 2, 3, 6)), r.randrange(12)) for _ in range(30)]
    claims = []
    for i in range(700):
        p = 1 if i % 3 == 0 else r.choice((1, 2, 3, 4, 5, 6, 7, None))
        at = DAY + dt.timedelta(hours=r.randrange(3) if p == 1 else r.randrange(90))
        claims.append((i, p, r.choice((None, *range(12))), 100, at))
    t = tables(
        promotions=(
            [(p, True, DAY - dt.timedelta(9), DAY + dt.timedelta(99), None, '{"discount_rate": 10}', a, b) for p, (a, b) in limits.items()],
            "id LONG, is_active BOOLEAN, starts_at TIMESTAMP_NTZ, ends_at TIMESTAMP_NTZ, conditions STRING, benefits STRING, "
            "usage_limit LONG, usage_limit_per_user LONG",
        ),
        promotion_usages=(usages, "promotion_id LONG, user_id LONG"),
    )
    frame = spark.createDataFrame(
        [(c, p, u, a, "x", at) for c, p, u, a, at in claims],
        "claim_id LONG, promotion_id LONG, user_id LONG, amount LONG, category STRING, claimed_at TIMESTAMP_NTZ",
    )
    got = {x.claim_id: x.reason for x in outreach.promotion_eligibility(t, frame, DAY).collect()}
    assert got == brute_claims(claims, usages, limits)


STEPS = ("a", "b", "a", "c")


def brute_funnel(events, steps):
    users = [0] * len(steps)
    for user in {e[0] for e in events if e[0] is not None}:
        at = None
        for i, step in enumerate(steps):
            later = [e[2] for e in events if e[0] == user and e[1] == step and e[2] is not None and (at is None or e[2] >= at)]
            if not later:
                break
            at = min(later)
            users[i] += 1
    return users


def test_funnel_against_brute_force_with_ties(spark):
    r = random.Random(7)
    moments = [DAY + dt.timedelta(seconds=s) for s in (0, 0, 1, 59, 60, 61, 3600, 86400, 86401)]
    events = [(r.randrange(60), r.choice("abcx"), r.choice(moments)) for _ in range(260)]
    events += [(1000, r.choice("abc"), DAY + dt.timedelta(seconds=i // 3)) for i in range(600)] + [(None, "a", DAY), (5, "b", None)]
    frame = spark.createDataFrame(events, "user_id LONG, event_type STRING, ts TIMESTAMP_NTZ")
    for steps in (STEPS, ("a",), ("c", "b", "a")):
        want = brute_funnel(events, steps)
        got = [x.users for x in analytics.event_funnel(frame, steps).orderBy("step_number").collect()]
        assert got == want
        # Stored minutes of two halves, merged to days, give the same.
        states = analytics.funnel_states(frame.filter("user_id % 2 = 0"), steps).unionByName(
            analytics.funnel_states(frame.filter("user_id % 2 = 1"), steps)
        )
        days = analytics.merge_funnel_states(states, "day", steps)
        assert [x.users for x in analytics.funnel_counts(days, steps).orderBy("step_number").collect()] == want


def test_funnel_reads_events_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", DAY)], "user_id LONG, event_type STRING, ts TIMESTAMP_NTZ").write.parquet(f"{tmp_path}/e")
    plan = analytics.event_funnel(spark.read.parquet(f"{tmp_path}/e"), ("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_funnel_of_nothing(spark):
    none = spark.createDataFrame([], "user_id LONG, event_type STRING, ts TIMESTAMP_NTZ")
    assert rows(analytics.event_funnel(none, ("a", "b")).select("step", "users", "from_first")) == [("a", 0, None), ("b", 0, None)]
