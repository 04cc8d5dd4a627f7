"""Visibility, data quality, changes, promotions and reports on small frames."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slotwise.functions.masking import is_mobile, mask_email, mask_id, mask_name, mask_phone
from slotwise.operators import analytics, changes, outreach, quality, views, visibility
from slotwise.sources import model, seeds
from tests.conftest import rows

NOW = dt.datetime(2001, 7, 15, 12)


@pytest.fixture
def market(tables):
    return tables(
        users=([(1, "admin"), (2, "shop_owner"), (3, "user"), (4, "user")], "id LONG, user_role STRING"),
        shops=([(10, 2, "active"), (11, 3, "suspended")], "id LONG, owner_id LONG, shop_status STRING"),
        reservations=([(100, 3, 10), (101, 4, 10), (102, 4, 11), (103, 2, 10)], "id LONG, user_id LONG, shop_id LONG"),
        payments=([("p", 100, 3), ("q", 102, 4)], "id STRING, reservation_id LONG, user_id LONG"),
    )


@pytest.mark.parametrize("who,seen", [(1, [100, 101, 102, 103]), (2, [100, 101, 103]), (3, [100, 102]), (4, [101, 102]), (9, [])])
def test_reservations_of_a_session(market, who, seen):
    assert rows(visibility.rows_for(market, "reservations", "select", who, NOW).select("id")) == [(i,) for i in seen]


def test_grants_agree_with_sessions(market):
    got = visibility.visible_reservations(market)
    pairs = {(r.principal_id, r.reservation_id) for r in got.filter("scope = 'row'").collect()}
    assert pairs == {(2, 100), (2, 101), (2, 103), (3, 100), (3, 102), (4, 101), (4, 102)}
    assert rows(got.filter("scope = 'table'").select("principal_id")) == [(1,)]


def test_payments_and_shops_of_a_session(market):
    assert rows(visibility.rows_for(market, "payments", "select", 2, NOW).select("id")) == [("p",)]
    assert rows(visibility.rows_for(market, "payments", "select", 4, NOW).select("id")) == [("q",)]
    assert rows(visibility.rows_for(market, "shops", "select", 4, NOW).select("id")) == [(10,)]
    assert rows(visibility.rows_for(market, "shops", "update", 3, NOW).select("id")) == [(11,)]
    assert visibility.rows_for(market, "shops", "update", 4, NOW).isEmpty()


def test_number_of_rules():
    shapes = {s: len(visibility.by_shape(s)) for s in ("own", "public", "shop", "parent_shop", "parent_user", "admin")}
    assert shapes == {"own": 9, "public": 2, "shop": 7, "parent_shop": 4, "parent_user": 1, "admin": 18}
    assert len(visibility.RULES) == 41 and len(model.COLUMNS) == 33 and len(model.DOMAINS) == 19


HOURS = "shop_id LONG, day INT, open_minute INT, updated_at TIMESTAMP_NTZ"


def test_upsert(spark):
    before = dt.datetime(2001, 1, 1)
    base = spark.createDataFrame([(1, 0, 540, before), (1, 1, 540, before), (1, 2, None, before)], HOURS)
    edits = spark.createDataFrame(
        [(1, 1, 600, 1), (1, 1, None, 2), (2, 0, 500, 3), (1, 2, None, 4)], "shop_id LONG, day INT, open_minute INT, seq INT"
    )
    got = rows(changes.upsert(base, edits, ["shop_id", "day"], "seq", NOW))
    # An edit that changes nothing leaves the time alone.
    assert got == [(1, 0, 540, before), (1, 1, None, NOW), (1, 2, None, before), (2, 0, 500, NOW)]


def test_insert_absent_adds_a_new_key_once(spark):
    base = spark.createDataFrame([(1, "a")], "id LONG, v STRING")
    more = spark.createDataFrame([(1, "x"), (2, "c"), (2, "b")], "id LONG, v STRING")
    assert rows(changes.insert_absent(base, more, ["id"])) == [(1, "a"), (2, "b")]


def test_defaults(spark):
    df = spark.createDataFrame([("p", None, False), ("q", 5, None)], "id STRING, usage_limit_per_user LONG, is_active BOOLEAN")
    assert rows(changes.apply_defaults(df, "promotions").select("id", "usage_limit_per_user", "is_active", "current_usage")) == [
        ("p", 1, False, 0), ("q", 5, True, 0)
    ]


def test_erasing_follows_references(spark, tables):
    t = tables(
        users=([(i,) for i in range(1, 7)], "id LONG"),
        shops=([(10, 3), (11, 6)], "id LONG, owner_id LONG"),
        reservations=([(100, 3), (101, 6)], "id LONG, user_id LONG"),
        payments=([("a", 3, 100), ("b", 6, 101)], "id STRING, user_id LONG, reservation_id LONG"),
        reservation_services=([(100,), (101,)], "reservation_id LONG"),
        # 6 keeps 1, 1 keeps 2, 2 keeps 4; 3's row goes with 3 and holds nobody; 5 is in the audit log.
        point_transactions=(
            [("x", 6, 1, None), ("y", 1, 2, None), ("z", 2, 4, None), ("w", 3, 5, 100), ("v", 6, None, 100), ("s", 3, 3, None)],
            "id STRING, user_id LONG, related_user_id LONG, reservation_id LONG",
        ),
        admin_actions=([(5,)], "admin_id LONG"),
    )
    got = changes.erase_users(t, spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "id LONG"))
    assert rows(got["erased"]) == [(3,)]
    assert rows(got["blocked"]) == [(1,), (2,), (4,), (5,)]
    assert rows(got["shops"].select("id", "owner_id")) == [(10, None), (11, 6)]
    assert rows(got["payments"].select("id")) == [("b",)]
    assert rows(got["reservation_services"]) == [(101,)]
    assert rows(got["point_transactions"].select("id", "reservation_id")) == [("v", None), ("x", None), ("y", None), ("z", None)]


def test_enum_and_key_violations(spark, tables):
    t = tables(
        users=([(1, "Kim", "a@x", "king"), (2, None, "a@x", "user"), (2, "Lee", None, None)], "id LONG, name STRING, email STRING, user_role STRING"),
        content_reports=([("spam",), ("copyright",), ("bad",), ("bad",)], "reason STRING"),
        user_settings=([(1,), (9,), (9,)], "user_id LONG"),
    )
    got = quality.enum_violations(t, ["users", "content_reports"])
    assert rows(got.select("table_name", "value", "drifted", "rows")) == [
        ("content_reports", "bad", False, 2), ("content_reports", "copyright", True, 1), ("users", "king", False, 1)
    ]
    found = {(r.table_name, r.check_name, r.columns): r.violations for r in quality.key_violations(t, ["users", "user_settings"]).collect()}
    assert found[("users", "not_null", "name")] == 1
    assert found[("users", "unique", "id")] == 1 and found[("users", "unique", "email")] == 1
    assert found[("user_settings", "reference", "user_id")] == 2 and found[("user_settings", "unique", "user_id")] == 1


def test_masks(spark):
    df = spark.createDataFrame([("dbgusgh123", "010-1234-5678"), ("ab", "01012345678"), ("x", None)], "id STRING, phone STRING")
    got = df.select(mask_id(F.col("id")), is_mobile(F.col("phone"))).collect()
    assert [tuple(r) for r in got] == [("dbgus", True), ("a", False), ("", False)]


def test_masks_never_show_a_value_whole(spark):
    names = ["김", "Lee", "김민수", "a", "", "Maximilian"]
    phones = ["01012345678", "+82-10-1234-5678", "010-1234-5678", "1588-0000", "12", ""]
    mails = ["nomail", "a@b.c", "ab@c.de", "@x", "a@b@c", "user@example.com"]
    df = spark.createDataFrame(list(zip(names, phones, mails)), "name STRING, phone STRING, mail STRING")
    got = df.select(mask_name(F.col("name")), mask_phone(F.col("phone")), mask_email(F.col("mail"))).collect()
    for plain, masked in zip(zip(names, phones, mails), got, strict=True):
        assert all(value == "" or value not in hidden for value, hidden in zip(plain, masked, strict=True))
    assert [r[1] for r in got] == ["***-****-**78", "***-****-**78", "***-****-**78", "***-****-**00", "***", "***"]
    assert [r[2] for r in got] == ["***", "***", "a***@c.de", "***", "***", "u***@example.com"]


def test_promotion_reasons(spark, tables):
    now, day = NOW, dt.timedelta(days=1)
    offers = [
        (1, '{"min_amount":100,"category":"nail"}', now - day, now + day, 3, 1), (2, "{bad", now - day, now + day, None, 1),
        (3, None, now - 2 * day, now - day, None, 1), (4, None, now, now, 2, 9), (5, None, now - day, now + day, None, 1),
    ]
    t = tables(
        promotions=([(i, c, '{"discount_rate":10}', s, e, limit, own, True) for i, c, s, e, limit, own in offers],
                    "id LONG, conditions STRING, benefits STRING, starts_at TIMESTAMP_NTZ, ends_at TIMESTAMP_NTZ, usage_limit LONG, usage_limit_per_user LONG, is_active BOOLEAN"),
        promotion_usages=([(4, 7), (4, 8), (5, 7)], "promotion_id LONG, user_id LONG"),
    )
    claims = spark.createDataFrame(
        [("a", 1, 7, 100, "nail"), ("b", 1, 7, 99, "nail"), ("c", 1, 7, 100, "hair"), ("d", 2, 7, 1, "nail"), ("e", 3, 7, 1, "nail"),
         ("f", 4, 9, 1, "nail"), ("g", 5, 7, 1, "nail"), ("h", 5, 8, 1, "nail"), ("i", 6, 8, 1, "nail")],
        "claim_id STRING, promotion_id LONG, user_id LONG, amount LONG, category STRING",
    ).withColumn("claimed_at", F.lit(now))
    got = {r.claim_id: r.reason for r in outreach.promotion_eligibility(t, claims, NOW).collect()}
    assert got == {
        "a": None, "b": "amount too small", "c": "other category", "d": "unreadable conditions", "e": "not live",
        "f": "used up", "g": "used up by user", "h": None, "i": "unknown",
    }


def test_claims_count_against_each_other(spark, tables):
    now, day = NOW, dt.timedelta(days=1)
    t = tables(
        promotions=([(1, None, '{"discount_rate":10}', now - day, now + day, 4, 2, True)],
                    "id LONG, conditions STRING, benefits STRING, starts_at TIMESTAMP_NTZ, ends_at TIMESTAMP_NTZ, usage_limit LONG, usage_limit_per_user LONG, is_active BOOLEAN"),
        promotion_usages=([(1, 7)], "promotion_id LONG, user_id LONG"),
    )
    # One use is gone: three are left, one of them to user 7.
    claims = spark.createDataFrame(
        [("a", 1, 7, 5, "x", now - day), ("b", 1, 7, 5, "x", now - day), ("c", 1, 8, 5, "x", now), ("d", 1, 9, 5, "x", now), ("e", 1, 8, 5, "x", now),
         ("f", None, 8, 5, "x", now)],
        "claim_id STRING, promotion_id LONG, user_id LONG, amount LONG, category STRING, claimed_at TIMESTAMP_NTZ",
    )
    got = {r.claim_id: r.reason for r in outreach.promotion_eligibility(t, claims, NOW).collect()}
    assert got == {"a": None, "b": "used up by user", "c": None, "d": None, "e": "used up", "f": "unknown"}


def test_each_kind_of_notice_has_its_switch(spark, tables):
    t = tables(
        user_settings=([(1, True, True, False, False), (2, True, False, True, True), (3, False, True, True, True)],
                       "user_id LONG, push_notifications_enabled BOOLEAN, reservation_notifications BOOLEAN, event_notifications BOOLEAN, marketing_notifications BOOLEAN"),
        push_tokens=([(1, "t1", "ios", True), (2, "t2", "ios", True), (3, "t3", "ios", True)], "user_id LONG, token STRING, platform STRING, is_active BOOLEAN"),
        notifications=([(f"{u}{k[:3]}", u, k) for u in (1, 2, 3) for k in ("reservation_confirmed", "point_earned", "promotion", "system")],
                       "id STRING, user_id LONG, notification_type STRING"),
    )
    assert [r[0] for r in rows(outreach.notification_targets(t).select("id"))] == ["1res", "1sys", "2poi", "2pro", "2sys"]


def test_quiet_hours_over_midnight(spark, tables):
    t = tables(
        shops=([(1, 70), (2, 71)], "id LONG, owner_id LONG"),
        shop_notification_settings=([(1, True, False, 1320, 120), (2, True, True, 540, 1320)],
                                    "shop_id LONG, new_reservation_notification BOOLEAN, cancellation_notification BOOLEAN, notification_start_minute INT, notification_end_minute INT"),
    )
    events = spark.createDataFrame(
        [(1, 1, "new", 1400), (2, 1, "new", 60), (3, 1, "new", 120), (4, 1, "cancelled", 60), (5, 2, "new", 540), (6, 2, "new", 1320)],
        "event_id LONG, shop_id LONG, kind STRING, minute INT",
    )
    got = rows(outreach.owner_notification_targets(t, events).select("event_id", "delivery"))
    assert got == [(1, "send"), (2, "send"), (3, "hold"), (5, "send"), (6, "hold")]


def test_funnel_is_ordered(spark):
    t0 = dt.datetime(2024, 1, 1)
    hour = dt.timedelta(hours=1)
    events = spark.createDataFrame(
        [(1, "a", t0), (1, "b", t0 - hour), (1, "b", t0 + hour), (1, "c", t0 + hour), (2, "a", t0), (2, "b", t0 - hour), (3, "b", t0)],
        "user_id LONG, event_type STRING, ts TIMESTAMP_NTZ",
    )
    got = [(r.step, r.users, r.from_first) for r in analytics.event_funnel(events, ("a", "b", "c")).orderBy("step_number").collect()]
    assert got == [("a", 2, 1.0), ("b", 1, 0.5), ("c", 1, 0.5)]


def test_dashboard_prefers_an_unpaid_settlement(spark, tables):
    t = tables(
        shops=([(1, "s", 7, "partnered"), (2, "t", 8, "partnered")], "id LONG, name STRING, owner_id LONG, shop_type STRING"),
        reservations=([(1, dt.date(2001, 7, 1), "completed", 1001), (1, dt.date(2001, 7, 31), "requested", 5), (1, dt.date(2001, 6, 30), "completed", 10)],
                      "shop_id LONG, reservation_date DATE, status STRING, total_amount LONG"),
        shop_settlements=([("a", 1, "completed", 11, NOW), ("b", 1, "completed", 22, None), ("c", 1, "completed", 33, None), ("d", 1, "pending", 44, None)],
                          "id STRING, shop_id LONG, settlement_status STRING, net_settlement_amount LONG, settled_at TIMESTAMP_NTZ"),
        system_settings=seeds.settings(spark),
    )
    got = {r.shop_id: r for r in views.shop_owner_dashboard(t, NOW).collect()}
    one = got[1]
    assert (one.this_month_bookings, one.this_month_completed, one.this_month_revenue) == (2, 1, 1001)
    assert float(one.this_month_commission) == 80.08
    assert (one.last_month_bookings, one.total_bookings, one.pending_reservations) == (1, 3, 1)
    assert (one.last_settlement_amount, one.last_settlement_date) == (22, None)
    assert got[2].total_bookings == 0 and got[2].last_settlement_amount is None


def test_every_sampled_table_with_declared_checks_is_checked(spark):
    from slotwise.plans import guards
    from slotwise.plans.registry import QUERIES
    from slotwise.sources import model
    from slotwise.sources.samples import open_samples

    sampled = open_samples(spark, "/root/testdata/sf0.001")
    keyed = {*model.REQUIRED, *model.MAX_LENGTH, *model.UNIQUE_KEYS, *(child for child, _ in model.REFERENCES)}
    typed = {n for n, columns in model.ENUM_COLUMNS.items() if n in sampled and set(columns) & set(sampled[n].columns)}
    # The seed schedules are a few fixed rows.
    for declared, checked in ((keyed, guards._KEYED + guards._OTHER_KEYS), (typed, guards._CHECKED + guards._OTHER_ENUMS)):
        assert {n for n in declared if n in sampled} - {"settlement_schedules"} == set(checked)
        assert len(checked) == len(set(checked))
    names = {(r.table_name, r.check_name, r.columns) for r in QUERIES["key_violations_other"].run(spark, "/root/testdata/sf0.001").collect()}
    assert ("payments", "unique", "id") in names and ("point_transactions", "reference", "related_user_id") in names
    assert ("shop_services", "not_null", "name") in names and ("shop_settlements", "reference", "shop_id") in names


def brute_held(links):
    held = {i for o, i in links if o is None}
    while True:
        more = {i for o, i in links if o in held} - held
        if not more:
            return held
        held |= more


def test_held_accounts_along_long_chains_cycles_and_branches(spark, monkeypatch):
    r = random.Random(3)
    written = []
    original = changes.cut_lineage
    monkeypatch.setattr(changes, "cut_lineage", lambda df: written.append(1) or original(df))
    chain = [(None, 0)] + [(i, i + 1) for i in range(200)]
    cycles = [(1000, 1001), (1001, 1002), (1002, 1000), (2000, 2001), (2001, 2000), (1002, 1500)]
    branches = [(3000 + r.randrange(40), 3000 + r.randrange(40)) for _ in range(50)] + [(None, 3007), (3500, 3001)]
    ladder = [(x, y) for i in range(0, 12, 2) for x in (4000 + i, 4001 + i) for y in (4002 + i, 4003 + i)] + [(None, 4000)]
    for links, most in ((chain, 10), (cycles, 2), (branches, 12), (ladder, 9), (chain + cycles + branches + ladder, 12), ([], 2)):
        links = [(o, i) for o, i in links if o != i]
        written.clear()
        got = changes.held_accounts(spark.createDataFrame(links, "owner LONG, id LONG"))
        assert {x.id for x in got.collect()} == brute_held(links)
        assert len(written) <= most


def test_erasing_reaches_every_declared_table(spark, tables):
    """Accounts 1 to 3 ask to go; 2 reviewed an application of 9, who stays; 3 acted on a booking of 1, which goes."""
    one = lambda column: ([(1, 1), (2, 2), (9, 9)], f"id LONG, {column} LONG")
    t = tables(
        users=([(1,), (2,), (3,), (9,)], "id LONG"),
        reservations=([(10, 1, 50), (90, 9, 50)], "id LONG, user_id LONG, shop_id LONG"),
        reservation_actions=([("a", 10, 3), ("b", 90, 9)], "id STRING, reservation_id LONG, performed_by LONG"),
        shop_applications=([(1, 1, None), (2, 9, 2)], "id LONG, applicant_id LONG, reviewed_by LONG"),
        content_reports=([(1, 1, None), (2, 9, 9)], "id LONG, reporter_id LONG, reviewed_by LONG"),
        point_balances=([(1,), (9,)], "user_id LONG"),
        settlement_details=([(1, 10), (2, 90)], "id LONG, reservation_id LONG"),
        user_settings=one("user_id"), user_favorites=one("user_id"), notifications=one("user_id"), push_tokens=one("user_id"),
        announcements=([(1, 9), (2, None)], "id LONG, created_by LONG"),
        shops=([(50, 1), (51, 9)], "id LONG, owner_id LONG"),
    )
    got = changes.erase_users(t, spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "id LONG"))
    assert rows(got["erased"]) == [(1,), (3,)] and rows(got["blocked"]) == [(2,)]
    assert {n: [x[0] for x in rows(got[n])] for n in set(got) - {"erased", "blocked", "shops"}} == {
        "users": [2, 9], "reservations": [90], "reservation_actions": ["b"], "shop_applications": [2], "content_reports": [2],
        "point_balances": [9], "settlement_details": [2], "user_settings": [2, 9], "user_favorites": [2, 9],
        "notifications": [2, 9], "push_tokens": [2, 9],
    }
    assert rows(got["shops"].select("id", "owner_id")) == [(50, None), (51, 9)]
