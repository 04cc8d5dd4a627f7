from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from slotwise.operators import booking
from slotwise.sources import seeds
from tests.conftest import rows

NOW = dt.datetime(2001, 7, 15, 12)
DAY = dt.date(2001, 7, 16)  # a Monday
BOOKED = "id LONG, user_id LONG, shop_id LONG, reservation_date DATE, reservation_minute INT, status STRING, cancelled_at TIMESTAMP_NTZ"
SERVICES = "id LONG, duration_minutes INT, cancellation_hours INT, price_min LONG, deposit_amount LONG, deposit_percentage DECIMAL(5,2)"
HOURS = "shop_id LONG, day_of_week INT, is_open BOOLEAN, open_minute INT, close_minute INT, break_start_minute INT, break_end_minute INT"


def slot_tables(tables, bookings, lines, hours):
    return tables(
        shops=([(1, "active"), (2, "suspended")], "id LONG, shop_status STRING"),
        shop_operating_hours=(hours, HOURS),
        reservations=(bookings, BOOKED),
        reservation_services=(lines, "reservation_id LONG, service_id LONG, quantity INT"),
        shop_services=([(10, 60, 24, 0, None, None), (11, 45, 24, 0, None, None)], SERVICES),
    )


def states(t, **kw):
    got = booking.free_slots(t, DAY, 1, NOW, **kw)
    return {(r.shop_id, r.start_minute): r.slot_status for r in got.collect()}


def test_touching_intervals_do_not_overlap(tables):
    # Booked 11:00-12:00; slots take an hour, so 10:00 and 12:00 stay free, 10:30 and 11:30 do not.
    t = slot_tables(
        tables, [(1, 5, 1, DAY, 660, "confirmed", None)], [(1, 10, 1)],
        [(1, 1, True, 540, 840, None, None), (2, 1, True, 540, 840, None, None)],
    )
    got = states(t)
    assert {k[0] for k in got} == {1}
    assert [m for (_, m), s in sorted(got.items()) if s == "booked"] == [630, 660, 690]
    assert (1, 780) in got and (1, 810) not in got


def test_odd_booking_times_and_lengths(tables):
    # 10:45-11:30 against half-hour slots of half an hour each.
    t = slot_tables(tables, [(1, 5, 1, DAY, 645, "requested", None)], [(1, 11, 1)], [(1, 1, True, 540, 840, None, None)])
    got = states(t, duration=30)
    assert [m for (_, m), s in sorted(got.items()) if s == "booked"] == [630, 660]


def test_breaks_closed_days_and_finished_bookings(tables):
    t = slot_tables(
        tables,
        [(1, 5, 1, DAY, 540, "completed", None), (2, 5, 1, DAY, 540, "cancelled_by_user", None)], [],
        [(1, 1, True, 540, 840, 600, 630), (1, 2, False, 540, 840, None, None)],
    )
    got = states(t)
    assert [m for (_, m), s in sorted(got.items()) if s == "blocked"] == [570, 600]
    assert "booked" not in got.values()
    assert booking.free_slots(t, DAY + dt.timedelta(1), 1, NOW).isEmpty()


def test_past_slots(tables):
    t = slot_tables(tables, [], [], [(1, 0, True, 540, 840, None, None)])
    got = {r.start_minute: r.slot_status for r in booking.free_slots(t, dt.date(2001, 7, 15), 1, NOW).collect()}
    assert got[690] == "past" and got[720] == "available"


def test_refunds(spark, tables):
    start = dt.datetime.combine(DAY, dt.time(10))
    bookings = [
        (1, 5, 1, DAY, 600, "cancelled_by_user", start - dt.timedelta(hours=24)),
        (2, 5, 1, DAY, 600, "cancelled_by_user", start - dt.timedelta(hours=23, minutes=59)),
        (3, 5, 1, DAY, 600, "cancelled_by_shop", start - dt.timedelta(hours=1)),
        (4, 5, 1, DAY, 600, "no_show", None),
        (5, 5, 1, DAY, 600, "cancelled_by_user", start - dt.timedelta(hours=13)),
        (6, 5, 1, DAY, 600, "completed", None),
    ]
    t = tables(
        reservations=(bookings, BOOKED),
        reservation_services=([(5, 20, 1), (5, 21, 1)], "reservation_id LONG, service_id LONG, quantity INT"),
        shop_services=([(20, 60, 24, 0, None, None), (21, 60, 12, 0, None, None)], SERVICES),
        payments=([(i, True, "deposit_paid", 100 * i) for i in range(1, 7)] + [(3, False, "fully_paid", 1)],
                  "reservation_id LONG, is_deposit BOOLEAN, payment_status STRING, amount LONG"),
        system_settings=seeds.settings(spark),
    )
    got = rows(booking.refund_decision(t).select("id", "refund_amount", "refund_type"))
    assert got == [(1, 100, "full"), (2, 0, "no_refund"), (3, 300, "deposit_only"), (4, 0, "no_refund"), (5, 500, "full")]


def test_quote_deposit_order(spark, tables):
    t = tables(
        shop_services=([(1, 60, 24, 100_000, 20_000, None), (2, 60, 24, 100_000, None, None), (3, 60, 24, 1_000, None, None)], SERVICES),
        users=([(9, 3_000)], "id LONG, available_points LONG"),
        system_settings=seeds.settings(spark),
    )
    asked = spark.createDataFrame([(1, 9, 5000), (2, 9, 500), (3, 9, 500), (4, 9, -5)], "quote_id LONG, user_id LONG, points_requested LONG")
    lines = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 2, 1)], "quote_id LONG, service_id LONG, quantity INT")
    got = rows(booking.reservation_quote(t, asked, lines).drop("user_id"))
    assert got == [(1, 200_000, 40_000, 3_000, 157_000), (2, 100_000, 30_000, 500, 69_500),
                   (3, 2_000, 2_000, 0, 0), (4, 100_000, 30_000, 0, 70_000)]


def owner_tables(tables):
    return tables(
        reservations=([(1, 5, 1, DAY, 600, "requested", None), (2, 5, 1, DAY, 600, "confirmed", None),
                       (3, 5, 1, DAY, 600, "completed", None)], BOOKED),
        shops=([(1, 70)], "id LONG, owner_id LONG"),
    )


def requests(spark, data):
    return spark.createDataFrame(data, "request_id LONG, reservation_id LONG, owner_id LONG, reason STRING")


def test_confirmation_by_owner_once(spark, tables):
    # The first request for booking 1 is by somebody else and does not use it up.
    asked = requests(spark, [(1, 1, 71, "no"), (2, 1, 70, "yes"), (3, 1, 70, "again"), (4, 2, 70, None), (5, 99, 70, None)])
    got = booking.confirm_reservations(owner_tables(tables), asked, NOW)
    assert rows(got["outcome"].select("request_id", "outcome")) == [
        (1, "rejected"), (2, "accepted"), (3, "rejected"), (4, "rejected"), (5, "rejected")
    ]
    assert rows(got["actions"].select("previous_status", "new_status", "reason")) == [("requested", "confirmed", "yes")]
    assert got["notifications"].first().title == "예약이 확정되었습니다"


def test_cancellation_keeps_previous_status(spark, tables):
    asked = requests(spark, [(1, 1, 70, "a"), (2, 2, 70, "b"), (3, 3, 70, "c")])
    got = booking.cancel_by_shop(owner_tables(tables), asked, NOW)
    assert rows(got["actions"].select("reservation_id", "previous_status", "reason")) == [(1, "requested", "a"), (2, "confirmed", "b")]


def test_approval_makes_a_whole_shop(spark, tables):
    t = tables(shop_applications=(
        [(1, 5, "Shop", "addr", "nail", "pending"), (2, 6, "Other", "addr", "nail", "rejected")],
        "id LONG, applicant_id LONG, shop_name STRING, shop_address STRING, main_category STRING, application_status STRING",
    ))
    asked = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 2, 0)], "request_id LONG, application_id LONG, admin_id LONG")
    got = booking.approve_applications(t, asked, NOW)
    assert got["shops"].count() == 1 and got["hours"].count() == 7
    assert rows(got["hours"].select("day_of_week")) == [(d,) for d in range(7)]
    assert rows(got["users"].select("id", "user_role")) == [(5, "shop_owner")]
    assert got["applications"].first().approved_shop_id == got["shops"].first().id
    assert got["notification_settings"].first().notification_end_minute == 1320


def test_applicants_with_a_shop_are_refused(spark, tables):
    t = tables(shops=([(1, 5, "active"), (2, 6, "pending_approval"), (3, 7, "suspended"), (4, None, "active")],
                      "id LONG, owner_id LONG, shop_status STRING"))
    asked = spark.createDataFrame([(5,), (6,), (7,), (8,)], "applicant_id LONG")
    got = booking.submit_applications(t, asked, NOW)
    assert rows(got["accepted"].select("applicant_id")) == [(7,), (8,)]
    assert rows(got["rejected"].select("applicant_id")) == [(5,), (6,)]


def brute_gaps(hours, bookings, lengths, breaks, days, as_of):
    """Free minutes one by one, joined to runs."""
    out = []
    for day in days:
        for shop, weekday, is_open, opens, closes, *_ in hours:
            if not is_open or weekday != (day.weekday() + 1) % 7:
                continue
            free = [True] * 1440
            for m in range(1440):
                if dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=m) < as_of:
                    free[m] = False
            for b, e in [(m, m + lengths.get(i, 60)) for i, s, d, m in bookings if s == shop and d == day] + breaks.get((shop, weekday), []):
                for m in range(max(b, 0), min(e, 1440)):
                    free[m] = False
            start = None
            for m in range(opens, closes + 1):
                if m < closes and free[m]:
                    start = m if start is None else start
                elif start is not None:
                    out.append((shop, day, opens, start, m))
                    start = None
    return sorted(out)


def test_gaps_and_first_starts_against_minutes(spark, tables):
    """Overlapping, nested, touching and very many bookings, breaks, closing time, and a time of asking inside a day."""
    r = random.Random(15)
    as_of = dt.datetime(2001, 7, 16, 10, 7, 30)
    days = [dt.date(2001, 7, 15) + dt.timedelta(i) for i in range(7)]
    hours, breaks = [], {}
    for shop in range(1, 7):
        for weekday in range(7):
            opens = r.choice((0, 540, 575))
            pause = r.choice(((None, None), (720, 780), (opens, opens + 30), (800, 790)))
            closes = r.choice((900, 1080, 1440))
            hours.append((shop, weekday, r.random() < 0.8, opens, closes, *pause))
            if pause[0] is not None and pause[0] < pause[1]:
                breaks[shop, weekday] = [pause]
    bookings = [(i, r.randrange(1, 7), r.choice(days), r.choice((0, 530, 570, 600, 615, 660, 719, 900, 1430)) + r.randrange(3)) for i in range(90)]
    bookings += [(1000 + i, 1, days[3], 600 + i % 5) for i in range(400)]
    lengths = {i: r.choice((5, 30, 45, 120, 300)) for i, *_ in bookings if r.random() < 0.8}
    services = [(100 + n, r.randrange(1, 7), n) for n in sorted(set(lengths.values()))] + [(500 + i, 1 + i % 6, 15 * (1 + i % 40)) for i in range(40)]
    by_length = {n: s for s, _, n in services if s < 500}
    t = tables(
        shops=([(i, "active") for i in range(1, 7)], "id LONG, shop_status STRING"),
        shop_operating_hours=(hours, HOURS),
        reservations=([(i, 5, s, d, m, r.choice(("requested", "confirmed")), None) for i, s, d, m in bookings]
                      + [(9000, 5, 1, days[2], 600, "completed", None)], BOOKED),
        reservation_services=([(i, by_length[n], 1) for i, n in lengths.items()], "reservation_id LONG, service_id LONG, quantity INT"),
        shop_services=([(s, shop, n) for s, shop, n in services], "id LONG, shop_id LONG, duration_minutes INT"),
    )
    gaps = booking.bookable_gaps(t, days[0], 7, as_of)
    want = brute_gaps(hours, bookings, lengths, breaks, days, as_of)
    assert sorted(tuple(g) for g in gaps.collect()) == want
    first = {}
    for service, shop, n in services:
        starts = [(d, o + 30 * k) for s, d, o, a, b in want if s == shop for k in range(48) if a <= o + 30 * k and o + 30 * k + n <= b]
        if starts:
            first[service] = min(starts)
    got = {x.service_id: (x.day, x.start_minute) for x in booking.first_starts(t, gaps).collect()}
    assert got == first and len(first) < len(services)
