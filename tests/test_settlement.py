from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from slotwise.operators import settings, settlement
from slotwise.sources import seeds
from tests.conftest import rows

NOW = dt.datetime(2001, 7, 15, 12)
SHOPS = "id LONG, shop_type STRING, shop_status STRING"
CONFIGS = "shop_id LONG, commission_rate DECIMAL(5,2), bank_name STRING, bank_account STRING, account_holder STRING"
BOOKED = "id LONG, shop_id LONG, status STRING, total_amount LONG, completed_at TIMESTAMP_NTZ"


def shop_tables(spark, tables, bookings, setting_rows=None):
    return tables(
        shops=([(1, "partnered", "active"), (2, "non_partnered", "active"), (3, "partnered", "active"),
                (4, "partnered", "suspended")], SHOPS),
        shop_settlement_configs=([(1, None, "B", "A", "H"), (3, Decimal("7.25"), "B", "A", "H")], CONFIGS),
        system_settings=seeds.settings(spark) if setting_rows is None else setting_rows,
        reservations=(bookings, BOOKED),
    )


def done(id, shop, amount, day=10, hour=1):
    return (id, shop, "completed", amount, dt.datetime(2001, 6, day, hour))


def test_rate_precedence(spark, tables):
    t = shop_tables(spark, tables, [])
    got = dict(rows(settlement.commission_rates(t).select("shop_id", "rate")))
    assert got == {1: Decimal("8.00"), 2: Decimal("10.00"), 3: Decimal("7.25"), 4: Decimal("8.00")}


def test_missing_rate_setting_falls_back_to_ten(spark, tables):
    inactive = seeds.settings(spark).withColumn("is_active", F.lit(False))
    t = shop_tables(spark, tables, [], inactive)
    assert dict(rows(settlement.commission_rates(t).select("shop_id", "rate")))[1] == Decimal("10.00")


def test_commission_is_rounded_once_on_the_sum(spark, tables):
    # 7.25 % of 109 is 7.9025 and of 436 is 31.61: rounding row by row gives 28, on the sum 31.
    t = shop_tables(spark, tables, [done(i, 3, 109) for i in range(4)])
    got = settlement.shop_settlement(t, dt.date(2001, 6, 1), dt.date(2001, 6, 30)).filter("shop_id = 3").first()
    assert (got.gross_revenue, got.commission_amount, got.net_settlement, got.booking_count) == (436, 31, 405, 4)
    t2 = t.replaced(payments=spark.createDataFrame([], "reservation_id LONG, payment_method STRING, is_deposit BOOLEAN"))
    per_row = settlement.settlement_details(t2, dt.date(2001, 6, 1), dt.date(2001, 6, 30))
    assert per_row.agg(F.sum("commission_amount")).first()[0] == 28


def test_large_sums_do_not_overflow(spark, tables):
    t = shop_tables(spark, tables, [done(i, 1, 2_000_000_000_000) for i in range(50)])
    got = settlement.shop_settlement(t, dt.date(2001, 6, 1), dt.date(2001, 6, 30)).filter("shop_id = 1").first()
    assert got.gross_revenue == 100_000_000_000_000 and got.commission_amount == 8_000_000_000_000


def test_period_days_are_inclusive_and_zoned(spark, tables):
    edge = [
        (1, 1, "completed", 1, dt.datetime(2001, 6, 1)), (2, 1, "completed", 2, dt.datetime(2001, 6, 30, 23, 59, 59)),
        (3, 1, "completed", 4, dt.datetime(2001, 7, 1)), (4, 1, "completed", 8, dt.datetime(2001, 5, 31, 15)),
    ]
    t = shop_tables(spark, tables, edge)
    june = (dt.date(2001, 6, 1), dt.date(2001, 6, 30))
    assert settlement.shop_settlement(t, *june).filter("booking_count > 0").first().gross_revenue == 3
    zoned = t.replaced(reservations=t["reservations"].withColumn("completed_at", F.col("completed_at").cast("timestamp")))
    # 31 May 15:00 UTC is 1 June in Seoul, 30 June 23:59 UTC is 1 July there.
    assert settlement.shop_settlement(zoned, *june, zone="Asia/Seoul").filter("booking_count > 0").first().gross_revenue == 1 + 8


def test_batch_takes_active_shops_with_bookings(spark, tables):
    t = shop_tables(spark, tables, [done(1, 1, 1000), done(2, 4, 1000)])
    batch = settlement.settlement_batch(t, "weekly", dt.date(2001, 6, 4), dt.date(2001, 6, 10))
    assert rows(batch["settlements"].select("shop_id", "net_settlement_amount")) == [(1, 920)]
    head = batch["batch"].first()
    assert (head.batch_name, head.shop_count) == ("2001-06-04 ~ 2001-06-10 주간정산", 1)
    empty = settlement.settlement_batch(t, "bi_weekly", dt.date(2000, 1, 3), dt.date(2000, 1, 16))["batch"].first()
    assert (empty.batch_name, empty.total_revenue, empty.shop_count) == ("2000-01-03 ~ 2000-01-16 정산", 0, 0)


def periods(spark, kind, day):
    df = spark.createDataFrame([(kind, True, day)], "settlement_period STRING, is_active BOOLEAN, day DATE")
    r = settlement.settlement_periods(df, F.col("day")).first()
    return r.period_start, r.period_end


def test_periods_at_year_and_leap_boundaries(spark):
    d = dt.date
    assert periods(spark, "weekly", d(2001, 1, 1)) == (d(2000, 12, 25), d(2000, 12, 31))
    assert periods(spark, "weekly", d(2001, 1, 7)) == (d(2000, 12, 25), d(2000, 12, 31))
    assert periods(spark, "bi_weekly", d(2001, 1, 3)) == (d(2000, 12, 18), d(2000, 12, 31))
    assert periods(spark, "monthly", d(2000, 3, 31)) == (d(2000, 2, 1), d(2000, 2, 29))
    assert periods(spark, "monthly", d(2001, 1, 15)) == (d(2000, 12, 1), d(2000, 12, 31))


def test_seed_schedules_and_settings(spark):
    due = settlement.settlement_periods(seeds.schedules(spark), F.lit(dt.date(2001, 7, 15)))
    assert rows(due.select("settlement_period", "period_start")) == [
        ("monthly", dt.date(2001, 6, 1)), ("weekly", dt.date(2001, 7, 2)),
    ]
    assert seeds.faqs(spark).count() == 5 and seeds.announcements(spark).count() == 1
    asked = spark.createDataFrame([("point_earning_rate",), ("app_maintenance_mode",), ("nothing",)], "setting_key STRING")
    assert rows(settings.setting_text(asked, seeds.settings(spark))) == [
        ("app_maintenance_mode", "false"), ("nothing", ""), ("point_earning_rate", "2.5"),
    ]
    assert [float(r[1]) for r in rows(settings.setting_number(asked, seeds.settings(spark)))] == [0, 0, 2.5]
    typed = {r.setting_key: r for r in settings.settings_typed(seeds.settings(spark)).collect()}
    assert typed["app_maintenance_mode"].boolean_value is False
    assert typed["customer_service_phone"].number_value is None


TRANSFERS = "settlement_id STRING, transfer_status STRING, transfer_amount LONG"
SETTLED = "id STRING, shop_id LONG, settlement_status STRING, net_settlement_amount LONG"


def transfer_tables(spark, tables):
    return shop_tables(spark, tables, []).replaced(
        shop_settlements=spark.createDataFrame(
            [("p", 1, "pending", 100), ("d", 1, "completed", 200), ("n", 2, "completed", 300), ("f", 1, "failed", 400)], SETTLED
        ),
        settlement_transfers=spark.createDataFrame(
            [("d", "approved", 200), ("n", "approved", 300), ("q", "transfer_requested", 500), ("z", "transfer_completed", 1)],
            TRANSFERS,
        ),
    )


def test_approval_needs_pending_and_works_once(spark, tables):
    t = transfer_tables(spark, tables)
    asked = spark.createDataFrame(
        [(1, "p", 9, "x"), (2, "p", 9, "y"), (3, "d", 9, None), (4, "f", 9, None), (5, "?", 9, None)],
        "request_id LONG, settlement_id STRING, admin_id LONG, notes STRING",
    )
    got = settlement.approve_settlements(t, asked, NOW)
    assert rows(got["outcome"].select("request_id", "outcome")) == [
        (1, "accepted"), (2, "rejected"), (3, "rejected"), (4, "rejected"), (5, "rejected"),
    ]
    assert rows(got["transfers"].select("settlement_id", "transfer_amount", "admin_notes")) == [("p", 100, "x")]
    assert got["logs"].count() == 1


def test_transfer_request_needs_bank_details(spark, tables):
    t = transfer_tables(spark, tables)
    asked = spark.createDataFrame(
        [(1, "d", 9, "bank_transfer"), (2, "n", 9, "bank_transfer"), (3, "q", 9, "bank_transfer")],
        "request_id LONG, settlement_id STRING, admin_id LONG, method STRING",
    )
    got = settlement.request_transfers(t, asked, NOW)
    assert rows(got["outcome"].select("request_id", "outcome")) == [(1, "accepted"), (2, "rejected"), (3, "rejected")]
    assert got["logs"].first().notes == "송금 요청: bank_transfer - H"


def test_completion_needs_a_requested_transfer(spark, tables):
    t = transfer_tables(spark, tables)
    asked = spark.createDataFrame(
        [(1, "q", "e1", 450, 500), (2, "d", "e2", None, None), (3, "z", "e3", None, None)],
        "request_id LONG, settlement_id STRING, external_id STRING, actual_amount LONG, fee LONG",
    )
    got = settlement.complete_transfers(t, asked, NOW)
    assert rows(got["transfers"].select("settlement_id", "transfer_amount", "transfer_fee")) == [("q", 450, 500)]
    assert got["logs"].first().notes == "송금 완료: e1 (수수료: 500원)"
    assert got["settlements"].first().settled_at == NOW


def test_shops_without_bookings_have_a_row_and_no_settlement(spark, tables):
    t = shop_tables(spark, tables, [done(1, 3, 100)])
    june = (dt.date(2001, 6, 1), dt.date(2001, 6, 30))
    got = settlement.shop_settlement(t, *june)
    assert got.count() == t["shops"].count()
    assert got.filter("shop_id <> 3 AND (booking_count <> 0 OR gross_revenue <> 0)").isEmpty()
    assert [r.shop_id for r in settlement.settlement_batch(t, "monthly", *june)["settlements"].collect()] == [3]


def test_scheduled_periods_overlap_and_target_types(spark, tables):
    t = shop_tables(spark, tables, [done(1, 1, 100, day=5), done(2, 1, 200, day=12), done(3, 2, 300, day=5), done(4, 4, 999, day=5)])
    first, middle, last = dt.date(2001, 6, 4), dt.date(2001, 6, 11), dt.date(2001, 6, 17)
    week = dt.timedelta(days=6)
    periods = spark.createDataFrame(
        [("weekly", first, first + week, None), ("weekly", middle, last, "partnered"), ("bi_weekly", first, last, None)],
        "settlement_period STRING, period_start DATE, period_end DATE, target_shop_type STRING",
    )
    got = settlement.scheduled_settlements(t, periods).select("settlement_period", "period_start_date", "shop_id", "gross_revenue", "commission_amount")
    assert rows(got) == [
        ("bi_weekly", first, 1, 300, 24), ("bi_weekly", first, 2, 300, 30), ("weekly", first, 1, 100, 8),
        ("weekly", first, 2, 300, 30), ("weekly", middle, 1, 200, 16),
    ]
    assert settlement.scheduled_settlements(t, periods, minimum_amount=250).count() == 3
