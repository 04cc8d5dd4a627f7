"""Streams over several batches: late rows, repeats, states across batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from slotwise.operators import points
from slotwise.streaming import streams
from tests.conftest import rows

NOW = dt.datetime(2001, 7, 15, 12)
LEDGER = "id STRING, user_id LONG, amount LONG, status STRING, available_from TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"


def run(spark, folder, batches, schema, moment, job):
    """Deliver each batch as a file and let the stream catch up."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        frame_schema = spark.createDataFrame([], schema).schema
        job(streams.arriving(spark, f"{folder}/in", frame_schema, moment)).awaitTermination()


def test_balances_equal_the_batch_job(spark, tmp_path):
    day = dt.timedelta(days=1)
    first = [("a", 1, 100, "available", NOW, None, NOW - day), ("b", 1, 50, "available", NOW + day, None, NOW - day),
             ("c", 2, 70, "pending", None, None, NOW)]
    second = [("a", 1, 100, "available", NOW, None, NOW - day), ("d", 1, -30, "available", None, None, NOW),
              ("e", 3, 5, "available", None, NOW, NOW)]
    run(spark, tmp_path, [first, second], LEDGER, "created_at",
        lambda s: streams.point_balance_deltas(s, f"{tmp_path}/out", f"{tmp_path}/state"))
    whole = spark.createDataFrame(first + second[1:], LEDGER)
    for moment in (NOW, NOW + day, NOW - day):
        got = streams.point_balances_at(spark, f"{tmp_path}/out", moment)
        assert rows(got) == rows(points.ledger_balances(whole, moment))
    assert rows(streams.point_balances_at(spark, f"{tmp_path}/out", NOW)) == [(1, 150, 70), (2, 0, 0), (3, 5, 0)]


def test_ledger_rows_months_late_count_once(spark, tmp_path):
    when = [dt.datetime(2001, 3, 1), dt.datetime(2001, 5, 1), dt.datetime(2001, 3, 15)]
    batches = [[(name, 1, 100, "available", None, None, at)] for name, at in zip("abc", when)] + [[("a", 1, 100, "available", None, None, when[0])]]
    run(spark, tmp_path, batches, LEDGER, "created_at", lambda s: streams.point_balance_deltas(s, f"{tmp_path}/out", f"{tmp_path}/state"))
    assert rows(streams.point_balances_at(spark, f"{tmp_path}/out", NOW)) == [(1, 300, 300)]


def test_event_counts_grow_and_late_rows_count(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE"
    batches = [[(at(1), "a", 1.0), (at(1, 30), "a", 1.0)], [(at(1, 59), "a", 1.0), (at(9), "b", 2.0)], [(at(9, 1), "b", 1.0)],
               [(at(1, 5), "a", 9.0)]]
    run(spark, tmp_path, batches, schema, "ts", lambda s: streams.event_counts(s, f"{tmp_path}/out", f"{tmp_path}/state"))
    got = streams.event_counts_now(spark, f"{tmp_path}/out").select(F.hour("hour"), "event_type", "events", "value")
    assert rows(got) == [(1, "a", 4, 12.0), (9, "b", 2, 3.0)]


def test_status_changes_across_batches(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "reservation_id LONG, seq INT, new_status STRING, changed_at TIMESTAMP_NTZ"
    batches = [
        [(1, 0, "requested", at(0)), (1, 1, "completed", at(1)), (2, 0, "confirmed", at(0)), (3, 1, "confirmed", at(2)), (3, 0, "requested", at(1))],
        [(1, 2, "confirmed", at(5)), (3, 2, "no_show", at(6))],
        [(1, 3, "completed", at(7)), (1, 4, "cancelled_by_user", at(8)), (3, 3, "completed", at(9))],
    ]
    run(spark, tmp_path, batches, schema, "changed_at", lambda s: streams.status_log(s, f"{tmp_path}/out", f"{tmp_path}/state"))
    log = spark.read.parquet(f"{tmp_path}/out/log")
    assert rows(log.select("reservation_id", "seq", "previous_status", "new_status", "accepted")) == [
        (1, 0, "", "requested", True), (1, 1, "requested", "completed", False), (1, 2, "requested", "confirmed", True),
        (1, 3, "confirmed", "completed", True), (1, 4, "", "cancelled_by_user", False),
        (2, 0, "", "confirmed", False),
        (3, 0, "", "requested", True), (3, 1, "requested", "confirmed", True), (3, 2, "confirmed", "no_show", True),
        (3, 3, "", "completed", False),
    ]
    # Older tables of open bookings are gone, and no entry is left for finished ones.
    assert sorted(p.name for p in (tmp_path / "out" / "open").iterdir() if p.is_dir()) == ["batch=1", "batch=2"]
    assert spark.read.parquet(f"{tmp_path}/out/open/batch=2").isEmpty()


def test_notices_respect_preferences_and_repeats(spark, tmp_path):
    schema = "id STRING, reservation_id LONG, user_id LONG, action STRING, created_at TIMESTAMP_NTZ"
    wishes = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True)],
                                   "user_id LONG, push_notifications_enabled BOOLEAN, reservation_notifications BOOLEAN")
    batches = [[("a", 10, 1, "confirmed", NOW), ("b", 11, 2, "confirmed", NOW), ("c", 12, 3, "confirmed", NOW)],
               [("a", 10, 1, "confirmed", NOW), ("d", 13, 1, "cancelled_by_shop", NOW), ("e", 14, 1, "completed", NOW)]]
    run(spark, tmp_path, batches, schema, "created_at",
        lambda s: streams.booking_notifications(s, wishes, f"{tmp_path}/out", f"{tmp_path}/state"))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got.select("related_id", "notification_type")) == [(10, "reservation_confirmed"), (13, "reservation_cancelled")]
