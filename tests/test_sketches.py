"""Distinct counts and cohorts from stored sketches, within the error that their size allows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from slotwise.operators import analytics as A

DAY = dt.datetime(2001, 1, 1)


def test_usage_of_weeks_and_months_from_stored_days(spark, tmp_path):
    events = spark.range(120_000).select(
        (F.lit(DAY) + F.make_dt_interval(days=(F.col("id") % 60).cast("int"))).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"),
        F.when(F.col("id") % 1000 != 5, (F.xxhash64("id") % 40_000)).alias("user_id"),
    )
    lg_k = 10
    A.usage_sketches(events, lg_k).write.parquet(f"{tmp_path}/days")
    stored = spark.read.parquet(f"{tmp_path}/days")
    for unit in ("week", "month"):
        exact = events.groupBy(F.to_date(F.date_trunc(unit, "ts")).alias("day"), "event_type").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("exact")
        )
        rows = A.usage_counts(A.merged_usage(stored, unit)).join(exact, ["day", "event_type"]).collect()
        assert len(rows) == exact.count() and all(r.events == r.n for r in rows)
        assert all(abs(r.users - r.exact) <= A.sketch_error(lg_k) * r.exact for r in rows)
        assert any(r.users != r.exact for r in rows)  # a sketch, not a count
    assert 0.02 < A.sketch_error() < 0.025


def test_retention_from_sketches_is_exact_for_few_and_near_for_many(spark):
    r = random.Random(4)
    data = [(u, DAY + dt.timedelta(days=r.randrange(150))) for u in range(3000) for _ in range(r.randint(1, 3))] + [(7, None)]
    bookings = spark.createDataFrame(data, "user_id LONG, created_at TIMESTAMP_NTZ")
    want = {(x.cohort, x.month_offset): (x.active_users, x.cohort_size) for x in A.retention(bookings.dropna()).collect()}

    def got(lg_k):
        found = A.retention_from_sketches(A.booker_sketches(bookings, lg_k), lg_k).collect()
        return {(x.cohort, x.month_offset): (x.active_users, x.cohort_size) for x in found}

    assert got(13) == want
    rough = got(8)
    # An intersection's error is that of the month as a whole, which has some 2000 users.
    assert all(abs(rough.get(k, (0, 0))[0] - n) <= A.sketch_error(8) * 2500 for k, (n, _) in want.items())
    assert rough != want


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], "ts TIMESTAMP_NTZ, event_type STRING, user_id LONG, created_at TIMESTAMP_NTZ")
    assert A.usage_counts(A.merged_usage(A.usage_sketches(none), "week")).collect() == []
    assert A.retention_from_sketches(A.booker_sketches(none)).collect() == []
