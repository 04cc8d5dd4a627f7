"""Levels of deltas, and counters that follow inserts, updates and deletes in any order."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from slotwise.operators import points
from slotwise.streaming import counters, streams
from slotwise.streaming.deltas import Levels
from tests.conftest import rows
from tests.test_streams import LEDGER, NOW, run

DAY = dt.timedelta(days=1)


def folders(root) -> set[str]:
    return {str(p.parent.relative_to(root)) for p in Path(root).glob("level=*/upto=*/_SUCCESS")}


def test_levels_sum_what_was_written_and_stay_few(spark, tmp_path):
    levels = Levels(spark, str(tmp_path), "k STRING", "n LONG, v DOUBLE", fanout=3)
    assert levels.newest() == -1 and levels.read().isEmpty()
    r = random.Random(1)
    total: dict[str | None, list] = {}
    for number in range(13):
        batch = [(r.choice(("a", "b", None)), r.randint(-3, 3), 0.5) for _ in range(5)]
        for k, n, v in batch:
            total.setdefault(k, [0, 0.0])
            total[k][0] += n
            total[k][1] += v
        frame = spark.createDataFrame(batch, "k STRING, n LONG, v DOUBLE")
        levels.write(frame, number)
        if number in (2, 5, 8):
            # The batch that merged comes again after a failure.
            levels.write(frame, number)
        got = levels.read().groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        assert rows(got) == sorted(((k, n, v) for k, (n, v) in total.items()), key=lambda x: [str(y) for y in x])
        assert len(levels.live(number)) <= 6 and len(folders(tmp_path)) <= 12
    assert levels.live(12) == [f"{tmp_path}/level=2/upto=8", f"{tmp_path}/level=1/upto=11", f"{tmp_path}/level=0/upto=12"]


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    levels = Levels(spark, str(tmp_path), "k STRING", "n LONG", fanout=2)
    one = spark.createDataFrame([("a", 1)], "k STRING, n LONG")
    for number in range(3):
        levels.write(one, number)
    # Batch 3 wrote its own folder but not yet the two merges that belong to it.
    one.write.parquet(f"{tmp_path}/level=0/upto=3")
    assert levels.newest() == 2
    assert rows(levels.read().groupBy("k").agg(F.sum("n"))) == [("a", 3)]
    levels.write(one, 3)
    assert levels.newest() == 3 and rows(levels.read()) == [("a", 4)]


def test_sums_that_come_to_nothing_leave(spark, tmp_path):
    levels = Levels(spark, str(tmp_path), "k LONG", "n LONG", fanout=2)
    levels.write(spark.createDataFrame([(1, 5), (2, 1), (3, 1)], "k LONG, n LONG"), 0)
    levels.write(spark.createDataFrame([(1, -5), (3, None)], "k LONG, n LONG"), 1)
    assert rows(levels.read()) == [(2, 1), (3, 1)]


@pytest.mark.parametrize("closed", [None, NOW])
def test_balances_over_many_batches_at_any_moment(spark, tmp_path, closed):
    r = random.Random(4)
    moments = [None, NOW - 9 * DAY, NOW - DAY, NOW, NOW + DAY, NOW + 9 * DAY]
    lines = [
        (f"r{i}", r.randrange(6), r.choice((-30, 0, 7, 100, None)), r.choice(("available", "pending", "expired")), r.choice(moments),
         r.choice(moments), NOW)
        for i in range(120)
    ]
    batches = [lines[i : i + 12] + r.sample(lines[: i + 1], min(3, i + 1)) for i in range(0, 120, 12)]
    run(spark, tmp_path, batches, LEDGER, "created_at",
        lambda s: streams.point_balance_deltas(s, f"{tmp_path}/out", f"{tmp_path}/state", closed))
    whole = spark.createDataFrame(lines, LEDGER)
    for moment in (NOW, NOW + DAY, NOW + 3 * DAY, NOW + 30 * DAY, *(() if closed else (NOW - 5 * DAY, NOW - 30 * DAY))):
        assert rows(streams.point_balances_at(spark, f"{tmp_path}/out", moment)) == rows(points.ledger_balances(whole, moment))
    if closed:
        # One row for all that is over and one for each of the two moments to come, in each of a few levels.
        kept = Levels(spark, f"{tmp_path}/out", streams.LEDGER_KEYS, streams.LEDGER_SUMS).read()
        assert max(c for _, c in rows(kept.groupBy("user_id").count())) <= 3 * 4
        assert kept.filter(F.col("moment") <= F.lit(NOW)).isEmpty()


def shuffled_changes(r, final, spoil):
    """Signed images that end in ``final``: some rows wrong at first, some there only for a while."""
    out = []
    for i, row in enumerate(final):
        images = [(1, row)]
        if r.random() < 0.4:
            wrong = spoil(row)
            images += [(1, wrong), (-1, wrong)]
        if r.random() < 0.3:
            images += [(1, row), (-1, row)]
        out += [(f"{i}:{k}", sign, *image, NOW) for k, (sign, image) in enumerate(images)]
    out += r.sample(out, len(out) // 6)
    r.shuffle(out)
    size = -(-len(out) // 6)
    return [out[i : i + size] for i in range(0, len(out), size)]


def test_referrals_follow_users_and_payments(spark, tmp_path):
    r = random.Random(9)
    users = [(u, r.choice("AB"), False) for u in range(40)] + [(u, "C", False) for u in range(40, 44)]
    payments = [(r.randrange(60), None, r.random() < 0.4) for _ in range(60)] + [(None, None, True)]
    def spoil(row):
        return (row[0], "B" if row[1] == "A" else "Z", False) if row[1] else (row[0], None, not row[2])

    batches = shuffled_changes(r, users + payments, spoil)
    run(spark, tmp_path, batches, "change_id STRING, sign INT, user_id LONG, code STRING, paid BOOLEAN, sent_at TIMESTAMP_NTZ", "sent_at",
        lambda s: counters.keep_referrals(s, f"{tmp_path}/out", f"{tmp_path}/state"))
    payers = {u for u, _, paid in payments if paid}
    want = {c: (sum(x == c for _, x, _ in users), sum(x == c and u in payers for u, x, _ in users)) for c in "ABCZ"}
    holders = spark.createDataFrame([(i, c, c, False, "user") for i, c in enumerate("ABCZ")],
                                    "id LONG, name STRING, referral_code STRING, is_influencer BOOLEAN, user_role STRING")
    got = counters.referrals_now(spark, f"{tmp_path}/out", holders)
    assert {x.referral_code: (x.total_referrals, x.successful_referrals) for x in got.collect()} == want
    # The counters themselves hold nothing for a code that only wrong images named.
    kept = Levels(spark, f"{tmp_path}/out/codes", *counters.REFERRALS).read().groupBy("code").agg(F.sum("total_referrals").alias("n"))
    assert {x.code: x.n for x in kept.collect() if x.n} == {c: n for c, (n, _) in want.items() if n}


def test_points_after_updates_and_deletes(spark, tmp_path):
    r = random.Random(12)
    lines = [(r.randrange(5), r.choice((-30, 7, 100)), r.choice(("available", "pending")), r.choice((None, NOW, NOW + DAY)), r.choice((None, NOW + 2 * DAY)))
             for _ in range(60)]
    batches = shuffled_changes(r, lines, lambda row: (row[0] + 1, 999, "available", None, None))
    schema = ("change_id STRING, sign INT, user_id LONG, amount LONG, status STRING, available_from TIMESTAMP_NTZ, "
              "expires_at TIMESTAMP_NTZ, sent_at TIMESTAMP_NTZ")
    run(spark, tmp_path, batches, schema, "sent_at", lambda s: counters.keep_point_balances(s, f"{tmp_path}/out", f"{tmp_path}/state"))
    whole = spark.createDataFrame(lines, "user_id LONG, amount LONG, status STRING, available_from TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ")
    for moment in (NOW, NOW + DAY, NOW + 2 * DAY):
        assert rows(counters.kept_point_balances(spark, f"{tmp_path}/out", moment)) == rows(points.point_balances(whole, moment))


def test_groups_whose_rows_are_all_gone_have_no_totals(spark, tmp_path):
    day, schema = dt.date(2001, 7, 1), (
        "change_id STRING, sign INT, period_start_date DATE, gross_revenue LONG, commission_amount LONG, net_settlement_amount LONG, sent_at TIMESTAMP_NTZ"
    )
    gone = dt.date(2001, 6, 1)
    batches = [[("a", 1, gone, 10, 1, 9, NOW), ("b", 1, day, 20, 2, 18, NOW)], [("c", -1, gone, 10, 1, 9, NOW), ("b", 1, day, 20, 2, 18, NOW)]]
    run(spark, tmp_path, batches, schema, "sent_at", lambda s: counters.keep_batch_totals(s, f"{tmp_path}/out", f"{tmp_path}/state"))
    assert rows(counters.batch_totals_now(spark, f"{tmp_path}/out")) == [(day, 20, 2, 18, 1)]
