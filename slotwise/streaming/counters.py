"""Stored counters kept up to date from change rows: inserts, updates and deletes.

A change row is an image of a row with ``sign``: +1 for the image that a change leaves, -1 for the one that it
takes away; an update is both. Counters are sums of signed images, so changes may come in any order and in any batch.
``change_id`` is unique; a change that is sent again counts once.

Counting different people needs more than a sum: their references are counted, and a person counts while any is left.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .deltas import Levels
from .streams import LEDGER_KEYS, LEDGER_SUMS, ledger_deltas, start, usable_sum

SHOP_BOOKINGS = ("shop_id LONG", "n LONG")
PROMOTION_USES = ("promotion_id LONG", "n LONG")
BATCH_TOTALS = ("period_start_date DATE", "n LONG, total_revenue LONG, total_commission LONG, total_settlement_amount LONG")
REFERENCES = ("user_id LONG, code STRING", "n LONG, paid LONG")
REFERRALS = ("code STRING", "total_referrals LONG, successful_referrals LONG")


def _signed(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value, F.lit(0)) * F.col("sign")


def _keep(changes: DataFrame, kept: tuple[str, str], images: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    levels = Levels(changes.sparkSession, target, *kept)

    def write(batch: DataFrame, number: int) -> None:
        levels.write(images(batch), number)

    return start(changes.sparkSession, changes.dropDuplicates(["change_id"]).writeStream.foreachBatch(write), checkpoint)


def keep_shop_bookings(reservations: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Bookings of each shop from changes of reservations."""
    return _keep(reservations, SHOP_BOOKINGS, lambda b: b.select("shop_id", F.col("sign").alias("n")), target, checkpoint)


def shop_bookings_now(spark: SparkSession, target: str, shops: DataFrame) -> DataFrame:
    counted = Levels(spark, target, *SHOP_BOOKINGS).read().groupBy("shop_id").agg(F.sum("n").alias("bookings"))
    return shops.select(F.col("id").alias("shop_id")).join(counted, "shop_id", "left").select(
        "shop_id", F.coalesce("bookings", F.lit(0)).alias("total_bookings")
    )


def keep_promotion_uses(usages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Uses of each promotion from changes of its usages."""
    return _keep(usages, PROMOTION_USES, lambda b: b.select("promotion_id", F.col("sign").alias("n")), target, checkpoint)


def promotion_uses_now(spark: SparkSession, target: str, promotions: DataFrame) -> DataFrame:
    counted = Levels(spark, target, *PROMOTION_USES).read().groupBy("promotion_id").agg(F.sum("n").alias("used"))
    return promotions.select(F.col("id").alias("promotion_id")).join(counted, "promotion_id", "left").select(
        "promotion_id", F.coalesce("used", F.lit(0)).alias("current_usage")
    )


def keep_batch_totals(settlements: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Totals of each settled period from changes of settlements."""
    return _keep(
        settlements, BATCH_TOTALS,
        lambda b: b.select(
            "period_start_date", F.col("sign").alias("n"), _signed("gross_revenue").alias("total_revenue"),
            _signed("commission_amount").alias("total_commission"), _signed("net_settlement_amount").alias("total_settlement_amount"),
        ),
        target, checkpoint,
    )


def batch_totals_now(spark: SparkSession, target: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("total_revenue", "total_commission", "total_settlement_amount")]
    return (
        Levels(spark, target, *BATCH_TOTALS).read().groupBy("period_start_date").agg(*sums, F.sum("n").alias("shop_count"))
        .filter("shop_count > 0")
    )


def keep_point_balances(ledger: DataFrame, target: str, checkpoint: str, closed: dt.datetime | None = None) -> StreamingQuery:
    """Point sums of each user from changes of ledger rows; ``closed`` as in :func:`ledger_deltas`."""
    return _keep(ledger, (LEDGER_KEYS, LEDGER_SUMS), lambda b: ledger_deltas(b, F.col("sign"), closed), target, checkpoint)


def kept_point_balances(spark: SparkSession, target: str, as_of: dt.datetime) -> DataFrame:
    """Earned, used, usable and waiting points of each user."""
    return (
        Levels(spark, target, LEDGER_KEYS, LEDGER_SUMS).read().groupBy("user_id")
        .agg(
            F.sum("earned").alias("total_earned"), F.sum("used").alias("total_used"),
            usable_sum(as_of).alias("available_balance"), F.sum("pending").alias("pending_balance"), F.sum("n").alias("n"),
        )
        .filter("n > 0").drop("n")
    )


def keep_referrals(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """People referred by each code and those of them who have paid, from changes of users and of payments.

    Changes: change_id, sign, user_id, and either ``code`` (a user who came by that code) or ``paid`` true (a finished
    payment of that user). Kept are references per person and the counters themselves. A batch reads the references
    of its own people only, and adds to the counters what they are worth after it less what they were worth before.
    """
    spark = changes.sparkSession
    people, counts = Levels(spark, f"{target}/people", *REFERENCES), Levels(spark, f"{target}/codes", *REFERRALS)

    def write(batch: DataFrame, number: int) -> None:
        marks = batch.filter(F.col("user_id").isNotNull()).select(
            "user_id", "code",
            F.when(F.col("code").isNotNull(), F.col("sign")).otherwise(0).alias("n"),
            F.when(F.col("paid"), F.col("sign")).otherwise(0).alias("paid"),
        ).groupBy("user_id", "code").agg(F.sum("n").alias("n"), F.sum("paid").alias("paid")).persist()
        # Batch numbers name the state before: a repeated batch starts from the same one.
        before = people.read(number - 1).join(marks.select("user_id").distinct(), "user_id", "left_semi")
        then = before.withColumn("era", F.explode(F.array(F.lit(-1), F.lit(1))))
        counts.write(_worth(then.unionByName(marks.withColumn("era", F.lit(1)))), number)
        people.write(marks, number)
        marks.unpersist()

    return start(spark, changes.dropDuplicates(["change_id"]).writeStream.foreachBatch(write), checkpoint)


def _worth(references: DataFrame) -> DataFrame:
    """(code, total_referrals, successful_referrals) of people's references, times ``era``."""
    one = references.groupBy("era", "user_id", "code").agg(F.sum("n").alias("n"), F.sum("paid").alias("paid"))
    payers = one.groupBy("era", "user_id").agg(F.sum("paid").alias("payments")).filter("payments > 0").drop("payments")
    came = one.filter("n > 0").select("era", "user_id", "code")
    joined = came.join(payers.withColumn("has_paid", F.lit(1)), ["era", "user_id"], "left")
    return joined.select(
        "code", F.col("era").alias("total_referrals"), (F.col("era") * F.coalesce("has_paid", F.lit(0))).alias("successful_referrals")
    )


def referrals_now(spark: SparkSession, target: str, users: DataFrame) -> DataFrame:
    counted = Levels(spark, f"{target}/codes", *REFERRALS).read().groupBy(F.col("code").alias("referral_code")).agg(
        F.sum("total_referrals").alias("total_referrals"), F.sum("successful_referrals").alias("successful_referrals")
    )
    return (
        users.select(F.col("id").alias("user_id"), "name", "referral_code", "is_influencer", "user_role")
        .join(counted, "referral_code", "left").na.fill(0, ["total_referrals", "successful_referrals"])
    )
