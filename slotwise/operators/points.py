"""Loyalty points: balances, maturation, awards, history and redemption."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import at, midnight, month_start, plus_days
from ..functions.money import award_points
from .durable import cut_lineage
from .settings import number
from .spread import join_per_key, running_totals

# Award rules where the settings do not say otherwise, and the award's text.
AWARD_PERCENT = "2.5"
AWARD_CAP = "300000"
HOLD_DAYS = "7"
BONUS_MULTIPLIER = "2.0"
AWARD_TEXT = "서비스 이용 적립"
PAGE_SIZE = 30


def _sum_where(condition: Column, value: Column | str = "amount") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")


def _usable(as_of: dt.datetime) -> Column:
    """Matured (boundary included) and not expired (boundary excluded)."""
    now = at(as_of)
    return (
        (F.col("status") == "available")
        & (F.col("available_from").isNull() | (F.col("available_from") <= now))
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    )


def ledger_balances(ledger: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Total and usable points of each user with ledger rows, in one pass."""
    return ledger.groupBy("user_id").agg(
        _sum_where((F.col("amount") > 0) & (F.col("status") == "available")).alias("total_points"),
        _sum_where(_usable(as_of)).alias("available_points"),
    )


def point_balances(ledger: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Earned, used, usable and waiting points of each user."""
    return ledger.groupBy("user_id").agg(
        _sum_where(F.col("amount") > 0).alias("total_earned"),
        (-_sum_where(F.col("amount") < 0)).alias("total_used"),
        _sum_where(_usable(as_of)).alias("available_balance"),
        _sum_where(F.col("status") == "pending").alias("pending_balance"),
    )


def user_point_summary(tables, as_of: dt.datetime) -> DataFrame:
    """Stored totals of each user with waiting points and points earned this month."""
    start = at(midnight(month_start(as_of)))
    earned_now = (F.col("status") == "available") & (F.col("amount") > 0) & (F.col("created_at") >= start)
    sums = (
        tables["point_transactions"]
        .filter((F.col("status") == "pending") | earned_now)
        .groupBy("user_id")
        .agg(
            _sum_where(F.col("status") == "pending").alias("pending_points"),
            _sum_where(earned_now).alias("points_this_month"),
        )
    )
    people = tables["users"].select(F.col("id").alias("user_id"), "name", "total_points", "available_points")
    return people.join(sums, "user_id", "left").na.fill(0, ["pending_points", "points_this_month"])


def points_maturation(ledger: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Ledger with states moved on: waiting rows whose hold is over become available, and
    available rows past their end become expired."""
    now = at(as_of)
    ready = F.when(
        (F.col("status") == "pending") & (F.col("available_from") <= now), "available"
    ).otherwise(F.col("status"))
    return ledger.withColumn("status", ready).withColumn(
        "status",
        F.when((F.col("status") == "available") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status")),
    )


def award_service_points(tables, as_of: dt.datetime) -> DataFrame:
    """New ledger rows for completed bookings that have no award yet."""
    settings = tables["system_settings"]
    awarded = (
        tables["point_transactions"]
        .filter((F.col("transaction_type") == "earned_service") & F.col("reservation_id").isNotNull())
        .select("reservation_id")
    )
    due = (
        tables["reservations"].filter(F.col("status") == "completed")
        .select(F.col("id").alias("reservation_id"), "user_id", "total_amount")
        .join(awarded, "reservation_id", "left_anti")
    )
    points = award_points(
        F.col("total_amount"),
        number(settings, "point_earning_rate", AWARD_PERCENT),
        number(settings, "point_max_eligible_amount", AWARD_CAP),
    )
    hold = number(settings, "point_restriction_days", HOLD_DAYS).cast("int")
    return due.select(
        "user_id",
        "reservation_id",
        F.lit("earned_service").alias("transaction_type"),
        points.alias("amount"),
        F.lit(AWARD_TEXT).alias("description"),
        F.lit("pending").alias("status"),
        plus_days(at(as_of), hold).alias("available_from"),
        at(as_of).alias("created_at"),
    )


def influencer_bonus(tables) -> DataFrame:
    """Extra ledger rows for referral points of influencers: base x (multiplier - 1)."""
    extra = number(tables["system_settings"], "influencer_point_bonus_rate", BONUS_MULTIPLIER) - F.lit(1)
    influencers = tables["users"].filter("is_influencer").select(F.col("id").alias("user_id"))
    return (
        tables["point_transactions"]
        .filter(F.col("transaction_type") == "earned_referral")
        .join(influencers, "user_id", "left_semi")
        .select(
            F.concat(F.lit("I"), F.col("id").cast("string")).alias("id"),
            "user_id",
            "reservation_id",
            F.lit("influencer_bonus").alias("transaction_type"),
            F.floor(F.col("amount").cast("decimal(20,0)") * extra.cast("decimal(7,4)")).cast("long").alias("amount"),
            "status",
            "available_from",
            "expires_at",
            "related_user_id",
            "created_at",
        )
    )


def points_history(ledger: DataFrame, tab: str = "all", page: int | None = None) -> DataFrame:
    """Ledger rows with the balance after each, their tab, and pages of 30, newest first.

    The balance counts every row of the user; ``position`` and pages count rows of the tab.
    """
    wanted = {"all": F.lit(True), "earned": F.col("amount") > 0, "used": F.col("amount") < 0}[tab]
    flag = F.when(wanted, 1).otherwise(0)
    rows = ledger.select("id", "user_id", "created_at", "transaction_type", "amount", "status")
    totals = running_totals(
        rows, "user_id", "created_at", "id", {"balance_after": F.col("amount"), "position": flag},
        finals={"rows_in_tab": "position"},
    ).filter(wanted)
    newest = F.col("rows_in_tab") - F.col("position")
    result = totals.select(
        "id", "user_id", "created_at", "transaction_type", "amount", "status", "balance_after", "position",
        F.when(F.col("amount") > 0, "earned").otherwise("used").alias("tab"),
        F.floor(newest / PAGE_SIZE).cast("long").alias("page"),
    )
    return result if page is None else result.filter(F.col("page") == page)


def points_overview(ledger: DataFrame) -> DataFrame:
    """One row: points issued, redeemed, waiting, expired and adjusted."""
    kind = F.col("transaction_type")
    return ledger.agg(
        _sum_where(kind.isin("earned_service", "earned_referral", "influencer_bonus")).alias("issued"),
        (-_sum_where(kind == "used_service")).alias("redeemed"),
        _sum_where(F.col("status") == "pending").alias("pending"),
        _sum_where((F.col("status") == "expired") & (F.col("amount") > 0)).alias("expired"),
        _sum_where(kind == "adjusted").alias("adjusted"),
    )


def point_redemption(requests: DataFrame, balances: DataFrame) -> DataFrame:
    """Decide requests to spend points, each user's in order of (requested_at, request_id).

    A request is accepted if the points left cover it; a rejected one costs nothing.
    Requests: request_id, user_id, requested_at, amount. Balances: user_id, available_points.

    Order matters, so a plain running sum is not enough. All users are decided together in
    rounds that never hold a user's requests in one task, see ``_rounds``.
    """
    asked = requests.filter(F.col("user_id").isNotNull()).select("request_id", "user_id", "requested_at", "amount")
    held = balances.select("user_id", F.col("available_points").alias("held"))
    funded = join_per_key(asked, held, "user_id", "request_id", "left").select(
        *asked.columns, F.coalesce("held", F.lit(0)).cast("long").alias("funds")
    )
    return _rounds(funded)


def _rounds(queued: DataFrame) -> DataFrame:
    """Decide queues in at most ``log2(funds) + 1`` rounds.

    Against the points left, a request is *small* (at most half) or *big*. Up to the first
    event every small request fits and every big one does not. The event is the first small
    request that takes the small ones past half, or the first big one that still fits. It is
    accepted and leaves less than half, so the points left halve with every round.
    """
    decided: list[DataFrame] = []
    live = cut_lineage(queued)
    while not live.isEmpty():
        fits = (F.col("amount") > 0) & (F.col("amount") <= F.col("funds"))
        decided.append(live.filter(~fits).select("request_id", "user_id", "amount", F.lit(False).alias("accepted")))
        small = 2 * F.col("amount") <= F.col("funds")
        summed = running_totals(
            live.filter(fits), "user_id", "requested_at", "request_id",
            {"spent": F.when(small, F.col("amount")).otherwise(0)},
        ).withColumn("event", F.when(small, 2 * F.col("spent") > F.col("funds")).otherwise(
            F.col("amount") <= F.col("funds") - F.col("spent")
        ))
        cost = F.col("spent") + F.when(small, 0).otherwise(F.col("amount"))
        place = F.struct("requested_at", "request_id")
        first = summed.filter("event").groupBy("user_id").agg(
            F.min(F.struct(place.alias("place"), (F.col("funds") - cost).alias("rest"))).alias("first")
        )
        judged = cut_lineage(
            join_per_key(summed, first, "user_id", "request_id", "left").withColumn(
                "accepted",
                F.when(F.col("first").isNull() | (place < F.col("first.place")), small)
                .when(place == F.col("first.place"), True),
            )
        )
        decided.append(judged.filter(F.col("accepted").isNotNull()).select("request_id", "user_id", "amount", "accepted"))
        live = judged.filter(F.col("accepted").isNull()).select(
            "request_id", "user_id", "requested_at", "amount", F.col("first.rest").alias("funds")
        )
    result = decided[0]
    for frame in decided[1:]:
        result = result.unionByName(frame)
    return result


def redemption_rows(decisions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Negative ledger rows of accepted requests."""
    return decisions.filter("accepted").select(
        F.concat(F.lit("S"), F.col("request_id").cast("string")).alias("id"),
        "user_id",
        F.lit("used_service").alias("transaction_type"),
        (-F.col("amount")).alias("amount"),
        F.lit("available").alias("status"),
        at(as_of).alias("created_at"),
    )
