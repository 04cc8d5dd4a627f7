"""Bookings: lists, quotes, free slots, refunds, and the owner's and applicant's requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import at, hours_between, slot_time
from .settings import number
from .spread import first_valid

# Rules where settings and services do not say otherwise.
CANCEL_HOURS = "24"
MIN_DEPOSIT = "10000"
DEFAULT_DEPOSIT_PERCENT = "30.00"
OPENING = (9 * 60, 18 * 60)
NOTIFY = (9 * 60, 22 * 60)

# Notices sent to customers.
CONFIRMED_NOTICE = ("예약이 확정되었습니다", "예약이 샵에서 승인되었습니다. 예약 시간에 방문해 주세요.")
CANCELLED_NOTICE = ("예약이 취소되었습니다", "샵 사정으로 예약이 취소되었습니다. 예약금은 환불됩니다.")


def reservation_datetime(reservations: DataFrame) -> DataFrame:
    """Add the start of each booking as one timestamp."""
    return reservations.withColumn(
        "reservation_datetime", slot_time(F.col("reservation_date"), F.col("reservation_minute"))
    )


def reservation_tabs(tables, as_of: dt.datetime) -> DataFrame:
    """Each user's bookings, upcoming (still open, not started) or past."""
    shops = tables["shops"].select(F.col("id").alias("shop_id"), F.col("name").alias("shop_name"))
    upcoming = (F.col("reservation_datetime") >= at(as_of)) & F.col("status").isin("requested", "confirmed")
    return (
        reservation_datetime(tables["reservations"])
        .select("id", "user_id", "shop_id", "reservation_datetime", "status", "total_amount")
        .join(shops, "shop_id")
        .withColumn("tab", F.when(upcoming, "upcoming").otherwise("past"))
    )


def reservation_quote(tables, requests: DataFrame, lines: DataFrame) -> DataFrame:
    """Price, deposit, points and rest of each requested booking.

    Requests: quote_id, user_id, points_requested. Lines: quote_id, service_id, quantity.
    A line's deposit is the service's fixed one, else its percentage, else 30 %. The deposit of
    the booking is at least the configured minimum and at most the price.
    """
    services = tables["shop_services"].select(
        F.col("id").alias("service_id"), "price_min", "deposit_amount", "deposit_percentage"
    )
    price = F.col("price_min") * F.col("quantity")
    percent = F.coalesce(F.col("deposit_percentage"), F.lit(DEFAULT_DEPOSIT_PERCENT)).cast("decimal(5,2)")
    share = F.floor(price.cast("decimal(20,0)") * percent * F.lit("0.01").cast("decimal(3,2)")).cast("long")
    totals = (
        lines.join(services, "service_id")
        .groupBy("quote_id")
        .agg(
            F.sum(price).alias("total_amount"),
            F.sum(F.coalesce(F.col("deposit_amount") * F.col("quantity"), share)).alias("asked_deposit"),
        )
    )
    minimum = number(tables["system_settings"], "min_deposit_amount", MIN_DEPOSIT).cast("long")
    funds = tables["users"].select(F.col("id").alias("user_id"), "available_points")
    deposit = F.least("total_amount", F.greatest(F.col("asked_deposit"), minimum))
    return (
        requests.join(totals, "quote_id").join(funds, "user_id", "left")
        .withColumn("deposit_amount", deposit)
        .withColumn(
            "points_used",
            F.greatest(
                F.lit(0),
                F.least(
                    "points_requested",
                    F.coalesce("available_points", F.lit(0)),
                    F.col("total_amount") - F.col("deposit_amount"),
                ),
            ).cast("long"),
        )
        .select(
            "quote_id", "user_id", "total_amount", "deposit_amount", "points_used",
            (F.col("total_amount") - F.col("deposit_amount") - F.col("points_used")).alias("remaining_amount"),
        )
    )


def _open_days(tables, first: dt.date, days: int) -> DataFrame:
    """Opening hours of every active shop on each of ``days`` days that it is open."""
    calendar = F.sequence(F.lit(first), F.lit(first + dt.timedelta(days=days - 1)))
    return (
        tables["shop_operating_hours"].filter(F.col("is_open"))
        .join(
            tables["shops"].filter(F.col("shop_status") == "active").select(F.col("id").alias("shop_id")),
            "shop_id", "left_semi",
        )
        .withColumn(
            "day",
            # weekday() counts from Monday; opening hours count from Sunday.
            F.explode(F.filter(calendar, lambda d: (F.weekday(d) + 1) % 7 == F.col("day_of_week"))),
        )
    )


def free_slots(
    tables, first: dt.date, days: int, as_of: dt.datetime, step: int = 30, duration: int = 60
) -> DataFrame:
    """State of every slot of every active shop on ``days`` days: available, booked, blocked, past.

    A slot starts every ``step`` minutes and takes ``duration``. Bookings are turned into the slot
    starts they touch and deduplicated, so the match is an equi-join on (shop, day, slot) and a
    shop with very many bookings on a day contributes each slot once.
    """
    open_days = _open_days(tables, first, days)
    last_start = F.col("close_minute") - duration
    slots = open_days.filter(last_start >= F.col("open_minute")).select(
        "shop_id", "day", "break_start_minute", "break_end_minute",
        F.explode(F.sequence(F.col("open_minute"), last_start, F.lit(step))).alias("start_minute"),
        F.col("open_minute"),
    )
    in_break = F.coalesce(
        (F.col("start_minute") < F.col("break_end_minute"))
        & (F.col("start_minute") + duration > F.col("break_start_minute")),
        F.lit(False),
    )
    started = slot_time(F.col("day"), F.col("start_minute")) < at(as_of)
    taken = _taken_slots(tables, first, days, step, duration)
    return (
        slots.join(taken, ["shop_id", "day", "start_minute"], "left")
        .select(
            "shop_id", "day", "start_minute",
            F.when(started, "past")
            .when(in_break, "blocked")
            .when(F.col("taken"), "booked")
            .otherwise("available")
            .alias("slot_status"),
        )
    )


def _booked(tables, first: dt.date, days: int) -> DataFrame:
    """Open bookings of ``days`` days with the minutes of their longest service, NULL where none is known."""
    last = first + dt.timedelta(days=days - 1)
    booked = tables["reservations"].filter(
        F.col("reservation_date").between(F.lit(first), F.lit(last)) & F.col("status").isin("requested", "confirmed")
    ).select(F.col("id").alias("reservation_id"), "shop_id", F.col("reservation_date").alias("day"), "reservation_minute")
    length = (
        tables["reservation_services"].select("reservation_id", "service_id")
        .join(booked.select("reservation_id"), "reservation_id", "left_semi")
        .join(tables["shop_services"].select(F.col("id").alias("service_id"), "duration_minutes"), "service_id")
        .groupBy("reservation_id")
        .agg(F.max("duration_minutes").alias("minutes"))
    )
    return booked.join(length, "reservation_id", "left")


def bookable_gaps(tables, first: dt.date, days: int, as_of: dt.datetime, duration: int = 60) -> DataFrame:
    """Stretches of free minutes of every active shop: shop_id, day, open_minute, gap_start, gap_end (exclusive).

    Bookings and breaks that overlap or touch are one island; a gap reaches from the end of one to the start of the
    next, from opening to closing time, and not before ``as_of``. Bookings of unknown length take ``duration``. Of
    bookings that start in the same minute only the longest counts, so a shop's day is 1441 rows at most, whatever
    the number of its bookings.
    """
    hours = _open_days(tables, first, days)
    own = F.array_compact(
        F.array(
            F.when(
                F.col("break_start_minute") < F.col("break_end_minute"),
                F.struct(F.col("break_start_minute").alias("begin"), F.col("break_end_minute").alias("end")),
            ),
            # Closing time ends the last gap.
            F.struct(F.col("close_minute").alias("begin"), F.col("close_minute").alias("end")),
        )
    )
    taken = _booked(tables, first, days).select(
        "shop_id", "day", F.col("reservation_minute").alias("begin"),
        (F.col("reservation_minute") + F.coalesce("minutes", F.lit(duration))).alias("end"),
    )
    busy = hours.select("shop_id", "day", F.inline(own)).unionByName(taken).groupBy("shop_id", "day", "begin").agg(F.max("end").alias("end"))
    before = Window.partitionBy("shop_id", "day").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    today, minute = as_of.date(), -(-(as_of.hour * 3600 + as_of.minute * 60 + as_of.second + (as_of.microsecond > 0)) // 60)
    now = F.when(F.col("day") < F.lit(today), 24 * 60).when(F.col("day") == F.lit(today), minute).otherwise(0)
    return (
        busy.join(hours.select("shop_id", "day", "open_minute", "close_minute"), ["shop_id", "day"])
        .withColumn("until", F.max("end").over(before))
        .select(
            "shop_id", "day", "open_minute",
            F.greatest("open_minute", F.coalesce("until", F.lit(0)), now).alias("gap_start"),
            F.least("begin", "close_minute").alias("gap_end"),
        )
        .filter(F.col("gap_start") < F.col("gap_end"))
    )


def first_starts(tables, gaps: DataFrame, step: int = 30) -> DataFrame:
    """The earliest day and start of every service that fits a gap whole: service_id, shop_id, duration_minutes, day, start_minute.

    Starts lie ``step`` minutes apart from opening time on. Gaps meet the different lengths of their shop's services,
    some tens, and not the services themselves.
    """
    services = tables["shop_services"].select(F.col("id").alias("service_id"), "shop_id", "duration_minutes")
    steps = F.ceil((F.col("gap_start") - F.col("open_minute")) / step).cast("int")
    start = F.col("open_minute") + steps * step
    earliest = (
        gaps.withColumn("start_minute", start)
        .join(services.select("shop_id", "duration_minutes").distinct(), "shop_id")
        .filter(F.col("start_minute") + F.col("duration_minutes") <= F.col("gap_end"))
        .groupBy("shop_id", "duration_minutes")
        .agg(F.min(F.struct("day", "start_minute")).alias("earliest"))
    )
    return services.join(earliest, ["shop_id", "duration_minutes"]).select(
        "service_id", "shop_id", "duration_minutes", "earliest.day", "earliest.start_minute"
    )


def _taken_slots(tables, first: dt.date, days: int, step: int, duration: int) -> DataFrame:
    """Slot starts that overlap an open booking. A booking lasts as long as its longest service."""
    booked = _booked(tables, first, days)
    hours = tables["shop_operating_hours"].select(
        "shop_id", "day_of_week", "open_minute", "close_minute"
    )
    begin = F.col("reservation_minute") - F.col("open_minute")
    end = begin + F.coalesce("minutes", F.lit(duration))
    # First and last slot number whose [start, start + duration) meets [begin, end).
    low = F.greatest(F.floor((begin - duration) / step).cast("int") + 1, F.lit(0))
    high = F.least(
        F.ceil(end / step).cast("int") - 1,
        F.floor((F.col("close_minute") - F.col("open_minute") - duration) / step).cast("int"),
    )
    return (
        booked
        .withColumn("day_of_week", (F.weekday("day") + 1) % 7)
        .join(hours, ["shop_id", "day_of_week"])
        .withColumn("low", low)
        .withColumn("high", high)
        .filter(F.col("low") <= F.col("high"))
        .select("shop_id", "day", "open_minute", F.explode(F.sequence("low", "high")).alias("slot"))
        .select("shop_id", "day", (F.col("open_minute") + F.col("slot") * step).alias("start_minute"))
        .distinct()
        .withColumn("taken", F.lit(True))
    )


def refund_decision(tables) -> DataFrame:
    """Refund of every cancelled or missed booking.

    The deposit goes back in full if the shop cancels, or the user does so early enough for the
    smallest cutoff of the booked services, else nothing.
    """
    ended = reservation_datetime(
        tables["reservations"].filter(F.col("status").isin("cancelled_by_user", "cancelled_by_shop", "no_show"))
    ).select("id", "user_id", "status", "cancelled_at", "reservation_datetime")
    cutoff = (
        tables["reservation_services"].select(F.col("reservation_id").alias("id"), "service_id")
        .join(ended.select("id"), "id", "left_semi")
        .join(tables["shop_services"].select(F.col("id").alias("service_id"), "cancellation_hours"), "service_id")
        .groupBy("id")
        .agg(F.min("cancellation_hours").alias("service_hours"))
    )
    paid = (
        tables["payments"].filter(F.col("payment_status").isin("deposit_paid", "fully_paid", "refunded"))
        .groupBy(F.col("reservation_id").alias("id"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("is_deposit"), F.col("amount"))), F.lit(0)).alias("deposit"),
            F.sum("amount").alias("paid"),
        )
    )
    default = number(tables["system_settings"], "default_cancellation_hours", CANCEL_HOURS).cast("int")
    notice = hours_between(F.col("cancelled_at"), F.col("reservation_datetime"))
    early = (F.col("status") == "cancelled_by_user") & (notice >= F.col("cutoff_hours"))
    refundable = F.coalesce((F.col("status") == "cancelled_by_shop") | early, F.lit(False))
    return (
        ended.join(cutoff, "id", "left").join(paid, "id", "left").na.fill(0, ["deposit", "paid"])
        .withColumn("cutoff_hours", F.coalesce("service_hours", default))
        .select(
            "id", "user_id", "status", notice.alias("notice_hours"), "cutoff_hours",
            F.when(refundable, F.col("deposit")).otherwise(F.lit(0)).cast("long").alias("refund_amount"),
            F.when(~refundable, "no_refund")
            .when(F.col("paid") > F.col("deposit"), "deposit_only")
            .otherwise("full")
            .alias("refund_type"),
        )
    )


def _judge(tables, requests: DataFrame, states: tuple[str, ...]) -> DataFrame:
    current = (
        tables["reservations"].select(F.col("id").alias("reservation_id"), "user_id", "shop_id", F.col("status").alias("previous_status"))
        .join(tables["shops"].select(F.col("id").alias("shop_id"), F.col("owner_id").alias("real_owner")), "shop_id")
    )
    allowed = F.col("previous_status").isin(*states) & (F.col("real_owner") == F.col("owner_id"))
    return first_valid(requests.join(current, "reservation_id", "left"), allowed, "reservation_id", "request_id")


def _owner_step(judged: DataFrame, new_status: str, kind: str, notice: tuple[str, str], as_of: dt.datetime, problem: str):
    accepted = judged.filter("accepted")
    return {
        "outcome": judged.select(
            "request_id", "reservation_id",
            F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("outcome"),
            F.when(~F.col("accepted"), problem).alias("reject_reason"),
        ),
        "reservations": accepted.select(
            "reservation_id", F.lit(new_status).alias("status"), "reason", at(as_of).alias("changed_at")
        ),
        "actions": accepted.select(
            "reservation_id", F.lit(new_status).alias("action"), F.col("owner_id").alias("performed_by"), "reason",
            "previous_status", F.lit(new_status).alias("new_status"), at(as_of).alias("created_at"),
        ),
        "notifications": accepted.select(
            "user_id", F.lit(kind).alias("notification_type"), F.lit(notice[0]).alias("title"),
            F.lit(notice[1]).alias("message"), F.lit("unread").alias("status"),
            F.col("reservation_id").alias("related_id"), at(as_of).alias("created_at"),
        ),
    }


def confirm_reservations(tables, requests: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Owners confirm requested bookings. Requests: request_id, reservation_id, owner_id, reason."""
    return _owner_step(
        _judge(tables, requests, ("requested",)), "confirmed", "reservation_confirmed", CONFIRMED_NOTICE, as_of,
        "no requested reservation of this owner",
    )


def cancel_by_shop(tables, requests: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Owners cancel requested or confirmed bookings; the reason is stored with the booking."""
    return _owner_step(
        _judge(tables, requests, ("requested", "confirmed")), "cancelled_by_shop", "reservation_cancelled",
        CANCELLED_NOTICE, as_of, "no open reservation of this owner",
    )


def submit_applications(tables, requests: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Applications of people who run no active shop and wait for none."""
    owners = (
        tables["shops"].filter(F.col("shop_status").isin("active", "pending_approval") & F.col("owner_id").isNotNull())
        .select(F.col("owner_id").alias("applicant_id")).distinct()
    )
    accepted = requests.join(owners, "applicant_id", "left_anti")
    return {
        "accepted": accepted.select(
            *requests.columns, F.lit("pending").alias("application_status"), at(as_of).alias("created_at")
        ),
        "rejected": requests.join(owners, "applicant_id", "left_semi").select(
            *requests.columns, F.lit("already has a shop").alias("reject_reason")
        ),
    }


def approve_applications(tables, requests: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Approve waiting applications: shop, owner role, seven days of hours, notification defaults.

    Requests: request_id, application_id, admin_id. The shop key is a digest of the application.
    """
    current = tables["shop_applications"].withColumnRenamed("id", "application_id")
    judged = first_valid(
        requests.join(current, "application_id", "left"),
        F.col("application_status") == "pending", "application_id", "request_id",
    )
    accepted = judged.filter("accepted").withColumn(
        "shop_id", F.md5(F.concat(F.lit("shop:"), F.col("application_id").cast("string")))
    )
    return {
        "outcome": judged.select(
            "request_id", "application_id",
            F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("outcome"),
            F.when(~F.col("accepted"), "no pending application").alias("reject_reason"),
        ),
        "shops": accepted.select(
            F.col("shop_id").alias("id"), F.col("applicant_id").alias("owner_id"), F.col("shop_name").alias("name"),
            F.col("shop_address").alias("address"), "main_category", F.lit("active").alias("shop_status"),
            F.lit("verified").alias("verification_status"),
        ),
        "users": accepted.select(
            F.col("applicant_id").alias("id"), F.lit("shop_owner").alias("user_role"), at(as_of).alias("updated_at")
        ).distinct(),
        "hours": accepted.select(
            "shop_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_of_week"), F.lit(True).alias("is_open"),
            F.lit(OPENING[0]).alias("open_minute"), F.lit(OPENING[1]).alias("close_minute"),
        ),
        "notification_settings": accepted.select(
            "shop_id", F.lit(True).alias("new_reservation_notification"), F.lit(True).alias("cancellation_notification"),
            F.lit(NOTIFY[0]).alias("notification_start_minute"), F.lit(NOTIFY[1]).alias("notification_end_minute"),
        ),
        "applications": accepted.select(
            F.col("application_id").alias("id"), F.lit("approved").alias("application_status"),
            F.col("admin_id").alias("reviewed_by"), at(as_of).alias("reviewed_at"),
            F.col("shop_id").alias("approved_shop_id"),
        ),
    }
