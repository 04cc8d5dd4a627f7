"""Product and admin reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import at
from .referrals import referral_counters

# Steps of the booking funnel, in order.
FUNNEL_STEPS = ("app_open", "search_performed", "shop_viewed", "reservation_created", "payment_completed")
# Registers of a sketch, as a power of two. Its size is what bounds its error, see ``sketch_error``.
SKETCH_LG_K = 15


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def platform_overview(tables) -> DataFrame:
    """One row: users, shops, open bookings."""
    active = F.count_if(F.col("status").isin("requested", "confirmed"))
    return tables["reservations"].agg(active.alias("active_reservations")).select(
        _rows(tables["users"]).alias("total_users"), _rows(tables["shops"]).alias("total_shops"), "active_reservations"
    )


def recent_activity(tables, size: int = 50) -> DataFrame:
    """The newest registrations and shop applications together."""
    order = [F.desc("created_at"), F.col("kind"), F.col("id")]
    joined = tables["users"].select(F.lit("user_registered").alias("kind"), "id", "name", "created_at")
    applied = tables["shop_applications"].select(
        F.lit("shop_application").alias("kind"), "id", F.col("shop_name").alias("name"), "created_at"
    )
    # Each side gives its newest rows, so only two short lists are merged.
    return joined.orderBy(*order).limit(size).unionByName(applied.orderBy(*order).limit(size)).orderBy(*order).limit(size)


def admin_user_search(users: DataFrame, text: str, status: str | None = None) -> DataFrame:
    """Users whose name, email or phone contains ``text``."""
    needle = text.lower()
    found = users.filter(
        F.lower("name").contains(needle) | F.lower("email").contains(needle) | F.col("phone_number").contains(needle)
    )
    return found if status is None else found.filter(F.col("user_status") == status)


def payment_list(payments: DataFrame) -> DataFrame:
    """Payments by state, deposit and balance apart, with what is left after refunds."""
    return payments.groupBy("payment_status", "is_deposit").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("amount").alias("amount"), F.sum("refund_amount").alias("refunded"),
        F.sum(F.col("amount") - F.col("refund_amount")).alias("net_amount"),
    )


def live_announcements(announcements: DataFrame, role: str, as_of: dt.datetime) -> DataFrame:
    """Announcements shown to a role now, important ones first, then the latest."""
    now = at(as_of)
    return announcements.filter(
        F.col("is_active")
        & (F.col("starts_at") <= now)
        & (F.col("ends_at").isNull() | (F.col("ends_at") >= now))
        & (F.col("target_user_type").isNull() | F.array_contains("target_user_type", role))
    ).orderBy(F.desc("is_important"), F.desc("starts_at"), "id")


def live_faqs(faqs: DataFrame) -> DataFrame:
    return faqs.filter("is_active").orderBy("category", "display_order", "id")


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.filter(F.col("status") == "unread").groupBy("user_id", "notification_type").agg(
        F.count(F.lit(1)).alias("unread")
    )


def moderation_queue(reports: DataFrame) -> DataFrame:
    """Waiting reports per target and reason, most reported first."""
    return (
        reports.filter(F.col("status") == "pending")
        .groupBy("reported_content_type", "reported_content_id", "reason")
        .agg(F.count(F.lit(1)).alias("reports"), F.min("created_at").alias("first_reported_at"))
        .orderBy(F.desc("reports"), "first_reported_at", "reported_content_id", "reason")
    )


def funnel_states(events: DataFrame, steps: tuple[str, ...] = FUNNEL_STEPS, unit: str = "minute") -> DataFrame:
    """What the events of a user and time slice do to a walk through ``steps``: (user_id, slice, moves).

    ``moves[s]`` is the number of steps done after the slice by somebody who came to it with ``s`` done. A step is
    done by the first of its events at or after the step before, so events of one instant are taken in the order
    of the steps. Slices are short, so one very active user is many groups. Events without a user or a time, or
    of another kind, are left out.
    """
    places = F.array_compact(
        F.array(*[F.when(F.col("event_type") == step, F.lit(i)) for i, step in enumerate(steps)])
    )
    placed = events.filter(F.col("event_type").isin(*steps) & F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(
        "user_id", "ts", F.explode(places).alias("place")
    )
    in_order = F.array_sort(F.collect_set(F.struct("ts", "place")))
    return placed.groupBy("user_id", F.date_trunc(unit, "ts").alias("slice")).agg(
        F.aggregate(
            in_order, _none_done(steps),
            lambda done, e: F.transform(done, lambda s: F.when(s == e["place"], s + 1).otherwise(s)),
        ).alias("moves")
    )


def _none_done(steps: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(i) for i in range(len(steps) + 1)])


def merge_funnel_states(states: DataFrame, unit: str, steps: tuple[str, ...] = FUNNEL_STEPS) -> DataFrame:
    """States of wider slices, such as days, from those of the slices inside, taken one after the other.

    Stored states of earlier days can be merged with new ones; no event is read again.
    """
    ordered = F.array_sort(F.collect_list(F.struct("slice", "moves")))
    return states.groupBy("user_id", F.date_trunc(unit, "slice").alias("wider")).agg(
        F.aggregate(ordered, _none_done(steps), lambda done, x: F.transform(done, lambda s: F.get(x["moves"], s))).alias("moves")
    ).withColumnRenamed("wider", "slice")


def funnel_counts(states: DataFrame, steps: tuple[str, ...] = FUNNEL_STEPS) -> DataFrame:
    """Users who did each step, from the states of all slices, whatever their width."""
    ordered = F.array_sort(F.collect_list(F.struct("slice", "moves")))
    done = states.groupBy("user_id").agg(F.aggregate(ordered, F.lit(0), lambda s, x: F.get(x["moves"], s)).alias("done"))
    users = done.agg(*[F.count_if(F.col("done") > i).alias(f"n{i}") for i in range(len(steps))])
    line = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_number"), F.lit(step).alias("step"), F.col(f"n{i}").alias("users"),
                F.round(F.col(f"n{i}") / F.nullif(F.col(f"n{max(i - 1, 0)}"), F.lit(0)), 4).alias("from_previous"),
                F.round(F.col(f"n{i}") / F.nullif(F.col("n0"), F.lit(0)), 4).alias("from_first"),
            )
            for i, step in enumerate(steps)
        ]
    )
    return users.select(F.inline(line))


def event_funnel(events: DataFrame, steps: tuple[str, ...] = FUNNEL_STEPS) -> DataFrame:
    """Users who did each step after the one before, and the share that got there, in one scan of the events.

    A user reaches a step with the first such event at or after reaching the step before.
    """
    return funnel_counts(funnel_states(events, steps), steps)


def retention(reservations: DataFrame) -> DataFrame:
    """Users of each first-booking month that booked again ``month_offset`` months later."""
    month = F.trunc(F.col("created_at").cast("date"), "month")
    active = reservations.select("user_id", month.alias("month")).distinct()
    first = active.groupBy("user_id").agg(F.min("month").alias("cohort"))
    offset = F.months_between("month", "cohort").cast("int")
    counted = (
        active.join(first, "user_id")
        .groupBy("cohort", offset.alias("month_offset"))
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    size = counted.filter(F.col("month_offset") == 0).select("cohort", F.col("active_users").alias("cohort_size"))
    return counted.join(size, "cohort").withColumn(
        "retention_rate", F.round(F.col("active_users") / F.col("cohort_size"), 4)
    )


def booker_sketches(reservations: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """(day, bookers) to be stored: a theta sketch of the users who booked on each day. Exact below 2 ** lg_k users."""
    return reservations.filter(F.col("created_at").isNotNull()).groupBy(F.to_date("created_at").alias("day")).agg(
        F.theta_sketch_agg("user_id", lg_k).alias("bookers")
    )


def retention_from_sketches(sketches: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Retention as above from stored sketches alone, estimated where a month has more than 2 ** lg_k users.

    A cohort is who booked in a month less who booked in any before; who of them came back is its intersection with
    a later month. Rows are months, so what is joined grows with the calendar and not with the bookings.
    """
    monthly = sketches.groupBy(F.trunc("day", "month").alias("month")).agg(F.theta_union_agg("bookers", lg_k).alias("bookers"))
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    known = monthly.withColumns({"known": F.theta_union_agg("bookers", lg_k).over(before), "last": F.max("month").over(Window.partitionBy())})
    cohorts = known.select(
        F.col("month").alias("cohort"),
        F.when(F.col("known").isNull(), F.col("bookers")).otherwise(F.theta_difference("bookers", "known")).alias("people"),
        F.explode(F.sequence("month", "last", F.make_ym_interval(F.lit(0), F.lit(1)))).alias("month"),
    )
    return (
        cohorts.join(monthly, "month")
        .select(
            "cohort", F.months_between("month", "cohort").cast("int").alias("month_offset"),
            F.theta_sketch_estimate(F.theta_intersection("people", "bookers")).alias("active_users"),
            F.theta_sketch_estimate("people").alias("cohort_size"),
        )
        .filter("active_users > 0")
        .withColumn("retention_rate", F.round(F.col("active_users") / F.col("cohort_size"), 4))
    )


def feature_usage(events: DataFrame) -> DataFrame:
    """Events and different users per kind and day, counted exactly."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users")
    )


def sketch_error(lg_k: int = SKETCH_LG_K) -> float:
    """Share by which a distinct count from a sketch may be off: four standard errors of one with 2 ** lg_k registers."""
    return 4 * 1.04 / 2 ** (lg_k / 2)


def usage_sketches(events: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """(day, event_type, events, users) to be stored, where ``users`` is a sketch of the different users.

    One shuffle of small rows: users are put into sketches where the events are read.
    """
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.hll_sketch_agg("user_id", lg_k).alias("users")
    )


def merged_usage(sketches: DataFrame, unit: str) -> DataFrame:
    """Sketches of longer times (``week``, ``month``) from those of the days in them; no event is read again."""
    return sketches.groupBy(F.trunc("day", unit).alias("day"), "event_type").agg(
        F.sum("events").alias("events"), F.hll_union_agg("users").alias("users")
    )


def usage_counts(sketches: DataFrame) -> DataFrame:
    """Different users of each row, estimated within ``sketch_error``."""
    return sketches.withColumn("users", F.hll_sketch_estimate("users"))


def onboarding_success(applications: DataFrame) -> DataFrame:
    """Approved share of decided applications per month and category."""
    status = F.col("application_status")
    approved, rejected = F.count_if(status == "approved"), F.count_if(status == "rejected")
    return (
        applications.groupBy(
            F.trunc(F.col("created_at").cast("date"), "month").alias("month"), F.col("main_category").alias("category")
        )
        .agg(
            F.count(F.lit(1)).alias("applications"), approved.alias("approved"), rejected.alias("rejected"),
            F.count_if(status == "pending").alias("pending"),
        )
        .withColumn(
            "approval_rate",
            F.round(F.col("approved") / F.nullif(F.col("approved") + F.col("rejected"), F.lit(0)), 4),
        )
    )


def error_report(errors: DataFrame) -> DataFrame:
    return errors.groupBy(F.to_date("created_at").alias("day"), "severity", "category").agg(
        F.count(F.lit(1)).alias("errors")
    )


def profile_stats(tables) -> DataFrame:
    """Points, referrals and bookings of each user."""
    bookings = tables["reservations"].groupBy("user_id").agg(
        F.count(F.lit(1)).alias("reservation_count"),
        F.count_if(F.col("status") == "completed").alias("completed_count"),
    )
    stored = tables["users"].select(F.col("id").alias("user_id"), "total_points", "available_points")
    return (
        referral_counters(tables)
        .select("user_id", "name", "total_referrals", "successful_referrals")
        .join(stored, "user_id")
        .join(bookings, "user_id", "left")
        .na.fill(0, ["reservation_count", "completed_count"])
    )


def shop_total_bookings(tables) -> DataFrame:
    """Rebuild the booking counter of every shop."""
    counted = tables["reservations"].groupBy("shop_id").agg(F.count(F.lit(1)).alias("bookings"))
    return (
        tables["shops"].select(F.col("id").alias("shop_id"))
        .join(counted, "shop_id", "left")
        .select("shop_id", F.coalesce("bookings", F.lit(0)).alias("total_bookings"))
    )
