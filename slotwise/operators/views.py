"""Standing views for users, shop owners and administrators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import at, midnight, month_start, next_month_start, previous_month_start, slot_time
from ..functions.money import percent_of
from .settings import commission_by_type
from .spread import first_per_key

# Day names from Sunday (0) to Saturday (6).
DAY_NAMES = ("일요일", "월요일", "화요일", "수요일", "목요일", "금요일", "토요일")


def _count_where(condition: Column) -> Column:
    return F.count_if(condition)


def _sum_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("total_amount"))), F.lit(0)).cast("long")


def shop_performance_summary(tables, as_of: dt.datetime) -> DataFrame:
    """Every shop with bookings made this month and revenue of all time."""
    start = at(midnight(month_start(as_of)))
    recent = F.col("status").isin("confirmed", "completed") & (F.col("created_at") >= start)
    done = F.col("status") == "completed"
    sums = (
        tables["reservations"].filter(recent | done)
        .groupBy("shop_id")
        .agg(_count_where(recent).alias("bookings_this_month"), _sum_where(done).alias("total_revenue"))
    )
    shops = tables["shops"].select(
        F.col("id").alias("shop_id"), "name", "shop_status", "shop_type", "total_bookings"
    )
    return shops.join(sums, "shop_id", "left").na.fill(0, ["bookings_this_month", "total_revenue"])


def admin_users_summary(tables) -> DataFrame:
    return tables["users"].select(
        "id", "name", "email", "phone_number", "user_status", "user_role", "is_influencer", "total_points",
        "total_referrals", "created_at",
    ).orderBy(F.desc("created_at"), "id")


def admin_shops_summary(tables) -> DataFrame:
    owner = tables["users"].select(
        F.col("id").alias("owner_id"), F.col("name").alias("owner_name"), F.col("email").alias("owner_email")
    )
    return (
        tables["shops"].join(owner, "owner_id", "left")
        .select(
            "id", "name", "shop_status", "shop_type", "main_category", "total_bookings", "owner_name",
            "owner_email", "created_at",
        )
        .orderBy(F.desc("created_at"), "id")
    )


def admin_reservations_summary(tables) -> DataFrame:
    people = tables["users"].select(
        F.col("id").alias("user_id"), F.col("name").alias("customer_name"),
        F.col("phone_number").alias("customer_phone"),
    )
    shops = tables["shops"].select(F.col("id").alias("shop_id"), F.col("name").alias("shop_name"))
    return (
        tables["reservations"].join(people, "user_id").join(shops, "shop_id")
        .select(
            "id", "reservation_date", "reservation_minute", "status", "total_amount", "customer_name",
            "customer_phone", "shop_name", "created_at",
        )
        # The key spreads a busy day over several sort ranges.
        .orderBy(F.desc("reservation_date"), F.desc("reservation_minute"), "id")
    )


def shop_owner_dashboard(tables, as_of: dt.datetime) -> DataFrame:
    """Month, previous month, all-time and waiting figures of every shop in one scan of the
    bookings, with the latest finished settlement.

    Commission is the type rate on this month's sum, not rounded. A finished settlement that is
    not paid yet (no date) counts as the latest.
    """
    day = F.col("reservation_date")
    this_month = (day >= F.lit(month_start(as_of))) & (day < F.lit(next_month_start(as_of)))
    last_month = (day >= F.lit(previous_month_start(as_of))) & (day < F.lit(month_start(as_of)))
    done = F.col("status") == "completed"
    sums = tables["reservations"].groupBy("shop_id").agg(
        _count_where(this_month).alias("this_month_bookings"),
        _count_where(this_month & done).alias("this_month_completed"),
        _sum_where(this_month & done).alias("this_month_revenue"),
        _count_where(last_month).alias("last_month_bookings"),
        _sum_where(last_month & done).alias("last_month_revenue"),
        F.count(F.lit(1)).alias("total_bookings"),
        _sum_where(done).alias("total_revenue"),
        _count_where(F.col("status") == "requested").alias("pending_reservations"),
    )
    latest = first_per_key(
        tables["shop_settlements"].filter(F.col("settlement_status") == "completed")
        .select("shop_id", "id", "net_settlement_amount", "settled_at"),
        ["shop_id"],
        [F.desc_nulls_first("settled_at"), F.col("id")],
    ).select(
        "shop_id",
        F.col("net_settlement_amount").alias("last_settlement_amount"),
        F.col("settled_at").alias("last_settlement_date"),
    )
    figures = [c for c in sums.columns if c != "shop_id"]
    rate = commission_by_type(F.col("shop_type"), tables["system_settings"])
    return (
        tables["shops"].select(F.col("id").alias("shop_id"), F.col("name").alias("shop_name"), "owner_id", "shop_type")
        .join(sums, "shop_id", "left")
        .join(latest, "shop_id", "left")
        .na.fill(0, figures)
        .withColumn("this_month_commission", percent_of(F.col("this_month_revenue"), rate))
        .drop("shop_type")
    )


def shop_today_reservations(tables, as_of: dt.datetime) -> DataFrame:
    """Bookings of the day with customer, shop and service names; none without a service."""
    today = tables["reservations"].filter(F.col("reservation_date") == F.lit(as_of.date())).select(
        "id", "user_id", "shop_id", "reservation_minute", "status", "total_amount", "special_requests"
    )
    names = (
        tables["reservation_services"].select(F.col("reservation_id").alias("id"), "service_id")
        .join(today.select("id"), "id", "left_semi")
        .join(tables["shop_services"].select(F.col("id").alias("service_id"), "name"), "service_id")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("name")).alias("service_names"))
    )
    people = tables["users"].select(
        F.col("id").alias("user_id"), F.col("name").alias("customer_name"),
        F.col("phone_number").alias("customer_phone"),
    )
    shops = tables["shops"].select(F.col("id").alias("shop_id"), "owner_id")
    return (
        today.join(names, "id").join(people, "user_id").join(shops, "shop_id")
        .select(
            "id", "reservation_minute", "status", "total_amount", "special_requests", "customer_name",
            "customer_phone", "shop_id", "owner_id", "service_names",
        )
        .orderBy("reservation_minute", "id")
    )


def shop_weekly_hours(tables) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), F.col("day_of_week") + 1)
    return (
        tables["shop_operating_hours"]
        .select(
            "shop_id", "day_of_week",
            F.when(F.col("day_of_week").between(0, 6), name).alias("day_name"),
            "is_open", "open_minute", "close_minute", "break_start_minute", "break_end_minute",
        )
        .orderBy("shop_id", "day_of_week")
    )


def owner_day_list(tables, as_of: dt.datetime) -> DataFrame:
    """Open bookings of each shop from the start of the day on, nearest first."""
    people = tables["users"].select(F.col("id").alias("user_id"), F.col("name").alias("customer_name"))
    shops = tables["shops"].select(F.col("id").alias("shop_id"), "owner_id")
    starts = slot_time(F.col("reservation_date"), F.col("reservation_minute"))
    return (
        tables["reservations"]
        .filter(
            (F.col("reservation_date") >= F.lit(as_of.date())) & F.col("status").isin("requested", "confirmed")
        )
        .join(people, "user_id")
        .join(shops, "shop_id")
        .select(
            "id", "shop_id", "owner_id", "customer_name", "status", "total_amount", starts.alias("starts_at"),
            F.when(F.col("reservation_date") == F.lit(as_of.date()), "today").otherwise("upcoming").alias("section"),
        )
        .orderBy("shop_id", "starts_at", "id")
    )
