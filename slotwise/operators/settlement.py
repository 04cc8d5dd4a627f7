"""Shop settlements: commission, per-period sums, batches, approval and transfer steps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import at, in_days, local_date
from ..functions.money import floor_percent_of
from .settings import commission_by_type
from .spread import first_valid

# Texts written into batches and logs, days from approval to payment.
BATCH_SUFFIX = {"weekly": " 주간정산", "monthly": " 월간정산"}
OTHER_BATCH_SUFFIX = " 정산"
REQUEST_NOTE = "송금 요청: "
COMPLETE_NOTE = ("송금 완료: ", " (수수료: ", "원)")
PAYOUT_DAYS = 3


def commission_rates(tables) -> DataFrame:
    """Type rate, individual override and the rate that applies, per shop."""
    own = tables["shop_settlement_configs"].select("shop_id", F.col("commission_rate").alias("override_rate"))
    typed = tables["shops"].select(
        F.col("id").alias("shop_id"),
        "shop_type",
        commission_by_type(F.col("shop_type"), tables["system_settings"]).alias("type_rate"),
    )
    return typed.join(own, "shop_id", "left").withColumn(
        "rate", F.coalesce("override_rate", "type_rate")
    )


def shop_settlement(
    tables, first: dt.date, last: dt.date, zone: str | None = None, active_only: bool = False
) -> DataFrame:
    """Per shop: gross, commission, net and count of bookings completed in ``[first, last]``.
    Shops without any have zeros.

    Sums per shop come first, so a busy shop is combined on the map side and meets its rate
    as one row. Commission is rounded down once, on the sum.
    """
    sums = (
        tables["reservations"]
        .filter((F.col("status") == "completed") & in_days(F.col("completed_at"), first, last, zone))
        .groupBy("shop_id")
        .agg(F.sum("total_amount").alias("gross_revenue"), F.count(F.lit(1)).alias("booking_count"))
    )
    rates = commission_rates(tables)
    if active_only:
        rates = rates.join(
            tables["shops"].filter(F.col("shop_status") == "active").select(F.col("id").alias("shop_id")),
            "shop_id",
        )
    fee = floor_percent_of(F.col("gross_revenue"), F.col("rate"))
    settled = rates.join(sums, "shop_id", "left").na.fill(0, ["gross_revenue", "booking_count"])
    return settled.select(
        "shop_id",
        "rate",
        "gross_revenue",
        fee.alias("commission_amount"),
        (F.col("gross_revenue") - fee).alias("net_settlement"),
        "booking_count",
    )


def batch_name(period: Column, first: Column, last: Column) -> Column:
    span = F.concat(first.cast("string"), F.lit(" ~ "), last.cast("string"))
    return (
        F.when(period == "weekly", F.concat(span, F.lit(BATCH_SUFFIX["weekly"])))
        .when(
            period == "monthly",
            F.concat(F.date_format(first, "yyyy'년' MM'월'"), F.lit(BATCH_SUFFIX["monthly"])),
        )
        .otherwise(F.concat(span, F.lit(OTHER_BATCH_SUFFIX)))
    )


def settlement_batch(
    tables, period: str, first: dt.date, last: dt.date, zone: str | None = None
) -> dict[str, DataFrame]:
    """A batch and the settlements of every active shop with completed bookings in it."""
    name = batch_name(F.lit(period), F.lit(first), F.lit(last))
    settlements = shop_settlement(tables, first, last, zone, active_only=True).filter("booking_count > 0").select(
        F.concat_ws("-", F.lit(period), F.lit(first).cast("string"), F.col("shop_id").cast("string")).alias(
            "settlement_id"
        ),
        name.alias("batch_name"),
        "shop_id",
        F.lit(first).alias("period_start_date"),
        F.lit(last).alias("period_end_date"),
        F.col("booking_count").alias("completed_bookings"),
        "gross_revenue",
        F.col("rate").alias("commission_rate"),
        "commission_amount",
        F.col("net_settlement").alias("net_settlement_amount"),
        F.lit("pending").alias("settlement_status"),
    )
    batch = batch_totals(settlements).select(
        name.alias("batch_name"),
        F.lit(period).alias("settlement_period"),
        F.lit(first).alias("period_start_date"),
        F.lit(last).alias("period_end_date"),
        "total_revenue",
        "total_commission",
        "total_settlement_amount",
        "shop_count",
        F.lit("pending").alias("status"),
    )
    return {"batch": batch, "settlements": settlements}


def batch_totals(settlements: DataFrame, *by: str) -> DataFrame:
    """Revenue, commission, net and shops summed over settlements."""
    def total(column: str, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long").alias(name)

    return settlements.groupBy(*by).agg(
        total("gross_revenue", "total_revenue"),
        total("commission_amount", "total_commission"),
        total("net_settlement_amount", "total_settlement_amount"),
        F.count(F.lit(1)).alias("shop_count"),
    )


def settlement_periods(schedules: DataFrame, as_of: Column) -> DataFrame:
    """The last finished period of each active schedule, seen from the day ``as_of``."""
    kind = F.col("settlement_period")

    def week_start(weeks: int) -> Column:
        return F.trunc(F.date_sub(as_of, 7 * weeks), "week")

    month = F.trunc(as_of, "month")
    start = (
        F.when(kind == "weekly", week_start(1))
        .when(kind == "bi_weekly", week_start(2))
        .when(kind == "monthly", F.add_months(month, -1))
    )
    end = (
        F.when(kind == "weekly", F.date_add(week_start(1), 6))
        .when(kind == "bi_weekly", F.date_add(week_start(2), 13))
        .when(kind == "monthly", F.date_sub(month, 1))
    )
    return schedules.filter("is_active").withColumn("period_start", start).withColumn("period_end", end)


def scheduled_settlements(tables, periods: DataFrame, minimum_amount: int | None = None) -> DataFrame:
    """The settlements of all due periods at once, one row per period and active shop with bookings.

    Periods: settlement_period, period_start, period_end, and optionally target_shop_type (NULL for
    all). Bookings are summed per shop and day before they meet the periods that their day is in, so
    overlapping periods cost rows of days and not of bookings. With ``minimum_amount``, smaller
    payouts are left for a later period.
    """
    wanted = periods if "target_shop_type" in periods.columns else periods.withColumn(
        "target_shop_type", F.lit(None).cast("string")
    )
    days = wanted.select("settlement_period", "period_start", "period_end", "target_shop_type").distinct().withColumn(
        "day", F.explode(F.sequence("period_start", "period_end"))
    )
    per_day = (
        tables["reservations"].filter(F.col("status") == "completed")
        .groupBy("shop_id", local_date(F.col("completed_at")).alias("day"))
        .agg(F.sum("total_amount").alias("gross"), F.count(F.lit(1)).alias("n"))
    )
    active = tables["shops"].filter(F.col("shop_status") == "active").select(F.col("id").alias("shop_id"))
    rates = commission_rates(tables).join(active, "shop_id", "left_semi")
    sums = (
        per_day.join(days, "day").groupBy("settlement_period", "period_start", "period_end", "target_shop_type", "shop_id")
        .agg(F.sum("gross").alias("gross_revenue"), F.sum("n").alias("completed_bookings"))
    )
    fee = floor_percent_of(F.col("gross_revenue"), F.col("rate"))
    settled = sums.join(rates, "shop_id").filter(
        F.col("target_shop_type").isNull() | (F.col("target_shop_type") == F.col("shop_type"))
    ).select(
        "settlement_period", F.col("period_start").alias("period_start_date"), F.col("period_end").alias("period_end_date"),
        "shop_id", "completed_bookings", "gross_revenue", F.col("rate").alias("commission_rate"),
        fee.alias("commission_amount"), (F.col("gross_revenue") - fee).alias("net_settlement_amount"),
    )
    return settled if minimum_amount is None else settled.filter(F.col("net_settlement_amount") >= minimum_amount)


def settlement_details(tables, first: dt.date, last: dt.date, zone: str | None = None) -> DataFrame:
    """One row per settled booking. Commission is rounded down per row, so its sum may be below
    the commission of the settlement."""
    done = (
        tables["reservations"]
        .filter((F.col("status") == "completed") & in_days(F.col("completed_at"), first, last, zone))
        .select(F.col("id").alias("reservation_id"), "shop_id", "total_amount", "completed_at")
    )
    method = (
        tables["payments"].filter("is_deposit")
        .groupBy("reservation_id")
        .agg(F.min("payment_method").alias("payment_method"))
    )
    active = tables["shops"].filter(F.col("shop_status") == "active").select(F.col("id").alias("shop_id"))
    rates = commission_rates(tables).join(active, "shop_id").select("shop_id", "rate")
    fee = floor_percent_of(F.col("total_amount"), F.col("rate"))
    return (
        done.join(rates, "shop_id")
        .join(method, "reservation_id", "left")
        .select(
            "reservation_id",
            "shop_id",
            F.col("total_amount").alias("service_amount"),
            F.col("rate").alias("commission_rate"),
            fee.alias("commission_amount"),
            (F.col("total_amount") - fee).alias("net_amount"),
            "payment_method",
            "completed_at",
        )
    )


def approve_settlements(tables, requests: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Approve pending settlements. Requests: request_id, settlement_id, admin_id, notes."""
    state = tables["shop_settlements"].select(
        F.col("id").alias("settlement_id"), "settlement_status", "net_settlement_amount"
    )
    judged = first_valid(
        requests.join(state, "settlement_id", "left"),
        F.col("settlement_status") == "pending",
        "settlement_id",
        "request_id",
    )
    accepted = judged.filter("accepted")
    return {
        "outcome": _outcome(judged, ["request_id", "settlement_id"], "no pending settlement"),
        "transfers": accepted.select(
            "settlement_id",
            F.lit("approved").alias("transfer_status"),
            F.col("admin_id").alias("approved_by"),
            at(as_of).alias("approved_at"),
            F.col("net_settlement_amount").alias("transfer_amount"),
            F.col("notes").alias("admin_notes"),
        ),
        "logs": _log(accepted, F.lit("approved"), F.col("admin_id"), F.col("notes"), as_of),
        "settlements": accepted.select(
            "settlement_id", F.lit("completed").alias("settlement_status"), at(as_of).alias("updated_at")
        ),
    }


def request_transfers(tables, requests: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Ask for payment of approved settlements. Requests: request_id, settlement_id, admin_id, method.

    A shop without bank details is rejected. A missing account holder gives a NULL note.
    """
    bank = tables["shop_settlement_configs"].select(
        "shop_id", "bank_name", "bank_account", "account_holder", F.lit(True).alias("has_bank")
    )
    state = (
        tables["settlement_transfers"].select("settlement_id", "transfer_status")
        .join(tables["shop_settlements"].select(F.col("id").alias("settlement_id"), "shop_id"), "settlement_id")
        .join(bank, "shop_id", "left")
    )
    judged = first_valid(
        requests.join(state, "settlement_id", "left"),
        (F.col("transfer_status") == "approved") & F.col("has_bank"),
        "settlement_id",
        "request_id",
    )
    accepted = judged.filter("accepted")
    note = F.concat(F.lit(REQUEST_NOTE), F.col("method"), F.lit(" - "), F.col("account_holder"))
    return {
        "outcome": _outcome(judged, ["request_id", "settlement_id"], "no approved transfer"),
        "transfers": accepted.select(
            "settlement_id",
            F.lit("transfer_requested").alias("transfer_status"),
            F.col("method").alias("transfer_method"),
            "bank_name",
            F.col("bank_account").alias("account_number"),
            "account_holder",
            at(as_of).alias("transfer_requested_at"),
        ),
        "logs": _log(accepted, F.lit("transfer_requested"), F.col("admin_id"), note, as_of),
    }


def complete_transfers(tables, requests: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Record finished payments of requested transfers.

    Requests: request_id, settlement_id, external_id, actual_amount, fee.
    """
    state = tables["settlement_transfers"].select("settlement_id", "transfer_status", "transfer_amount")
    judged = first_valid(
        requests.join(state, "settlement_id", "left"),
        F.col("transfer_status") == "transfer_requested",
        "settlement_id",
        "request_id",
    )
    accepted = judged.filter("accepted").withColumn("fee", F.coalesce("fee", F.lit(0)))
    note = F.concat(
        F.lit(COMPLETE_NOTE[0]), F.col("external_id"), F.lit(COMPLETE_NOTE[1]), F.col("fee").cast("string"),
        F.lit(COMPLETE_NOTE[2]),
    )
    return {
        "outcome": _outcome(judged, ["request_id", "settlement_id"], "no requested transfer"),
        "transfers": accepted.select(
            "settlement_id",
            F.lit("transfer_completed").alias("transfer_status"),
            F.col("external_id").alias("external_transfer_id"),
            F.coalesce("actual_amount", "transfer_amount").alias("transfer_amount"),
            F.col("fee").alias("transfer_fee"),
            at(as_of).alias("transfer_completed_at"),
        ),
        "settlements": accepted.select(
            "settlement_id", F.lit("completed").alias("settlement_status"), at(as_of).alias("settled_at")
        ),
        "logs": _log(accepted, F.lit("completed"), F.lit(None), note, as_of),
    }


def _outcome(judged: DataFrame, keep: list[str], reason: str) -> DataFrame:
    return judged.select(
        *keep,
        F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("outcome"),
        F.when(~F.col("accepted"), reason).alias("reject_reason"),
    )


def _log(accepted: DataFrame, action: Column, who: Column, notes: Column, as_of: dt.datetime) -> DataFrame:
    return accepted.select(
        "settlement_id",
        action.alias("action"),
        who.cast("string").alias("performed_by"),
        notes.alias("notes"),
        at(as_of).alias("created_at"),
    )


def settlement_status(tables, shops: DataFrame | None = None) -> DataFrame:
    """Settlements with the state of their payment, newest period first within a shop."""
    settlements = tables["shop_settlements"]
    if shops is not None:
        settlements = settlements.join(shops.select("shop_id"), "shop_id", "left_semi")
    transfers = tables["settlement_transfers"].select(
        F.col("settlement_id").alias("id"), "transfer_status", "approved_at"
    )
    return (
        settlements.join(transfers, "id", "left")
        .select(
            F.col("id").alias("settlement_id"),
            "shop_id",
            F.col("period_start_date").alias("period_start"),
            F.col("period_end_date").alias("period_end"),
            "gross_revenue",
            "commission_amount",
            F.col("net_settlement_amount").alias("net_settlement"),
            "settlement_status",
            F.coalesce("transfer_status", F.lit("not_started")).alias("transfer_status"),
            F.date_add(local_date(F.col("approved_at")), PAYOUT_DAYS).alias("expected_transfer_date"),
            F.col("settled_at").alias("completed_at"),
        )
        .orderBy("shop_id", F.desc("period_start"))
    )


def monthly_revenue(tables) -> DataFrame:
    """Gross, commission, refunds and payout per month of completion or refund, with subtotals
    per month and overall (``level`` is 1 for all types of a month and 3 for all months, so that a
    missing month in the data is no total). Commission keeps the applied rate, rounded down per
    shop and month."""
    per_shop = (
        tables["reservations"].filter(F.col("status") == "completed")
        .groupBy(F.trunc(local_date(F.col("completed_at")), "month").alias("month"), "shop_id")
        .agg(F.sum("total_amount").alias("gross"))
        .join(commission_rates(tables).select("shop_id", "shop_type", "rate"), "shop_id")
        .select(
            "month", "shop_type", "gross",
            floor_percent_of(F.col("gross"), F.col("rate")).alias("commission"),
            F.lit(0).cast("long").alias("refunds"),
        )
    )
    refunded = (
        tables["payments"].filter(F.col("refund_amount") > 0)
        .select("reservation_id", "refund_amount", "refunded_at")
        .join(tables["reservations"].select(F.col("id").alias("reservation_id"), "shop_id"), "reservation_id")
        .groupBy(F.trunc(local_date(F.col("refunded_at")), "month").alias("month"), "shop_id")
        .agg(F.sum("refund_amount").alias("refunds"))
        .join(tables["shops"].select(F.col("id").alias("shop_id"), "shop_type"), "shop_id")
        .select(
            "month", "shop_type", F.lit(0).cast("long").alias("gross"), F.lit(0).cast("long").alias("commission"),
            "refunds",
        )
    )
    return (
        per_shop.unionByName(refunded)
        .rollup("month", "shop_type")
        .agg(
            F.sum("gross").alias("gross"),
            F.sum("commission").alias("commission"),
            F.sum("refunds").alias("refunds"),
            F.sum(F.col("gross") - F.col("commission")).alias("payout_due"),
            F.grouping_id().cast("int").alias("level"),
        )
    )
