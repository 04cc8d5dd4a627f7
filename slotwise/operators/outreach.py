"""Promotions and notifications: who may use what, who is told what."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import at
from .durable import cut_lineage
from .spread import first_come

# The switch of each kind of notice; kinds that are not named have only the one for all.
SWITCHES = {
    "reservation_confirmed": "reservation_notifications",
    "reservation_cancelled": "reservation_notifications",
    "point_earned": "event_notifications",
    "referral_success": "event_notifications",
    "promotion": "marketing_notifications",
}

CONDITIONS = "min_amount BIGINT, category STRING"
BENEFITS = "discount_rate BIGINT"


def parsed_promotions(promotions: DataFrame) -> DataFrame:
    """Conditions and benefits as columns; ``readable`` is false where the JSON is broken."""
    return (
        promotions.withColumn("c", F.from_json("conditions", CONDITIONS))
        .withColumn("b", F.from_json("benefits", BENEFITS))
        .withColumn(
            "readable", F.col("conditions").isNull() | F.try_parse_json("conditions").isNotNull()
        )
        .select(
            *[c for c in promotions.columns if c not in ("conditions", "benefits")],
            F.col("c.min_amount").alias("min_amount"), F.col("c.category").alias("only_category"),
            F.col("b.discount_rate").alias("discount_rate"), "readable",
        )
    )


def event_properties(events: DataFrame) -> DataFrame:
    """Events with their JSON properties as typed columns."""
    props = F.from_json("props", "k INT")
    return events.select("event_id", "event_type", props["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


def live(as_of: dt.datetime) -> Column:
    now = at(as_of)
    return F.col("is_active") & (F.col("starts_at") <= now) & (F.col("ends_at") >= now)


def promotion_usage(tables) -> DataFrame:
    """Rebuild the usage counter of every promotion."""
    used = tables["promotion_usages"].groupBy("promotion_id").agg(F.count(F.lit(1)).alias("used"))
    return (
        tables["promotions"].select(F.col("id").alias("promotion_id"))
        .join(used, "promotion_id", "left")
        .select("promotion_id", F.coalesce("used", F.lit(0)).alias("current_usage"))
    )


def promotion_eligibility(tables, claims: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Whether each claim may use its promotion, with the first reason against it.

    Claims: claim_id (unique), promotion_id, user_id, amount, category, claimed_at. Usage is counted
    before it is joined, per promotion and per promotion and user. Claims count against each other in
    order of (claimed_at, claim_id): those beyond what is left to their user go first, and of the others
    those beyond what is left of the promotion, which is what deciding one by one gives. Only claims of
    groups that ask for more than what is left are put in order.
    """
    offers = parsed_promotions(tables["promotions"]).select(
        F.col("id").alias("promotion_id"), live(as_of).alias("is_live"), "min_amount", "only_category", "readable",
        "usage_limit", "usage_limit_per_user", F.lit(True).alias("known"), "discount_rate",
    )
    usages = tables["promotion_usages"]
    total = usages.groupBy("promotion_id").agg(F.count(F.lit(1)).alias("used"))
    own = usages.groupBy("promotion_id", "user_id").agg(F.count(F.lit(1)).alias("used_by_user"))
    joined = (
        claims.join(offers.join(total, "promotion_id", "left"), "promotion_id", "left")
        .join(own, ["promotion_id", "user_id"], "left")
        .na.fill(0, ["used", "used_by_user"])
    )
    reason = (
        F.when(F.col("known").isNull(), "unknown")
        .when(~F.col("is_live"), "not live")
        .when(~F.col("readable"), "unreadable conditions")
        .when(F.col("amount") < F.col("min_amount"), "amount too small")
        .when(F.col("category") != F.col("only_category"), "other category")
    )
    # Groups under one name each, nulls told apart from texts; room that is null has no end.
    named = lambda *keys: F.concat_ws(":", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys])
    judged = cut_lineage(
        joined.select(
            "claim_id", "promotion_id", "user_id", "amount", "claimed_at", "discount_rate", reason.alias("unfit"),
            named("promotion_id", "user_id").alias("pair"), named("promotion_id").alias("offer"),
            (F.col("usage_limit_per_user") - F.col("used_by_user")).alias("own_room"),
            (F.col("usage_limit") - F.col("used")).alias("room"),
        )
    )
    fit = judged.filter(F.col("unfit").isNull())
    own_turns = cut_lineage(first_come(fit, "pair", "claimed_at", "claim_id", "own_room").withColumnRenamed("wins", "in_time"))
    within = F.col("own_room").isNull() | ((F.col("own_room") > 0) & F.coalesce("in_time", F.lit(True)))
    met = judged.join(own_turns, "claim_id", "left").withColumn("within", F.col("unfit").isNull() & within)
    turns = first_come(met.filter("within"), "offer", "claimed_at", "claim_id", "room")
    reason = (
        F.when(F.col("unfit").isNotNull(), F.col("unfit"))
        .when(~F.col("within"), "used up by user")
        .when((F.col("room") <= 0) | ~F.coalesce("wins", F.lit(True)), "used up")
    )
    return met.join(turns, "claim_id", "left").select(
        "claim_id", "promotion_id", "user_id", reason.isNull().alias("eligible"), reason.alias("reason"),
        F.when(reason.isNull(), F.floor(F.col("amount") * F.col("discount_rate") / 100).cast("long")).alias("discount"),
    )


def notification_targets(tables) -> DataFrame:
    """Active devices of users who want to hear about a kind of notice, per notification.

    Each kind has its own switch (``SWITCHES``) below the one for all; system notices have only that.
    """
    wants = tables["user_settings"].filter("push_notifications_enabled").select("user_id", *sorted(set(SWITCHES.values())))
    devices = tables["push_tokens"].filter("is_active").select("user_id", "token", "platform").join(wants, "user_id")
    kind = F.col("notification_type")
    wanted = reduce(
        lambda so_far, name: so_far.when(kind == name, F.col(SWITCHES[name])), SWITCHES, F.when(F.lit(False), F.lit(False))
    ).otherwise(F.lit(True))
    return (
        tables["notifications"].select("id", "user_id", "notification_type").join(devices, "user_id").filter(wanted)
        .select("id", "user_id", "notification_type", "token", "platform")
    )


def owner_notification_targets(tables, events: DataFrame) -> DataFrame:
    """Owners to tell about new and cancelled bookings, held back outside their hours.

    Events: event_id, shop_id, kind ('new' or 'cancelled'), minute of day. Hours that end before
    they start run over midnight.
    """
    wishes = tables["shop_notification_settings"].join(
        tables["shops"].select(F.col("id").alias("shop_id"), "owner_id"), "shop_id"
    )
    wanted = F.when(F.col("kind") == "new", F.col("new_reservation_notification")).otherwise(
        F.col("cancellation_notification")
    )
    start, end, minute = F.col("notification_start_minute"), F.col("notification_end_minute"), F.col("minute")
    inside = F.when(start <= end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))
    return events.join(wishes, "shop_id").filter(wanted).select(
        "event_id", "shop_id", "owner_id", "kind",
        F.when(inside, "send").otherwise("hold").alias("delivery"),
    )
