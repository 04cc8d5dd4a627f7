"""Domain tables projected from the sample star schema (see FIXTURES.md).

Each projection is lazy and scans only the columns it needs. ``reservations`` groups line
items before it meets the orders, so one order with very many lines is spread over its
shops first. ``payments`` and ``point_transactions`` make their rows in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clock import plus_days, plus_hours
from . import seeds
from .store import Tables

_SAMPLE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _c(name: str) -> Column:
    return F.col(name)


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _pick(key: Column, *values) -> Column:
    """``values[key]``, the last one standing for every other key."""
    chain = None
    for i, value in enumerate(values[:-1]):
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(key == i, value) if chain is None else chain.when(key == i, value)
    last = values[-1] if isinstance(values[-1], Column) else F.lit(values[-1])
    return chain.otherwise(last)


def _day0(text: str, days: Column) -> Column:
    return plus_days(F.lit(text).cast("timestamp_ntz"), days.cast("int"))


def _whole(value: Column) -> Column:
    return F.floor(value).cast("long")


def _booking_key(order: Column, shop: Column) -> Column:
    """One number for an order and a shop: 36 bits and 27, which hold samples up to scale factor 10,000.
    Larger orders overflow, which is an error and no silent collision."""
    return order * 134217728 + shop


def _service_key(shop: Column, part: Column) -> Column:
    """One number for a shop and a part: 27 bits and 31."""
    return shop * 2147483648 + part


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def users(t: Tables) -> DataFrame:
    k = _c("c_custkey")
    points = F.greatest(_c("c_acctbal"), F.lit(0.0))
    return t["customer"].select(
        k.alias("id"),
        _c("c_name").alias("name"),
        _text("u", k, "@example.com").alias("email"),
        _text(
            "010-", F.lpad((k % 10000).cast("string"), 4, "0"), "-", F.lpad((k * 7 % 10000).cast("string"), 4, "0")
        ).alias("phone_number"),
        F.when(k == 0, "admin").when(k < _row_count(t["supplier"]), "shop_owner").otherwise("user").alias("user_role"),
        F.when(k % 20 == 19, "suspended").when(k % 20 == 18, "deleted").otherwise("active").alias("user_status"),
        F.when(_c("c_mktsegment") == "FURNITURE", "kakao")
        .when(_c("c_mktsegment") == "MACHINERY", "apple")
        .when(_c("c_mktsegment") == "BUILDING", "google")
        .otherwise("email")
        .alias("social_provider"),
        _text("R", k).alias("referral_code"),
        F.when((k != 0) & (k % 7 != 3), _text("R", F.floor(k / 100).cast("long"))).alias("referred_by_code"),
        (k % 97 == 5).alias("is_influencer"),
        _whole(points).alias("total_points"),
        _whole(points / 2).alias("available_points"),
        (k % 13).alias("total_referrals"),
        (37.43 + (k * 53 % 1000).cast("double") * 0.00027).alias("latitude"),
        (126.77 + (k * 71 % 1000).cast("double") * 0.00041).alias("longitude"),
        _day0("1999-01-01", k % 900).alias("created_at"),
    )


def user_settings(t: Tables) -> DataFrame:
    k = _c("c_custkey")
    return t["customer"].select(
        k.alias("user_id"),
        (k % 6 != 0).alias("push_notifications_enabled"),
        (k % 4 != 0).alias("reservation_notifications"),
        (k % 5 != 1).alias("event_notifications"),
        (k % 3 == 0).alias("marketing_notifications"),
    )


def push_tokens(t: Tables) -> DataFrame:
    k = _c("c_custkey")
    devices = F.when(k % 3 == 0, F.array(F.lit("ios"), F.lit("android"))).otherwise(F.array(F.lit("ios")))
    return t["customer"].select(k, F.explode(devices).alias("platform")).select(
        k.alias("user_id"),
        _text("tok-", k, "-", _c("platform")).alias("token"),
        _c("platform"),
        ((k % 5 != 0) | (_c("platform") == "android")).alias("is_active"),
    )


def shops(t: Tables) -> DataFrame:
    k = _c("s_suppkey")
    return t["supplier"].select(
        k.alias("id"),
        k.alias("owner_id"),
        _c("s_name").alias("name"),
        F.when(k % 3 == 0, "partnered").otherwise("non_partnered").alias("shop_type"),
        F.when(k % 10 == 9, "suspended").when(k % 10 == 8, "pending_approval").otherwise("active").alias("shop_status"),
        _pick(k % 4, "nail", "eyelash", "waxing", "eyebrow_tattoo").alias("main_category"),
        F.when(k % 3 == 0, F.array(F.lit("nail"), F.lit("waxing")))
        .when(k % 3 == 1, F.array(F.lit("eyelash")))
        .alias("sub_categories"),
        F.when(k % 3 == 0, _day0("1999-01-01", k * 13 % 900)).alias("partnership_started_at"),
        (k % 50).alias("total_bookings"),
        (37.43 + (k * 37 % 100).cast("double") * 0.0027).alias("latitude"),
        (126.77 + (k * 61 % 100).cast("double") * 0.0041).alias("longitude"),
        _day0("1998-01-01", k % 700).alias("created_at"),
    )


def shop_settlement_configs(t: Tables) -> DataFrame:
    k = _c("s_suppkey")
    return t["supplier"].filter(k % 4 != 3).select(
        k.alias("shop_id"),
        F.when(k % 2 == 0, F.lit("7.25")).cast("decimal(5,2)").alias("commission_rate"),
        _text("BANK", _c("s_nationkey")).alias("bank_name"),
        _text("ACC", k).alias("bank_account"),
        F.when(k % 11 != 5, _c("s_name")).alias("account_holder"),
    )


def shop_operating_hours(t: Tables) -> DataFrame:
    k, d = _c("s_suppkey"), _c("day_of_week")
    return t["supplier"].select(k, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_of_week")).select(
        k.alias("shop_id"),
        d,
        (d != k % 7).alias("is_open"),
        F.lit(540).alias("open_minute"),
        F.lit(1080).alias("close_minute"),
        F.when(k % 2 == 0, 720).alias("break_start_minute"),
        F.when(k % 2 == 0, 780).alias("break_end_minute"),
    )


def shop_notification_settings(t: Tables) -> DataFrame:
    k = _c("s_suppkey")
    return t["supplier"].select(
        k.alias("shop_id"),
        (k % 5 != 0).alias("new_reservation_notification"),
        (k % 7 != 0).alias("cancellation_notification"),
        (540 + (k % 4).cast("int") * 60).alias("notification_start_minute"),
        F.when(k % 6 == 0, 120).otherwise(1320).alias("notification_end_minute"),
    )


def shop_services(t: Tables) -> DataFrame:
    price = _whole(_c("p_retailprice"))
    offered = t["lineitem"].select("l_suppkey", "l_partkey").distinct()
    return offered.join(t["part"], _c("l_partkey") == _c("p_partkey")).select(
        _service_key(_c("l_suppkey"), _c("l_partkey")).alias("id"),
        _c("l_suppkey").alias("shop_id"),
        _c("p_name").alias("name"),
        part_category().alias("category"),
        (price * 50).alias("price_min"),
        (price * 80).alias("price_max"),
        (30 + _c("p_size") * 3).alias("duration_minutes"),
        F.when(_c("p_size") % 3 == 0, F.lit(20000)).alias("deposit_amount"),
        F.when(_c("p_size") % 3 == 1, F.lit("25.00")).cast("decimal(5,2)").alias("deposit_percentage"),
        F.lit(24).alias("cancellation_hours"),
    )


def part_category() -> Column:
    return (
        F.when(_c("p_type") == "ECONOMY", "nail")
        .when(_c("p_type") == "MEDIUM", "eyelash")
        .when(_c("p_type") == "PROMO", "waxing")
        .when(_c("p_type") == "STANDARD", "eyebrow_tattoo")
        .otherwise("hair")
    )


def reservations(t: Tables) -> DataFrame:
    # The one-letter flag is compared by code: a minimum of numbers can be hashed, one of texts
    # would be sorted.
    order, shop = _c("l_orderkey"), _c("l_suppkey")
    flag = F.char(_c("flag"))
    lines = t["lineitem"].groupBy(order, shop).agg(
        F.min("l_shipdate").alias("shipped"),
        F.min(F.ascii("l_returnflag")).alias("flag"),
        F.sum(5 * _whole(_c("l_extendedprice"))).alias("total_amount"),
    )
    state, shipped = _c("o_orderstatus"), _c("shipped")
    return lines.join(t["orders"], order == _c("o_orderkey")).select(
        _booking_key(order, shop).alias("id"),
        _c("o_custkey").alias("user_id"),
        shop.alias("shop_id"),
        shipped.cast("date").alias("reservation_date"),
        (540 + 30 * ((order * 7 + shop) % 18).cast("int")).alias("reservation_minute"),
        F.when(state == "F", "completed")
        .when(state == "O", F.when(flag == "N", "requested").otherwise("confirmed"))
        .otherwise(
            F.when(flag == "A", "cancelled_by_user").when(flag == "R", "cancelled_by_shop").otherwise("no_show")
        )
        .alias("status"),
        _c("total_amount"),
        F.when(order % 9 == 0, _text("note ", order)).alias("special_requests"),
        F.when(state == "F", plus_hours(shipped, F.lit(15))).alias("completed_at"),
        F.when(
            (state == "P") & (flag != "N"), plus_hours(shipped, -((order + shop) % 60).cast("int"))
        ).alias("cancelled_at"),
        _c("o_orderdate").alias("created_at"),
    )


def reservation_services(t: Tables) -> DataFrame:
    return t["lineitem"].select(
        _booking_key(_c("l_orderkey"), _c("l_suppkey")).alias("reservation_id"),
        _service_key(_c("l_suppkey"), _c("l_partkey")).alias("service_id"),
        _c("l_quantity").cast("int").alias("quantity"),
        (5 * _whole(_c("l_extendedprice"))).alias("total_price"),
    )


def payments(t: Tables) -> DataFrame:
    key, total, status = _c("r.id"), _c("r.total_amount"), _c("r.status")
    deposit = _whole(total * F.lit("0.3").cast("decimal(2,1)"))
    settled = key % 11 != 0
    first = F.struct(
        _text("D", key).alias("id"),
        F.lit(True).alias("is_deposit"),
        F.when(status == "cancelled_by_shop", "refunded").otherwise("deposit_paid").alias("payment_status"),
        deposit.alias("amount"),
        _c("r.created_at").alias("paid_at"),
        F.lit(False).alias("goodwill"),
    )
    second = F.struct(
        _text("B", key).alias("id"),
        F.lit(False).alias("is_deposit"),
        F.when(settled, "fully_paid").otherwise("pending").alias("payment_status"),
        (total - deposit).alias("amount"),
        F.when(settled, _c("r.completed_at")).alias("paid_at"),
        (settled & (key % 17 == 0)).alias("goodwill"),  # a small part given back long after the visit
    )
    parts = F.when(status == "completed", F.array(first, second)).otherwise(F.array(first))
    return (
        t["reservations"].alias("r")
        .filter(status != "requested")
        .select(
            key.alias("reservation_id"), _c("r.user_id"), _c("r.cancelled_at"), _c("r.created_at"), F.explode(parts).alias("p")
        )
        .select(
            _c("p.id"), "reservation_id", "user_id", _c("p.is_deposit"), _c("p.payment_status"),
            _pick(_c("reservation_id") % 5, "card", "kakao_pay", "naver_pay", "toss_payments", "bank_transfer").alias(
                "payment_method"
            ),
            _c("p.amount"), _c("p.paid_at"),
            F.when(_c("p.payment_status") == "refunded", _c("p.amount")).when(_c("p.goodwill"), 1000)
            .otherwise(F.lit(0)).cast("long").alias("refund_amount"),
            F.when(_c("p.payment_status") == "refunded", plus_days(F.coalesce(_c("cancelled_at"), _c("created_at")), F.lit(1)))
            .when(_c("p.goodwill"), plus_days(_c("p.paid_at"), F.lit(40))).alias("refunded_at"),
        )
    )


def point_transactions(t: Tables) -> DataFrame:
    done = _c("status") == "completed"
    none_time = F.lit(None).cast("timestamp_ntz")
    none_id = F.lit(None).cast("long")
    points = _whole(F.least(_c("total_amount"), F.lit(300000)) * F.lit("0.025").cast("decimal(4,3)"))
    earned = F.struct(
        _text("E", _c("id")).alias("id"), _c("user_id").alias("user_id"), _c("id").alias("reservation_id"),
        F.lit("earned_service").alias("transaction_type"), points.alias("amount"),
        F.when(_c("id") % 3 == 0, "pending").otherwise("available").alias("status"),
        plus_days(_c("completed_at"), F.lit(7)).alias("available_from"),
        plus_days(_c("completed_at"), F.lit(365)).alias("expires_at"),
        none_id.alias("related_user_id"), _c("completed_at").alias("created_at"),
    )
    used = F.struct(
        _text("U", _c("id")).alias("id"), _c("user_id").alias("user_id"), _c("id").alias("reservation_id"),
        F.lit("used_service").alias("transaction_type"), F.lit(-500).cast("long").alias("amount"),
        F.lit("available").alias("status"), none_time.alias("available_from"), none_time.alias("expires_at"),
        none_id.alias("related_user_id"), _c("created_at").alias("created_at"),
    )
    reward = F.struct(
        _text("F", _c("id")).alias("id"), _c("referrer_id").alias("user_id"), _c("id").alias("reservation_id"),
        F.lit("earned_referral").alias("transaction_type"), F.lit(150).cast("long").alias("amount"),
        F.lit("available").alias("status"), plus_days(_c("completed_at"), F.lit(7)).alias("available_from"),
        none_time.alias("expires_at"), _c("user_id").alias("related_user_id"),
        _c("completed_at").alias("created_at"),
    )
    people = t["users"]
    referrer = (
        people.select("id", "referred_by_code").filter(_c("referred_by_code").isNotNull())
        .join(people.select(_c("id").alias("referrer_id"), "referral_code"), _c("referred_by_code") == _c("referral_code"))
        .select(_c("id").alias("user_id"), "referrer_id")
    )
    rows = t["reservations"].filter(done | ((_c("status") == "confirmed") & (_c("id") % 5 == 0)))
    entries = (
        F.when(done & _c("referrer_id").isNotNull(), F.array(earned, reward))
        .when(done, F.array(earned))
        .otherwise(F.array(used))
    )
    return rows.join(referrer, "user_id", "left").select(F.inline(entries))


def shop_settlements(t: Tables) -> DataFrame:
    month = F.trunc(_c("completed_at").cast("date"), "month")
    sums = (
        t["reservations"].filter(_c("status") == "completed")
        .groupBy("shop_id", month.alias("period_start_date"))
        .agg(F.sum("total_amount").alias("gross_revenue"), F.count(F.lit(1)).alias("completed_bookings"))
    )
    gross, fee = _c("gross_revenue"), _whole(_c("gross_revenue") * F.lit("0.1").cast("decimal(2,1)"))
    return sums.select(
        _text(_c("shop_id"), "-", _c("period_start_date")).alias("id"),
        "shop_id",
        "period_start_date",
        F.last_day("period_start_date").alias("period_end_date"),
        "completed_bookings",
        gross,
        fee.alias("commission_amount"),
        (gross - fee).alias("net_settlement_amount"),
        F.when(gross % 3 == 0, "pending").otherwise("completed").alias("settlement_status"),
        F.when(gross % 3 == 1, plus_days(_c("period_start_date").cast("timestamp_ntz"), F.lit(40))).alias("settled_at"),
    )


def settlement_transfers(t: Tables) -> DataFrame:
    return t["shop_settlements"].filter(_c("settlement_status") == "completed").select(
        _c("id").alias("settlement_id"),
        _c("net_settlement_amount").alias("transfer_amount"),
        F.when(_c("settled_at").isNull(), "approved").otherwise("transfer_completed").alias("transfer_status"),
        plus_days(_c("period_start_date").cast("timestamp_ntz"), F.lit(35)).alias("approved_at"),
    )


def app_events(t: Tables) -> DataFrame:
    kind = _c("event_type")
    return t["events"].select(
        "event_id", "ts", "user_id",
        F.when(kind == "signup", "app_open")
        .when(kind == "click", "search_performed")
        .when(kind == "view", "shop_viewed")
        .when(kind == "error", "reservation_created")
        .otherwise("payment_completed")
        .alias("event_type"),
        "value", "props",
    )


def error_logs(t: Tables) -> DataFrame:
    k = _c("event_id")
    return t["events"].filter(_c("event_type") == "error").select(
        k.alias("id"),
        _c("ts").alias("created_at"),
        _pick(k % 4, "low", "medium", "high", "critical").alias("severity"),
        _pick(k % 6, "authentication", "payment", "validation", "network", "system", "business_logic").alias("category"),
    )


def user_favorites(t: Tables) -> DataFrame:
    return t["events"].filter(_c("event_type") == "click").select(
        "user_id",
        (_c("event_id") * 17 % _row_count(t["supplier"])).alias("shop_id"),
        _c("ts").alias("created_at"),
    )


def hours_changes(t: Tables) -> DataFrame:
    """Edits of opening hours, some for shops that have no hours yet."""
    k = _c("event_id")
    return t["events"].filter(_c("event_type") == "view").select(
        k.alias("seq"),
        (k * 7 % (_row_count(t["supplier"]) + 10)).alias("shop_id"),
        (k % 7).cast("int").alias("day_of_week"),
        (k % 3 != 0).alias("is_open"),
        (480 + (k % 5).cast("int") * 30).alias("open_minute"),
        (1020 + (k % 6).cast("int") * 30).alias("close_minute"),
        F.when(k % 2 == 0, 750).alias("break_start_minute"),
        F.when(k % 2 == 0, 810).alias("break_end_minute"),
    )


def shop_applications(t: Tables) -> DataFrame:
    k = _c("c_custkey")
    return t["customer"].select(
        k.alias("id"),
        k.alias("applicant_id"),
        _text("Shop ", _c("c_name")).alias("shop_name"),
        _pick(k % 4, "nail", "eyelash", "waxing", "eyebrow_tattoo").alias("main_category"),
        _text("addr ", k).alias("shop_address"),
        _day0("2001-01-01", k % 180).alias("created_at"),
        _pick(k % 3, "approved", "rejected", "pending").alias("application_status"),
    )


def promotions(t: Tables) -> DataFrame:
    k = _c("p_partkey")
    starts = _day0("2001-01-01", k % 300)
    return t["part"].select(
        k.alias("id"),
        _text("P", k).alias("promotion_code"),
        _c("p_name").alias("title"),
        F.when(
            k % 10 != 9, _text('{"min_amount":', _c("p_size") * 1000, ',"category":"', part_category(), '"}')
        ).otherwise(F.lit("{broken")).alias("conditions"),
        _text('{"discount_rate":', _c("p_size"), "}").alias("benefits"),
        F.when(k % 4 != 0, (3 + _c("p_size")).cast("long")).alias("usage_limit"),
        (1 + k % 2).alias("usage_limit_per_user"),
        starts.alias("starts_at"),
        plus_days(starts, 30 + _c("p_size") * 5).alias("ends_at"),
        (k % 7 != 0).alias("is_active"),
    )


def promotion_usages(t: Tables) -> DataFrame:
    return (
        t["lineitem"].filter(_c("l_linenumber") != 5).select("l_orderkey", "l_partkey", "l_shipdate")
        .join(t["orders"].select("o_orderkey", "o_custkey"), _c("l_orderkey") == _c("o_orderkey"))
        .select(_c("l_partkey").alias("promotion_id"), _c("o_custkey").alias("user_id"), _c("l_shipdate").alias("used_at"))
    )


def promotion_claims(t: Tables) -> DataFrame:
    """Fifth lines ask for what the other lines have used."""
    lines = t["lineitem"].filter(_c("l_linenumber") == 5).join(
        t["orders"].select("o_orderkey", "o_custkey"), _c("l_orderkey") == _c("o_orderkey")
    )
    return lines.select(
        _text(_c("l_orderkey"), "-", _c("l_partkey"), "-", _c("l_suppkey")).alias("claim_id"),
        _c("l_partkey").alias("promotion_id"),
        _c("o_custkey").alias("user_id"),
        _whole(_c("l_extendedprice")).alias("amount"),
        _pick(_c("l_suppkey") % 4, "nail", "eyelash", "waxing", "eyebrow_tattoo").alias("category"),
        _c("l_shipdate").alias("claimed_at"),
    )


def notifications(t: Tables) -> DataFrame:
    kind = (
        F.when(_c("status") == "confirmed", "reservation_confirmed")
        .when(_c("status") == "cancelled_by_shop", "reservation_cancelled")
        .when(_c("status") == "completed", _pick(_c("id") % 4, "point_earned", "referral_success", "system", None))
    )
    return t["reservations"].withColumn("kind", kind).filter(_c("kind").isNotNull()).select(
        _text("N", _c("id")).alias("id"),
        "user_id",
        _c("kind").alias("notification_type"),
        _pick(_c("id") % 3, "unread", "read", "deleted").alias("status"),
        _c("id").alias("related_id"),
        "created_at",
    )


def reviews(t: Tables) -> DataFrame:
    return t["reservations"].select(
        _text("V", _c("id")).alias("id"),
        _c("id").alias("reservation_id"),
        "user_id",
        "shop_id",
        (1 + _c("id") % 5).cast("int").alias("rating"),
        "created_at",
    )


def posts(t: Tables) -> DataFrame:
    k = _c("doc_id")
    return t["documents"].select(
        k.alias("id"),
        _c("text").alias("content"),
        _c("source").alias("region"),
        _c("lang").alias("language"),
        _pick(k % 8, "hidden", "reported", "deleted", "active").alias("status"),
        _day0("2001-01-01", k % 365).alias("created_at"),
    )


def content_reports(t: Tables) -> DataFrame:
    k = _c("doc_id")
    return t["labels"].select(
        k.alias("id"),
        (k % _row_count(t["customer"])).alias("reporter_id"),
        F.lit("post").alias("reported_content_type"),
        (k - k % 7).alias("reported_content_id"),
        F.when(_c("toxic") == 1, "harassment")
        .when(_c("quality") == 0, "spam")
        .when(k % 5 == 0, "copyright")
        .otherwise("other")
        .alias("reason"),
        _pick(k % 3, "pending", "approved", "rejected").alias("status"),
        _day0("2001-03-01", k % 100).alias("created_at"),
    )


def announcements(t: Tables) -> DataFrame:
    k = _c("doc_id")
    return t["documents"].select(
        k.alias("id"),
        _text("Notice ", k).alias("title"),
        _c("text").alias("content"),
        (k % 7 == 0).alias("is_important"),
        (k % 9 != 0).alias("is_active"),
        F.when(k % 3 == 0, F.array(F.lit("user")))
        .when(k % 3 == 1, F.array(F.lit("user"), F.lit("shop_owner")))
        .alias("target_user_type"),
        _day0("2001-01-01", k % 365).alias("starts_at"),
        F.when(k % 4 != 0, plus_days(_day0("2001-01-01", k % 365), F.lit(60))).alias("ends_at"),
    )


def faqs(t: Tables) -> DataFrame:
    """Each conversation that has an answer: its first turn asks, all later ones answer."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    talks = t["conversations"].groupBy("conv_id").agg(turns.alias("turns"))
    said = F.transform(F.filter("turns", lambda x: x["turn"] > 0), lambda x: x["text"])
    return talks.filter((_c("turns")[0]["turn"] == 0) & (F.size(said) > 0)).select(
        "conv_id", _c("turns")[0]["text"].alias("question"), F.array_join(said, "\n").alias("answer")
    ).select(
        _c("conv_id").alias("id"),
        _pick(_c("conv_id") % 3, "booking", "points", "account").alias("category"),
        "question", "answer",
        (_c("conv_id") % 20).cast("int").alias("display_order"),
        (_c("conv_id") % 6 != 0).alias("is_active"),
    )


def shop_images(t: Tables) -> DataFrame:
    k = _c("s_suppkey")
    return t["supplier"].select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("display_order")).select(
        _text(k, "-", _c("display_order")).alias("id"), k.alias("shop_id"), "display_order"
    )


def service_images(t: Tables) -> DataFrame:
    return t["shop_services"].select(
        _text("img-", _c("id")).alias("id"), _c("id").alias("service_id")
    )


def reservation_actions(t: Tables) -> DataFrame:
    return t["reservations"].filter(_c("status").isin("confirmed", "cancelled_by_shop")).select(
        _text("A", _c("id")).alias("id"), _c("id").alias("reservation_id"), _c("status").alias("action"),
        _c("shop_id").alias("performed_by"), F.lit("requested").alias("previous_status"),
        _c("status").alias("new_status"), "created_at",
    )


def category_settings(t: Tables) -> DataFrame:
    """One settings row per part: a settings table that grows with the data."""
    k = _c("p_partkey")
    return t["part"].select(
        _text("part_", k).alias("setting_key"),
        F.when(k % 11 == 7, F.lit("n/a"))
        .when(k % 4 == 0, _text(_whole(_c("p_retailprice")), ".50"))
        .when(k % 4 == 1, _c("p_name"))
        .when(k % 4 == 2, F.when(_c("p_size") % 2 == 0, "true").otherwise("false"))
        .otherwise(_text('{"size":', _c("p_size"), "}"))
        .alias("setting_value"),
        _pick(k % 4, "number", "string", "boolean", "json").alias("value_type"),
        _c("p_type").alias("category"),
        (k % 5 != 4).alias("is_active"),
        _day0("2001-01-01", k % 200).alias("updated_at"),
    )


def payment_documents(t: Tables) -> DataFrame:
    """Payments with metadata as providers send it: in several shapes, some broken, some absent."""
    k, fee = _c("reservation_id"), _whole(_c("amount") / 100)
    return t["payments"].select(
        "id", "reservation_id",
        _pick(
            k % 7,
            _text('{"provider":"toss","card":{"brand":"visa","installments":3},"fees":[', fee, ",30]}"),
            '{"provider":"kakao","card":{"brand":"master","installments":"6"}}',
            _text('{"provider":"naver","point":{"used":', fee, '},"fees":[', fee, "]}"),
            '{"provider":"card","card":null}', '{"provider":"toss","card":{', F.lit(None).cast("string"), "[1,2]",
        ).alias("metadata"),
    )


def shop_documents(t: Tables) -> DataFrame:
    """Shops with their opening hours as one document, in a newer and an older shape, some cut off."""
    k = _c("shop_id")
    clock = lambda c: F.date_format(F.timestamp_seconds(_c(c) * 60), "HH:mm")
    name = F.element_at(F.array(*[F.lit(d) for d in ("sun", "mon", "tue", "wed", "thu", "fri", "sat")]), _c("day_of_week") + 1)
    newer = F.when(
        _c("is_open"),
        _text('{"open":"', clock("open_minute"), '","close":"', clock("close_minute"), '"', F.when(
            _c("break_start_minute").isNotNull(),
            _text(',"break":["', clock("break_start_minute"), '","', clock("break_end_minute"), '"]'),
        ).otherwise(""), "}"),
    ).otherwise("null")
    older = F.when(_c("is_open"), _text('"', clock("open_minute"), "-", clock("close_minute"), '"')).otherwise('"closed"')
    days = t["shop_operating_hours"].select(k, _text('"', name, '":', F.when(k % 5 == 0, older).otherwise(newer)).alias("day"))
    whole = days.groupBy("shop_id").agg(_text("{", F.concat_ws(",", F.sort_array(F.collect_list("day"))), "}").alias("hours"))
    return whole.select(
        k.alias("id"), F.when(k % 13 == 12, F.left("hours", F.lit(20))).otherwise(_c("hours")).alias("operating_hours")
    )


def app_configs(t: Tables) -> DataFrame:
    k = _c("p_partkey")
    return t["part"].select(
        _text("config_", k).alias("config_key"), _pick(k % 3, "ios", "android", "all").alias("platform"),
        _pick(
            k % 5,
            _text('{"version":{"min":"1.', k % 10, '","latest":"2.0"},"flags":{"new_home":true,"dark":{}}}'),
            _text('{"limits":{"page":30,"radius":', k % 50, "}}"),
            '{"limits":{"page":"30"},"banner":["a","b"]}', '{"maintenance":false,"note":null}', '{"limits":',
        ).alias("config_data"),
    )


_DERIVED = (
    users, user_settings, push_tokens, shops, shop_settlement_configs, shop_operating_hours,
    shop_notification_settings, shop_services, reservations, reservation_services, payments,
    point_transactions, shop_settlements, settlement_transfers, app_events, error_logs, user_favorites,
    hours_changes, shop_applications, promotions, promotion_usages, promotion_claims, notifications,
    reviews, posts, content_reports, announcements, faqs, shop_images, service_images,
    reservation_actions, category_settings, payment_documents, shop_documents, app_configs,
)


def open_samples(spark: SparkSession, directory: str) -> Tables:
    builders = {n: (lambda _t, n=n: spark.read.parquet(f"{directory}/{n}.parquet")) for n in _SAMPLE_TABLES}
    builders.update({f.__name__: f for f in _DERIVED})
    builders["system_settings"] = lambda _t: seeds.settings(spark)
    builders["settlement_schedules"] = lambda _t: seeds.schedules(spark)
    tables = Tables(builders)
    tables.spark, tables.directory = spark, directory
    return tables
