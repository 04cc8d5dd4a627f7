"""Streaming queries, run over the whole sample as a stream of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.durable import cut_lineage, shared_folder
from ..streaming import counters, streams
from .loyalty import COUNTERS
from .registry import AS_OF, query

NOW = "TIMESTAMP '2001-07-15 12:00:00'"


BATCHES = 3


def _as_stream(t, df: DataFrame, name: str, moment: str, turn: Column, job) -> str:
    """Run ``job(stream, folder)`` over ``df`` as files that arrive in BATCHES batches, by ``turn``."""
    folder = shared_folder(t.spark, name)
    dealt = cut_lineage(df.withColumn("turn", turn))
    for batch in range(BATCHES):
        dealt.filter(F.col("turn") == batch).drop("turn").write.mode("append").parquet(f"{folder}/in")
        job(streams.arriving(t.spark, f"{folder}/in", df.schema, moment), folder).awaitTermination()
    return folder


def _shuffled(*columns: str) -> Column:
    """Batches without regard to time, so that many rows come late."""
    return F.pmod(F.crc32(F.concat_ws(":", *[F.col(c).cast("string") for c in columns])), F.lit(BATCHES))


@query("stream_point_balances", f"""
SELECT user_id, CAST(COALESCE(SUM(CASE WHEN amount>0 AND status='available' THEN amount END),0) AS BIGINT) AS total_points,
  CAST(COALESCE(SUM(CASE WHEN status='available' AND (available_from IS NULL OR available_from<={NOW}) AND (expires_at IS NULL OR expires_at>{NOW})
    THEN amount END),0) AS BIGINT) AS available_points FROM point_transactions GROUP BY user_id""")
def _(t):
    ledger = t["point_transactions"].select(
        "id", "user_id", "amount", "status", "available_from", "expires_at", "created_at"
    )
    # Every seventh row is sent twice.
    sent = ledger.withColumn(
        "again", F.explode(F.when(F.crc32("id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    folder = _as_stream(
        t, sent, "ledger", "created_at", _shuffled("id", "again"),
        lambda stream, at: streams.point_balance_deltas(stream, f"{at}/out", f"{at}/state", closed=AS_OF),
    )
    return streams.point_balances_at(t.spark, f"{folder}/out", AS_OF)


@query("stream_event_counts", """
SELECT DATE_TRUNC('hour',ts) AS hour, event_type, COUNT(*) AS events, ROUND(SUM(value),2) AS value FROM app_events GROUP BY 1,2""")
def _(t):
    # The events are read as a stream straight from the sample file.
    raw = streams.arriving(t.spark, t.directory, t["events"].schema, "ts", "events.parquet")
    named = raw.withColumn(
        "event_type",
        F.when(F.col("event_type") == "signup", "app_open").when(F.col("event_type") == "click", "search_performed")
        .when(F.col("event_type") == "view", "shop_viewed").when(F.col("event_type") == "error", "reservation_created")
        .otherwise("payment_completed"),
    )
    folder = shared_folder(t.spark, "events")
    streams.event_counts(named, f"{folder}/out", f"{folder}/state").awaitTermination()
    return streams.event_counts_now(t.spark, f"{folder}/out").select(
        F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "events", F.round("value", 2).alias("value")
    )


def _changes(t) -> DataFrame:
    """Status changes of every booking; one in thirteen skips its confirmation."""
    status, skips = F.col("status"), F.col("id") % 13 == 0
    confirmed = status.isin("confirmed", "completed", "no_show", "cancelled_by_shop") & ~skips
    steps = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("seq"), F.lit("requested").alias("new_status")),
            F.when(confirmed, F.struct(F.lit(1).alias("seq"), F.lit("confirmed").alias("new_status"))),
            F.when(~status.isin("requested", "confirmed"), F.struct(F.lit(2).alias("seq"), status.alias("new_status"))),
        )
    )
    return t["reservations"].select("id", "created_at", F.explode(steps).alias("s")).select(
        F.col("id").alias("reservation_id"), "s.seq", "s.new_status",
        (F.col("created_at") + F.make_dt_interval(hours=F.col("s.seq"))).alias("changed_at"),
    )


@query("stream_status_log", """
WITH steps AS (
  SELECT id, 0 AS seq, '' AS previous_status, 'requested' AS new_status, created_at AS changed_at FROM reservations
  UNION ALL SELECT id, 1, 'requested', 'confirmed', created_at+INTERVAL '1' HOUR FROM reservations
    WHERE status IN ('confirmed','completed','no_show','cancelled_by_shop') AND id%13<>0
  UNION ALL SELECT id, 2, CASE WHEN status<>'cancelled_by_user' AND id%13<>0 THEN 'confirmed' ELSE 'requested' END, status, created_at+INTERVAL '2' HOUR
    FROM reservations WHERE status NOT IN ('requested','confirmed'))
SELECT id AS reservation_id, seq, previous_status, new_status,
  NOT (previous_status='requested' AND new_status IN ('completed','no_show')) AS accepted, changed_at FROM steps""")
def _(t):
    # A booking's changes come one batch after the other; states are carried between them.
    folder = _as_stream(
        t, _changes(t), "changes", "changed_at", F.col("seq"),
        lambda stream, at: streams.status_log(stream, f"{at}/out", f"{at}/state"),
    )
    return t.spark.read.parquet(f"{folder}/out/log").drop("batch").withColumn(
        "changed_at", F.col("changed_at").cast("timestamp_ntz")
    )


@query("stream_notifications", """
SELECT r.user_id, CASE r.status WHEN 'confirmed' THEN 'reservation_confirmed' ELSE 'reservation_cancelled' END AS notification_type,
  CASE r.status WHEN 'confirmed' THEN '예약이 확정되었습니다' ELSE '예약이 취소되었습니다' END AS title,
  CASE r.status WHEN 'confirmed' THEN '예약이 샵에서 승인되었습니다. 예약 시간에 방문해 주세요.' ELSE '샵 사정으로 예약이 취소되었습니다. 예약금은 환불됩니다.' END AS message,
  'unread' AS status, r.id AS related_id, r.created_at FROM reservations r
JOIN user_settings s ON s.user_id=r.user_id AND s.push_notifications_enabled AND s.reservation_notifications WHERE r.status IN ('confirmed','cancelled_by_shop')""")
def _(t):
    actions = t["reservations"].select(
        F.concat(F.lit("A"), F.col("id").cast("string")).alias("id"), F.col("id").alias("reservation_id"), "user_id",
        F.col("status").alias("action"), "created_at",
        F.explode(F.when(F.col("id") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    )
    folder = _as_stream(
        t, actions, "actions", "created_at", _shuffled("id", "again"),
        lambda stream, at: streams.booking_notifications(stream, t["user_settings"], f"{at}/out", f"{at}/state"),
    )
    return t.spark.read.parquet(f"{folder}/out").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def _history(df: DataFrame, key: Column, **wrong: Column) -> DataFrame:
    """``df`` as the end of a history of changes: some rows were wrong at first, some are gone, some changes come twice."""
    image = lambda k, sign, spoiled: F.struct(
        F.lit(k).alias("k"), F.lit(sign).alias("sign"), *[(wrong[c] if spoiled and c in wrong else F.col(c)).alias(c) for c in df.columns]
    )
    chance = F.crc32(key.cast("string"))
    images = F.array_compact(
        F.array(
            image(0, 1, False),
            *[F.when(chance % 5 == 0, image(1 + i, sign, True)) for i, sign in enumerate((1, -1))],
            *[F.when(chance % 7 == 0, image(3 + i, sign, spoiled)) for i, (sign, spoiled) in enumerate(((1, False), (-1, False)))],
        )
    )
    changes = df.select(key.cast("string").alias("name"), F.explode(images).alias("i")).select(
        F.concat_ws(":", "name", "i.k").alias("change_id"), "i.sign", *[F.col(f"i.{c}").alias(c) for c in df.columns]
    )
    return changes.withColumn(
        "again", F.explode(F.when(F.crc32("change_id") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("sent_at", F.lit(AS_OF).cast("timestamp_ntz"))


def _kept(t, changes: DataFrame, name: str, keep) -> str:
    folder = _as_stream(
        t, changes, name, "sent_at", _shuffled("change_id", "again"), lambda stream, at: keep(stream, f"{at}/out", f"{at}/state")
    )
    return f"{folder}/out"


@query("stream_point_counters", f"""
SELECT user_id, CAST(COALESCE(SUM(CASE WHEN amount>0 THEN amount END),0) AS BIGINT) AS total_earned,
  CAST(COALESCE(SUM(CASE WHEN amount<0 THEN -amount END),0) AS BIGINT) AS total_used,
  CAST(COALESCE(SUM(CASE WHEN status='available' AND (available_from IS NULL OR available_from<={NOW}) AND (expires_at IS NULL OR expires_at>{NOW})
    THEN amount END),0) AS BIGINT) AS available_balance,
  CAST(COALESCE(SUM(CASE WHEN status='pending' THEN amount END),0) AS BIGINT) AS pending_balance FROM point_transactions GROUP BY user_id""")
def _(t):
    ledger = t["point_transactions"].select("id", "user_id", "amount", "status", "available_from", "expires_at")
    changes = _history(ledger, F.col("id"), amount=F.col("amount") * 3 + 1, status=F.lit("pending"), user_id=F.col("user_id") + 1)
    return counters.kept_point_balances(t.spark, _kept(t, changes, "ledger", counters.keep_point_balances), AS_OF)


@query("stream_referral_counters", COUNTERS)
def _(t):
    came = t["users"].filter(F.col("referred_by_code").isNotNull()).select(F.col("id").alias("user_id"), F.col("referred_by_code").alias("code"))
    users = _history(came, F.concat(F.lit("U"), F.col("user_id")), code=F.reverse("code")).withColumn("paid", F.lit(False))
    done = t["payments"].select("id", "user_id", (F.col("payment_status") == "fully_paid").alias("paid"))
    payments = _history(done, F.col("id"), paid=~F.col("paid")).drop("id").withColumn("code", F.lit(None).cast("string"))
    target = _kept(t, users.unionByName(payments), "referrals", counters.keep_referrals)
    return counters.referrals_now(t.spark, target, t["users"])


@query("stream_shop_bookings", """
SELECT s.id AS shop_id, COALESCE(r.n,0) AS total_bookings FROM shops s LEFT JOIN (SELECT shop_id, COUNT(*) AS n FROM reservations GROUP BY 1) r ON r.shop_id=s.id""")
def _(t):
    changes = _history(t["reservations"].select("id", "shop_id"), F.col("id"), shop_id=F.col("shop_id") + 1)
    return counters.shop_bookings_now(t.spark, _kept(t, changes, "bookings", counters.keep_shop_bookings), t["shops"])


@query("stream_batch_totals", """
SELECT period_start_date, CAST(SUM(gross_revenue) AS BIGINT) AS total_revenue, CAST(SUM(commission_amount) AS BIGINT) AS total_commission,
  CAST(SUM(net_settlement_amount) AS BIGINT) AS total_settlement_amount, COUNT(*) AS shop_count
FROM shop_settlements GROUP BY period_start_date""")
def _(t):
    rows = t["shop_settlements"].select("id", "period_start_date", "gross_revenue", "commission_amount", "net_settlement_amount")
    changes = _history(
        rows, F.col("id"), period_start_date=F.date_add("period_start_date", 1), gross_revenue=F.col("gross_revenue") + 5
    )
    return counters.batch_totals_now(t.spark, _kept(t, changes, "totals", counters.keep_batch_totals))


@query("stream_promotion_uses", """
SELECT p.id AS promotion_id, COALESCE(u.n,0) AS current_usage FROM promotions p LEFT JOIN (SELECT promotion_id, COUNT(*) AS n FROM promotion_usages GROUP BY 1) u ON u.promotion_id=p.id""")
def _(t):
    # Usages have no key of their own; equal ones are told apart by their place among them.
    same = Window.partitionBy("promotion_id", "user_id", "used_at").orderBy(F.lit(1))
    rows = t["promotion_usages"].select("promotion_id", "user_id", "used_at").withColumn("place", F.row_number().over(same))
    key = F.concat_ws(":", "promotion_id", "user_id", "used_at", "place")
    changes = _history(rows, key, promotion_id=F.col("promotion_id") + 1).drop("user_id", "used_at", "place")
    return counters.promotion_uses_now(t.spark, _kept(t, changes, "uses", counters.keep_promotion_uses), t["promotions"])
