"""Visibility, data quality and change queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import changes, quality, visibility
from ..operators.durable import cut_lineage, shared_folder, written_once
from ..sources import model, store
from .registry import AS_OF, query

NOW = "TIMESTAMP '2001-07-15 12:00:00'"
_KEYS = visibility.ROW_KEYS


def _key(table: str, alias: str) -> str:
    return "CONCAT_WS('/'," + ",".join(f"CAST({alias}.{c} AS STRING)" for c in _KEYS.get(table, ("id",))) + ")"


def _row_sql(*shapes: str) -> str:
    parts = []
    for r in visibility.by_shape(*shapes):
        head = f"SELECT '{r.table}' AS table_name, '{r.command}' AS command, "
        if r.shape == "own":
            parts.append(f"{head}x.{r.column} AS principal_id, {_key(r.table, 'x')} AS row_id FROM {r.table} x")
        elif r.shape == "shop":
            parts.append(f"{head}s.owner_id AS principal_id, {_key(r.table, 'x')} AS row_id FROM {r.table} x JOIN shops s ON s.id=x.shop_id")
        elif r.shape == "parent_shop":
            parts.append(f"{head}s.owner_id AS principal_id, {_key(r.table, 'x')} AS row_id FROM {r.table} x JOIN {r.parent} p ON p.id=x.{r.column} JOIN shops s ON s.id=p.shop_id")
        else:
            parts.append(f"{head}p.user_id AS principal_id, {_key(r.table, 'x')} AS row_id FROM {r.table} x JOIN {r.parent} p ON p.id=x.{r.column}")
    return "\nUNION ALL ".join(parts)


@query("visible_own", _row_sql("own"))
def _(t):
    return visibility.row_grants(t, visibility.by_shape("own"))


@query("visible_owner1", _row_sql("shop"))
def _(t):
    return visibility.row_grants(t, visibility.by_shape("shop"))


@query("visible_owner2", _row_sql("parent_shop"))
def _(t):
    t = written_once(t, "reservations", "shop_services", "shop_settlements")
    return visibility.row_grants(t, visibility.by_shape("parent_shop"))


@query("visible_via_reservation", _row_sql("parent_user"))
def _(t):
    return visibility.row_grants(t, visibility.by_shape("parent_user"))


@query("visible_public", f"""
SELECT 'shops' AS table_name, CAST(id AS STRING) AS row_id FROM shops WHERE shop_status='active'
UNION ALL SELECT 'promotions', CAST(id AS STRING) FROM promotions WHERE is_active AND starts_at<={NOW} AND ends_at>={NOW}""")
def _(t):
    return visibility.public_rows(t, AS_OF)


# Tables of the sample that do not exist or do not grow.
_NOT_SAMPLED = ("settlement_schedules", "service_category_configs", "app_configs", "system_settings")


@query("visible_admin", "\nUNION ALL ".join(
    f"SELECT u.id AS principal_id, '{r.table}' AS table_name, '{r.command}' AS command, (SELECT COUNT(*) FROM {r.table}) AS visible_rows FROM users u WHERE u.user_role='admin'"
    for r in visibility.by_shape("admin") if r.table not in _NOT_SAMPLED
))
def _(t):
    return visibility.table_grants(t, skip=_NOT_SAMPLED)


@query("visible_reservations", """
SELECT principal_id, reservation_id, 'row' AS scope FROM (SELECT user_id AS principal_id, id AS reservation_id FROM reservations
  UNION SELECT s.owner_id, r.id FROM reservations r JOIN shops s ON s.id=r.shop_id) x
WHERE principal_id NOT IN (SELECT id FROM users WHERE user_role='admin')
UNION ALL SELECT id, NULL, 'table' FROM users WHERE user_role='admin'""")
def _(t):
    return visibility.visible_reservations(written_once(t, "reservations"))


@query("visible_reservations_admin_session", "SELECT id, user_id, shop_id, status FROM reservations")
def _(t):
    return visibility.rows_for(t, "reservations", "select", 0, AS_OF).select("id", "user_id", "shop_id", "status")


_CHECKED = ["users", "shops", "shop_services", "reservations", "payments", "point_transactions", "notifications", "content_reports", "shop_settlements"]


# What each checked column may hold, and what is documented for it but not declared. Written out here, apart
# from ``sources/model.py``, so that a value lost there is found.
_LISTED = {
    ("users", "user_status"): "active inactive suspended deleted",
    ("users", "user_role"): "user shop_owner admin influencer",
    ("users", "social_provider"): "kakao apple google email",
    ("shops", "shop_status"): "active inactive pending_approval suspended deleted",
    ("shops", "shop_type"): "partnered non_partnered",
    ("shops", "main_category"): "nail eyelash waxing eyebrow_tattoo hair",
    ("shop_services", "category"): "nail eyelash waxing eyebrow_tattoo hair",
    ("reservations", "status"): "requested confirmed completed cancelled_by_user cancelled_by_shop no_show",
    ("payments", "payment_status"): "pending deposit_paid fully_paid refunded partially_refunded failed",
    ("payments", "payment_method"): "toss_payments kakao_pay naver_pay card bank_transfer",
    ("point_transactions", "transaction_type"): "earned_service earned_referral used_service expired adjusted influencer_bonus",
    ("point_transactions", "status"): "pending available used expired",
    ("notifications", "notification_type"): "reservation_confirmed reservation_cancelled point_earned referral_success system",
    ("notifications", "status"): "unread read deleted",
    ("content_reports", "reason"): "spam inappropriate_content harassment other",
    ("shop_settlements", "settlement_status"): "pending processing completed failed cancelled",
}
_DOCUMENTED = {("notifications", "notification_type"): "payment_required promotion", ("content_reports", "reason"): "fake_review copyright"}


def _enum_sql() -> str:
    quoted = lambda words: ",".join(f"'{w}'" for w in words.split()) or "''"
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS value, {column} IN ({quoted(_DOCUMENTED.get((table, column), ''))}) AS drifted, "
        f"COUNT(*) AS rows FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN ({quoted(listed)}) GROUP BY {column}"
        for (table, column), listed in _LISTED.items()
    )


@query("enum_violations", _enum_sql())
def _(t):
    return quality.enum_violations(t, _CHECKED)


_KEYED = ["users", "shops", "user_favorites", "reservations", "shop_operating_hours"]


def _unique(table: str, *key: str) -> str:
    columns, present = ",".join(key), " AND ".join(f"{c} IS NOT NULL" for c in key)
    return (
        f"SELECT '{table}' AS table_name, 'unique' AS check_name, '{columns}' AS columns, CAST(COALESCE(SUM(n-1),0) AS BIGINT) AS violations "
        f"FROM (SELECT COUNT(*) AS n FROM {table} WHERE {present} GROUP BY {columns}) x WHERE n>1"
    )


def _missing(table: str, column: str) -> str:
    return f"SELECT '{table}', 'not_null', '{column}', COUNT(*) FROM {table} WHERE {column} IS NULL"


def _long(table: str, column: str, size: int) -> str:
    return f"SELECT '{table}', 'max_length', '{column}', COUNT(*) FROM {table} WHERE LENGTH({column})>{size}"


def _orphan(table: str, column: str, parent: str) -> str:
    return f"SELECT '{table}', 'reference', '{column}', COUNT(*) FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {parent})"


@query("key_violations", "\nUNION ALL ".join([
    _unique("users", "id"), _unique("users", "email"), _unique("users", "phone_number"), _unique("users", "referral_code"),
    _missing("users", "id"), _missing("users", "name"), _long("users", "email", 255), _long("users", "phone_number", 20),
    _long("users", "name", 100), _long("users", "referral_code", 20), _long("users", "referred_by_code", 20),
    _unique("shops", "id"), _missing("shops", "id"), _missing("shops", "name"), _missing("shops", "main_category"),
    _long("shops", "name", 255), _orphan("shops", "owner_id", "users"),
    _unique("user_favorites", "user_id", "shop_id"), _orphan("user_favorites", "user_id", "users"), _orphan("user_favorites", "shop_id", "shops"),
    _unique("reservations", "id"), _orphan("reservations", "user_id", "users"), _orphan("reservations", "shop_id", "shops"),
    *[_missing("reservations", c) for c in ("id", "user_id", "shop_id", "reservation_date", "reservation_minute", "total_amount")],
    _unique("shop_operating_hours", "shop_id", "day_of_week"), _orphan("shop_operating_hours", "shop_id", "shops"),
]))
def _(t):
    return quality.key_violations(t, _KEYED)


# The sampled tables with declared checks that the two queries above leave out.
_OTHER_KEYS = [
    "shop_services", "payments", "point_transactions", "shop_settlements", "settlement_transfers", "shop_settlement_configs",
    "reservation_services", "reservation_actions", "user_settings", "push_tokens", "notifications", "content_reports", "promotions",
    "shop_applications", "shop_notification_settings", "shop_images", "service_images", "system_settings", "app_configs",
]
_OTHER_ENUMS = ["shop_applications"]


@query("key_violations_other", "\nUNION ALL ".join([
    _unique("shop_services", "id"), *[_missing("shop_services", c) for c in ("id", "shop_id", "name", "category")], _unique("app_configs", "config_key"),
    _long("shop_services", "name", 255), _orphan("shop_services", "shop_id", "shops"),
    _unique("payments", "id"), *[_missing("payments", c) for c in ("id", "reservation_id", "user_id", "payment_method", "amount")],
    _orphan("payments", "reservation_id", "reservations"), _orphan("payments", "user_id", "users"),
    _unique("point_transactions", "id"), *[_missing("point_transactions", c) for c in ("id", "user_id", "transaction_type", "amount")],
    _orphan("point_transactions", "user_id", "users"), _orphan("point_transactions", "reservation_id", "reservations"),
    _orphan("point_transactions", "related_user_id", "users"),
    _unique("shop_settlements", "id"), *[_missing("shop_settlements", c) for c in ("id", "shop_id", "period_start_date")],
    _orphan("shop_settlements", "shop_id", "shops"),
    _unique("settlement_transfers", "settlement_id"), _orphan("settlement_transfers", "settlement_id", "shop_settlements"),
    _unique("shop_settlement_configs", "shop_id"), _orphan("shop_settlement_configs", "shop_id", "shops"),
    _orphan("reservation_services", "reservation_id", "reservations"), _orphan("reservation_services", "service_id", "shop_services"),
    _orphan("reservation_actions", "reservation_id", "reservations"),
    _unique("user_settings", "user_id"), _orphan("user_settings", "user_id", "users"),
    _unique("push_tokens", "user_id", "token"), _orphan("push_tokens", "user_id", "users"),
    _orphan("notifications", "user_id", "users"), _orphan("content_reports", "reporter_id", "users"),
    _unique("promotions", "id"), _unique("promotions", "promotion_code"),
    _unique("shop_applications", "id"), _orphan("shop_applications", "applicant_id", "users"),
    _unique("shop_notification_settings", "shop_id"), _orphan("shop_notification_settings", "shop_id", "shops"),
    _orphan("shop_images", "shop_id", "shops"), _orphan("service_images", "service_id", "shop_services"),
    _unique("system_settings", "setting_key"),
]))
def _(t):
    t = written_once(t, "reservations", "shop_services", "shop_settlements", "point_transactions")
    return quality.key_violations(t, _OTHER_KEYS)


@query("enum_violations_other", """
SELECT 'shop_applications' AS table_name, 'main_category' AS column_name, main_category AS value, FALSE AS drifted, COUNT(*) AS rows
FROM (SELECT CASE WHEN id%9=0 THEN 'tattoo' ELSE main_category END AS main_category FROM shop_applications) x WHERE main_category IS NOT NULL AND main_category NOT IN ({}) GROUP BY main_category""".format(
    ",".join(f"'{v}'" for v in model.DOMAINS["service_category"])
))
def _(t):
    # The sample has no value outside the domain, so some are planted.
    category = F.when(F.col("id") % 9 == 0, "tattoo").otherwise(F.col("main_category"))
    return quality.enum_violations({"shop_applications": t["shop_applications"].withColumn("main_category", category)}, _OTHER_ENUMS)


@query("pii_masked", """
SELECT id, CASE WHEN id%8 IN (0,1) THEN '***' WHEN id%8=2 THEN '김***' ELSE SUBSTR(name,1,1)||'***' END AS name,
  CASE WHEN id%8=3 THEN '***' ELSE '***-****-**'||LPAD(CAST((id*7)%100 AS STRING),2,'0') END AS phone_number,
  CASE WHEN id%8 IN (0,4) THEN '***' ELSE 'u***@example.com' END AS email FROM users""")
def _(t):
    # Names of one and of three characters, numbers without hyphens, foreign and broken, addresses that are none.
    kind = F.col("id") % 8
    people = t["users"].withColumns({
        "name": F.when(kind == 0, "이").when(kind == 1, "").when(kind == 2, "김민수").otherwise(F.col("name")),
        "phone_number": F.when(kind == 3, "1588").when(kind == 4, F.replace("phone_number", F.lit("-"), F.lit("")))
        .when(kind == 5, F.concat(F.lit("+82-"), F.substring("phone_number", 2, 20))).otherwise(F.col("phone_number")),
        "email": F.when(kind == 0, "nomail").when(kind == 4, "a@b@c").otherwise(F.col("email")),
    })
    return quality.pii_masked(people)


@query("phone_valid", """
SELECT id, phone_number, regexp_matches(phone_number,'^010-[0-9]{4}-[0-9]{4}$') AS valid FROM
  (SELECT id, CASE WHEN id%10=0 THEN REPLACE(phone_number,'-','') ELSE phone_number END AS phone_number FROM users) x""")
def _(t):
    people = t["users"].withColumn(
        "phone_number", F.when(F.col("id") % 10 == 0, F.replace("phone_number", F.lit("-"), F.lit(""))).otherwise(F.col("phone_number"))
    )
    return quality.phone_valid(people)


_LAST = """last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY shop_id, day_of_week ORDER BY seq DESC) AS k FROM hours_changes) x WHERE k=1)"""
_HOURS = ("is_open", "open_minute", "close_minute", "break_start_minute", "break_end_minute")


@query("upsert_hours", f"""
WITH {_LAST} SELECT COALESCE(l.shop_id,h.shop_id) AS shop_id, COALESCE(l.day_of_week,h.day_of_week) AS day_of_week,
  {', '.join(f'CASE WHEN l.seq IS NOT NULL THEN l.{c} ELSE h.{c} END AS {c}' for c in _HOURS)},
  CASE WHEN l.seq IS NOT NULL THEN {NOW} END AS updated_at
FROM shop_operating_hours h FULL JOIN last l ON l.shop_id=h.shop_id AND l.day_of_week=h.day_of_week""")
def _(t):
    return changes.upsert(t["shop_operating_hours"], t["hours_changes"], ["shop_id", "day_of_week"], "seq", AS_OF)


@query("touch_updated_at", f"""
WITH new AS (SELECT id, CASE WHEN id%4=0 THEN 'nail' ELSE main_category END AS main_category, CASE WHEN id%6=0 THEN 'active' ELSE shop_status END AS shop_status FROM shops)
SELECT s.id, n.main_category, n.shop_status, CASE WHEN n.main_category<>s.main_category OR n.shop_status<>s.shop_status THEN {NOW} ELSE s.created_at END AS updated_at
FROM shops s JOIN new n ON n.id=s.id""")
def _(t):
    base = t["shops"].select("id", "main_category", "shop_status", F.col("created_at").alias("updated_at"))
    edits = t["shops"].select(
        "id", F.when(F.col("id") % 4 == 0, "nail").otherwise(F.col("main_category")).alias("main_category"),
        F.when(F.col("id") % 6 == 0, "active").otherwise(F.col("shop_status")).alias("shop_status"), F.lit(1).alias("seq"),
    )
    return changes.upsert(base, edits, ["id"], "seq", AS_OF)


@query("insert_absent_hours", """
SELECT shop_id, day_of_week, open_minute FROM shop_operating_hours
UNION ALL SELECT shop_id, day_of_week, MIN(open_minute) FROM hours_changes c WHERE NOT EXISTS (SELECT 1 FROM shop_operating_hours h
  WHERE h.shop_id=c.shop_id AND h.day_of_week=c.day_of_week) GROUP BY shop_id, day_of_week""")
def _(t):
    columns = ["shop_id", "day_of_week", "open_minute"]
    return changes.insert_absent(
        t["shop_operating_hours"].select(*columns), t["hours_changes"].select(*columns), ["shop_id", "day_of_week"]
    )


@query("apply_defaults", """
SELECT user_id, push_notifications_enabled, COALESCE(CASE WHEN user_id%5<>0 THEN reservation_notifications END,TRUE) AS reservation_notifications,
  marketing_notifications, event_notifications, TRUE AS location_tracking_enabled, 'ko' AS language_preference,
  'KRW' AS currency_preference, 'light' AS theme_preference FROM user_settings""")
def _(t):
    some = t["user_settings"].withColumn(
        "reservation_notifications", F.when(F.col("user_id") % 5 != 0, F.col("reservation_notifications"))
    )
    return changes.apply_defaults(some, "user_settings")


@query("append_log", "SELECT id, reservation_id, action, performed_by, previous_status, new_status, created_at FROM reservation_actions")
def _(t):
    # Four batches, of which two come again, as after a failure; the first one half written at first.
    root, rows = shared_folder(t.spark, "log"), t["reservation_actions"]
    dealt = cut_lineage(rows.withColumn("batch", F.pmod(F.crc32("id"), F.lit(4))))
    for batch, share in ((0, 2), (0, 1), (1, 1), (2, 1), (1, 1), (3, 1)):
        part = dealt.filter((F.col("batch") == batch) & (F.pmod(F.xxhash64("id"), F.lit(share)) == 0))
        store.append_log(part, root, "reservation_actions", batch)
    number = lambda c: F.col(c).cast("long").alias(c)  # noqa: E731 - stored keys are texts
    return store.load(t.spark, root, "reservation_actions").select(
        "id", number("reservation_id"), "action", number("performed_by"), "previous_status", "new_status",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


# Rows that name an account: points by the friend they were earned with, actions by who did them. An account that asked
# to go is held where such a row belongs to somebody who did not ask, or who is held.
_ERASE = """WITH RECURSIVE asked AS (SELECT id FROM users WHERE user_status='deleted'),
links AS (SELECT DISTINCT user_id AS owner, related_user_id AS id FROM point_transactions WHERE related_user_id IS NOT NULL AND user_id<>related_user_id
  UNION SELECT r.user_id, a.performed_by FROM reservation_actions a JOIN reservations r ON r.id=a.reservation_id WHERE r.user_id<>a.performed_by),
held AS (SELECT l.id FROM links l JOIN asked ON asked.id=l.id WHERE l.owner NOT IN (SELECT id FROM asked)
  UNION SELECT l.id FROM held h JOIN links l ON l.owner=h.id JOIN asked ON asked.id=l.id),
erased AS (SELECT id FROM asked WHERE id NOT IN (SELECT id FROM held)) """


def _erase(t):
    t = written_once(t, "reservations")
    return changes.erase_users(t, t["users"].filter(F.col("user_status") == "deleted").select("id"))


@query("erase_users", _ERASE + "SELECT id, 'erased' AS outcome FROM erased UNION ALL SELECT id, 'blocked' FROM asked WHERE id NOT IN (SELECT id FROM erased)")
def _(t):
    result = _erase(t)
    return result["erased"].withColumn("outcome", F.lit("erased")).unionByName(
        result["blocked"].withColumn("outcome", F.lit("blocked"))
    )


@query("erase_users_ledger", _ERASE + """SELECT p.id, p.user_id, CASE WHEN r.user_id NOT IN (SELECT id FROM erased) THEN p.reservation_id END AS reservation_id
FROM point_transactions p LEFT JOIN reservations r ON r.id=p.reservation_id WHERE p.user_id NOT IN (SELECT id FROM erased)""")
def _(t):
    return _erase(t)["point_transactions"].select("id", "user_id", "reservation_id")


@query("erase_users_payments", _ERASE + """SELECT p.id, p.user_id, p.amount FROM payments p JOIN reservations r ON r.id=p.reservation_id
WHERE r.user_id NOT IN (SELECT id FROM erased) AND p.user_id NOT IN (SELECT id FROM erased)""")
def _(t):
    return _erase(t)["payments"].select("id", "user_id", "amount")


_GONE_BOOKINGS = "(SELECT id FROM reservations WHERE user_id IN (SELECT id FROM erased))"


@query("erase_users_counts", _ERASE + f"""
SELECT 'users' AS table_name, COUNT(*) AS rows_left FROM users WHERE id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'shops with an owner', COUNT(*) FROM shops WHERE owner_id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'reservations', COUNT(*) FROM reservations WHERE user_id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'reservation_services', COUNT(*) FROM reservation_services WHERE reservation_id NOT IN {_GONE_BOOKINGS}
UNION ALL SELECT 'reservation_actions', COUNT(*) FROM reservation_actions WHERE reservation_id NOT IN {_GONE_BOOKINGS}
UNION ALL SELECT 'payments', COUNT(*) FROM payments WHERE reservation_id NOT IN {_GONE_BOOKINGS} AND user_id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'point_transactions', COUNT(*) FROM point_transactions WHERE user_id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'user_settings', COUNT(*) FROM user_settings WHERE user_id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'user_favorites', COUNT(*) FROM user_favorites WHERE user_id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'notifications', COUNT(*) FROM notifications WHERE user_id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'push_tokens', COUNT(*) FROM push_tokens WHERE user_id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'content_reports', COUNT(*) FROM content_reports WHERE reporter_id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'shop_applications', COUNT(*) FROM shop_applications WHERE applicant_id NOT IN (SELECT id FROM erased)""")
def _(t):
    result = _erase(t)
    counts = []
    for name in sorted(set(result) - {"erased", "blocked"}):
        left = result[name].filter(F.col("owner_id").isNotNull()) if name == "shops" else result[name]
        label = "shops with an owner" if name == "shops" else name
        counts.append(left.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(label).alias("table_name"), "rows_left"))
    return reduce(DataFrame.unionByName, counts)
