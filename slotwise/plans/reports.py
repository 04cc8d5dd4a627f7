"""Report, promotion and notification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, documents, outreach
from ..operators.durable import cut_lineage
from .registry import AS_OF, query

NOW = "TIMESTAMP '2001-07-15 12:00:00'"


@query("platform_overview", """
SELECT (SELECT COUNT(*) FROM users) AS total_users, (SELECT COUNT(*) FROM shops) AS total_shops,
  (SELECT COUNT(*) FROM reservations WHERE status IN ('requested','confirmed')) AS active_reservations""")
def _(t):
    return analytics.platform_overview(t)


@query("recent_activity", """
SELECT * FROM (SELECT 'user_registered' AS kind, id, name, created_at FROM users
  UNION ALL SELECT 'shop_application', id, shop_name, created_at FROM shop_applications) x ORDER BY created_at DESC, kind, id LIMIT 50""")
def _(t):
    return analytics.recent_activity(t)


@query("admin_user_search", """
SELECT id, name, email, phone_number, user_status FROM users
WHERE (LOWER(name) LIKE '%12%' OR LOWER(email) LIKE '%12%' OR phone_number LIKE '%12%') AND user_status='active'""")
def _(t):
    return analytics.admin_user_search(t["users"], "12", "active").select(
        "id", "name", "email", "phone_number", "user_status"
    )


@query("payment_list", """
SELECT payment_status, is_deposit, COUNT(*) AS payments, CAST(SUM(amount) AS BIGINT) AS amount, CAST(SUM(refund_amount) AS BIGINT) AS refunded,
  CAST(SUM(amount-refund_amount) AS BIGINT) AS net_amount FROM payments GROUP BY payment_status, is_deposit""")
def _(t):
    return analytics.payment_list(t["payments"])


@query("live_content", f"""
SELECT id, title, is_important, starts_at, ends_at, LENGTH(content) AS content_length FROM announcements WHERE is_active AND starts_at<={NOW}
  AND (ends_at IS NULL OR ends_at>={NOW}) AND (target_user_type IS NULL OR list_contains(target_user_type,'shop_owner'))""")
def _(t):
    return analytics.live_announcements(t["announcements"], "shop_owner", AS_OF).select(
        "id", "title", "is_important", "starts_at", "ends_at", F.length("content").cast("long").alias("content_length")
    )


@query("live_faqs", "SELECT id, category, question, answer, display_order FROM faqs WHERE is_active")
def _(t):
    return analytics.live_faqs(t["faqs"]).drop("is_active")


@query("unread_counts", """
SELECT user_id, notification_type, COUNT(*) AS unread FROM notifications WHERE status='unread' GROUP BY 1,2""")
def _(t):
    return analytics.unread_counts(t["notifications"])


@query("moderation_queue", """
SELECT reported_content_type, reported_content_id, reason, COUNT(*) AS reports, MIN(created_at) AS first_reported_at
FROM content_reports WHERE status='pending' GROUP BY 1,2,3""")
def _(t):
    return analytics.moderation_queue(t["content_reports"])


def _funnel_sql() -> str:
    parts, previous = [], None
    for i, step in enumerate(analytics.FUNNEL_STEPS):
        if previous is None:
            parts.append(f"s{i} AS (SELECT user_id, MIN(ts) AS at FROM app_events WHERE event_type='{step}' GROUP BY user_id)")
        else:
            parts.append(
                f"s{i} AS (SELECT e.user_id, MIN(e.ts) AS at FROM app_events e JOIN {previous} p ON p.user_id=e.user_id AND e.ts>=p.at "
                f"WHERE e.event_type='{step}' GROUP BY e.user_id)"
            )
        previous = f"s{i}"
    rows = " UNION ALL ".join(
        f"SELECT {i + 1} AS step_number, '{step}' AS step, (SELECT COUNT(*) FROM s{i}) AS users, (SELECT COUNT(*) FROM s{max(i - 1, 0)}) AS prev"
        for i, step in enumerate(analytics.FUNNEL_STEPS)
    )
    return (
        "WITH " + ", ".join(parts) + f" SELECT step_number, step, users, ROUND(CAST(users AS DOUBLE)/prev,4) AS from_previous, "
        f"ROUND(CAST(users AS DOUBLE)/(SELECT COUNT(*) FROM s0),4) AS from_first FROM ({rows}) x"
    )


@query("event_funnel", _funnel_sql())
def _(t):
    return analytics.event_funnel(t["app_events"])


_RETENTION = """
WITH act AS (SELECT DISTINCT user_id, CAST(DATE_TRUNC('month',created_at) AS DATE) AS m FROM reservations),
co AS (SELECT user_id, MIN(m) AS cohort FROM act GROUP BY user_id),
n AS (SELECT cohort, CAST((EXTRACT(year FROM m)-EXTRACT(year FROM cohort))*12+EXTRACT(month FROM m)-EXTRACT(month FROM cohort) AS INT) AS month_offset,
  COUNT(*) AS active_users FROM act JOIN co ON co.user_id=act.user_id GROUP BY 1,2)
SELECT n.cohort, n.month_offset, n.active_users, z.active_users AS cohort_size, ROUND(CAST(n.active_users AS DOUBLE)/z.active_users,4) AS retention_rate
FROM n JOIN n z ON z.cohort=n.cohort AND z.month_offset=0"""


@query("retention", _RETENTION)
def _(t):
    return analytics.retention(t["reservations"])


@query("feature_usage", """
SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users FROM app_events GROUP BY 1,2""")
def _(t):
    return analytics.feature_usage(t["app_events"])


# Sketches of few users are exact, which the samples' days and weeks stay below; tests hold larger ones to their error.
@query("feature_usage_approximate", """
SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users FROM app_events GROUP BY 1,2""")
def _(t):
    return analytics.usage_counts(analytics.usage_sketches(t["app_events"]))


@query("feature_usage_weekly", """
SELECT CAST(DATE_TRUNC('week',ts) AS DATE) AS day, event_type, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users FROM app_events GROUP BY 1,2""")
def _(t):
    return analytics.usage_counts(analytics.merged_usage(cut_lineage(analytics.usage_sketches(t["app_events"])), "week"))


@query("retention_from_sketches", _RETENTION)
def _(t):
    return analytics.retention_from_sketches(cut_lineage(analytics.booker_sketches(t["reservations"])))


@query("onboarding_success", """
SELECT CAST(DATE_TRUNC('month',created_at) AS DATE) AS month, main_category AS category, COUNT(*) AS applications,
  COUNT(CASE WHEN application_status='approved' THEN 1 END) AS approved, COUNT(CASE WHEN application_status='rejected' THEN 1 END) AS rejected,
  COUNT(CASE WHEN application_status='pending' THEN 1 END) AS pending,
  ROUND(CAST(COUNT(CASE WHEN application_status='approved' THEN 1 END) AS DOUBLE)/NULLIF(COUNT(CASE WHEN application_status IN ('approved','rejected') THEN 1 END),0),4) AS approval_rate
FROM shop_applications GROUP BY 1,2""")
def _(t):
    return analytics.onboarding_success(t["shop_applications"])


@query("error_report", """
SELECT CAST(created_at AS DATE) AS day, severity, category, COUNT(*) AS errors FROM error_logs GROUP BY 1,2,3""")
def _(t):
    return analytics.error_report(t["error_logs"])


@query("shop_total_bookings", """
SELECT s.id AS shop_id, COALESCE(r.n,0) AS total_bookings FROM shops s LEFT JOIN (SELECT shop_id, COUNT(*) AS n FROM reservations GROUP BY 1) r ON r.shop_id=s.id""")
def _(t):
    return analytics.shop_total_bookings(t)


@query("json_columns", """
SELECT event_id, event_type, CAST(json_extract_string(props,'$.k') AS INT) AS k, json_extract_string(props,'$.k') AS k_text FROM app_events""")
def _(t):
    return outreach.event_properties(t["app_events"])


# What the documents of the sample say, told from the numbers that they were written from.
@query("json_payments", """
SELECT id, CASE reservation_id%7 WHEN 0 THEN 'toss' WHEN 1 THEN 'kakao' WHEN 2 THEN 'naver' WHEN 3 THEN 'card' END AS provider,
  CASE reservation_id%7 WHEN 0 THEN 'visa' WHEN 1 THEN 'master' END AS card_brand, CASE reservation_id%7 WHEN 0 THEN 3 WHEN 1 THEN 6 END AS installments,
  CASE WHEN reservation_id%7=2 THEN amount//100 END AS points_used,
  CASE reservation_id%7 WHEN 0 THEN amount//100+30 WHEN 2 THEN amount//100 END AS fee_total, reservation_id%7<>4 AS readable FROM payments""")
def _(t):
    return documents.payment_details(t["payment_documents"])


@query("json_opening_hours", """
SELECT shop_id, day_of_week, is_open, CASE WHEN is_open THEN open_minute END AS open_minute, CASE WHEN is_open THEN close_minute END AS close_minute,
  CASE WHEN is_open AND shop_id%5<>0 THEN break_start_minute END AS break_start_minute,
  CASE WHEN is_open AND shop_id%5<>0 THEN break_end_minute END AS break_end_minute FROM shop_operating_hours WHERE shop_id%13<>12""")
def _(t):
    return documents.opening_hours(t["shop_documents"])


@query("json_app_configs", """
WITH c AS (SELECT CONCAT('config_',p_partkey) AS config_key, p_partkey AS k,
  CASE p_partkey%3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE 'all' END AS platform FROM part),
v AS (SELECT * FROM (VALUES (0,'version.latest','STRING','2.0'),(0,'flags.new_home','BOOLEAN','true'),(0,'flags.dark','OBJECT<>','{}'),(1,'limits.page','BIGINT','30'),
  (2,'limits.page','STRING','30'),(2,'banner','ARRAY<STRING>','["a","b"]'),(3,'maintenance','BOOLEAN','false'),(3,'note','VOID',NULL)) AS v(form,path,kind,value))
SELECT config_key, platform, path, kind, value FROM c JOIN v ON v.form=c.k%5
UNION ALL SELECT config_key, platform, 'version.min', 'STRING', CONCAT('1.',k%10) FROM c WHERE k%5=0
UNION ALL SELECT config_key, platform, 'limits.radius', 'BIGINT', CAST(k%50 AS VARCHAR) FROM c WHERE k%5=1""")
def _(t):
    return documents.leaves(t["app_configs"], "config_data", "config_key", "platform")


@query("json_payment_drift", """
SELECT path, kind, COUNT(*) AS documents FROM payments JOIN (VALUES (0,'provider','STRING'),(1,'provider','STRING'),(2,'provider','STRING'),(3,'provider','STRING'),
  (0,'card.brand','STRING'),(1,'card.brand','STRING'),(0,'card.installments','BIGINT'),(1,'card.installments','STRING'),(3,'card','VOID'),
  (0,'fees','ARRAY<BIGINT>'),(2,'fees','ARRAY<BIGINT>'),(2,'point.used','BIGINT'),(6,'','ARRAY<BIGINT>')) AS v(form,path,kind) ON form=reservation_id%7
GROUP BY path, kind""")
def _(t):
    return documents.field_kinds(t["payment_documents"], "metadata")


GOOD = "json_valid(conditions)"


def _json(column: str, key: str) -> str:
    return f"CASE WHEN json_valid({column}) THEN json_extract_string({column},'$.{key}') END"


@query("json_promotions", f"""
SELECT id, CAST({_json('conditions', 'min_amount')} AS BIGINT) AS min_amount, {_json('conditions', 'category')} AS only_category,
  CAST({_json('benefits', 'discount_rate')} AS BIGINT) AS discount_rate, {GOOD} AS readable FROM promotions""")
def _(t):
    return outreach.parsed_promotions(t["promotions"]).select(
        "id", "min_amount", "only_category", "discount_rate", "readable"
    )


@query("promotion_usage", """
SELECT p.id AS promotion_id, COALESCE(u.n,0) AS current_usage FROM promotions p LEFT JOIN (SELECT promotion_id, COUNT(*) AS n FROM promotion_usages GROUP BY 1) u ON u.promotion_id=p.id""")
def _(t):
    return outreach.promotion_usage(t)


@query("promotion_eligibility", f"""
WITH tot AS (SELECT promotion_id, COUNT(*) AS n FROM promotion_usages GROUP BY 1),
own AS (SELECT promotion_id, user_id, COUNT(*) AS n FROM promotion_usages GROUP BY 1,2),
x AS (SELECT c.claim_id, c.promotion_id, c.user_id, c.amount, CAST({_json('p.benefits', 'discount_rate')} AS BIGINT) AS rate, CASE
  WHEN p.id IS NULL THEN 'unknown' WHEN NOT (p.is_active AND p.starts_at<={NOW} AND p.ends_at>={NOW}) THEN 'not live'
  WHEN NOT json_valid(p.conditions) THEN 'unreadable conditions'
  WHEN c.amount<CAST({_json('p.conditions', 'min_amount')} AS BIGINT) THEN 'amount too small'
  WHEN c.category<>{_json('p.conditions', 'category')} THEN 'other category'
  END AS unfit, COALESCE(tot.n,0) AS used, COALESCE(own.n,0) AS own, p.usage_limit, p.usage_limit_per_user, c.claimed_at
  FROM promotion_claims c LEFT JOIN promotions p ON p.id=c.promotion_id LEFT JOIN tot ON tot.promotion_id=c.promotion_id
  LEFT JOIN own ON own.promotion_id=c.promotion_id AND own.user_id=c.user_id),
y AS (SELECT *, own+COUNT(*) FILTER (unfit IS NULL) OVER (PARTITION BY promotion_id, user_id ORDER BY claimed_at, claim_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)>usage_limit_per_user AS over FROM x),
z AS (SELECT *, CASE WHEN unfit IS NOT NULL THEN unfit WHEN over THEN 'used up by user'
  WHEN used+COUNT(*) FILTER (unfit IS NULL AND NOT over) OVER (PARTITION BY promotion_id ORDER BY claimed_at, claim_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)>usage_limit THEN 'used up' END AS reason FROM y)
SELECT claim_id, promotion_id, user_id, reason IS NULL AS eligible, reason,
  CASE WHEN reason IS NULL THEN CAST(FLOOR(amount*rate/100.0) AS BIGINT) END AS discount FROM z""")
def _(t):
    return outreach.promotion_eligibility(t, t["promotion_claims"], AS_OF)


@query("notification_targets", """
SELECT n.id, n.user_id, n.notification_type, k.token, k.platform FROM notifications n JOIN push_tokens k ON k.user_id=n.user_id AND k.is_active
JOIN user_settings s ON s.user_id=n.user_id AND s.push_notifications_enabled
WHERE CASE WHEN n.notification_type IN ('reservation_confirmed','reservation_cancelled') THEN s.reservation_notifications
  WHEN n.notification_type IN ('point_earned','referral_success') THEN s.event_notifications WHEN n.notification_type='promotion' THEN s.marketing_notifications ELSE TRUE END""")
def _(t):
    return outreach.notification_targets(t)


@query("owner_notification_targets", """
WITH ev AS (SELECT id AS event_id, shop_id, CASE status WHEN 'requested' THEN 'new' ELSE 'cancelled' END AS kind, reservation_minute AS minute
  FROM reservations WHERE status IN ('requested','cancelled_by_user'))
SELECT e.event_id, e.shop_id, s.owner_id, e.kind, CASE WHEN CASE WHEN n.notification_start_minute<=n.notification_end_minute
  THEN e.minute>=n.notification_start_minute AND e.minute<n.notification_end_minute
  ELSE e.minute>=n.notification_start_minute OR e.minute<n.notification_end_minute END THEN 'send' ELSE 'hold' END AS delivery
FROM ev e JOIN shop_notification_settings n ON n.shop_id=e.shop_id JOIN shops s ON s.id=e.shop_id
WHERE CASE e.kind WHEN 'new' THEN n.new_reservation_notification ELSE n.cancellation_notification END""")
def _(t):
    events = t["reservations"].filter(F.col("status").isin("requested", "cancelled_by_user")).select(
        F.col("id").alias("event_id"), "shop_id",
        F.when(F.col("status") == "requested", "new").otherwise("cancelled").alias("kind"),
        F.col("reservation_minute").alias("minute"),
    )
    return outreach.owner_notification_targets(t, events)
