"""SQL text of the sample projections, used as CTEs by the SQL twin of a query.

Written apart from ``sources/samples.py`` so that the two can be checked against each other.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "users": """
SELECT c_custkey AS id, c_name AS name, CONCAT('u',CAST(c_custkey AS STRING),'@example.com') AS email,
  CONCAT('010-',LPAD(CAST(c_custkey%10000 AS STRING),4,'0'),'-',LPAD(CAST((c_custkey*7)%10000 AS STRING),4,'0')) AS phone_number,
  CASE WHEN c_custkey=0 THEN 'admin' WHEN c_custkey<(SELECT COUNT(*) FROM supplier) THEN 'shop_owner' ELSE 'user' END AS user_role,
  CASE c_custkey%20 WHEN 19 THEN 'suspended' WHEN 18 THEN 'deleted' ELSE 'active' END AS user_status,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'kakao' WHEN 'MACHINERY' THEN 'apple' WHEN 'BUILDING' THEN 'google' ELSE 'email' END AS social_provider,
  CONCAT('R',CAST(c_custkey AS STRING)) AS referral_code,
  CASE WHEN c_custkey=0 OR c_custkey%7=3 THEN NULL ELSE CONCAT('R',CAST(CAST(FLOOR(c_custkey/100.0) AS BIGINT) AS STRING)) END AS referred_by_code,
  c_custkey%97=5 AS is_influencer, CAST(FLOOR(GREATEST(c_acctbal,0)) AS BIGINT) AS total_points,
  CAST(FLOOR(GREATEST(c_acctbal,0)/2) AS BIGINT) AS available_points, c_custkey%13 AS total_referrals,
  37.43+CAST((c_custkey*53)%1000 AS DOUBLE)*0.00027 AS latitude, 126.77+CAST((c_custkey*71)%1000 AS DOUBLE)*0.00041 AS longitude,
  TIMESTAMP '1999-01-01 00:00:00'+INTERVAL '1' DAY*CAST(c_custkey%900 AS INT) AS created_at
FROM customer""",
    "user_settings": """
SELECT c_custkey AS user_id, c_custkey%6<>0 AS push_notifications_enabled, c_custkey%4<>0 AS reservation_notifications,
  c_custkey%5<>1 AS event_notifications, c_custkey%3=0 AS marketing_notifications FROM customer""",
    "push_tokens": """
SELECT c_custkey AS user_id, CONCAT('tok-',CAST(c_custkey AS STRING),'-ios') AS token, 'ios' AS platform, c_custkey%5<>0 AS is_active FROM customer
UNION ALL SELECT c_custkey, CONCAT('tok-',CAST(c_custkey AS STRING),'-android'), 'android', TRUE FROM customer WHERE c_custkey%3=0""",
    "shops": """
SELECT s_suppkey AS id, s_suppkey AS owner_id, s_name AS name,
  CASE WHEN s_suppkey%3=0 THEN 'partnered' ELSE 'non_partnered' END AS shop_type,
  CASE s_suppkey%10 WHEN 9 THEN 'suspended' WHEN 8 THEN 'pending_approval' ELSE 'active' END AS shop_status,
  CASE s_suppkey%4 WHEN 0 THEN 'nail' WHEN 1 THEN 'eyelash' WHEN 2 THEN 'waxing' ELSE 'eyebrow_tattoo' END AS main_category,
  CASE s_suppkey%3 WHEN 0 THEN ['nail','waxing'] WHEN 1 THEN ['eyelash'] END AS sub_categories,
  CASE WHEN s_suppkey%3=0 THEN TIMESTAMP '1999-01-01 00:00:00'+INTERVAL '1' DAY*CAST((s_suppkey*13)%900 AS INT) END AS partnership_started_at,
  s_suppkey%50 AS total_bookings,
  37.43+CAST((s_suppkey*37)%100 AS DOUBLE)*0.0027 AS latitude, 126.77+CAST((s_suppkey*61)%100 AS DOUBLE)*0.0041 AS longitude,
  TIMESTAMP '1998-01-01 00:00:00'+INTERVAL '1' DAY*CAST(s_suppkey%700 AS INT) AS created_at
FROM supplier""",
    "shop_settlement_configs": """
SELECT s_suppkey AS shop_id, CAST(CASE WHEN s_suppkey%2=0 THEN 7.25 END AS DECIMAL(5,2)) AS commission_rate,
  CONCAT('BANK',CAST(s_nationkey AS STRING)) AS bank_name, CONCAT('ACC',CAST(s_suppkey AS STRING)) AS bank_account,
  CASE WHEN s_suppkey%11<>5 THEN s_name END AS account_holder FROM supplier WHERE s_suppkey%4<>3""",
    "shop_operating_hours": """
SELECT s_suppkey AS shop_id, d AS day_of_week, d<>s_suppkey%7 AS is_open, 540 AS open_minute, 1080 AS close_minute,
  CASE WHEN s_suppkey%2=0 THEN 720 END AS break_start_minute, CASE WHEN s_suppkey%2=0 THEN 780 END AS break_end_minute
FROM supplier CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6)) AS t(d)""",
    "shop_notification_settings": """
SELECT s_suppkey AS shop_id, s_suppkey%5<>0 AS new_reservation_notification, s_suppkey%7<>0 AS cancellation_notification,
  540+60*CAST(s_suppkey%4 AS INT) AS notification_start_minute,
  CASE WHEN s_suppkey%6=0 THEN 120 ELSE 1320 END AS notification_end_minute FROM supplier""",
    "system_settings": """
SELECT * FROM (VALUES ('partnered_commission_rate','8.00','number','commission',TRUE),
  ('non_partnered_commission_rate','10.00','number','commission',TRUE),('point_earning_rate','2.5','number','point',TRUE),
  ('point_max_eligible_amount','300000','number','point',TRUE),('point_restriction_days','7','number','point',TRUE),
  ('influencer_point_bonus_rate','1.5','number','point',TRUE),('default_cancellation_hours','24','number','reservation',TRUE),
  ('min_deposit_amount','10000','number','reservation',TRUE),('app_maintenance_mode','false','boolean','app',TRUE),
  ('customer_service_phone','1588-0000','string','app',TRUE)) AS t(setting_key,setting_value,value_type,category,is_active)""",
    "category_settings": """
SELECT CONCAT('part_',CAST(p_partkey AS STRING)) AS setting_key,
  CASE WHEN p_partkey%11=7 THEN 'n/a' WHEN p_partkey%4=0 THEN CONCAT(CAST(CAST(FLOOR(p_retailprice) AS BIGINT) AS STRING),'.50')
    WHEN p_partkey%4=1 THEN p_name WHEN p_partkey%4=2 THEN CASE WHEN p_size%2=0 THEN 'true' ELSE 'false' END
    ELSE CONCAT('{"size":',CAST(p_size AS STRING),'}') END AS setting_value,
  CASE p_partkey%4 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'boolean' ELSE 'json' END AS value_type,
  p_type AS category, p_partkey%5<>4 AS is_active,
  TIMESTAMP '2001-01-01 00:00:00'+INTERVAL '1' DAY*CAST(p_partkey%200 AS INT) AS updated_at FROM part""",
    "shop_services": """
SELECT DISTINCT l_suppkey*2147483648+l_partkey AS id, l_suppkey AS shop_id, p_name AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'nail' WHEN 'MEDIUM' THEN 'eyelash' WHEN 'PROMO' THEN 'waxing' WHEN 'STANDARD' THEN 'eyebrow_tattoo' ELSE 'hair' END AS category,
  CAST(FLOOR(p_retailprice) AS BIGINT)*50 AS price_min, CAST(FLOOR(p_retailprice) AS BIGINT)*80 AS price_max, 30+p_size*3 AS duration_minutes,
  CASE WHEN p_size%3=0 THEN 20000 END AS deposit_amount,
  CAST(CASE WHEN p_size%3=1 THEN 25.00 END AS DECIMAL(5,2)) AS deposit_percentage, 24 AS cancellation_hours
FROM lineitem JOIN part ON l_partkey=p_partkey""",
    "reservations": """
SELECT l_orderkey*134217728+l_suppkey AS id, MIN(o_custkey) AS user_id, l_suppkey AS shop_id,
  CAST(MIN(l_shipdate) AS DATE) AS reservation_date, 540+30*CAST((l_orderkey*7+l_suppkey)%18 AS INT) AS reservation_minute,
  CASE MIN(o_orderstatus) WHEN 'F' THEN 'completed'
    WHEN 'O' THEN CASE WHEN MIN(l_returnflag)='N' THEN 'requested' ELSE 'confirmed' END
    ELSE CASE MIN(l_returnflag) WHEN 'A' THEN 'cancelled_by_user' WHEN 'R' THEN 'cancelled_by_shop' ELSE 'no_show' END END AS status,
  CAST(SUM(5*CAST(FLOOR(l_extendedprice) AS BIGINT)) AS BIGINT) AS total_amount,
  CASE WHEN l_orderkey%9=0 THEN CONCAT('note ',CAST(l_orderkey AS STRING)) END AS special_requests,
  CASE WHEN MIN(o_orderstatus)='F' THEN MIN(l_shipdate)+INTERVAL '15' HOUR END AS completed_at,
  CASE WHEN MIN(o_orderstatus)='P' AND MIN(l_returnflag)<>'N' THEN MIN(l_shipdate)-INTERVAL '1' HOUR*CAST((l_orderkey+l_suppkey)%60 AS INT) END AS cancelled_at,
  MIN(o_orderdate) AS created_at
FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY l_orderkey,l_suppkey""",
    "reservation_services": """
SELECT l_orderkey*134217728+l_suppkey AS reservation_id, l_suppkey*2147483648+l_partkey AS service_id,
  CAST(l_quantity AS INT) AS quantity, 5*CAST(FLOOR(l_extendedprice) AS BIGINT) AS total_price FROM lineitem""",
    "payments": """
SELECT p.* EXCLUDE (cancel_or_made), CASE reservation_id%5 WHEN 0 THEN 'card' WHEN 1 THEN 'kakao_pay' WHEN 2 THEN 'naver_pay' WHEN 3 THEN 'toss_payments' ELSE 'bank_transfer' END AS payment_method,
  CASE WHEN payment_status='refunded' THEN amount WHEN payment_status='fully_paid' AND reservation_id%17=0 THEN 1000 ELSE 0 END AS refund_amount,
  CASE WHEN payment_status='refunded' THEN cancel_or_made+INTERVAL '1' DAY WHEN payment_status='fully_paid' AND reservation_id%17=0 THEN paid_at+INTERVAL '40' DAY END AS refunded_at
  FROM (
SELECT CONCAT('D',CAST(id AS STRING)) AS id, id AS reservation_id, user_id, TRUE AS is_deposit,
  CASE WHEN status='cancelled_by_shop' THEN 'refunded' ELSE 'deposit_paid' END AS payment_status,
  CAST(FLOOR(total_amount*0.3) AS BIGINT) AS amount, created_at AS paid_at,
  COALESCE(cancelled_at,created_at) AS cancel_or_made FROM reservations WHERE status<>'requested'
UNION ALL SELECT CONCAT('B',CAST(id AS STRING)), id, user_id, FALSE, CASE WHEN id%11=0 THEN 'pending' ELSE 'fully_paid' END,
  total_amount-CAST(FLOOR(total_amount*0.3) AS BIGINT), CASE WHEN id%11<>0 THEN completed_at END, NULL FROM reservations WHERE status='completed') p""",
    "point_transactions": """
SELECT CONCAT('E',CAST(id AS STRING)) AS id, user_id, id AS reservation_id, 'earned_service' AS transaction_type,
  CAST(FLOOR(LEAST(total_amount,300000)*CAST(0.025 AS DECIMAL(4,3))) AS BIGINT) AS amount,
  CASE WHEN id%3=0 THEN 'pending' ELSE 'available' END AS status, completed_at+INTERVAL '7' DAY AS available_from,
  completed_at+INTERVAL '365' DAY AS expires_at, CAST(NULL AS BIGINT) AS related_user_id, completed_at AS created_at
  FROM reservations WHERE status='completed'
UNION ALL SELECT CONCAT('U',CAST(id AS STRING)), user_id, id, 'used_service', CAST(-500 AS BIGINT), 'available', NULL, NULL, NULL, created_at
  FROM reservations WHERE status='confirmed' AND id%5=0
UNION ALL SELECT CONCAT('F',CAST(r.id AS STRING)), p.id, r.id, 'earned_referral', CAST(150 AS BIGINT), 'available',
  r.completed_at+INTERVAL '7' DAY, NULL, u.id, r.completed_at
  FROM reservations r JOIN users u ON r.user_id=u.id JOIN users p ON u.referred_by_code=p.referral_code WHERE r.status='completed'""",
    "shop_settlements": """
SELECT CONCAT(CAST(shop_id AS STRING),'-',CAST(m AS STRING)) AS id, shop_id, m AS period_start_date,
  CAST(LAST_DAY(m) AS DATE) AS period_end_date, n AS completed_bookings,
  CAST(gross AS BIGINT) AS gross_revenue, CAST(FLOOR(gross*0.1) AS BIGINT) AS commission_amount, gross-CAST(FLOOR(gross*0.1) AS BIGINT) AS net_settlement_amount,
  CASE WHEN gross%3=0 THEN 'pending' ELSE 'completed' END AS settlement_status,
  CASE WHEN gross%3=1 THEN CAST(m AS TIMESTAMP)+INTERVAL '40' DAY END AS settled_at
FROM (SELECT shop_id, CAST(DATE_TRUNC('month',completed_at) AS DATE) AS m, CAST(SUM(total_amount) AS BIGINT) AS gross, COUNT(*) AS n
  FROM reservations WHERE status='completed' GROUP BY shop_id, CAST(DATE_TRUNC('month',completed_at) AS DATE)) g""",
    "settlement_transfers": """
SELECT id AS settlement_id, net_settlement_amount AS transfer_amount,
  CASE WHEN settled_at IS NULL THEN 'approved' ELSE 'transfer_completed' END AS transfer_status,
  CAST(period_start_date AS TIMESTAMP)+INTERVAL '35' DAY AS approved_at FROM shop_settlements WHERE settlement_status='completed'""",
    "app_events": """
SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'app_open' WHEN 'click' THEN 'search_performed'
  WHEN 'view' THEN 'shop_viewed' WHEN 'error' THEN 'reservation_created' ELSE 'payment_completed' END AS event_type, value, props FROM events""",
    "error_logs": """
SELECT event_id AS id, ts AS created_at, CASE event_id%4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  CASE event_id%6 WHEN 0 THEN 'authentication' WHEN 1 THEN 'payment' WHEN 2 THEN 'validation' WHEN 3 THEN 'network' WHEN 4 THEN 'system' ELSE 'business_logic' END AS category
FROM events WHERE event_type='error'""",
    "user_favorites": """
SELECT e.user_id, (e.event_id*17)%(SELECT COUNT(*) FROM supplier) AS shop_id, e.ts AS created_at FROM events e WHERE e.event_type='click'""",
    "hours_changes": """
SELECT event_id AS seq, (event_id*7)%((SELECT COUNT(*) FROM supplier)+10) AS shop_id, CAST(event_id%7 AS INT) AS day_of_week,
  event_id%3<>0 AS is_open, 480+30*CAST(event_id%5 AS INT) AS open_minute, 1020+30*CAST(event_id%6 AS INT) AS close_minute,
  CASE WHEN event_id%2=0 THEN 750 END AS break_start_minute, CASE WHEN event_id%2=0 THEN 810 END AS break_end_minute
FROM events WHERE event_type='view'""",
    "shop_applications": """
SELECT c_custkey AS id, c_custkey AS applicant_id, CONCAT('Shop ',c_name) AS shop_name,
  CASE c_custkey%4 WHEN 0 THEN 'nail' WHEN 1 THEN 'eyelash' WHEN 2 THEN 'waxing' ELSE 'eyebrow_tattoo' END AS main_category,
  CONCAT('addr ',CAST(c_custkey AS STRING)) AS shop_address,
  TIMESTAMP '2001-01-01 00:00:00'+INTERVAL '1' DAY*CAST(c_custkey%180 AS INT) AS created_at,
  CASE c_custkey%3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS application_status FROM customer""",
    "promotions": """
SELECT p_partkey AS id, CONCAT('P',CAST(p_partkey AS STRING)) AS promotion_code, p_name AS title,
  CASE WHEN p_partkey%10<>9 THEN CONCAT('{"min_amount":',CAST(p_size*1000 AS STRING),',"category":"',
    CASE p_type WHEN 'ECONOMY' THEN 'nail' WHEN 'MEDIUM' THEN 'eyelash' WHEN 'PROMO' THEN 'waxing' WHEN 'STANDARD' THEN 'eyebrow_tattoo' ELSE 'hair' END,'"}')
    ELSE '{broken' END AS conditions,
  CONCAT('{"discount_rate":',CAST(p_size AS STRING),'}') AS benefits,
  CASE WHEN p_partkey%4<>0 THEN CAST(3+p_size AS BIGINT) END AS usage_limit, 1+p_partkey%2 AS usage_limit_per_user,
  TIMESTAMP '2001-01-01 00:00:00'+INTERVAL '1' DAY*CAST(p_partkey%300 AS INT) AS starts_at,
  TIMESTAMP '2001-01-01 00:00:00'+INTERVAL '1' DAY*CAST(p_partkey%300+30+p_size*5 AS INT) AS ends_at, p_partkey%7<>0 AS is_active
FROM part""",
    "promotion_usages": """
SELECT l_partkey AS promotion_id, o_custkey AS user_id, l_shipdate AS used_at FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_linenumber<>5""",
    "promotion_claims": """
SELECT CONCAT(CAST(l_orderkey AS STRING),'-',CAST(l_partkey AS STRING),'-',CAST(l_suppkey AS STRING)) AS claim_id, l_partkey AS promotion_id,
  o_custkey AS user_id, CAST(FLOOR(l_extendedprice) AS BIGINT) AS amount,
  CASE l_suppkey%4 WHEN 0 THEN 'nail' WHEN 1 THEN 'eyelash' WHEN 2 THEN 'waxing' ELSE 'eyebrow_tattoo' END AS category, l_shipdate AS claimed_at
FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_linenumber=5""",
    "notifications": """
SELECT CONCAT('N',CAST(id AS STRING)) AS id, user_id, CASE status WHEN 'confirmed' THEN 'reservation_confirmed' WHEN 'cancelled_by_shop' THEN 'reservation_cancelled'
  ELSE CASE id%4 WHEN 0 THEN 'point_earned' WHEN 1 THEN 'referral_success' ELSE 'system' END END AS notification_type,
  CASE id%3 WHEN 0 THEN 'unread' WHEN 1 THEN 'read' ELSE 'deleted' END AS status, id AS related_id, created_at
FROM reservations WHERE status IN ('confirmed','cancelled_by_shop') OR (status='completed' AND id%4<>3)""",
    "reviews": """
SELECT CONCAT('V',CAST(id AS STRING)) AS id, id AS reservation_id, user_id, shop_id, CAST(1+id%5 AS INT) AS rating, created_at
FROM reservations""",
    "faqs": """
SELECT a.conv_id AS id, CASE a.conv_id%3 WHEN 0 THEN 'booking' WHEN 1 THEN 'points' ELSE 'account' END AS category, a.text AS question, b.answer,
  CAST(a.conv_id%20 AS INT) AS display_order, a.conv_id%6<>0 AS is_active
FROM conversations a JOIN (SELECT conv_id, STRING_AGG(text, CHR(10) ORDER BY turn) AS answer FROM conversations WHERE turn>0 GROUP BY conv_id) b
  ON a.conv_id=b.conv_id WHERE a.turn=0""",
    "shop_images": """
SELECT CONCAT(CAST(s_suppkey AS STRING),'-',CAST(d AS STRING)) AS id, s_suppkey AS shop_id, d AS display_order FROM supplier CROSS JOIN (VALUES (0),(1)) AS t(d)""",
    "service_images": """
SELECT CONCAT('img-',CAST(id AS STRING)) AS id, id AS service_id FROM shop_services""",
    "app_configs": """
SELECT CONCAT('config_',CAST(p_partkey AS STRING)) AS config_key, CASE p_partkey%3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE 'all' END AS platform FROM part""",
    "reservation_actions": """
SELECT CONCAT('A',CAST(id AS STRING)) AS id, id AS reservation_id, status AS action, shop_id AS performed_by, 'requested' AS previous_status,
  status AS new_status, created_at FROM reservations WHERE status IN ('confirmed','cancelled_by_shop')""",
    "posts": """
SELECT doc_id AS id, text AS content, source AS region, lang AS language,
  CASE doc_id%8 WHEN 0 THEN 'hidden' WHEN 1 THEN 'reported' WHEN 2 THEN 'deleted' ELSE 'active' END AS status,
  TIMESTAMP '2001-01-01 00:00:00'+INTERVAL '1' DAY*CAST(doc_id%365 AS INT) AS created_at FROM documents""",
    "content_reports": """
SELECT doc_id AS id, doc_id%(SELECT COUNT(*) FROM customer) AS reporter_id, 'post' AS reported_content_type, doc_id-doc_id%7 AS reported_content_id,
  CASE WHEN toxic=1 THEN 'harassment' WHEN quality=0 THEN 'spam' WHEN doc_id%5=0 THEN 'copyright' ELSE 'other' END AS reason,
  CASE doc_id%3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status,
  TIMESTAMP '2001-03-01 00:00:00'+INTERVAL '1' DAY*CAST(doc_id%100 AS INT) AS created_at FROM labels""",
    "announcements": """
SELECT doc_id AS id, CONCAT('Notice ',CAST(doc_id AS STRING)) AS title, text AS content, doc_id%7=0 AS is_important, doc_id%9<>0 AS is_active,
  CASE doc_id%3 WHEN 0 THEN ['user'] WHEN 1 THEN ['user','shop_owner'] END AS target_user_type,
  TIMESTAMP '2001-01-01 00:00:00'+INTERVAL '1' DAY*CAST(doc_id%365 AS INT) AS starts_at,
  CASE WHEN doc_id%4<>0 THEN TIMESTAMP '2001-01-01 00:00:00'+INTERVAL '1' DAY*CAST(doc_id%365+60 AS INT) END AS ends_at FROM documents""",
}

_WORD = re.compile(r"[A-Za-z_]+")


def _mentions(text: str) -> list[str]:
    words = set(_WORD.findall(text))
    return [name for name in CTES if name in words]


def with_tables(body: str) -> str:
    """``body`` preceded by the projections it reads, in order of dependence."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in _mentions(CTES[name]):
            if other != name:
                visit(other)
        order.append(name)

    for name in _mentions(body):
        visit(name)
    if not order:
        return body.strip()
    head = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
