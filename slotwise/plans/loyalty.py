"""Points and referral queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import analytics, points, referrals
from .registry import AS_OF, query

NOW = "TIMESTAMP '2001-07-15 12:00:00'"
USABLE = f"status='available' AND (available_from IS NULL OR available_from<={NOW}) AND (expires_at IS NULL OR expires_at>{NOW})"
YEAR = (dt.date(2001, 1, 1), dt.date(2001, 6, 30))


@query("points_from_user_ledger", f"""
SELECT user_id, CAST(COALESCE(SUM(CASE WHEN amount>0 AND status='available' THEN amount END),0) AS BIGINT) AS total_points,
  CAST(COALESCE(SUM(CASE WHEN {USABLE} THEN amount END),0) AS BIGINT) AS available_points FROM point_transactions GROUP BY user_id""")
def _(t):
    return points.ledger_balances(t["point_transactions"], AS_OF)


@query("point_balances", f"""
SELECT user_id, CAST(COALESCE(SUM(CASE WHEN amount>0 THEN amount END),0) AS BIGINT) AS total_earned,
  CAST(COALESCE(SUM(CASE WHEN amount<0 THEN -amount END),0) AS BIGINT) AS total_used,
  CAST(COALESCE(SUM(CASE WHEN {USABLE} THEN amount END),0) AS BIGINT) AS available_balance,
  CAST(COALESCE(SUM(CASE WHEN status='pending' THEN amount END),0) AS BIGINT) AS pending_balance FROM point_transactions GROUP BY user_id""")
def _(t):
    return points.point_balances(t["point_transactions"], AS_OF)


@query("user_point_summary", """
SELECT u.id AS user_id, u.name, u.total_points, u.available_points, CAST(COALESCE(p.pending_points,0) AS BIGINT) AS pending_points,
  CAST(COALESCE(r.points_this_month,0) AS BIGINT) AS points_this_month
FROM users u
LEFT JOIN (SELECT user_id, SUM(amount) AS pending_points FROM point_transactions WHERE status='pending' GROUP BY user_id) p ON p.user_id=u.id
LEFT JOIN (SELECT user_id, SUM(amount) AS points_this_month FROM point_transactions WHERE status='available' AND amount>0
  AND created_at>=TIMESTAMP '2001-07-01 00:00:00' GROUP BY user_id) r ON r.user_id=u.id""")
def _(t):
    return points.user_point_summary(t, AS_OF)


MATURED = f"""SELECT id, user_id, transaction_type, amount, created_at,
  CASE WHEN (status='available' OR (status='pending' AND available_from<={NOW})) AND expires_at<={NOW} THEN 'expired'
    WHEN status='pending' AND available_from<={NOW} THEN 'available' ELSE status END AS status FROM point_transactions"""


@query("points_maturation", MATURED)
def _(t):
    return points.points_maturation(t["point_transactions"], AS_OF).select(
        "id", "user_id", "transaction_type", "amount", "created_at", "status"
    )


@query("points_overview", f"""
WITH m AS ({MATURED}) SELECT
  CAST(COALESCE(SUM(CASE WHEN transaction_type IN ('earned_service','earned_referral','influencer_bonus') THEN amount END),0) AS BIGINT) AS issued,
  CAST(COALESCE(SUM(CASE WHEN transaction_type='used_service' THEN -amount END),0) AS BIGINT) AS redeemed,
  CAST(COALESCE(SUM(CASE WHEN status='pending' THEN amount END),0) AS BIGINT) AS pending,
  CAST(COALESCE(SUM(CASE WHEN status='expired' AND amount>0 THEN amount END),0) AS BIGINT) AS expired,
  CAST(COALESCE(SUM(CASE WHEN transaction_type='adjusted' THEN amount END),0) AS BIGINT) AS adjusted FROM m""")
def _(t):
    return points.points_overview(points.points_maturation(t["point_transactions"], AS_OF))


@query("award_service_points", f"""
SELECT user_id, id AS reservation_id, 'earned_service' AS transaction_type,
  CAST(FLOOR(LEAST(total_amount,300000)*CAST(0.025 AS DECIMAL(4,3))) AS BIGINT) AS amount, '서비스 이용 적립' AS description, 'pending' AS status,
  TIMESTAMP '2001-07-22 12:00:00' AS available_from, {NOW} AS created_at
FROM reservations r WHERE status='completed' AND NOT EXISTS (SELECT 1 FROM point_transactions p
  WHERE p.reservation_id=r.id AND p.transaction_type='earned_service' AND p.reservation_id%4<>0)""")
def _(t):
    # The sample ledger has every award; take out one in four so that some are due.
    partial = t["point_transactions"].filter(F.col("reservation_id") % 4 != 0)
    return points.award_service_points(t.replaced(point_transactions=partial), AS_OF)


@query("influencer_bonus", """
SELECT CONCAT('I',p.id) AS id, p.user_id, p.reservation_id, 'influencer_bonus' AS transaction_type, CAST(FLOOR(p.amount*0.5) AS BIGINT) AS amount,
  p.status, p.available_from, p.expires_at, p.related_user_id, p.created_at
FROM point_transactions p JOIN users u ON u.id=p.user_id AND u.is_influencer WHERE p.transaction_type='earned_referral'""")
def _(t):
    return points.influencer_bonus(t)


HISTORY = """
SELECT id, user_id, created_at, transaction_type, amount, status, balance_after, position, CASE WHEN amount>0 THEN 'earned' ELSE 'used' END AS tab,
  CAST(FLOOR((COUNT(*) OVER (PARTITION BY user_id)-position)/30.0) AS BIGINT) AS page FROM (
  SELECT *, CAST(SUM(amount) OVER w AS BIGINT) AS balance_after, CAST(SUM(CASE WHEN {wanted} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS position
  FROM point_transactions WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x WHERE {wanted}"""


@query("points_history", HISTORY.format(wanted="TRUE"))
def _(t):
    return points.points_history(t["point_transactions"])


@query("points_history_used", HISTORY.format(wanted="amount<0"))
def _(t):
    return points.points_history(t["point_transactions"], tab="used")


def _spend_requests(t):
    """Every booking asks to pay part of its price with points, in order of creation."""
    return t["reservations"].select(
        F.col("id").alias("request_id"), "user_id", F.col("created_at").alias("requested_at"),
        (F.col("total_amount") % 4000 + F.col("id") % 3 - 1).alias("amount"),
    )


SPEND = f"""
WITH RECURSIVE balance AS (SELECT user_id, CAST(COALESCE(SUM(CASE WHEN {USABLE} THEN amount END),0) AS BIGINT) AS funds FROM point_transactions GROUP BY user_id),
queue AS (SELECT r.id AS request_id, r.user_id, r.total_amount%4000+r.id%3-1 AS amount, COALESCE(b.funds,0) AS funds,
  ROW_NUMBER() OVER (PARTITION BY r.user_id ORDER BY r.created_at, r.id) AS n FROM reservations r LEFT JOIN balance b ON b.user_id=r.user_id),
walk AS (SELECT request_id, user_id, amount, n, amount>0 AND amount<=funds AS accepted,
    CASE WHEN amount>0 AND amount<=funds THEN funds-amount ELSE funds END AS funds FROM queue WHERE n=1
  UNION ALL SELECT q.request_id, q.user_id, q.amount, q.n, q.amount>0 AND q.amount<=w.funds,
    CASE WHEN q.amount>0 AND q.amount<=w.funds THEN w.funds-q.amount ELSE w.funds END FROM walk w JOIN queue q ON q.user_id=w.user_id AND q.n=w.n+1)
"""


@query("point_redemption", SPEND + "SELECT request_id, user_id, amount, accepted FROM walk")
def _(t):
    funds = points.ledger_balances(t["point_transactions"], AS_OF)
    return points.point_redemption(_spend_requests(t), funds)


@query("point_redemption_rows", SPEND + f"""SELECT CONCAT('S',CAST(request_id AS STRING)) AS id, user_id, 'used_service' AS transaction_type,
  -amount AS amount, 'available' AS status, {NOW} AS created_at FROM walk WHERE accepted""")
def _(t):
    funds = points.ledger_balances(t["point_transactions"], AS_OF)
    return points.redemption_rows(points.point_redemption(_spend_requests(t), funds), AS_OF)


COUNTERS = """
  SELECT u.id AS user_id, u.name, u.referral_code, u.is_influencer, u.user_role, COALESCE(c.n,0) AS total_referrals, COALESCE(c.paid,0) AS successful_referrals
  FROM users u LEFT JOIN (SELECT f.referred_by_code, COUNT(DISTINCT f.id) AS n, COUNT(DISTINCT p.user_id) AS paid
    FROM users f LEFT JOIN payments p ON p.user_id=f.id AND p.payment_status='fully_paid' WHERE f.referred_by_code IS NOT NULL
    GROUP BY f.referred_by_code) c ON c.referred_by_code=u.referral_code"""


@query("referral_counters", COUNTERS)
def _(t):
    return referrals.referral_counters(t)


def _status_sql(needed: int) -> str:
    good = f"(total_referrals>={needed} AND successful_referrals>={needed})"
    return f"""WITH c AS ({COUNTERS}) SELECT user_id, total_referrals AS referral_count, successful_referrals AS paid_referral_count,
  {good} AS qualifies, ({good} AND NOT is_influencer) AS flips,
  CASE WHEN {good} AND NOT is_influencer THEN 'influencer' ELSE user_role END AS user_role,
  CASE WHEN {good} AND NOT is_influencer THEN {NOW} END AS influencer_qualified_at FROM c"""


@query("influencer_status", _status_sql(50))
def _(t):
    return referrals.influencer_status(t, AS_OF)


@query("influencer_status_82", _status_sql(82))
def _(t):
    return referrals.influencer_status(t, AS_OF, needed=82)


@query("referral_leaderboard", f"""
WITH c AS ({COUNTERS}) SELECT user_id, name, total_referrals, successful_referrals, is_influencer,
  CAST(FLOOR(LEAST(total_referrals,successful_referrals,50)*100/50.0) AS BIGINT) AS progress_percent FROM c WHERE total_referrals>0""")
def _(t):
    return referrals.referral_leaderboard(t)


REWARDS = """
  SELECT p.user_id AS referrer_id, p.related_user_id AS friend_id, SUBSTR(SPLIT_PART(u.email,'@',1),1,LEAST(6,LENGTH(SPLIT_PART(u.email,'@',1))//2)) AS friend, p.amount, p.created_at
  FROM point_transactions p LEFT JOIN users u ON u.id=p.related_user_id
  WHERE p.transaction_type IN ('earned_referral','influencer_bonus') AND CAST(p.created_at AS DATE) BETWEEN DATE '2001-01-01' AND DATE '2001-06-30'"""


@query("referral_earnings", f"""
WITH w AS ({REWARDS}) SELECT referrer_id, friend_id, friend, CAST(SUM(amount) AS BIGINT) AS points, COUNT(*) AS rewards, 1 AS friends, FALSE AS is_total
FROM w GROUP BY 1,2,3
UNION ALL SELECT referrer_id, NULL, NULL, CAST(SUM(amount) AS BIGINT), COUNT(*), COUNT(DISTINCT friend_id), TRUE FROM w GROUP BY 1""")
def _(t):
    return referrals.referral_earnings(t, *YEAR)


@query("referral_earning_rows", f"""
WITH w AS ({REWARDS}) SELECT referrer_id, friend_id, friend, STRFTIME(created_at,'%y/%m/%d') AS day, amount FROM w""")
def _(t):
    return referrals.referral_earning_rows(t, *YEAR)


_HALF = 36**4


def _code_sql(number: str, source: str, keep: str) -> str:
    """SELECT of ``keep`` and ``code`` for the numbers ``number`` of ``source``, step by step."""
    body = f"SELECT {keep}, ({number})//{_HALF} AS u, ({number})%{_HALF} AS l FROM {source}"
    for step in range(6):
        moved, by = ("u", "l") if step % 2 == 0 else ("l", "u")
        mixed = f"({moved}+CAST('0x' || SUBSTR(MD5('{step}:' || {by}),1,8) AS BIGINT))%{_HALF} AS {moved}"
        body = f"SELECT {keep}, {', '.join((mixed, by))} FROM ({body})"
    digits = " || ".join(f"SUBSTR('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789',CAST((w//{36**i})%36+1 AS INT),1)" for i in range(8))
    return f"SELECT {keep}, {digits} AS code FROM (SELECT {keep}, u*{_HALF}+l AS w FROM ({body}))"


# All numbers that could be needed, with their codes; those that nobody holds go to the users in order.
@query("referral_codes", f"""
WITH held AS (SELECT code FROM ({_code_sql("id//3*2", "(SELECT id FROM users WHERE id%3=1)", "id")})),
asking AS (SELECT id, ROW_NUMBER() OVER (ORDER BY SUBSTR(MD5(CAST(id AS VARCHAR)),1,3), id) AS r FROM users WHERE id%3=0),
numbers AS (SELECT n FROM (SELECT UNNEST(RANGE((SELECT COUNT(*) FROM users))) AS n)),
free AS (SELECT code, ROW_NUMBER() OVER (ORDER BY n) AS r FROM ({_code_sql("n", "numbers", "n")}) WHERE code NOT IN (SELECT code FROM held))
SELECT id, code FROM asking JOIN free ON free.r=asking.r""")
def _(t):
    # A third of the users have no code yet; another third hold codes that would be given out, every second number.
    people = t["users"].repartition("id")  # one file is one task otherwise
    planted = referrals.with_codes(people.withColumn("n", F.floor(F.col("id") / 3) * 2), "n", "planted")
    return referrals.referral_codes(
        planted.withColumn("referral_code", F.when(F.col("id") % 3 == 1, F.col("planted")).when(F.col("id") % 3 == 2, F.col("referral_code")))
    )


@query("profile_stats", f"""
WITH c AS ({COUNTERS}) SELECT c.user_id, c.name, u.total_points, u.available_points, c.total_referrals, c.successful_referrals,
  COALESCE(r.n,0) AS reservation_count, COALESCE(r.done,0) AS completed_count
FROM c JOIN users u ON u.id=c.user_id LEFT JOIN (SELECT user_id, COUNT(*) AS n, COUNT(CASE WHEN status='completed' THEN 1 END) AS done
  FROM reservations GROUP BY user_id) r ON r.user_id=c.user_id""")
def _(t):
    return analytics.profile_stats(t)
