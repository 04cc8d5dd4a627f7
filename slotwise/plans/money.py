"""Settlement, settings and revenue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import settings, settlement
from .registry import AS_OF, PERIOD, query

RATES = """
  SELECT s.id AS shop_id, s.shop_type, CAST(CASE WHEN s.shop_type='partnered'
      THEN COALESCE((SELECT CAST(setting_value AS DECIMAL(5,2)) FROM system_settings WHERE setting_key='partnered_commission_rate' AND is_active AND value_type='number'),10.00)
      ELSE COALESCE((SELECT CAST(setting_value AS DECIMAL(5,2)) FROM system_settings WHERE setting_key='non_partnered_commission_rate' AND is_active AND value_type='number'),10.00)
    END AS DECIMAL(5,2)) AS type_rate, c.commission_rate AS override_rate
  FROM shops s LEFT JOIN shop_settlement_configs c ON c.shop_id=s.id"""

# Hundredths of a percent as integers keep the commission exact in both engines.
JUNE = """
  SELECT r.shop_id, MIN(COALESCE(q.override_rate,q.type_rate)) AS rate, CAST(SUM(r.total_amount) AS BIGINT) AS gross_revenue,
    CAST(FLOOR(CAST(SUM(r.total_amount*CAST(COALESCE(q.override_rate,q.type_rate)*100 AS BIGINT)) AS DECIMAL(30,0))*0.0001) AS BIGINT) AS fee,
    COUNT(*) AS booking_count
  FROM reservations r JOIN rates q ON q.shop_id=r.shop_id
  WHERE r.status='completed' AND CAST(r.completed_at AS DATE) BETWEEN DATE '2001-06-01' AND DATE '2001-06-30' GROUP BY r.shop_id"""


@query("settings_typed", """
SELECT setting_key, category, value_type, CASE WHEN value_type='string' THEN setting_value END AS text_value,
  CASE WHEN value_type='number' THEN TRY_CAST(setting_value AS DECIMAL(18,4)) END AS number_value,
  CASE WHEN value_type='boolean' THEN TRY_CAST(setting_value AS BOOLEAN) END AS boolean_value,
  CASE WHEN value_type='json' THEN setting_value END AS json_value
FROM category_settings WHERE is_active""")
def _(t):
    return settings.settings_typed(t["category_settings"])


def _setting_requests(t):
    """Every event asks for the setting of one part; some parts do not exist."""
    parts = t["part"].agg((F.count(F.lit(1)) + 10).alias("n")).scalar()
    return t["events"].select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("part_"), (F.col("event_id") % parts).cast("string")).alias("setting_key"),
    )


_REQUESTS = "requests AS (SELECT event_id AS request_id, CONCAT('part_',CAST(event_id%(SELECT COUNT(*)+10 FROM part) AS STRING)) AS setting_key FROM events)"


@query("setting_text", f"""
WITH {_REQUESTS} SELECT q.request_id, q.setting_key, COALESCE(s.setting_value,'') AS setting_text
FROM requests q LEFT JOIN category_settings s ON s.setting_key=q.setting_key AND s.is_active""")
def _(t):
    return settings.setting_text(_setting_requests(t), t["category_settings"])


@query("setting_number", f"""
WITH {_REQUESTS} SELECT q.request_id, q.setting_key, CAST(COALESCE(TRY_CAST(s.setting_value AS DECIMAL(18,4)),0) AS DECIMAL(18,4)) AS setting_number
FROM requests q LEFT JOIN category_settings s ON s.setting_key=q.setting_key AND s.is_active AND s.value_type='number'""")
def _(t):
    return settings.setting_number(_setting_requests(t), t["category_settings"])


@query("admin_settings_summary", """
SELECT category, COUNT(*) AS setting_count, COUNT(CASE WHEN is_active THEN 1 END) AS active_count, MAX(updated_at) AS last_updated
FROM category_settings GROUP BY category ORDER BY category""")
def _(t):
    return settings.settings_summary(t["category_settings"])


@query("commission_rates", f"""
SELECT shop_id, shop_type, type_rate, override_rate, COALESCE(override_rate,type_rate) AS rate FROM ({RATES}) x""")
def _(t):
    return settlement.commission_rates(t)


@query("shop_settlement", f"""
WITH rates AS ({RATES}), june AS ({JUNE})
SELECT q.shop_id, COALESCE(q.override_rate,q.type_rate) AS rate, COALESCE(gross_revenue,0) AS gross_revenue, COALESCE(fee,0) AS commission_amount,
  COALESCE(gross_revenue-fee,0) AS net_settlement, COALESCE(booking_count,0) AS booking_count FROM rates q LEFT JOIN june j ON j.shop_id=q.shop_id""")
def _(t):
    return settlement.shop_settlement(t, *PERIOD)


@query("settlement_batch", f"""
WITH rates AS ({RATES}), june AS ({JUNE})
SELECT CONCAT('monthly-2001-06-01-',CAST(j.shop_id AS STRING)) AS settlement_id, '2001년 06월 월간정산' AS batch_name, j.shop_id,
  DATE '2001-06-01' AS period_start_date, DATE '2001-06-30' AS period_end_date, booking_count AS completed_bookings, gross_revenue,
  rate AS commission_rate, fee AS commission_amount, gross_revenue-fee AS net_settlement_amount, 'pending' AS settlement_status
FROM june j JOIN shops s ON s.id=j.shop_id WHERE s.shop_status='active'""")
def _(t):
    return settlement.settlement_batch(t, "monthly", *PERIOD)["settlements"]


@query("settlement_batch_header", f"""
WITH rates AS ({RATES}), june AS ({JUNE})
SELECT '2001년 06월 월간정산' AS batch_name, 'monthly' AS settlement_period, DATE '2001-06-01' AS period_start_date, DATE '2001-06-30' AS period_end_date,
  CAST(SUM(gross_revenue) AS BIGINT) AS total_revenue, CAST(SUM(fee) AS BIGINT) AS total_commission,
  CAST(SUM(gross_revenue-fee) AS BIGINT) AS total_settlement_amount, COUNT(*) AS shop_count, 'pending' AS status
FROM june j JOIN shops s ON s.id=j.shop_id WHERE s.shop_status='active'""")
def _(t):
    return settlement.settlement_batch(t, "monthly", *PERIOD)["batch"]


@query("settlement_batch_totals", """
SELECT period_start_date, CAST(SUM(gross_revenue) AS BIGINT) AS total_revenue, CAST(SUM(commission_amount) AS BIGINT) AS total_commission,
  CAST(SUM(net_settlement_amount) AS BIGINT) AS total_settlement_amount, COUNT(*) AS shop_count
FROM shop_settlements GROUP BY period_start_date""")
def _(t):
    return settlement.batch_totals(t["shop_settlements"], "period_start_date")


PERIODS = """
WITH days AS (SELECT DISTINCT reservation_date AS run_date FROM reservations),
schedules AS (SELECT * FROM (VALUES ('weekly'),('bi_weekly'),('monthly')) AS v(settlement_period))
SELECT run_date, settlement_period,
  CASE settlement_period WHEN 'weekly' THEN CAST(DATE_TRUNC('week',run_date-INTERVAL '7' DAY) AS DATE)
    WHEN 'bi_weekly' THEN CAST(DATE_TRUNC('week',run_date-INTERVAL '14' DAY) AS DATE)
    ELSE CAST(DATE_TRUNC('month',run_date-INTERVAL '1' MONTH) AS DATE) END AS period_start,
  CASE settlement_period WHEN 'weekly' THEN CAST(DATE_TRUNC('week',run_date-INTERVAL '7' DAY)+INTERVAL '6' DAY AS DATE)
    WHEN 'bi_weekly' THEN CAST(DATE_TRUNC('week',run_date-INTERVAL '14' DAY)+INTERVAL '13' DAY AS DATE)
    ELSE CAST(DATE_TRUNC('month',run_date)-INTERVAL '1' DAY AS DATE) END AS period_end
FROM days CROSS JOIN schedules"""


@query("settlement_periods", PERIODS)
def _(t):
    return _due_periods(t)


def _due_periods(t):
    """Each booked day asks which periods a run on that day would settle."""
    kinds = F.array(*[F.lit(p) for p in ("weekly", "bi_weekly", "monthly")])
    runs = t["reservations"].select(F.col("reservation_date").alias("run_date")).distinct().select(
        "run_date", F.explode(kinds).alias("settlement_period"), F.lit(True).alias("is_active")
    )
    return settlement.settlement_periods(runs, F.col("run_date")).drop("is_active")


@query("scheduled_settlements", f"""
WITH rates AS ({RATES}), periods AS (SELECT DISTINCT settlement_period, period_start, period_end FROM ({PERIODS}) due),
sums AS (SELECT settlement_period, period_start, period_end, r.shop_id, COUNT(*) AS n, CAST(SUM(r.total_amount) AS BIGINT) AS gross
  FROM reservations r JOIN periods p ON CAST(r.completed_at AS DATE) BETWEEN p.period_start AND p.period_end
  JOIN shops s ON s.id=r.shop_id AND s.shop_status='active' WHERE r.status='completed' GROUP BY ALL),
paid AS (SELECT sums.*, COALESCE(q.override_rate,q.type_rate) AS rate,
  CAST(FLOOR(CAST(gross*CAST(COALESCE(q.override_rate,q.type_rate)*100 AS BIGINT) AS DECIMAL(30,0))*0.0001) AS BIGINT) AS fee
  FROM sums JOIN rates q ON q.shop_id=sums.shop_id)
SELECT settlement_period, period_start AS period_start_date, period_end AS period_end_date, shop_id, n AS completed_bookings,
  gross AS gross_revenue, rate AS commission_rate, fee AS commission_amount, gross-fee AS net_settlement_amount FROM paid""")
def _(t):
    return settlement.scheduled_settlements(t, _due_periods(t))


@query("settlement_details", f"""
WITH rates AS ({RATES})
SELECT r.id AS reservation_id, r.shop_id, r.total_amount AS service_amount, COALESCE(q.override_rate,q.type_rate) AS commission_rate,
  CAST(FLOOR(CAST(r.total_amount*CAST(COALESCE(q.override_rate,q.type_rate)*100 AS BIGINT) AS DECIMAL(30,0))*0.0001) AS BIGINT) AS commission_amount,
  r.total_amount-CAST(FLOOR(CAST(r.total_amount*CAST(COALESCE(q.override_rate,q.type_rate)*100 AS BIGINT) AS DECIMAL(30,0))*0.0001) AS BIGINT) AS net_amount,
  p.payment_method, r.completed_at
FROM reservations r JOIN rates q ON q.shop_id=r.shop_id JOIN shops s ON s.id=r.shop_id AND s.shop_status='active'
LEFT JOIN payments p ON p.reservation_id=r.id AND p.is_deposit
WHERE r.status='completed' AND CAST(r.completed_at AS DATE) BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'""")
def _(t):
    return settlement.settlement_details(t, *PERIOD)


def _approvals(t):
    """Every settlement is asked for, those with an even gross twice, and one unknown per month start."""
    asked = t["shop_settlements"].select(
        F.col("id").alias("settlement_id"),
        F.explode(F.when(F.col("gross_revenue") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("turn"),
    )
    unknown = t["shop_settlements"].select(
        F.concat(F.lit("none-"), F.col("period_start_date").cast("string")).alias("settlement_id")
    ).distinct().withColumn("turn", F.lit("a"))
    return asked.unionByName(unknown).select(
        F.concat_ws(":", "turn", "settlement_id").alias("request_id"),
        "settlement_id",
        F.lit(0).alias("admin_id"),
        F.concat(F.lit("ok "), F.col("settlement_id")).alias("notes"),
    )


_APPROVALS = """asked AS (SELECT CONCAT('a:',id) AS request_id, id AS settlement_id FROM shop_settlements
  UNION ALL SELECT CONCAT('b:',id), id FROM shop_settlements WHERE gross_revenue%2=0
  UNION ALL SELECT DISTINCT CONCAT('a:none-',CAST(period_start_date AS STRING)), CONCAT('none-',CAST(period_start_date AS STRING)) FROM shop_settlements),
judged AS (SELECT a.*, s.net_settlement_amount, s.settlement_status='pending' AND ROW_NUMBER() OVER (PARTITION BY a.settlement_id ORDER BY a.request_id)=1 AS good
  FROM asked a LEFT JOIN shop_settlements s ON s.id=a.settlement_id)"""


@query("approve_settlements", f"""
WITH {_APPROVALS} SELECT request_id, settlement_id, CASE WHEN good THEN 'accepted' ELSE 'rejected' END AS outcome,
  CASE WHEN good THEN NULL ELSE 'no pending settlement' END AS reject_reason FROM judged""")
def _(t):
    return settlement.approve_settlements(t, _approvals(t), AS_OF)["outcome"]


@query("approve_settlements_transfers", f"""
WITH {_APPROVALS} SELECT settlement_id, 'approved' AS transfer_status, 0 AS approved_by, TIMESTAMP '2001-07-15 12:00:00' AS approved_at,
  net_settlement_amount AS transfer_amount, CONCAT('ok ',settlement_id) AS admin_notes FROM judged WHERE good""")
def _(t):
    return settlement.approve_settlements(t, _approvals(t), AS_OF)["transfers"]


@query("approve_settlements_logs", f"""
WITH {_APPROVALS} SELECT settlement_id, 'approved' AS action, '0' AS performed_by, CONCAT('ok ',settlement_id) AS notes,
  TIMESTAMP '2001-07-15 12:00:00' AS created_at FROM judged WHERE good""")
def _(t):
    return settlement.approve_settlements(t, _approvals(t), AS_OF)["logs"]


def _payout_requests(t):
    return t["shop_settlements"].select(
        F.concat(F.lit("q:"), F.col("id")).alias("request_id"), F.col("id").alias("settlement_id"),
        F.lit(0).alias("admin_id"), F.lit("bank_transfer").alias("method"),
    )


_PAYOUTS = """judged AS (SELECT CONCAT('q:',s.id) AS request_id, s.id AS settlement_id, c.bank_name, c.bank_account, c.account_holder,
  COALESCE(t.transfer_status='approved' AND c.shop_id IS NOT NULL,FALSE) AS good
  FROM shop_settlements s LEFT JOIN settlement_transfers t ON t.settlement_id=s.id LEFT JOIN shop_settlement_configs c ON c.shop_id=s.shop_id)"""


@query("request_transfers", f"""
WITH {_PAYOUTS} SELECT request_id, settlement_id, CASE WHEN good THEN 'accepted' ELSE 'rejected' END AS outcome,
  CASE WHEN good THEN NULL ELSE 'no approved transfer' END AS reject_reason FROM judged""")
def _(t):
    return settlement.request_transfers(t, _payout_requests(t), AS_OF)["outcome"]


@query("request_transfers_rows", f"""
WITH {_PAYOUTS} SELECT settlement_id, 'transfer_requested' AS transfer_status, 'bank_transfer' AS transfer_method, bank_name,
  bank_account AS account_number, account_holder, TIMESTAMP '2001-07-15 12:00:00' AS transfer_requested_at FROM judged WHERE good""")
def _(t):
    return settlement.request_transfers(t, _payout_requests(t), AS_OF)["transfers"]


@query("request_transfers_logs", f"""
WITH {_PAYOUTS} SELECT settlement_id, 'transfer_requested' AS action, '0' AS performed_by,
  '송금 요청: ' || 'bank_transfer' || ' - ' || account_holder AS notes, TIMESTAMP '2001-07-15 12:00:00' AS created_at FROM judged WHERE good""")
def _(t):
    return settlement.request_transfers(t, _payout_requests(t), AS_OF)["logs"]


def _callbacks(t):
    """Transfers after the request step, each with a callback."""
    requested = t.replaced(
        settlement_transfers=t["settlement_transfers"].withColumn(
            "transfer_status",
            F.when(
                (F.col("transfer_status") == "approved") & (F.col("transfer_amount") % 2 == 0), "transfer_requested"
            ).otherwise(F.col("transfer_status")),
        )
    )
    calls = t["settlement_transfers"].select(
        F.concat(F.lit("c:"), F.col("settlement_id")).alias("request_id"),
        "settlement_id",
        F.concat(F.lit("ext-"), F.col("settlement_id")).alias("external_id"),
        F.when(F.col("transfer_amount") % 5 == 0, F.col("transfer_amount") - 500).alias("actual_amount"),
        F.when(F.col("transfer_amount") % 3 == 0, F.lit(500)).alias("fee"),
    )
    return requested, calls


_CALLBACKS = """good AS (SELECT settlement_id, transfer_amount, COALESCE(CASE WHEN transfer_amount%3=0 THEN 500 END,0) AS fee,
  CASE WHEN transfer_amount%5=0 THEN transfer_amount-500 ELSE transfer_amount END AS paid FROM settlement_transfers
  WHERE transfer_status='approved' AND transfer_amount%2=0)"""


@query("complete_transfers", f"""
WITH {_CALLBACKS} SELECT settlement_id, 'transfer_completed' AS transfer_status, CONCAT('ext-',settlement_id) AS external_transfer_id,
  paid AS transfer_amount, fee AS transfer_fee, TIMESTAMP '2001-07-15 12:00:00' AS transfer_completed_at FROM good""")
def _(t):
    return settlement.complete_transfers(*_callbacks(t), AS_OF)["transfers"]


@query("complete_transfers_logs", f"""
WITH {_CALLBACKS} SELECT settlement_id, 'completed' AS action, CAST(NULL AS STRING) AS performed_by,
  CONCAT('송금 완료: ext-',settlement_id,' (수수료: ',CAST(fee AS STRING),'원)') AS notes, TIMESTAMP '2001-07-15 12:00:00' AS created_at FROM good""")
def _(t):
    return settlement.complete_transfers(*_callbacks(t), AS_OF)["logs"]


@query("settlement_status", """
SELECT s.id AS settlement_id, s.shop_id, s.period_start_date AS period_start, s.period_end_date AS period_end, s.gross_revenue, s.commission_amount,
  s.net_settlement_amount AS net_settlement, s.settlement_status, COALESCE(t.transfer_status,'not_started') AS transfer_status,
  CAST(t.approved_at AS DATE)+3 AS expected_transfer_date, s.settled_at AS completed_at
FROM shop_settlements s LEFT JOIN settlement_transfers t ON t.settlement_id=s.id""")
def _(t):
    return settlement.settlement_status(t)


@query("monthly_revenue", f"""
WITH rates AS ({RATES}),
done AS (SELECT CAST(DATE_TRUNC('month',r.completed_at) AS DATE) AS m, r.shop_id, MIN(q.shop_type) AS shop_type, SUM(r.total_amount) AS gross,
  FLOOR(CAST(SUM(r.total_amount*CAST(COALESCE(q.override_rate,q.type_rate)*100 AS BIGINT)) AS DECIMAL(30,0))*0.0001) AS fee
  FROM reservations r JOIN rates q ON q.shop_id=r.shop_id WHERE r.status='completed' GROUP BY 1,2),
back AS (SELECT CAST(DATE_TRUNC('month',p.refunded_at) AS DATE) AS m, s.shop_type, SUM(p.refund_amount) AS refunds
  FROM payments p JOIN reservations r ON r.id=p.reservation_id JOIN shops s ON s.id=r.shop_id
  WHERE p.refund_amount>0 GROUP BY 1,2),
al AS (SELECT m, shop_type, gross, fee, 0 AS refunds FROM done UNION ALL SELECT m, shop_type, 0, 0, refunds FROM back)
SELECT m AS month, shop_type, CAST(SUM(gross) AS BIGINT) AS gross, CAST(SUM(fee) AS BIGINT) AS commission, CAST(SUM(refunds) AS BIGINT) AS refunds,
  CAST(SUM(gross-fee) AS BIGINT) AS payout_due, CAST(GROUPING(m,shop_type) AS INT) AS level FROM al GROUP BY ROLLUP (m, shop_type)""")
def _(t):
    return settlement.monthly_revenue(t)
