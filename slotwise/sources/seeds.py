"""Dimension rows that every installation starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Initial settings.
SETTINGS = [
    ("partnered_commission_rate", "8.00", "number", "commission", True),
    ("non_partnered_commission_rate", "10.00", "number", "commission", True),
    ("point_earning_rate", "2.5", "number", "point", True),
    ("point_max_eligible_amount", "300000", "number", "point", True),
    ("point_restriction_days", "7", "number", "point", True),
    ("influencer_point_bonus_rate", "1.5", "number", "point", True),
    ("default_cancellation_hours", "24", "number", "reservation", True),
    ("min_deposit_amount", "10000", "number", "reservation", True),
    ("app_maintenance_mode", "false", "boolean", "app", True),
    ("customer_service_phone", "1588-0000", "string", "app", True),
]

# Initial questions and answers.
FAQS = [
    ("예약", "예약을 취소하고 싶어요",
     "예약 시간 24시간 전까지는 100% 환불이 가능합니다. 마이예약에서 취소 버튼을 눌러주세요.", 1),
    ("예약", "예약금은 얼마인가요?",
     "예약금은 샵과 서비스에 따라 다르며, 보통 전체 금액의 20-30% 정도입니다.", 2),
    ("포인트", "포인트는 언제 사용할 수 있나요?", "포인트는 적립된 날로부터 7일 후에 사용 가능합니다.", 1),
    ("포인트", "포인트 적립률은 얼마인가요?",
     "서비스 이용 금액의 2.5%가 포인트로 적립됩니다. (최대 30만원까지)", 2),
    ("계정", "회원탈퇴는 어떻게 하나요?", "마이페이지 > 설정 > 회원탈퇴에서 진행할 수 있습니다.", 1),
]

# First notice of a new installation; the wording is this project's own.
ANNOUNCEMENTS = [("앱 출시!", "앱이 정식 출시되었습니다.", True, ["user"])]

# Initial settlement schedules (name, period, day, minute of day, approves itself).
SCHEDULES = [
    ("주간 정산 (목요일)", "weekly", 4, 15 * 60, False),
    ("월간 정산 (매월 5일)", "monthly", 5, 14 * 60, False),
]


def _inline(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Rows as an inline SQL table, which the optimizer can see through."""

    def literal(value) -> str:
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, list):
            return f"ARRAY({', '.join(literal(v) for v in value)})"
        return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else str(value)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def settings(spark: SparkSession) -> DataFrame:
    return _inline(spark, SETTINGS, "setting_key, setting_value, value_type, category, is_active")


def faqs(spark: SparkSession) -> DataFrame:
    return _inline(spark, FAQS, "category, question, answer, display_order")


def announcements(spark: SparkSession) -> DataFrame:
    return _inline(spark, ANNOUNCEMENTS, "title, content, is_important, target_user_type")


def schedules(spark: SparkSession) -> DataFrame:
    return _inline(
        spark, SCHEDULES, "schedule_name, settlement_period, schedule_day, schedule_minute, auto_approve"
    ).selectExpr("*", "TRUE AS is_active", "CAST(NULL AS STRING) AS target_shop_type")
