"""Domain data model: columns, value domains, keys and references of every table.

Values here are fixed by the data format and must stay as they are.
"""

from __future__ import annotations

# Value domains.
DOMAINS: dict[str, tuple[str, ...]] = {
    "user_gender": ("male", "female", "other", "prefer_not_to_say"),
    "user_status": ("active", "inactive", "suspended", "deleted"),
    "user_role": ("user", "shop_owner", "admin", "influencer"),
    "social_provider": ("kakao", "apple", "google", "email"),
    "shop_status": ("active", "inactive", "pending_approval", "suspended", "deleted"),
    "shop_type": ("partnered", "non_partnered"),
    "service_category": ("nail", "eyelash", "waxing", "eyebrow_tattoo", "hair"),
    "shop_verification_status": ("pending", "verified", "rejected"),
    "reservation_status": (
        "requested", "confirmed", "completed", "cancelled_by_user", "cancelled_by_shop", "no_show",
    ),
    "payment_status": (
        "pending", "deposit_paid", "fully_paid", "refunded", "partially_refunded", "failed",
    ),
    "payment_method": ("toss_payments", "kakao_pay", "naver_pay", "card", "bank_transfer"),
    "point_transaction_type": (
        "earned_service", "earned_referral", "used_service", "expired", "adjusted", "influencer_bonus",
    ),
    "point_status": ("pending", "available", "used", "expired"),
    "notification_type": (
        "reservation_confirmed", "reservation_cancelled", "point_earned", "referral_success", "system",
    ),
    "notification_status": ("unread", "read", "deleted"),
    "report_reason": ("spam", "inappropriate_content", "harassment", "other"),
    "admin_action_type": (
        "user_suspended", "shop_approved", "shop_rejected", "refund_processed", "points_adjusted",
    ),
    "settlement_status": ("pending", "processing", "completed", "failed", "cancelled"),
    "settlement_period": ("weekly", "bi_weekly", "monthly"),
}

# Documented, but not accepted by the declared domains. Reported apart.
DRIFTED_VALUES: dict[str, tuple[str, ...]] = {
    "notification_type": ("payment_required", "promotion"),
    "report_reason": ("fake_review", "copyright"),
    "admin_action_type": ("post_removed", "review_removed"),
}

# Column -> domain, per table.
ENUM_COLUMNS: dict[str, dict[str, str]] = {
    "users": {
        "gender": "user_gender", "user_status": "user_status", "user_role": "user_role",
        "social_provider": "social_provider",
    },
    "shops": {
        "shop_status": "shop_status", "shop_type": "shop_type", "main_category": "service_category",
        "verification_status": "shop_verification_status",
    },
    "shop_services": {"category": "service_category"},
    "reservations": {"status": "reservation_status"},
    "payments": {"payment_status": "payment_status", "payment_method": "payment_method"},
    "point_transactions": {"transaction_type": "point_transaction_type", "status": "point_status"},
    "notifications": {"notification_type": "notification_type", "status": "notification_status"},
    "content_reports": {"reason": "report_reason"},
    "admin_actions": {"action_type": "admin_action_type"},
    "shop_settlements": {"settlement_status": "settlement_status"},
    "settlement_batches": {"settlement_period": "settlement_period", "status": "settlement_status"},
    "shop_settlement_configs": {"settlement_period": "settlement_period"},
    "settlement_schedules": {"settlement_period": "settlement_period", "target_shop_type": "shop_type"},
    "settlement_details": {"payment_method": "payment_method"},
    "shop_applications": {"main_category": "service_category"},
    "service_category_configs": {"category": "service_category"},
}

# Keys that must be unique, per table.
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "users": (("id",), ("email",), ("phone_number",), ("referral_code",)),
    "user_settings": (("id",), ("user_id",)),
    "shops": (("id",),),
    "shop_services": (("id",),),
    "reservations": (("id",),),
    "reservation_services": (("id",),),
    "payments": (("id",),),
    "point_transactions": (("id",),),
    "point_balances": (("user_id",),),
    "user_favorites": (("id",), ("user_id", "shop_id")),
    "push_tokens": (("id",), ("user_id", "token")),
    "promotions": (("id",), ("promotion_code",)),
    "system_settings": (("id",), ("setting_key",)),
    "app_configs": (("id",), ("config_key",)),
    "shop_settlement_configs": (("id",), ("shop_id",)),
    "settlement_batches": (("id",),),
    "shop_settlements": (("id",), ("settlement_batch_id", "shop_id")),
    "settlement_transfers": (("id",), ("settlement_id",)),
    "shop_operating_hours": (("id",), ("shop_id", "day_of_week")),
    "shop_notification_settings": (("id",), ("shop_id",)),
    "shop_applications": (("id",),),
    "service_category_configs": (("category",),),
}

# (child table, child column) -> (parent table, action when the parent row goes away).
REFERENCES: dict[tuple[str, str], tuple[str, str]] = {
    ("user_settings", "user_id"): ("users", "cascade"),
    ("shops", "owner_id"): ("users", "set_null"),
    ("shop_images", "shop_id"): ("shops", "cascade"),
    ("shop_services", "shop_id"): ("shops", "cascade"),
    ("service_images", "service_id"): ("shop_services", "cascade"),
    ("reservations", "user_id"): ("users", "cascade"),
    ("reservations", "shop_id"): ("shops", "cascade"),
    ("reservation_services", "reservation_id"): ("reservations", "cascade"),
    ("reservation_services", "service_id"): ("shop_services", "restrict"),
    ("payments", "reservation_id"): ("reservations", "cascade"),
    ("payments", "user_id"): ("users", "cascade"),
    ("point_transactions", "user_id"): ("users", "cascade"),
    ("point_transactions", "reservation_id"): ("reservations", "set_null"),
    ("point_transactions", "related_user_id"): ("users", "restrict"),
    ("point_balances", "user_id"): ("users", "cascade"),
    ("user_favorites", "user_id"): ("users", "cascade"),
    ("user_favorites", "shop_id"): ("shops", "cascade"),
    ("notifications", "user_id"): ("users", "cascade"),
    ("push_tokens", "user_id"): ("users", "cascade"),
    ("content_reports", "reporter_id"): ("users", "cascade"),
    ("admin_actions", "admin_id"): ("users", "restrict"),
    ("shop_settlement_configs", "shop_id"): ("shops", "cascade"),
    ("shop_settlements", "settlement_batch_id"): ("settlement_batches", "cascade"),
    ("shop_settlements", "shop_id"): ("shops", "cascade"),
    ("settlement_details", "settlement_id"): ("shop_settlements", "cascade"),
    ("settlement_details", "reservation_id"): ("reservations", "cascade"),
    ("settlement_transfers", "settlement_id"): ("shop_settlements", "cascade"),
    ("settlement_logs", "settlement_id"): ("shop_settlements", "cascade"),
    ("shop_applications", "applicant_id"): ("users", "cascade"),
    ("shop_operating_hours", "shop_id"): ("shops", "cascade"),
    ("reservation_actions", "reservation_id"): ("reservations", "cascade"),
    ("shop_notification_settings", "shop_id"): ("shops", "cascade"),
}

# References to accounts that say nothing of deletion: a row that stays holds the account it names back.
HOLDERS: tuple[tuple[str, str], ...] = (
    ("point_transactions", "related_user_id"), ("content_reports", "reviewed_by"), ("admin_actions", "admin_id"),
    ("system_settings", "created_by"), ("system_settings", "updated_by"), ("app_configs", "created_by"), ("app_configs", "updated_by"),
    ("promotions", "created_by"), ("promotions", "updated_by"), ("settlement_batches", "created_by"),
    ("settlement_schedules", "created_by"), ("settlement_transfers", "approved_by"), ("settlement_logs", "performed_by"),
    ("announcements", "created_by"), ("shop_applications", "reviewed_by"), ("reservation_actions", "performed_by"),
)

# Defaults that a row takes where the column was left out.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {
        "phone_verified": False, "user_role": "user", "user_status": "active", "is_influencer": False,
        "total_points": 0, "available_points": 0, "total_referrals": 0, "successful_referrals": 0,
        "marketing_consent": False,
    },
    "user_settings": {
        "push_notifications_enabled": True, "reservation_notifications": True, "event_notifications": True,
        "marketing_notifications": False, "location_tracking_enabled": True, "language_preference": "ko",
        "currency_preference": "KRW", "theme_preference": "light",
    },
    "shops": {
        "shop_type": "non_partnered", "shop_status": "pending_approval", "verification_status": "pending",
        "total_bookings": 0, "is_featured": False,
    },
    "shop_services": {
        "is_available": True, "booking_advance_days": 30, "cancellation_hours": 24, "display_order": 0,
    },
    "shop_notification_settings": {
        "new_reservation_notification": True, "cancellation_notification": True, "review_notification": True,
        "settlement_notification": True, "email_notifications": True, "sms_notifications": False,
        "notification_start_minute": 540, "notification_end_minute": 1320,
    },
    "promotions": {"usage_limit_per_user": 1, "current_usage": 0, "is_active": True},
    "payments": {"payment_status": "pending", "currency": "KRW", "is_deposit": True, "refund_amount": 0},
}

# Columns that may not be NULL, and longest text allowed.
REQUIRED: dict[str, tuple[str, ...]] = {
    "users": ("id", "name"),
    "shops": ("id", "name", "main_category"),
    "shop_services": ("id", "shop_id", "name", "category"),
    "reservations": ("id", "user_id", "shop_id", "reservation_date", "reservation_minute", "total_amount"),
    "payments": ("id", "reservation_id", "user_id", "payment_method", "amount"),
    "point_transactions": ("id", "user_id", "transaction_type", "amount"),
    "shop_settlements": ("id", "shop_id", "period_start_date"),
}
MAX_LENGTH: dict[str, dict[str, int]] = {
    "users": {"email": 255, "phone_number": 20, "name": 100, "referral_code": 20, "referred_by_code": 20},
    "shops": {"name": 255},
    "shop_services": {"name": 255},
}

_STAMPS = "created_at TIMESTAMP, updated_at TIMESTAMP"
_CREATED = "created_at TIMESTAMP"

# Stored layout. Keys are text, money is BIGINT won, times of day are minutes, JSON stays text.
COLUMNS: dict[str, str] = {
    "users": "id STRING, email STRING, phone_number STRING, phone_verified BOOLEAN, name STRING, "
    "nickname STRING, gender STRING, birth_date DATE, profile_image_url STRING, user_role STRING, "
    "user_status STRING, is_influencer BOOLEAN, influencer_qualified_at TIMESTAMP, social_provider STRING, "
    "social_provider_id STRING, referral_code STRING, referred_by_code STRING, total_points BIGINT, "
    "available_points BIGINT, total_referrals BIGINT, successful_referrals BIGINT, last_login_at TIMESTAMP, "
    f"terms_accepted_at TIMESTAMP, privacy_accepted_at TIMESTAMP, marketing_consent BOOLEAN, {_STAMPS}",
    "user_settings": "id STRING, user_id STRING, push_notifications_enabled BOOLEAN, "
    "reservation_notifications BOOLEAN, event_notifications BOOLEAN, marketing_notifications BOOLEAN, "
    "location_tracking_enabled BOOLEAN, language_preference STRING, currency_preference STRING, "
    f"theme_preference STRING, {_STAMPS}",
    "shops": "id STRING, owner_id STRING, name STRING, description STRING, phone_number STRING, email STRING, "
    "address STRING, detailed_address STRING, postal_code STRING, latitude DECIMAL(10,8), "
    "longitude DECIMAL(11,8), shop_type STRING, shop_status STRING, verification_status STRING, "
    "business_license_number STRING, business_license_image_url STRING, main_category STRING, "
    "sub_categories ARRAY<STRING>, operating_hours STRING, payment_methods ARRAY<STRING>, "
    "kakao_channel_url STRING, total_bookings BIGINT, partnership_started_at TIMESTAMP, "
    f"featured_until TIMESTAMP, is_featured BOOLEAN, commission_rate DECIMAL(5,2), {_STAMPS}",
    "shop_images": "id STRING, shop_id STRING, image_url STRING, alt_text STRING, is_primary BOOLEAN, "
    f"display_order INT, {_CREATED}",
    "shop_services": "id STRING, shop_id STRING, name STRING, description STRING, category STRING, "
    "price_min BIGINT, price_max BIGINT, duration_minutes INT, deposit_amount BIGINT, "
    "deposit_percentage DECIMAL(5,2), is_available BOOLEAN, booking_advance_days INT, "
    f"cancellation_hours INT, display_order INT, {_STAMPS}",
    "service_images": f"id STRING, service_id STRING, image_url STRING, alt_text STRING, display_order INT, {_CREATED}",
    "reservations": "id STRING, user_id STRING, shop_id STRING, reservation_date DATE, reservation_minute INT, "
    "status STRING, total_amount BIGINT, deposit_amount BIGINT, remaining_amount BIGINT, points_used BIGINT, "
    "points_earned BIGINT, special_requests STRING, cancellation_reason STRING, no_show_reason STRING, "
    f"confirmed_at TIMESTAMP, completed_at TIMESTAMP, cancelled_at TIMESTAMP, {_STAMPS}",
    "reservation_services": "id STRING, reservation_id STRING, service_id STRING, quantity INT, "
    f"unit_price BIGINT, total_price BIGINT, {_CREATED}",
    "payments": "id STRING, reservation_id STRING, user_id STRING, payment_method STRING, payment_status STRING, "
    "amount BIGINT, currency STRING, payment_provider STRING, provider_transaction_id STRING, "
    "provider_order_id STRING, is_deposit BOOLEAN, paid_at TIMESTAMP, refunded_at TIMESTAMP, "
    f"refund_amount BIGINT, failure_reason STRING, metadata STRING, {_STAMPS}",
    "point_transactions": "id STRING, user_id STRING, reservation_id STRING, transaction_type STRING, "
    "amount BIGINT, description STRING, status STRING, available_from TIMESTAMP, expires_at TIMESTAMP, "
    f"related_user_id STRING, metadata STRING, {_CREATED}",
    "point_balances": "user_id STRING, total_earned BIGINT, total_used BIGINT, available_balance BIGINT, "
    "pending_balance BIGINT, last_calculated_at TIMESTAMP, updated_at TIMESTAMP",
    "user_favorites": f"id STRING, user_id STRING, shop_id STRING, {_CREATED}",
    "notifications": "id STRING, user_id STRING, notification_type STRING, title STRING, message STRING, "
    "status STRING, related_id STRING, action_url STRING, scheduled_for TIMESTAMP, sent_at TIMESTAMP, "
    f"read_at TIMESTAMP, {_CREATED}",
    "push_tokens": "id STRING, user_id STRING, token STRING, platform STRING, is_active BOOLEAN, "
    f"last_used_at TIMESTAMP, {_CREATED}",
    "content_reports": "id STRING, reporter_id STRING, reported_content_type STRING, reported_content_id STRING, "
    "reason STRING, description STRING, status STRING, reviewed_by STRING, reviewed_at TIMESTAMP, "
    f"resolution_notes STRING, {_CREATED}",
    "admin_actions": "id STRING, admin_id STRING, action_type STRING, target_type STRING, target_id STRING, "
    f"reason STRING, metadata STRING, {_CREATED}",
    "system_settings": "id STRING, setting_key STRING, setting_value STRING, value_type STRING, category STRING, "
    f"description STRING, is_active BOOLEAN, created_by STRING, updated_by STRING, {_STAMPS}",
    "service_category_configs": "id STRING, category STRING, default_commission_rate DECIMAL(5,2), "
    "default_deposit_percentage DECIMAL(5,2), default_cancellation_hours INT, default_booking_advance_days INT, "
    "min_service_duration INT, max_service_duration INT, category_description STRING, is_active BOOLEAN, "
    f"display_order INT, icon_url STRING, {_STAMPS}",
    "app_configs": "id STRING, config_key STRING, platform STRING, config_data STRING, is_active BOOLEAN, "
    f"created_by STRING, updated_by STRING, {_STAMPS}",
    "promotions": "id STRING, promotion_code STRING, title STRING, description STRING, promotion_type STRING, "
    "target_audience STRING, conditions STRING, benefits STRING, usage_limit BIGINT, usage_limit_per_user BIGINT, "
    "current_usage BIGINT, starts_at TIMESTAMP, ends_at TIMESTAMP, is_active BOOLEAN, created_by STRING, "
    f"updated_by STRING, {_STAMPS}",
    "shop_settlement_configs": "id STRING, shop_id STRING, settlement_period STRING, settlement_day INT, "
    "bank_name STRING, bank_account STRING, account_holder STRING, business_registration_number STRING, "
    "tax_invoice_email STRING, commission_rate DECIMAL(5,2), minimum_settlement_amount BIGINT, "
    f"auto_settlement BOOLEAN, is_active BOOLEAN, {_STAMPS}",
    "settlement_batches": "id STRING, batch_name STRING, settlement_period STRING, period_start_date DATE, "
    "period_end_date DATE, total_revenue BIGINT, total_commission BIGINT, total_settlement_amount BIGINT, "
    f"shop_count BIGINT, status STRING, processed_at TIMESTAMP, created_by STRING, {_STAMPS}",
    "shop_settlements": "id STRING, settlement_batch_id STRING, shop_id STRING, period_start_date DATE, "
    "period_end_date DATE, total_bookings BIGINT, completed_bookings BIGINT, cancelled_bookings BIGINT, "
    "gross_revenue BIGINT, commission_rate DECIMAL(5,2), commission_amount BIGINT, adjustment_amount BIGINT, "
    "net_settlement_amount BIGINT, tax_amount BIGINT, settlement_status STRING, bank_transfer_amount BIGINT, "
    f"transfer_fee BIGINT, settled_at TIMESTAMP, settlement_notes STRING, {_STAMPS}",
    "settlement_details": "id STRING, settlement_id STRING, reservation_id STRING, service_amount BIGINT, "
    "commission_rate DECIMAL(5,2), commission_amount BIGINT, net_amount BIGINT, payment_method STRING, "
    f"completed_at TIMESTAMP, {_CREATED}",
    "settlement_schedules": "id STRING, schedule_name STRING, settlement_period STRING, schedule_day INT, "
    "schedule_minute INT, target_shop_type STRING, is_active BOOLEAN, auto_approve BOOLEAN, "
    f"notification_emails ARRAY<STRING>, created_by STRING, {_STAMPS}",
    "settlement_transfers": "id STRING, settlement_id STRING, transfer_status STRING, approved_by STRING, "
    "approved_at TIMESTAMP, transfer_method STRING, bank_name STRING, account_number STRING, "
    "account_holder STRING, transfer_amount BIGINT, transfer_fee BIGINT, external_transfer_id STRING, "
    "transfer_requested_at TIMESTAMP, transfer_completed_at TIMESTAMP, failure_reason STRING, "
    f"admin_notes STRING, retry_count INT, {_STAMPS}",
    "settlement_logs": f"id STRING, settlement_id STRING, action STRING, performed_by STRING, notes STRING, {_CREATED}",
    "announcements": "id STRING, title STRING, content STRING, is_important BOOLEAN, is_active BOOLEAN, "
    f"target_user_type ARRAY<STRING>, starts_at TIMESTAMP, ends_at TIMESTAMP, created_by STRING, {_STAMPS}",
    "faqs": "id STRING, category STRING, question STRING, answer STRING, display_order INT, is_active BOOLEAN, "
    f"view_count BIGINT, helpful_count BIGINT, {_STAMPS}",
    "shop_applications": "id STRING, applicant_id STRING, shop_name STRING, business_license_number STRING, "
    "business_license_image_url STRING, shop_address STRING, detailed_address STRING, phone_number STRING, "
    "main_category STRING, sub_categories ARRAY<STRING>, description STRING, application_status STRING, "
    f"rejection_reason STRING, reviewed_by STRING, reviewed_at TIMESTAMP, approved_shop_id STRING, {_STAMPS}",
    "shop_operating_hours": "id STRING, shop_id STRING, day_of_week INT, is_open BOOLEAN, open_minute INT, "
    f"close_minute INT, break_start_minute INT, break_end_minute INT, {_STAMPS}",
    "reservation_actions": "id STRING, reservation_id STRING, action STRING, performed_by STRING, reason STRING, "
    f"previous_status STRING, new_status STRING, {_CREATED}",
    "shop_notification_settings": "id STRING, shop_id STRING, new_reservation_notification BOOLEAN, "
    "cancellation_notification BOOLEAN, review_notification BOOLEAN, settlement_notification BOOLEAN, "
    "email_notifications BOOLEAN, sms_notifications BOOLEAN, notification_start_minute INT, "
    f"notification_end_minute INT, {_STAMPS}",
}

# What the jobs read beyond the data model above, declared by this project: where users are, what they think of a visit,
# and who used which promotion.
COLUMNS["users"] += ", latitude DECIMAL(10,8), longitude DECIMAL(11,8)"
OWN_COLUMNS: dict[str, str] = {
    "reviews": "id STRING, reservation_id STRING, user_id STRING, shop_id STRING, rating INT, created_at TIMESTAMP",
    "promotion_usages": "id STRING, promotion_id STRING, user_id STRING, used_at TIMESTAMP",
}

# Tables that are only ever added to, batch by batch.
LOGS: tuple[str, ...] = ("admin_actions", "settlement_logs", "reservation_actions")

# Tables that grow with time, and the date they are laid out by on disk.
PARTITION_DATE: dict[str, str] = {
    "reservations": "reservation_date",
    "payments": "created_at",
    "point_transactions": "created_at",
    "notifications": "created_at",
    "settlement_details": "completed_at",
    "admin_actions": "created_at",
    "settlement_logs": "created_at",
    "reservation_actions": "created_at",
}
