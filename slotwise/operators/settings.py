"""Key/value settings as typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: rate used when a setting is not there at all.
FALLBACK_COMMISSION = "10.00"


def settings_typed(settings: DataFrame) -> DataFrame:
    """Active settings with one column per value type; text that does not parse gives NULL."""
    value, kind = F.col("setting_value"), F.col("value_type")
    return settings.filter("is_active").select(
        "setting_key",
        "category",
        "value_type",
        F.when(kind == "string", value).alias("text_value"),
        F.when(kind == "number", value.try_cast("decimal(18,4)")).alias("number_value"),
        F.when(kind == "boolean", value.try_cast("boolean")).alias("boolean_value"),
        F.when(kind == "json", value).alias("json_value"),
    )


def setting_text(requests: DataFrame, settings: DataFrame) -> DataFrame:
    """Text of each requested key, empty where there is no active setting."""
    active = settings.filter("is_active").select("setting_key", "setting_value")
    return requests.join(active, "setting_key", "left").select(
        *requests.columns, F.coalesce("setting_value", F.lit("")).alias("setting_text")
    )


def setting_number(requests: DataFrame, settings: DataFrame) -> DataFrame:
    """Number of each requested key, 0 where there is no active number of that name."""
    numbers = settings.filter(F.col("is_active") & (F.col("value_type") == "number")).select(
        "setting_key", F.col("setting_value").try_cast("decimal(18,4)").alias("number")
    )
    return requests.join(numbers, "setting_key", "left").select(
        *requests.columns,
        F.coalesce("number", F.lit(0)).cast("decimal(18,4)").alias("setting_number"),
    )


def number(settings: DataFrame, key: str, default: str | None = None) -> Column:
    """One numeric setting as a scalar subquery; ``default`` where the key is absent."""
    row = settings.filter(
        (F.col("setting_key") == key) & (F.col("value_type") == "number") & F.col("is_active")
    ).agg(F.max(F.col("setting_value").try_cast("decimal(18,4)")).alias("v"))
    value = row.scalar()
    return value if default is None else F.coalesce(value, F.lit(default).cast("decimal(18,4)"))


def commission_by_type(shop_type: Column, settings: DataFrame) -> Column:
    """Percent commission for a shop type; anything but partnered pays the other rate."""
    return (
        F.when(shop_type == "partnered", number(settings, "partnered_commission_rate", FALLBACK_COMMISSION))
        .otherwise(number(settings, "non_partnered_commission_rate", FALLBACK_COMMISSION))
        .cast("decimal(5,2)")
    )


def settings_summary(settings: DataFrame) -> DataFrame:
    """Per category: how many settings, how many active, last change."""
    return (
        settings.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("setting_count"),
            F.count_if("is_active").alias("active_count"),
            F.max("updated_at").alias("last_updated"),
        )
        .orderBy("category")
    )
