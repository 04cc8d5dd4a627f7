"""Masks and format checks for personal data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Visible prefix of a masked friend id, national mobile number format.
VISIBLE_ID_CHARS = 6
MOBILE_FORMAT = r"^010-[0-9]{4}-[0-9]{4}$"
STARS = "***"


def mask_id(value: Column) -> Column:
    """The first six characters, but never more than half of a short id."""
    return F.substring(value, F.lit(1), F.least(F.lit(VISIBLE_ID_CHARS), F.floor(F.length(value) / 2)).cast("int"))


def mask_name(value: Column) -> Column:
    """The first character of a name; of a name of one character nothing."""
    return F.when(F.length(value) > 1, F.concat(F.substring(value, 1, 1), F.lit(STARS))).when(
        value.isNotNull(), F.lit(STARS)
    )


def mask_phone(value: Column) -> Column:
    """The last two digits of a number that has at least eight, whatever stands between; else nothing."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.concat(F.lit("***-****-**"), F.right(digits, F.lit(2)))).when(
        value.isNotNull(), F.lit(STARS)
    )


def mask_email(value: Column) -> Column:
    """The first character and the domain of an address with one ``@`` and more than one character before it; else nothing."""
    return F.when(
        value.rlike("^[^@]{2,}@[^@]+$"), F.concat(F.substring(value, 1, 1), F.lit(STARS + "@"), F.substring_index(value, "@", -1))
    ).when(value.isNotNull(), F.lit(STARS))


def is_mobile(value: Column) -> Column:
    return F.coalesce(value.rlike(MOBILE_FORMAT), F.lit(False))
