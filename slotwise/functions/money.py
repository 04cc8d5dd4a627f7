"""Exact money arithmetic: whole won as BIGINT, rates as DECIMAL percent."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WIDE = "decimal(20,0)"


def percent_of(amount: Column, rate: Column) -> Column:
    """``amount * rate / 100`` without rounding (dividing by 100 only shifts two digits)."""
    return (amount.cast(WIDE) * rate.cast("decimal(5,2)") * F.lit("0.01").cast("decimal(3,2)")).cast(
        "decimal(30,4)"
    )


def floor_percent_of(amount: Column, rate: Column) -> Column:
    return F.floor(percent_of(amount, rate)).cast("long")


def award_points(amount: Column, percent: Column, cap: Column) -> Column:
    """Points for a purchase: ``percent`` of the amount up to ``cap``, rounded down."""
    eligible = F.least(amount, cap.cast("long"))
    return F.floor(
        eligible.cast(WIDE) * percent.cast("decimal(7,4)") * F.lit("0.01").cast("decimal(3,2)")
    ).cast("long")
