"""Great-circle distance and nested square cells over latitude and longitude."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.195


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon), F.lit(2)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def cell_degrees(level: int) -> float:
    """Edge of a cell; level 0 is one cell for the globe, each level halves the edge."""
    return 360.0 / (1 << level)


def row_cell(lat: Column, level: int) -> Column:
    return F.floor((lat + 90.0) / cell_degrees(level)).cast("int")


def column_cell(lon: Column, level: int) -> Column:
    """The meridian at 180 degrees is that at -180."""
    return F.pmod(F.floor((lon + 180.0) / cell_degrees(level)).cast("int"), F.lit(1 << level))
