"""Distances on the sphere and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def walking_minutes(km: Column) -> Column:
    """Minutes at 4.8 km/h over a way 1.3 times as long, rounded half up."""
    return F.floor(km * 1.3 / 4.8 * 60 + 0.5).cast("int")


def bounding_box(lat: Column, lng: Column, km: Column) -> dict[str, Column]:
    """The box around a point; no care is taken of poles and the date line (at a pole the box spans all longitudes)."""
    by_lat = km / KM_PER_DEGREE
    width = F.cos(F.radians(lat))
    by_lng = F.when(F.abs(width) < 1e-12, 360.0).otherwise(km / (KM_PER_DEGREE * F.when(F.abs(width) < 1e-12, 1.0).otherwise(width)))
    return {"min_lat": lat - by_lat, "max_lat": lat + by_lat, "min_lng": lng - by_lng, "max_lng": lng + by_lng}


def format_distance(km: Column) -> Column:
    """Metres below 1 km (0.9996 gives 1000 m), else kilometres with one decimal, ties up."""
    metres = F.concat(F.floor(km * 1000 + 0.5).cast("string"), F.lit(" m"))
    return F.when(km < 1, metres).otherwise(F.concat(F.round(km.cast("decimal(38,18)"), 1).cast("decimal(20,1)").cast("string"), F.lit(" km")))


def format_walking_time(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("int")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min walk"))).when(rest == 0, F.concat(hours, F.lit(" hr walk"))).otherwise(F.concat(hours, F.lit(" hr "), rest.cast("string"), F.lit(" min walk")))
