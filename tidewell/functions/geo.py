"""Geographic predicates over longitude and latitude columns in degrees; all stay on the JVM side. Null coordinates give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6371008.8


def distance(lon: Column, lat: Column, to_lon: Column, to_lat: Column) -> Column:
    """Metres along a great circle, by the haversine formula."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    h = half(lat, to_lat) + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * half(lon, to_lon)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within_box(lon: Column, lat: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Between the corners low and high (longitude, latitude); plain comparisons, so they reach the scan."""
    return lon.between(low[0], high[0]) & lat.between(low[1], high[1])


def within_circle(lon: Column, lat: Column, centre: tuple[float, float], metres: float) -> Column:
    """A band of latitudes that the scan can prune comes before the distance."""
    band = metres / EARTH_METRES * 57.29577951308232
    return lat.between(centre[1] - band, centre[1] + band) & (distance(lon, lat, F.lit(centre[0]), F.lit(centre[1])) <= metres)


def within_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Inside a ring in the plane: a ray to the east crosses an odd number of its sides."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            at = x1 + (lat - y1) * ((x2 - x1) / (y2 - y1))
            crossed = crossed + F.when(((lat < y1) != (lat < y2)) & (lon < at), 1).otherwise(0)
    return F.when(lon.isNotNull() & lat.isNotNull(), crossed % 2 == 1)
