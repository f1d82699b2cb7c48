"""Great-circle distance and the box that bounds a radius."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Earth radius in metres.
EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    d_lat = F.radians(lat - F.lit(at_lat))
    d_lon = F.radians(lon - F.lit(at_lon))
    h = F.pow(F.sin(d_lat / 2), 2) + F.lit(math.cos(math.radians(at_lat))) * F.cos(F.radians(lat)) * F.pow(
        F.sin(d_lon / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within_radius(lat: Column, lon: Column, at_lat: float, at_lon: float, radius_m: float) -> Column:
    """Inside the radius; null coordinates are outside.

    A latitude band comes first: it is a plain range predicate, so the scan can use column statistics, and it
    spares the trigonometry on most rows. The band is widened a little to stay a superset of the circle.
    """
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * 1.000001 + 1e-9
    band = lat.between(at_lat - reach, at_lat + reach)
    inside = haversine_m(lat, lon, at_lat, at_lon) <= F.lit(float(radius_m))
    return F.coalesce(band & inside, F.lit(False))
