"""Planar geometry in micro-degrees and miles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Miles in a degree of latitude.
MILES = 69.172


def planar_miles(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Equirectangular distance at the pair's mean latitude; arguments in micro-degrees."""
    dy = (lat_a - lat_b) / F.lit(1e6) * F.lit(MILES)
    dx = (lng_a - lng_b) / F.lit(1e6) * F.lit(MILES) * F.cos(F.radians((lat_a + lat_b) / F.lit(2e6)))
    return F.sqrt(dx * dx + dy * dy)


def half_up(value: Column, places: int) -> Column:
    """A double to ``places`` decimals; what lies within 1e-7 units of the last place below a half goes up, so that the order of summands does not show."""
    scale = 10**places
    return F.floor(value * scale + F.lit(0.5000001)) / scale


def cell(value_u: Column, size_u: int) -> Column:
    """Grid cell number of a coordinate in micro-degrees."""
    return F.floor(value_u / F.lit(size_u)).cast("long")


def along_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Clamped share of segment a-b at which the point's foot lies."""
    dx, dy = bx - ax, by - ay
    norm = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.when(norm > 0, norm)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))


def sine_line(i: Column, n: int, lng0: Column, lat0: Column, lng1: Column, lat1: Column) -> tuple[Column, Column]:
    """(lng_u, lat_u) of step ``i`` of ``n`` on a straight line with two sines across, from degrees to whole micro-degrees."""
    t = i / F.lit(float(n))
    lat = lat0 + (lat1 - lat0) * i / n + F.lit(0.3) * F.sin(t * 30) + F.lit(0.05) * F.sin(t * 137)
    return half_up((lng0 + (lng1 - lng0) * i / n) * 1_000_000, 0).cast("long").alias("lng_u"), half_up(lat * 1_000_000, 0).cast("long").alias("lat_u")
