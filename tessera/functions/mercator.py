"""Spherical Web-Mercator as Column expressions.

World coordinates are 32-bit unsigned values held in BIGINT, origin in the
north-west, y downwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LAT = 85.0511


def project(lat: Column, lon: Column, zoom: int = 32) -> tuple[Column, Column]:
    """Tile or world coordinates of a point, truncated towards zero."""
    n, phi = F.lit(float(2**zoom)), lat * F.pi() / 180
    x = n * ((lon + 180) / 360)
    y = n * (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / F.pi()) / 2
    return x.cast("long"), y.cast("long")


def unproject(x: Column, y: Column, zoom: int = 32) -> tuple[Column, Column]:
    """Latitude and longitude of the north-west corner of a cell."""
    n = float(2**zoom)
    lat = F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / n))))
    return lat, 360.0 * x / n - 180.0


def tile_of(world: Column, zoom) -> Column:
    """Tile number on one axis at ``zoom`` (an int or a Column)."""
    bits = (F.lit(32) - zoom).cast("int")
    return F.call_function("shiftrightunsigned", world, bits)


def fraction(world: Column, tile: Column, zoom: int) -> Column:
    """Place within a tile; below 0 or above 1 outside of it."""
    size = float(2 ** (32 - zoom))
    return (world - tile * F.lit(int(size))) / size


def in_range(lat: Column, lon: Column) -> Column:
    """Points that the projection accepts; NaN is not among them."""
    finite = ~F.isnan(lat) & ~F.isnan(lon)
    return finite & lat.between(-MAX_LAT, MAX_LAT) & (lon > -180) & (lon < 180)


def centre_latitude(y: int, zoom: int) -> float:
    """Latitude of the middle of a tile row, in radians."""
    return math.atan(math.sinh(math.pi * (1 - 2 * (y + 0.5) / 2**zoom)))
