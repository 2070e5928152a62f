"""Tile and distance functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zoom level, tile extent in pixels, earth radius in metres.
ZOOM = 14
EXTENT = 4096
EARTH_RADIUS_M = 6_371_000.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tile_x(lon, zoom: int = ZOOM) -> Column:
    """Tile column of a longitude."""
    return ((_col(lon) + 180.0) / 360.0 * F.lit(float(2**zoom))).cast("int")


def tile_y(lat, zoom: int = ZOOM) -> Column:
    """Tile row of a latitude; NULL where the projection has no value."""
    phi = F.radians(_col(lat))
    mercator = F.ln(F.tan(phi) + 1.0 / F.cos(phi))
    return ((1.0 - mercator / F.pi()) / 2.0 * F.lit(float(2**zoom))).cast("int")


def tile_lon(x, px, zoom: int = ZOOM) -> Column:
    """Longitude of a pixel column inside a tile."""
    return (_col(x) + _col(px) / float(EXTENT)) / F.lit(float(2**zoom)) * 360.0 - 180.0


def tile_lat(y, py, zoom: int = ZOOM) -> Column:
    """Latitude of a pixel row inside a tile, rows counted downwards."""
    turn = 1.0 - 2.0 * (_col(y) + _col(py) / float(EXTENT)) / F.lit(float(2**zoom))
    return F.degrees(F.atan(F.sinh(F.pi() * turn)))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1.0 - a)))


def pixel_x(lon, x, zoom: int = ZOOM) -> Column:
    """Pixel column of a longitude, counted from the left edge of a tile."""
    return ((_col(lon) + 180.0) / 360.0 * F.lit(float(2**zoom)) - _col(x)) * F.lit(float(EXTENT))


def pixel_y(lat, y, zoom: int = ZOOM) -> Column:
    """Pixel row of a latitude, counted from the top edge of a tile."""
    phi = F.radians(_col(lat))
    mercator = F.ln(F.tan(phi) + 1.0 / F.cos(phi))
    return ((1.0 - mercator / F.pi()) / 2.0 * F.lit(float(2**zoom)) - _col(y)) * F.lit(float(EXTENT))


def metres_per_pixel(lat, zoom: int = ZOOM) -> Column:
    """Length of a pixel at a latitude; the projection has the same scale in both directions."""
    whole = 2.0 * math.pi * EARTH_RADIUS_M / (2**zoom * EXTENT)
    return F.cos(F.radians(_col(lat))) * F.lit(whole)
