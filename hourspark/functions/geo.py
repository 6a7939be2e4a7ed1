"""Great-circle geometry, grid cells and coordinate texts as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourspark.functions.numbers import half_even

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
REFERENCE_LAT = -37.81
WALKING_M_PER_MIN = 80.0
POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance; ``radius`` sets the unit."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        half_dlon
    ) * F.sin(half_dlon)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return haversine_m(lon1, lat1, lon2, lat2, EARTH_M / 1000.0)


def metres(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """``haversine_m`` of arrays."""
    half_lat, half_lon = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * np.arcsin(np.sqrt(half_lat * half_lat + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half_lon * half_lon))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing from point 1 to point 2, 0-360 clockwise from north."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_difference(start: Column, end: Column) -> Column:
    """Signed turn from ``start`` to ``end`` in (-180, 180]; positive turns right."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - (end - start), F.lit(360.0))


def cell_degrees(cell_m: float, reference_lat: float = REFERENCE_LAT) -> tuple[float, float]:
    """Cell height and width in degrees for a square cell of ``cell_m`` metres."""
    return cell_m / METRES_PER_DEGREE, cell_m / (METRES_PER_DEGREE * math.cos(math.radians(reference_lat)))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    """Finite and within range; false for null."""
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(inside & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def coordinate_key(lat: Column, lon: Column) -> Column:
    """Struct(lat, lon) at 7 decimals, null when the coordinate is not usable."""
    return F.when(
        valid_coordinate(lat, lon), F.struct(half_even(lat, 7).alias("lat"), half_even(lon, 7).alias("lon"))
    )


def site_id(lat: Column, lon: Column) -> Column:
    """``coord:<lat>:<lon>`` with 7 decimals."""
    key = coordinate_key(lat, lon)
    return F.when(key.isNotNull(), F.format_string("coord:%.7f:%.7f", key["lat"], key["lon"]))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float], keep_missing: bool = False) -> Column:
    """Inside (min_lon, min_lat, max_lon, max_lat), bounds included."""
    min_lon, min_lat, max_lon, max_lat = box
    inside = F.coalesce(lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon), F.lit(False))
    return inside | lat.isNull() | lon.isNull() if keep_missing else inside


@F.pandas_udf(POINT)
def wkb_point(raw: pd.Series) -> pd.DataFrame:
    """Latitude and longitude of WKB points; null for other shapes and short values."""
    lat = np.full(len(raw), np.nan)
    lon = np.full(len(raw), np.nan)
    size = raw.map(lambda v: 0 if v is None else len(v)).to_numpy()
    long_enough = np.flatnonzero(size >= 21)
    if len(long_enough):
        head = np.frombuffer(b"".join(bytes(v[:21]) for v in raw.iloc[long_enough]), np.uint8).reshape(-1, 21)
        for little, order in ((True, "<"), (False, ">")):
            picked = (head[:, 0] == 1) == little
            block = head[picked]
            kind = np.ascontiguousarray(block[:, 1:5]).view(f"{order}u4").ravel()
            xy = np.ascontiguousarray(block[:, 5:21]).view(f"{order}f8").reshape(-1, 2)
            rows = long_enough[picked][kind == 1]
            lon[rows], lat[rows] = xy[kind == 1, 0], xy[kind == 1, 1]
    frame = pd.DataFrame({"lat": lat, "lon": lon})
    return frame.astype(object).where(frame.notna(), None)
