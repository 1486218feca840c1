"""Distances on the globe as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = math.pi * EARTH_KM / 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance between two points given in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _row(lat: Column, km: float) -> Column:
    # a hair more than the radius, so that rounding never moves a partner two rows away
    return F.floor((lat + 90) / (km / KM_PER_DEGREE * 1.000001))


def _cells_around(row: Column, km: float) -> Column:
    """Number of cells in a latitude row; each is at least `km` wide on the row's narrower neighbours too."""
    step = km / KM_PER_DEGREE * 1.000001
    edge = F.greatest(F.abs((row - 1) * step - 90), F.abs((row + 2) * step - 90))
    width = F.lit(KM_PER_DEGREE) * F.cos(F.radians(F.least(edge, F.lit(90.0))))
    # the parallel between two meridians is longer than the great circle: under 1 % with 16 cells or more
    cells = F.floor(F.lit(360.0) * width / F.lit(km * 1.01)).cast("bigint")
    return F.when(cells < 16, F.lit(1)).otherwise(cells)


def _column_of(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / F.lit(360.0) * cells).cast("bigint"), cells)


def cell(lat: Column, lon: Column, km: float) -> Column:
    """Grid cell of a point: (latitude row, longitude column)."""
    row = _row(lat, km)
    return F.struct(row.cast("bigint").alias("r"), _column_of(lon, _cells_around(row, km)).alias("c"))


def neighbour_cells(lat: Column, lon: Column, km: float) -> Column:
    """The cells in which points closer than `km` can lie: three rows, three columns in each."""
    own = _row(lat, km)
    cells = []
    for shift in (-1, 0, 1):
        row = own + shift
        around = _cells_around(row, km)
        column = _column_of(lon, around)
        cells += [
            F.struct(row.cast("bigint").alias("r"), F.pmod(column + step, around).alias("c")) for step in (-1, 0, 1)
        ]
    return F.array_distinct(F.array(*cells))
