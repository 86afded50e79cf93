"""Coordinate reference systems as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geomatch.constants import METRES_PER_DEGREE, ORIGIN_LAT, ORIGIN_LON

# Codes of the spherical Mercator projection and its radius; geographic NAD83.
_MERCATOR_CODES = ("3857", "3785", "900913", "102113")
_MERCATOR_RADIUS = 6378137.0
_GEOGRAPHIC_CODES = ("4269",)

# Codes of the Dutch national grid (alone, and compound with the height datum), its
# base point, and the published polynomial from grid to WGS84, as (power of dx, power of dy, factor).
_RD_CODES = ("28992", "7415")
_RD_X0, _RD_Y0 = 155000.0, 463000.0
_RD_LAT0, _RD_LON0 = 52.15517440, 5.38720621
_RD_LAT = (
    (0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978),
    (0, 3, -0.06550), (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.00530),
    (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012),
)
_RD_LON = (
    (1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885),
    (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256),
    (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026),
)


def epsg_code(crs: Column, run: str = "first") -> Column:
    """EPSG code from a CRS text: its first digit run, or the last one with ``run='last'``.

    The first run of the URL form ``.../EPSG/0/7415`` is ``0``; the last run is the code.
    """
    runs = F.regexp_extract_all(crs, F.lit("([0-9]+)"), F.lit(1))
    if run == "first":
        return F.get(runs, F.lit(0))
    if run == "last":
        return F.try_element_at(runs, F.lit(-1))
    raise ValueError(f"unknown run {run!r}")


def is_wgs84(crs: Column) -> Column:
    """True for CRS texts whose coordinates are already longitude and latitude."""
    return F.coalesce(F.contains(crs, F.lit("4326")) | F.contains(crs, F.lit("WGS84")), F.lit(False))


def _power(base: Column, n: int) -> Column | None:
    out = None
    for _ in range(n):
        out = base if out is None else out * base
    return out


def _polynomial(terms, dx: Column, dy: Column) -> Column:
    total = None
    for p, q, factor in terms:
        term = F.lit(factor)
        for part in (_power(dx, p), _power(dy, q)):
            term = term if part is None else term * part
        total = term if total is None else total + term
    return total


def to_lonlat(x: Column, y: Column, crs: Column, mode: str = "approximate") -> Column:
    """``struct<lon, lat>`` of a point.

    WGS84 coordinates and spherical Mercator are exact. Every other CRS, and a missing one, uses the
    metres-per-degree approximation around the fixed origin. ``mode='rd_polynomial'`` adds the Dutch
    national grid.
    """
    if mode not in ("approximate", "rd_polynomial"):
        raise ValueError(f"unknown mode {mode!r}")
    code = epsg_code(crs)
    geographic = is_wgs84(crs) | F.coalesce(code.isin(*_GEOGRAPHIC_CODES), F.lit(False))
    mercator = code.isin(*_MERCATOR_CODES)
    lon = F.when(geographic, x).when(mercator, F.degrees(x / _MERCATOR_RADIUS))
    lat = F.when(geographic, y).when(
        mercator, F.degrees(2.0 * F.atan(F.exp(y / _MERCATOR_RADIUS)) - math.pi / 2)
    )
    if mode == "rd_polynomial":
        dutch = epsg_code(crs, "last").isin(*_RD_CODES)
        dx, dy = (x - _RD_X0) * 1e-5, (y - _RD_Y0) * 1e-5
        lon = lon.when(dutch, F.lit(_RD_LON0) + _polynomial(_RD_LON, dx, dy) / 3600.0)
        lat = lat.when(dutch, F.lit(_RD_LAT0) + _polynomial(_RD_LAT, dx, dy) / 3600.0)
    return F.struct(
        lon.otherwise(F.lit(ORIGIN_LON) + x / METRES_PER_DEGREE).alias("lon"),
        lat.otherwise(F.lit(ORIGIN_LAT) + y / METRES_PER_DEGREE).alias("lat"),
    )
