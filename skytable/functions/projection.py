"""Map projections as Column expressions: UTM (Krueger series), Web Mercator, equal-area.

All angles are degrees at the surface of these functions and radians inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids as (semi-major axis, inverse flattening).
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0


class _Series:
    """Constants of the fourth-order Krueger series for one ellipsoid."""

    def __init__(self, ellipsoid: tuple[float, float]):
        a, inverse = ellipsoid
        f = 1 / inverse
        n = f / (2 - f)
        self.radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.eccentric = 2 * math.sqrt(n) / (1 + n)
        self.forward = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )
        self.backward = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )
        self.latitude = (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        )


_SERIES = {"WGS84": _Series(WGS84), "GRS80": _Series(GRS80)}


def utm_zone(lon: Column) -> Column:
    """Zone 1..60 of a longitude."""
    zone = F.floor((lon + 180) / 6) + 1
    return F.least(zone, F.lit(60)).cast("int")


def utm_epsg(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """EPSG code of the WGS 84 zone at the west edge; north when the south edge is not below zero.

    A box outside of the UTM range (80 S to 84 N) has no zone and gives null.
    """
    inside = (max_lat > -80) & (min_lat < 84) & min_lon.between(-180, 180) & max_lon.between(-180, 180)
    base = F.when(min_lat >= 0, F.lit(32600)).otherwise(F.lit(32700))
    return F.when(inside, base + utm_zone(min_lon))


def to_utm(lon: Column, lat: Column, zone: Column, south: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Easting and northing in meters."""
    return utm_plane(*utm_angles(lon, lat, zone, ellipsoid), south, ellipsoid)


def utm_angles(lon: Column, lat: Column, zone: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """The two spherical angles that the series starts from."""
    k = _SERIES[ellipsoid]
    phi = F.radians(lat)
    away = F.radians(lon - (zone * 6.0 - 183.0))
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - k.eccentric * F.atanh(k.eccentric * sine))
    return F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))


def utm_plane(xi: Column, eta: Column, south: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Easting and northing from the two angles."""
    k = _SERIES[ellipsoid]
    east, north = eta, xi
    for j, alpha in enumerate(k.forward, start=1):
        east = east + alpha * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        north = north + alpha * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    shift = F.when(south, F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    return FALSE_EASTING + UTM_SCALE * k.radius * east, shift + UTM_SCALE * k.radius * north


def from_utm(x: Column, y: Column, zone: Column, south: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi, eta = utm_start(x, y, south, ellipsoid)
    return sphere_lonlat(*sphere_angles(xi, eta, ellipsoid), zone, ellipsoid)


def utm_start(x: Column, y: Column, south: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Scaled northing and easting that the backward series starts from."""
    k = _SERIES[ellipsoid]
    shift = F.when(south, F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    return (y - shift) / (UTM_SCALE * k.radius), (x - FALSE_EASTING) / (UTM_SCALE * k.radius)


def sphere_angles(xi0: Column, eta0: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Angles on the sphere after the backward series."""
    xi, eta = xi0, eta0
    for j, beta in enumerate(_SERIES[ellipsoid].backward, start=1):
        xi = xi - beta * F.sin(2.0 * j * xi0) * F.cosh(2.0 * j * eta0)
        eta = eta - beta * F.cos(2.0 * j * xi0) * F.sinh(2.0 * j * eta0)
    return xi, eta


def sphere_lonlat(xi: Column, eta: Column, zone: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Longitude and latitude in degrees from the angles on the sphere."""
    lon = zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
    return lon, geodetic_latitude(F.asin(F.sin(xi) / F.cosh(eta)), ellipsoid)


def geodetic_latitude(chi: Column, ellipsoid: str = "WGS84") -> Column:
    """Latitude in degrees from the conformal one."""
    phi = chi
    for j, delta in enumerate(_SERIES[ellipsoid].latitude, start=1):
        phi = phi + delta * F.sin(2.0 * j * chi)
    return F.degrees(phi)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator meters."""
    a = WGS84[0]
    return a * F.radians(lon), a * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    a = WGS84[0]
    return F.degrees(x / a), F.degrees(2 * F.atan(F.exp(y / a)) - math.pi / 2)


def crs_error(epsg: Column) -> Column:
    """Message for a target system without a projection here, or null."""
    known = (
        epsg.isin(4326, 4258, 3857)
        | epsg.between(32601, 32660)
        | epsg.between(32701, 32760)
        | epsg.between(25828, 25838)
    )
    return F.when(~known, F.concat(F.lit("unsupported CRS EPSG:"), epsg.cast("string")))


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude to a supported target system."""
    if epsg in (4326, 4258):
        return lon, lat
    if epsg == 3857:
        return to_mercator(lon, lat)
    zone, south, ellipsoid = utm_parts(epsg)
    return to_utm(lon, lat, F.lit(float(zone)), F.lit(south), ellipsoid)


def unproject(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Back from a supported system to longitude and latitude."""
    if epsg in (4326, 4258):
        return x, y
    if epsg == 3857:
        return from_mercator(x, y)
    zone, south, ellipsoid = utm_parts(epsg)
    return from_utm(x, y, F.lit(float(zone)), F.lit(south), ellipsoid)


def utm_parts(epsg: int) -> tuple[int, bool, str]:
    for low, high, south, ellipsoid in (
        (32601, 32660, False, "WGS84"),
        (32701, 32760, True, "WGS84"),
        (25828, 25838, False, "GRS80"),
    ):
        if low <= epsg <= high:
            return epsg % 100, south, ellipsoid
    raise ValueError(f"unsupported CRS EPSG:{epsg}")


def authalic(lat: Column) -> Column:
    """Latitude on the sphere of equal area, in radians."""
    f = 1 / WGS84[1]
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q(sine):
        return (1 - e2) * (sine / (1 - e2 * sine * sine) - F.log((1 - e * sine) / (1 + e * sine)) / (2 * e))

    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q(F.sin(F.radians(lat))) / _polar_q())))


def _polar_q() -> float:
    f = 1 / WGS84[1]
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    return (1 - e2) * (1 / (1 - e2) - math.log((1 - e) / (1 + e)) / (2 * e))


def authalic_radius() -> float:
    """Radius of the sphere of equal area."""
    return WGS84[0] * math.sqrt(_polar_q() / 2)


def equal_area(lon: Column, beta: Column, lon0: Column, beta0: Column) -> tuple[Column, Column]:
    """Azimuthal equal-area plane about (lon0, beta0); betas are authalic radians."""
    away = F.radians(lon - lon0)
    cosine = F.sin(beta0) * F.sin(beta) + F.cos(beta0) * F.cos(beta) * F.cos(away)
    k = authalic_radius() * F.sqrt(2.0 / (1.0 + cosine))
    x = k * F.cos(beta) * F.sin(away)
    y = k * (F.cos(beta0) * F.sin(beta) - F.sin(beta0) * F.cos(beta) * F.cos(away))
    return x, y
