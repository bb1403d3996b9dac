"""Plane and ellipsoid geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80, and the projection's parallels and origin (degrees).
A, FLATTENING = 6_378_137.0, 1 / 298.257222101
PARALLELS, ORIGIN = (29.5, 45.5), (23.0, -96.0)
E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)


def _q(sin: float) -> float:
    return (1 - E2) * (sin / (1 - E2 * sin * sin) - math.log((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


_P1, _P2, _P0 = (math.radians(x) for x in (*PARALLELS, ORIGIN[0]))
_N = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(math.sin(_P2)) - _q(math.sin(_P1)))
_C = _m(_P1) ** 2 + _N * _q(math.sin(_P1))
_RHO0 = A * math.sqrt(_C - _N * _q(math.sin(_P0))) / _N


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude (degrees) to metres in the equal-area conic projection."""
    sin = F.sin(F.radians(lat))
    q = (1 - E2) * (sin / (1 - E2 * sin * sin) - F.log((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))
    rho = A * F.sqrt(_C - _N * q) / _N
    theta = _N * F.radians(lon - ORIGIN[1])
    return rho * F.sin(theta), _RHO0 - rho * F.cos(theta)


def project_on_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(share of the segment 0..1, distance) of the point of a segment that is nearest to (x, y)."""
    dx, dy = x2 - x1, y2 - y1
    share = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return share, F.hypot(x - (x1 + share * dx), y - (y1 + share * dy))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere of the ellipsoid's mean radius; within 0.6 % of the geodesic."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_008.8 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geodesic_near(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the WGS84 ellipsoid between points a few kilometres apart, by the two radii of curvature at the middle
    latitude; of Vincenty's result within a millimetre a kilometre, and JVM-side."""
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    mid = F.radians((lat1 + lat2) / 2)
    w = 1 - e2 * F.sin(mid) ** 2
    north = F.lit(A * (1 - e2)) / (w * F.sqrt(w)) * F.radians(lat2 - lat1)
    east = F.lit(A) / F.sqrt(w) * F.cos(mid) * F.radians(lon2 - lon1)
    return F.hypot(north, east)


def vincenty(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Metres along the WGS84 geodesic, by Vincenty's inverse formula; for single pairs on the driver or in a UDF."""
    if (lon1, lat1) == (lon2, lat2):
        return 0.0
    f, b = 1 / 298.257223563, A * (1 - 1 / 298.257223563)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    span = math.radians(lon2 - lon1)
    lam = span
    for _ in range(200):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2 = 1 - sin_a * sin_a
        mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        new = span + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))
        done, lam = abs(new - lam) < 1e-12, new
        if done:
            break
    k = cos2 * (A * A - b * b) / (b * b)
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    delta = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid * mid - 1) - small / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))
    return b * big * (sigma - delta)
