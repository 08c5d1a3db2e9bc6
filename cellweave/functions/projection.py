"""Map projections on an ellipsoid as column expressions: Albers' equal-area conic and the transverse Mercator of UTM.

Albers' follows the closed formulas through the authalic q, its inverse a Newton iteration for the latitude; the
transverse Mercator and its inverse are series in the third flattening up to its fourth power. Formulas as published by
the USGS (Professional Paper 1395) and by Krueger (1912).
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


class Ellipsoid(NamedTuple):
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


# Half axis and flattening.
WGS84, GRS80 = Ellipsoid(6378137.0, 1 / 298.257223563), Ellipsoid(6378137.0, 1 / 298.257222101)


class Albers(NamedTuple):
    """Of the contiguous United States unless said otherwise: origin, standard parallels, in degrees."""

    lat0: float = 23.0
    lon0: float = -96.0
    lat1: float = 29.5
    lat2: float = 45.5
    ellipsoid: Ellipsoid = GRS80

    def constants(self) -> tuple[float, float, float]:
        """n, C and rho of the origin's parallel."""
        e2, a = self.ellipsoid.e2, self.ellipsoid.a
        q = lambda lat: _q(math.sin(math.radians(lat)), e2, math)
        m = lambda lat: math.cos(math.radians(lat)) ** 2 / (1 - e2 * math.sin(math.radians(lat)) ** 2)
        n = (m(self.lat1) - m(self.lat2)) / (q(self.lat2) - q(self.lat1)) if self.lat1 != self.lat2 else math.sin(math.radians(self.lat1))
        c = m(self.lat1) + n * q(self.lat1)
        return n, c, a * math.sqrt(c - n * q(self.lat0)) / n


def _q(s, e2: float, of):
    """The authalic q of a sine of latitude; of: where log is found."""
    e = math.sqrt(e2)
    log = of.log if of is math else F.ln
    return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))


def albers(lon: Column, lat: Column, to: Albers = Albers()) -> Column:  # noqa: B008
    """A struct of x and y in metres; null in, null out."""
    n, c, rho0 = to.constants()
    q = let(F.sin(F.radians(lat)), lambda s: _q(s, to.ellipsoid.e2, F))
    rho = to.ellipsoid.a * F.sqrt(c - n * q) / n
    theta = n * F.radians(lon - to.lon0)
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))


def albers_inverse(x: Column, y: Column, to: Albers = Albers(), steps: int = 5) -> Column:  # noqa: B008
    """A struct of lon and lat in degrees."""
    n, c, rho0 = to.constants()
    e2, sign = to.ellipsoid.e2, math.copysign(1.0, n)
    up = rho0 - y
    q = (c - (x * x + up * up) * (n * n / to.ellipsoid.a**2)) / n

    def nearer(lat: Column, goal: Column) -> Column:
        s = F.sin(lat)
        curve = 1 - e2 * s * s
        return lat + curve * curve / (2 * F.cos(lat)) * ((goal - _q(s, e2, F)) / (1 - e2))

    lat = let(q, lambda goal: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.asin(goal / 2), lambda lat, _: nearer(lat, goal)))
    return F.struct((to.lon0 + F.degrees(F.atan2(sign * x, sign * up)) / n).alias("lon"), F.degrees(lat).alias("lat"))


def _series(ellipsoid: Ellipsoid) -> tuple[float, list[float], list[float], list[float]]:
    """The rectifying radius, and coefficients forward, back and from the conformal latitude."""
    n = ellipsoid.f / (2 - ellipsoid.f)
    n2, n3, n4 = n**2, n**3, n**4
    radius = ellipsoid.a / (1 + n) * (1 + n2 / 4 + n4 / 64)
    forward = [n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440, 61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280]
    back = [n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360, n2 / 48 + n3 / 15 - 437 * n4 / 1440, 17 * n3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280]
    latitude = [2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45, 7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45, 56 * n3 / 15 - 136 * n4 / 35, 4279 * n4 / 630]
    return radius, forward, back, latitude


def central_meridian(lon: Column) -> Column:
    """Of the UTM zone of a longitude."""
    return F.floor((lon + 180) / 6) * 6 - 177


def transverse_mercator(lon: Column, lat: Column, lon0: Column, ellipsoid: Ellipsoid = WGS84, scale: float = 0.9996, east: float = 500_000.0) -> Column:
    """A struct of x and y in metres; y is negative south of the equator."""
    radius, forward, _, _ = _series(ellipsoid)
    e = math.sqrt(ellipsoid.e2)
    t = let(F.sin(F.radians(lat)), lambda s: F.sinh(F.atanh(s) - e * F.atanh(e * s)))
    away = F.radians(lon - lon0)

    def of(tau: Column) -> Column:
        xi, eta = F.atan2(tau, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + tau * tau))

        def summed(p: Column) -> Column:
            u, v = p["u"], p["v"]
            x = v + sum(a * F.cos(2 * k * u) * F.sinh(2 * k * v) for k, a in enumerate(forward, 1))
            y = u + sum(a * F.sin(2 * k * u) * F.cosh(2 * k * v) for k, a in enumerate(forward, 1))
            return F.struct((east + scale * radius * x).alias("x"), (scale * radius * y).alias("y"))

        return let(F.struct(xi.alias("u"), eta.alias("v")), summed)

    return let(t, of)


def transverse_mercator_inverse(x: Column, y: Column, lon0: Column, ellipsoid: Ellipsoid = WGS84, scale: float = 0.9996, east: float = 500_000.0) -> Column:
    """A struct of lon and lat in degrees."""
    radius, _, back, latitude = _series(ellipsoid)
    plane = F.struct((y / (scale * radius)).alias("u"), ((x - east) / (scale * radius)).alias("v"))

    def unwound(p: Column) -> Column:
        u = p["u"] - sum(b * F.sin(2 * k * p["u"]) * F.cosh(2 * k * p["v"]) for k, b in enumerate(back, 1))
        v = p["v"] - sum(b * F.cos(2 * k * p["u"]) * F.sinh(2 * k * p["v"]) for k, b in enumerate(back, 1))
        return F.struct(u.alias("u"), v.alias("v"))

    def of(p: Column) -> Column:
        conformal = F.asin(F.sin(p["u"]) / F.cosh(p["v"]))
        lat = let(conformal, lambda chi: chi + sum(d * F.sin(2 * k * chi) for k, d in enumerate(latitude, 1)))
        return F.struct((lon0 + F.degrees(F.atan2(F.sinh(p["v"]), F.cos(p["u"])))).alias("lon"), F.degrees(lat).alias("lat"))

    return let(let(plane, unwound), of)
