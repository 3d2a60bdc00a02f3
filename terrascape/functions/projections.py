"""Map projections as columns: from longitude and latitude in degrees to metres and back, on the ellipsoid.

Transverse Mercator by Krueger's series in the third flattening, conformal and equal-area conics
in closed form with series for the way back, and the sphere's Mercator of web maps. Errors of a
way there and back are below a millimetre. Reference systems on WGS84, GRS80 or datums that
were made to agree with them to about a metre count as one datum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis in metres and inverse flattening.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101)}
#: Longitude and latitude in degrees.
GEOGRAPHIC = (4326, 4258, 4269, 4283, 7844, 4167)
#: Kind, ellipsoid, standard parallels, latitude and longitude of the origin, false easting and northing.
CONICS = {
    2154: ("conformal", "GRS80", 44.0, 49.0, 46.5, 3.0, 700000.0, 6600000.0),
    3034: ("conformal", "GRS80", 35.0, 65.0, 52.0, 10.0, 4000000.0, 2800000.0),
    3112: ("conformal", "GRS80", -18.0, -36.0, 0.0, 134.0, 0.0, 0.0),
    3577: ("equal-area", "GRS80", -18.0, -36.0, 0.0, 132.0, 0.0, 0.0),
    5070: ("equal-area", "GRS80", 29.5, 45.5, 23.0, -96.0, 0.0, 0.0),
}
#: First and last code of zones, number of the first, ellipsoid, false northing.
ZONES = ((32601, 32660, 1, "WGS84", 0.0), (32701, 32760, 1, "WGS84", 1e7), (25828, 25838, 28, "GRS80", 0.0), (26901, 26923, 1, "GRS80", 0.0), (28348, 28358, 48, "GRS80", 1e7), (7846, 7859, 46, "GRS80", 1e7))

#: Series in the third flattening, by multiples of the angle and then by its powers from the first one with a term.
TO_PLANE = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
FROM_PLANE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
FROM_CONFORMAL = ((2.0, -2 / 3, -2.0, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))
FROM_AUTHALIC = ((4 / 3, 4 / 45, -16 / 35, -2582 / 14175), (46 / 45, 152 / 945, -11966 / 14175), (3044 / 2835, 3802 / 14175), (6059 / 4725,))


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def e(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    def series(self, table: tuple[tuple[float, ...], ...]) -> list[float]:
        return [sum(c * self.n ** (j + 1 + k) for k, c in enumerate(row)) for j, row in enumerate(table)]

    def latitude(self, other: Column, table: tuple[tuple[float, ...], ...]) -> Column:
        """Latitude of an auxiliary one; radians."""
        out = other
        for j, c in enumerate(self.series(table), 1):
            out = out + c * F.sin(2 * j * other)
        return out


class Geographic:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


class WebMercator:
    a = 6378137.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return self.a * F.radians(lon), self.a * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(x / self.a), F.degrees(2 * F.atan(F.exp(y / self.a)) - math.pi / 2)


@dataclass(frozen=True)
class TransverseMercator:
    ellipsoid: Ellipsoid
    lon0: float
    northing: float
    easting: float = 500000.0
    scale: float = 0.9996

    @property
    def radius(self) -> float:
        n = self.ellipsoid.n
        return self.scale * self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, s, away = self.ellipsoid.e, F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi0, eta0 = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
        xi, eta = xi0, eta0
        for j, c in enumerate(self.ellipsoid.series(TO_PLANE), 1):
            xi, eta = xi + c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0), eta + c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        return self.easting + self.radius * eta, self.northing + self.radius * xi

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        xi0, eta0 = (y - self.northing) / self.radius, (x - self.easting) / self.radius
        xi, eta = xi0, eta0
        for j, c in enumerate(self.ellipsoid.series(FROM_PLANE), 1):
            xi, eta = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0), eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        lat = self.ellipsoid.latitude(F.asin(F.sin(xi) / F.cosh(eta)), FROM_CONFORMAL)
        return self.lon0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


@dataclass(frozen=True)
class Conic:
    ellipsoid: Ellipsoid
    equal_area: bool
    parallels: tuple[float, float]
    origin: tuple[float, float]
    false: tuple[float, float]

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (self.ellipsoid.e * math.sin(lat)) ** 2)

    def _t(self, lat: float) -> float:
        e, s = self.ellipsoid.e, math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    def _q(self, lat: float) -> float:
        e, s = self.ellipsoid.e, math.sin(lat)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e)

    @property
    def cone(self) -> tuple[float, float, float]:
        """The cone's constant, the factor of its radii, and the radius at the origin."""
        one, two, lat0 = (math.radians(v) for v in (*self.parallels, self.origin[0]))
        if self.equal_area:
            n = (self._m(one) ** 2 - self._m(two) ** 2) / (self._q(two) - self._q(one))
            c = self._m(one) ** 2 + n * self._q(one)
            return n, c, self.ellipsoid.a * math.sqrt(c - n * self._q(lat0)) / n
        n = math.log(self._m(one) / self._m(two)) / math.log(self._t(one) / self._t(two))
        c = self.ellipsoid.a * self._m(one) / (n * self._t(one) ** n)
        return n, c, c * self._t(lat0) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        (n, c, rho0), e, s = self.cone, self.ellipsoid.e, F.sin(F.radians(lat))
        if self.equal_area:
            q = (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)
            rho = self.ellipsoid.a / n * F.sqrt(c - n * q)
        else:
            t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
            rho = c * F.pow(t, F.lit(n))
        turn = n * F.radians(lon - self.origin[1])
        return self.false[0] + rho * F.sin(turn), self.false[1] + rho0 - rho * F.cos(turn)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        (n, c, rho0), sign = self.cone, math.copysign(1.0, self.cone[0])
        dx, dy = x - self.false[0], rho0 - (y - self.false[1])
        rho, turn = sign * F.sqrt(dx * dx + dy * dy), F.atan2(sign * dx, sign * dy)
        if self.equal_area:
            q = (c - (rho * n / self.ellipsoid.a) ** 2) / n
            lat = self.ellipsoid.latitude(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / self._q(math.pi / 2)))), FROM_AUTHALIC)
        else:
            lat = self.ellipsoid.latitude(math.pi / 2 - 2 * F.atan(F.pow(rho / c, F.lit(1 / n))), FROM_CONFORMAL)
        return self.origin[1] + F.degrees(turn / n), F.degrees(lat)


def projection(crs: str):
    """The projection of a reference system as epsg() writes it; ValueError for one that isn't known."""
    head, _, code = crs.partition(":")
    number = int(code) if head == "EPSG" and code.isdigit() else -1
    if number in GEOGRAPHIC:
        return Geographic()
    if number == 3857:
        return WebMercator()
    for first, last, zone, name, northing in ZONES:
        if first <= number <= last:
            return TransverseMercator(Ellipsoid(*ELLIPSOIDS[name]), -183.0 + 6.0 * (zone + number - first), northing)
    if number in CONICS:
        kind, name, one, two, lat0, lon0, x0, y0 = CONICS[number]
        return Conic(Ellipsoid(*ELLIPSOIDS[name]), kind == "equal-area", (one, two), (lat0, lon0), (x0, y0))
    raise ValueError(f"no projection for {crs}")
