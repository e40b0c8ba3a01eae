"""Coordinate systems: names, axis order, local frames, and closed-form transforms."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid (semi-major axis, inverse flattening) and the parameters of the known systems.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101)}
LATITUDE_FIRST = {4326, 4979, 4258, 4937, 6697}
SPHERE = 6378137.0


class UnknownCrs(LookupError):
    """A system without a closed form here; nothing is approximated."""


@dataclass(frozen=True)
class Crs:
    code: int
    vertical: int | None = None

    @property
    def latitude_first(self) -> bool:
        return self.code in LATITUDE_FIRST

    @property
    def degrees(self) -> bool:
        return self.code in LATITUDE_FIRST


def parse(name: str) -> Crs:
    """A code from EPSG:28992, urn:ogc:def:crs:EPSG::28992, an opengis URL, or a compound of two."""
    codes = re.findall(r"EPSG(?:/|::|:)(?:[\d.]*(?:/|:))?(\d{4,6})", name, flags=re.I)
    if not codes and (found := re.fullmatch(r"\s*EPSG:(\d{4,6})\s*\+\s*(\d{4,6})\s*", name, flags=re.I)):
        codes = list(found.groups())
    if not codes:
        raise UnknownCrs(name)
    return Crs(int(codes[0]), int(codes[1]) if len(codes) > 1 else None)


def same(a: str | None, b: str | None) -> bool:
    """Whether two names mean one system; unknown equals only unknown."""
    return a == b if a is None or b is None else parse(a) == parse(b)


def quantise(value: Column, scale: float, translate: float) -> Column:
    return F.round((value - translate) / scale).cast("bigint")


def metric_frame(latitude: Column) -> tuple[Column, Column]:
    """Metres per degree of longitude and latitude (equirectangular, on the mean sphere)."""
    per_degree = SPHERE * math.pi / 180
    return F.cos(F.radians(latitude)) * per_degree, F.lit(per_degree)


def _utm(code: int) -> tuple[int, bool] | None:
    if 32601 <= code <= 32660:
        return code - 32600, True
    if 32701 <= code <= 32760:
        return code - 32700, False
    if 25828 <= code <= 25838:
        return code - 25800, True
    return None


def _mercator(lon: Column, lat: Column, ellipsoid: str, zone: int, north: bool) -> tuple[Column, Column]:
    """Transverse Mercator by Krueger's series to the third order (millimetres within a zone)."""
    a, inverse = ELLIPSOIDS[ellipsoid]
    f = 1 / inverse
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * radius * x, 0.9996 * radius * y + (0 if north else 10_000_000)


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Plan coordinates from a geographic system (degrees) to Web Mercator or UTM; z is never changed.

    The first coordinate of a latitude-first source is the latitude. Any other pair raises.
    """
    s, t = parse(source), parse(target)
    if s == t:
        return x, y
    if not s.degrees:
        raise UnknownCrs(f"{source} to {target}")
    lon, lat = (y, x) if s.latitude_first else (x, y)
    if t.code == 3857:
        return F.radians(lon) * SPHERE, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * SPHERE
    zone = _utm(t.code)
    if zone is None:
        raise UnknownCrs(f"{source} to {target}")
    return _mercator(lon, lat, "GRS80" if t.code < 26000 else "WGS84", *zone)


def place(point: Column, origin: Column, matrix: Column) -> Column:
    """M v + p of a template's point (struct x, y, z), for a row-major 4 x 4 affine matrix; raises otherwise."""
    m = [F.get(matrix, F.lit(i)) for i in range(16)]
    affine = (F.size(matrix) == 16) & (m[12] == 0) & (m[13] == 0) & (m[14] == 0) & (m[15] == 1)
    values = []
    for k, axis in enumerate("xyz"):
        row = m[4 * k] * point["x"] + m[4 * k + 1] * point["y"] + m[4 * k + 2] * point["z"] + m[4 * k + 3] + origin[axis]
        values.append(F.when(affine, row).otherwise(F.raise_error(F.lit("the matrix is not affine")).cast("double")).alias(axis))
    return F.when(matrix.isNotNull(), F.struct(*values))
