"""National grid coordinates as column expressions: the ellipsoid's transverse Mercator projection and the seven-parameter datum shift, after
the published Ordnance Survey guide."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-axes of the WGS84 and Airy 1830 ellipsoids; the shift WGS84 to OSGB36 (metres, parts per million, arc seconds).
WGS84, AIRY = (6378137.0, 6356752.314245), (6377563.396, 6356256.909)
SHIFT, PPM, TURN = (-446.448, 125.157, -542.060), 20.4894, (-0.1502, -0.2470, -0.8421)
#: Scale, true origin and false origin of the grid.
F0, LAT0, LON0, E0, N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: an expression that names it many times would else hold it as often."""
    return F.transform(F.array(value), body)[0]


def _cartesian(lat: Column, lon: Column, axes) -> tuple[Column, Column, Column]:
    a, b = axes
    e2 = 1 - (b / a) ** 2
    v = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    return v * F.cos(lat) * F.cos(lon), v * F.cos(lat) * F.sin(lon), (1 - e2) * v * F.sin(lat)


def _geographic(x: Column, y: Column, z: Column, axes, rounds: int = 4) -> tuple[Column, Column]:
    a, b = axes
    e2 = 1 - (b / a) ** 2
    p = F.sqrt(x * x + y * y)
    lat = F.atan2(z, p * (1 - e2))
    for _ in range(rounds):
        lat = _let(F.sin(lat), lambda s: F.atan2(z + e2 * a / F.sqrt(1 - e2 * s * s) * s, p))
    return lat, F.atan2(y, x)


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(east, north) in metres of latitude and longitude (radians) on the grid's own ellipsoid."""
    a, b = AIRY
    e2, n = 1 - (b / a) ** 2, (a - b) / (a + b)
    s, c, t = F.sin(lat), F.cos(lat), F.tan(lat)
    v = a * F0 / F.sqrt(1 - e2 * s * s)
    rho = a * F0 * (1 - e2) / F.pow(1 - e2 * s * s, 1.5)
    eta = v / rho - 1
    d, u = lat - LAT0, lat + LAT0
    arc = b * F0 * ((1 + n + 1.25 * (n**2 + n**3)) * d - (3 * (n + n**2) + 2.625 * n**3) * F.sin(d) * F.cos(u) + 1.875 * (n**2 + n**3) * F.sin(2 * d) * F.cos(2 * u) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * u))
    w = lon - LON0
    north = arc + N0 + v / 2 * s * c * w**2 + v / 24 * s * c**3 * (5 - t**2 + 9 * eta) * w**4 + v / 720 * s * c**5 * (61 - 58 * t**2 + t**4) * w**6
    east = E0 + v * c * w + v / 6 * c**3 * (v / rho - t**2) * w**3 + v / 120 * c**5 * (5 - 18 * t**2 + t**4 + 14 * eta - 58 * t**2 * eta) * w**5
    return east, north


def to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(east, north) of WGS84 degrees."""
    x, y, z = _cartesian(F.radians(lat), F.radians(lon), WGS84)
    k, (rx, ry, rz) = 1 + PPM * 1e-6, (math.radians(r / 3600) for r in TURN)
    moved = F.struct((SHIFT[0] + x * k - y * rz + z * ry).alias("x"), (SHIFT[1] + x * rz + y * k - z * rx).alias("y"), (SHIFT[2] - x * ry + y * rx + z * k).alias("z"))
    place = _let(moved, lambda m: F.struct(*[c.alias(n) for c, n in zip(_geographic(m["x"], m["y"], m["z"], AIRY), ("lat", "lon"))]))
    east, north = _let(place, lambda g: project(g["lat"], g["lon"])[0]), _let(place, lambda g: project(g["lat"], g["lon"])[1])
    return east, north


def _meridian(lat, xp):
    a, b = AIRY
    n = (a - b) / (a + b)
    d, u = lat - LAT0, lat + LAT0
    return b * F0 * ((1 + n + 1.25 * (n**2 + n**3)) * d - (3 * (n + n**2) + 2.625 * n**3) * xp.sin(d) * xp.cos(u) + 1.875 * (n**2 + n**3) * xp.sin(2 * d) * xp.cos(2 * u) - 35 / 24 * n**3 * xp.sin(3 * d) * xp.cos(3 * u))


def from_grid(east: Column, north: Column) -> Column:
    """struct<lat, lon> in WGS84 degrees: ``to_grid`` turned round, by repeated correction in vectors, as the projection has no closed inverse."""
    @F.pandas_udf("struct<lat: double, lon: double>")
    def back(e: pd.Series, n: pd.Series) -> pd.DataFrame:
        e, n = e.to_numpy(float), n.to_numpy(float)
        a, b = AIRY
        e2 = 1 - (b / a) ** 2
        lat = LAT0 + (n - N0) / (a * F0)
        for _ in range(12):
            lat = lat + (n - N0 - _meridian(lat, np)) / (a * F0)
        s, c, t = np.sin(lat), np.cos(lat), np.tan(lat)
        v = a * F0 / np.sqrt(1 - e2 * s * s)
        rho = a * F0 * (1 - e2) / (1 - e2 * s * s) ** 1.5
        eta, d = v / rho - 1, e - E0
        own = lat - t / (2 * rho * v) * d**2 + t / (24 * rho * v**3) * (5 + 3 * t**2 + eta - 9 * t**2 * eta) * d**4 - t / (720 * rho * v**5) * (61 + 90 * t**2 + 45 * t**4) * d**6
        lon = LON0 + d / (c * v) - d**3 / (6 * c * v**3) * (v / rho + 2 * t**2) + d**5 / (120 * c * v**5) * (5 + 28 * t**2 + 24 * t**4)
        # To the other ellipsoid: the shift's inverse by the same parameters with their signs turned, corrected until the way there gives where we began.
        w = AIRY[0] / np.sqrt(1 - e2 * np.sin(own) ** 2)
        goal = np.stack([w * np.cos(own) * np.cos(lon), w * np.cos(own) * np.sin(lon), (1 - e2) * w * np.sin(own)])
        k, (rx, ry, rz) = 1 + PPM * 1e-6, (math.radians(r / 3600) for r in TURN)
        turn = np.array([[k, -rz, ry], [rz, k, -rx], [-ry, rx, k]])
        x, y, z = np.linalg.solve(turn, goal - np.array(SHIFT)[:, None])
        a, b = WGS84
        e2 = 1 - (b / a) ** 2
        p = np.hypot(x, y)
        lat = np.arctan2(z, p * (1 - e2))
        for _ in range(6):
            lat = np.arctan2(z + e2 * a / np.sqrt(1 - e2 * np.sin(lat) ** 2) * np.sin(lat), p)
        return pd.DataFrame({"lat": np.degrees(lat), "lon": np.degrees(np.arctan2(y, x))})

    return back(east, north)
