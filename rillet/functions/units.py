"""Units, transforms of a level, and grids of hours and longitudes, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vapour_pressure, wind_at_2m

KELVIN = 273.15


def MONTH_SECONDS(month: Column) -> Column:  # noqa: N802  a constant but for the month's length
    return F.dayofmonth(F.last_day(month)) * 86400


def millimetres(metres: Column) -> Column:
    """Of an accumulated depth; rounding below nothing is nothing."""
    return F.greatest(metres * 1000, F.lit(0.0))


def megajoules(joules: Column) -> Column:
    return F.greatest(joules / 1e6, F.lit(0.0))


def celsius(kelvin: Column) -> Column:
    return kelvin - KELVIN


def log_flow(flow: Column, eps: float) -> Column:
    return F.ln(flow + eps)


def flow(log: Column, eps: float) -> Column:
    """Back from ``log_flow``, and never below nothing."""
    return F.greatest(F.exp(log) - eps, F.lit(0.0))


def wind_speed(east: Column, north: Column) -> Column:
    return F.hypot(east, north)


def closed_month(month: Column, today: Column) -> Column:
    """Whether all of a month's days are over."""
    return F.last_day(month) < today


def grid_longitude(lon: Column, wide: bool) -> Column:
    """A longitude as a grid has it: 0 to 360 (``wide``), or -180 to 180."""
    return F.pmod(lon, F.lit(360.0)) if wide else F.pmod(lon + 180, F.lit(360.0)) - 180


def midnight_steps(hour: Column, days: int, most: int) -> Column:
    """Hours from a run at ``hour`` to the midnights that bound ``days`` days, up to ``most``."""
    first = F.pmod(24 - hour, F.lit(24))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(days)), lambda k: first + 24 * k), lambda s: s <= most)


def additive_band(mid: Column, variance: Column, sigma: Column, alpha: Column, tau: Column, sd_end: Column, to_end: Column, to_month: Column, gap: Column, z: float = 1.2815515594) -> tuple[Column, Column, Column]:
    """(low, mid, high) of a month: mid, and z standard deviations of three independent parts: the noise of ``to_month`` days since the last
    observation, the climate's ``variance``, and what the forecast's end (sd_end, ``to_end`` days out, its noise taken off) leaves after ``gap`` days
    of forgetting by ``tau``."""
    grown = lambda days: sigma * sigma * (1 - F.exp(-2 * F.greatest(days, F.lit(0.0)) / F.greatest(alpha, F.lit(1e-6))))
    state = F.greatest(sd_end * sd_end - grown(to_end), F.lit(0.0))
    sd = F.sqrt(F.greatest(grown(to_month) + variance + state * F.exp(-2 * F.greatest(gap, F.lit(0.0)) / F.greatest(tau, F.lit(1e-6))), F.lit(0.0)))
    return mid - z * sd, mid, mid + z * sd


def penman_monteith(tmin: Column, tmax: Column, dew: Column, wind10: Column, sun: Column, lat: Column, day: Column, height: Column) -> Column:
    """Reference evapotranspiration in mm a day by the published FAO-56 formulas: degrees Celsius, m/s at 10 m, MJ/m2 of short waves, degrees north,
    day of the year, metres above the sea."""
    mean, wind, vapour = (tmin + tmax) / 2, wind_at_2m(wind10), vapour_pressure(dew)
    slope = 4098 * vapour_pressure(mean) / F.pow(mean + 237.3, 2)
    gamma = 0.000665 * 101.3 * F.pow((293 - 0.0065 * height) / 293, 5.26)
    turn = 2 * math.pi * day / 365
    tilt, phi = 0.409 * F.sin(turn - 1.39), F.radians(lat)
    sunset = F.acos(F.least(F.greatest(-F.tan(phi) * F.tan(tilt), F.lit(-1.0)), F.lit(1.0)))
    top = 24 * 60 / math.pi * 0.082 * (1 + 0.033 * F.cos(turn)) * (sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset))
    clear = F.least(F.try_divide(sun, (0.75 + 2e-5 * height) * top), F.lit(1.0))
    long_waves = 4.903e-9 * (F.pow(tmax + 273.16, 4) + F.pow(tmin + 273.16, 4)) / 2 * (0.34 - 0.14 * F.sqrt(vapour)) * (1.35 * clear - 0.35)
    short = 0.77 * sun
    lack = (vapour_pressure(tmin) + vapour_pressure(tmax)) / 2 - vapour
    return F.greatest((0.408 * slope * (short - long_waves) + gamma * 900 / (mean + 273) * wind * lack) / (slope + gamma * (1 + 0.34 * wind)), F.lit(0.0))


def lower_gamma(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function, by its series below n + 1 and a continued fraction above (published forms)."""
    n, x = np.asarray(n, float), np.maximum(np.asarray(x, float), 1e-300)
    scale = np.exp(-x + n * np.log(x) - np.array([math.lgamma(v) for v in n]))
    term = total = 1 / n
    for k in range(1, 400):
        term = term * x / (n + k)
        total = total + term
    b = x + 1 - n
    c, d = np.full_like(x, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d.copy()
    for i in range(1, 400):
        a, b = -i * (i - n), b + 2
        d = 1 / np.where(np.abs(a * d + b) < 1e-300, 1e-300, a * d + b)
        c = b + a / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
    return np.where(x < n + 1, scale * total, 1 - scale * h)


@F.pandas_udf(T.DoubleType())
def memory_days(n: pd.Series, a: pd.Series, alpha: pd.Series) -> pd.Series:
    """How long a level's anomaly lasts: the later of the time by which a Gamma response (shape n, scale a) has given 95 %, by bisection, and the noise's own
    ``alpha``; 30 to 2000 days, and 30 where neither is known."""
    k, scale, noise = n.to_numpy(float), a.to_numpy(float), np.nan_to_num(alpha.to_numpy(float), nan=0.0, posinf=0.0)
    sound = np.isfinite(k) & np.isfinite(scale) & (k > 0) & (scale > 0)
    k = np.where(sound, k, 1.0)
    low, high = np.zeros(len(k)), k + 60 * np.sqrt(k) + 60
    for _ in range(80):
        mid = (low + high) / 2
        under = lower_gamma(k, mid) < 0.95
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    days = np.maximum(np.where(sound, scale * high, 0.0), noise)
    return pd.Series(np.clip(np.where(days > 0, days, 30.0), 30.0, 2000.0), index=n.index)
