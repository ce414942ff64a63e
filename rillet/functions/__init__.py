"""Column expressions: no shuffle, no Python on executors."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def total(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def sound(c: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def day(ts: Column) -> Column:
    return F.to_date(ts)


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def water_year(date: Column) -> Column:
    """October starts the next one."""
    return F.year(date) + F.when(F.month(date) >= 10, 1).otherwise(0)


def season_day(date: Column) -> Column:
    """Day of a 365-day year; 29 February counts as 28."""
    leap = ((F.year(date) % 4 == 0) & (F.year(date) % 100 != 0)) | (F.year(date) % 400 == 0)
    return F.dayofyear(date) - F.when(leap & (F.dayofyear(date) >= 60), 1).otherwise(0)


def seasonality(date: Column) -> dict[str, Column]:
    x = 2 * math.pi * F.dayofyear(date) / 365.25
    return {"season_sin": F.sin(x), "season_cos": F.cos(x)}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


#: Edges up to which a ring is an expression of its own; one of more edges is a literal array of them.
FEW_EDGES = 64


def _edges(ring: list[tuple[float, float]]) -> Column:
    """The edges that aren't level, as one literal of each coordinate."""
    edges = [(a, b) for a, b in zip(ring, [*ring[1:], ring[0]]) if a[1] != b[1]]
    numbers = np.array([[*a, *b] for a, b in edges], float).reshape(-1, 4)
    return F.arrays_zip(*[F.lit(np.ascontiguousarray(numbers[:, i])).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a closed or open ring of (lon, lat)."""
    if len(ring) > FEW_EDGES:
        crosses = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (lat - e["y1"]) * ((e["x2"] - e["x1"]) / (e["y2"] - e["y1"])) + e["x1"])
        return F.aggregate(_edges(ring), F.lit(False), lambda odd, e: odd != crosses(e))
    edges = [(a, b) for a, b in zip(ring, [*ring[1:], ring[0]]) if a != b]
    crossed = [F.when(((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (lat - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1)) + F.lit(x1)), 1).otherwise(0) for (x1, y1), (x2, y2) in edges if y1 != y2]
    return total(crossed) % 2 == 1


def in_polygon(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """In the outer ring and in none of the holes."""
    inside = in_ring(lon, lat, rings[0])
    for hole in rings[1:]:
        inside = inside & ~in_ring(lon, lat, hole)
    return inside


def edge_distance(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Planar distance to a ring's nearest edge, in degrees: with a bound it is a round-capped buffer."""
    parts = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        dx, dy = x2 - x1, y2 - y1
        if (n := dx * dx + dy * dy) > 0:
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - x1) * dx + (lat - y1) * dy) / n))
            parts.append(F.hypot(lon - x1 - t * dx, lat - y1 - t * dy))
    return F.least(*parts)


def weibull_kernel(shape: float, scale: float, length: int) -> list[float]:
    """Density at lags 1 to length, made to sum to 1."""
    w = [shape / scale * (i / scale) ** (shape - 1) * math.exp(-((i / scale) ** shape)) for i in range(1, length + 1)]
    return [x / sum(w) for x in w]


def ladder_percentile(v: Column, p10: Column, t1: Column, median: Column, t2: Column, p90: Column) -> Column:
    """Percentile of a value in a ladder of quantiles: linear between rungs, 2 below and 98 above; null for a falling ladder."""
    rungs, ps = [p10, t1, median, t2, p90], [10.0, 100 / 3, 50.0, 200 / 3, 90.0]
    out = F.when(v < p10, F.lit(2.0)).when(v > p90, F.lit(98.0))
    for a, b, pa, pb in zip(rungs[3::-1], rungs[:0:-1], ps[3::-1], ps[:0:-1]):
        out = out.when(v >= a, F.when(b > a, pa + (v - a) / (b - a) * (pb - pa)).otherwise(F.lit(pb)))
    return F.when((p10 <= t1) & (t1 <= median) & (median <= t2) & (t2 <= p90) & v.isNotNull(), out)


def status(v: Column, t1: Column, t2: Column) -> Column:
    """Bounds themselves are near."""
    return F.when(v < t1, "below").when(v > t2, "above").when(v.isNotNull() & t1.isNotNull(), "near")


def trend_class(change: Column, eps: float = 0.02) -> Column:
    return F.when(change > eps, "rising").when(change < -eps, "falling").when(change.isNotNull(), "stable")


def vapour_pressure(t: Column) -> Column:
    """Saturation vapour pressure in kPa at t degrees Celsius (the published FAO-56 formula)."""
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def wind_at_2m(u: Column, z: float = 10.0) -> Column:
    return u * (4.87 / math.log(67.8 * z - 5.42))


def hargreaves(tmin: Column, tmax: Column, ra: Column) -> Column:
    """Reference evapotranspiration from temperatures and extraterrestrial radiation."""
    return F.greatest(F.lit(0.0), 0.0023 * ((tmin + tmax) / 2 + 17.8) * F.sqrt(F.greatest(tmax - tmin, F.lit(0.0))) * 0.408 * ra)


def effective_rain(rain: Column, et0: Column, floor: float = 0.0) -> Column:
    return F.greatest(rain - F.coalesce(et0, F.lit(0.0)), F.lit(floor))


def normal_cdf(x: Column) -> Column:
    """Phi by the rational approximation of Abramowitz and Stegun 26.2.17; off by 7.5e-8 at most."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def crps_gaussian(mu: Column, sigma: Column, y: Column) -> Column:
    z = (y - mu) / sigma
    return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def pinball(q: Column, y: Column, tau: float) -> Column:
    return F.greatest(tau * (y - q), (tau - 1) * (y - q))


def pipe_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def uri_tail(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normal_name(c: Column) -> Column:
    """Lower case, letters and digits only, words in order."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def percent_text(p: Column) -> Column:
    n = half_up(p * 100)
    return F.when(p.isNull(), None).when((p > 0) & (n < 1), "<1%").when((p < 1) & (n > 99), ">99%").otherwise(F.concat(n.cast("string"), F.lit("%")))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's, over rows that have both; null where one of them doesn't vary (``corr`` divides by zero there)."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))
