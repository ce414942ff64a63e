"""Transfer functions of a key: a level as the response to rain less evaporation, with first-order noise.

    level(t) = base + sum over lags of theta(lag) * (rain - factor * evaporation)(t - lag) + residual(t)
    innovation(t_i) = residual(t_i) - exp(-(t_i - t_{i-1}) / alpha) * residual(t_{i-1})

theta is the day's share of gain * P(shape, t / scale), P being the regularised incomplete gamma function. All six parameters are free within bounds and
found by least squares of the innovations, each divided by the root of its expected share of the variance. Given shape, scale and decay, the level is linear in the others, so
these three alone are sought, by damped steps on their logarithms, and gain, factor and base are the best for them each time. The steps start at the best points of a table of responses,
whose kernels all records of a length share. Where the noise takes the signal over (variance explained under LEAST_EVP percent, or a decay beyond ten times LONGEST_DECAY days), the fit is
done again with the decay held under LONGEST_DECAY, and the one that explains more stays.

A key's record is one group: daily, some ten thousand rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segments import spread

#: Bounds of (gain, shape, scale, factor, decay), the decay's in a second try, and the least variance explained, in percent, for which there is none.
BOUNDS = {"gain": (1e-5, 1e5), "shape": (0.1, 10.0), "scale": (0.01, 5000.0), "factor": (0.0, 2.0), "alpha": (1e-2, 5000.0)}
LONGEST_DECAY, LEAST_EVP = 365.0, 5.0
#: Shapes, scales and decays among which fits start: at the best, and at the best that is no neighbour of it, STARTS in all.
SCAN = [(1.0, 0.1), (1.0, 0.5), (10.0, 0.15), (10.0, 0.3), (10.0, 0.5)]
SCAN += [(shape, scale) for scale in np.geomspace(1.0, 4000.0, 13).tolist() for shape in (0.15, 0.4, 1.0, 2.5, 6.0, 10.0) if shape * scale < 6000]
DECAYS, STARTS = (0.3, 3.0, 30.0), 2
MOST_LAGS = 4000
COLUMNS = "gain double, shape double, scale double, factor double, base double, alpha double, sigma double, objective double, evp double, lag_one double, rescued boolean, n long"


def gamma_share(shape: float, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: its series under shape + 1, a continued fraction beyond."""
    out = np.zeros(len(x))
    scale = np.exp(shape * np.log(np.maximum(x, 1e-300)) - x - math.lgamma(shape))
    low = (x > 0) & (x < shape + 1)
    term = np.full(low.sum(), 1 / shape)
    total, n = term.copy(), shape
    for _ in range(500):
        n += 1
        term = term * x[low] / n
        total += term
        if not len(term) or term.max() < 1e-16:
            break
    out[low] = total * scale[low]
    high = x >= shape + 1
    z = x[high]
    b = z + 1 - shape
    c, d = np.full(len(z), 1e300), 1 / b
    h = d.copy()
    for i in range(1, 500):
        a = -i * (i - shape)
        b = b + 2
        d = 1 / np.where(np.abs(v := a * d + b) < 1e-300, 1e-300, v)
        c = np.where(np.abs(v := b + a / c) < 1e-300, 1e-300, v)
        h = h * d * c
        if not len(z) or np.abs(d * c - 1).max() < 1e-15:
            break
    out[high] = 1 - h * scale[high]
    return out


#: The first days, where the density may have no bound, are told by the function's series, later ones by Gauss's rule: (first day, last, points of a day). The density
#: bends less the longer ago the rain fell, so fewer points leave the same error, under 1e-13 of the whole.
FIRST = 3
RULES = ((FIRST, 32, 8), (32, 128, 4), (128, 1024, 3), (1024, MOST_LAGS, 2))
#: Beyond this the function is 1 to the last bit for any shape, and so many terms of the series tell it before.
SURE, TERMS = 60.0, np.arange(1, 161)


def _points() -> tuple:
    """All rules' points in one array, their logarithms, and of each rule its first day, its last, its first point and its weights."""
    at, rules, n = [], [], 0
    for first, last, points in RULES:
        nodes, weights = np.polynomial.legendre.leggauss(points)
        at.append((np.arange(first, last)[:, None] + (nodes + 1) / 2).ravel())
        rules.append((first, last, n, weights / 2))
        n += len(at[-1])
    return np.concatenate(at), np.log(np.concatenate(at)), rules


_AT, _AT_LOGS, _RULES = _points()
_DAYS = np.arange(1.0, MOST_LAGS + 1)
_DAYS_LOGS = np.log(_DAYS)


def rises(total: np.ndarray) -> np.ndarray:
    out = total.copy()
    out[1:] -= total[:-1]
    return out


def _early(shape: float, scale: float, days: int) -> np.ndarray:
    """The function's rise over each of the first days, by its series, all of whose terms are positive."""
    x = _DAYS[:days] / scale
    total = np.ones(days)
    n = int(np.searchsorted(x, SURE))
    if n > FIRST:
        z = x[:n]
        total[:n] = np.exp(shape * np.log(z) - z - math.lgamma(shape + 1)) * (1 + np.cumprod(z[:, None] / (shape + TERMS), axis=1).sum(1))
    else:
        for i, z in enumerate(x[:n].tolist()):
            term = summed = 1.0
            k = shape
            while term > 1e-17 * summed:
                k += 1
                term *= z / k
                summed += term
            total[i] = math.exp(shape * math.log(z) - z - math.lgamma(shape + 1)) * summed
    return rises(total)


def shares(shape: float, scale: float, days: int, slopes: bool = False) -> np.ndarray:
    """P(shape, (t + 1) / scale) - P(shape, t / scale) of each day t; with ``slopes`` two rows, their derivatives by the logarithms of shape and scale."""
    early = days if scale < 1 else min(days, FIRST)
    if not slopes:
        out = np.empty(days)
        out[:early] = _early(shape, scale, early)
    else:
        h, out = 1e-4, np.empty((2, days))
        out[0, :early] = (_early(shape * math.exp(h), scale, early) - _early(shape * math.exp(-h), scale, early)) / (2 * h)
        out[1] = -rises(np.exp(shape * (_DAYS_LOGS[:days] - math.log(scale)) - _DAYS[:days] / scale - math.lgamma(shape)))
        psi = (math.lgamma(shape + h) - math.lgamma(shape - h)) / (2 * h)
    if days == early:
        return out
    spans = [(first, min(last, days), at, weights) for first, last, at, weights in _RULES if first < days]
    n = spans[-1][2] + (spans[-1][1] - spans[-1][0]) * len(spans[-1][3])
    density = _AT_LOGS[:n] * (shape - 1)
    density -= _AT[:n] / scale
    density -= shape * math.log(scale) + math.lgamma(shape)
    np.exp(density, out=density)
    if slopes:
        density *= _AT_LOGS[:n] - (math.log(scale) + psi)
        density *= shape
    told = out[0] if slopes else out
    for first, last, at, weights in spans:
        told[first:last] = density[at : at + (last - first) * len(weights)].reshape(last - first, -1) @ weights
    return out


def lags(shape: float, scale: float, most: int = MOST_LAGS) -> int:
    """Days up to where no more than 1e-6 of the response is left; ``most`` is as far as a record goes."""
    return min(math.ceil(scale * (shape + 8 * math.sqrt(shape) + 8)) + 1, MOST_LAGS, max(most, 1))


def response(gain: float, shape: float, scale: float, most: int = MOST_LAGS) -> np.ndarray:
    """A day's shares of the response."""
    return gain * shares(shape, scale, lags(shape, scale, most))


#: Lengths that are transformed fast.
_LENGTHS = np.array(sorted(2**i * k for i in range(26) for k in (1, 3, 5, 9, 15)))


def fast(n: int) -> int:
    return int(_LENGTHS[np.searchsorted(_LENGTHS, n)])


def convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """x by the kernel, from x's first day on."""
    n = 1 << (len(x) + len(kernel) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(kernel, n), n)[: len(x)]


_KERNELS: dict[int, np.ndarray] = {}  #: by length, what ``scan`` asks of all records


class Record:
    """A key's observations at days ``at`` of the daily drivers."""

    def __init__(self, at: np.ndarray, level: np.ndarray, rain: np.ndarray, evaporation: np.ndarray):
        self.at, self.level, self.rain, self.evaporation = at, level, rain, evaporation
        self.gap, self.known, self.spectra, self.noise = np.diff(at).astype(float), {}, {}, (None,)
        self.longest, self.least = 0.0, math.inf  # the longest decay that a fit tried, the cost that the next one has to beat
        self.plain = np.stack([np.zeros(len(at)), np.zeros(len(at)), np.ones(len(at)), level])

    def spectrum(self, days: int) -> tuple[int, np.ndarray]:
        """Both drivers, transformed once a length."""
        n = fast(len(self.rain) + days)
        if n not in self.spectra:
            if len(self.spectra) > 7:
                self.spectra.pop(next(iter(self.spectra)))
            self.spectra[n] = np.fft.rfft(np.stack([self.rain, self.evaporation]), n)
        return n, self.spectra[n]

    def responses(self, kernel: np.ndarray) -> np.ndarray:
        """Both drivers by the kernel, at the observed days."""
        n, drivers = self.spectrum(len(kernel))
        return np.fft.irfft(drivers * np.fft.rfft(kernel, n), n)[:, self.at]

    def unit(self, shape: float, scale: float) -> np.ndarray:
        """Responses of gain one to rain and to evaporation; the last few are remembered, as some steps leave the shape alone."""
        if (shape, scale) not in self.known:
            if len(self.known) > 7:
                self.known.pop(next(iter(self.known)))
            self.known[shape, scale] = self.responses(response(1.0, shape, scale, len(self.rain)))
        return self.known[shape, scale]

    def scan(self, most: float) -> np.ndarray:
        """Costs by DECAYS and SCAN with the best gain, factor (``most`` at most) and base, in single precision and but for the base's bounds: where to start. No gain is had
        where it had to be over its bound. The kernels are the same for all records of a length, and few lengths are kept."""
        n = fast(2 * len(self.rain))
        if n not in _KERNELS:
            if len(_KERNELS) > 3:
                _KERNELS.pop(next(iter(_KERNELS)))
            _KERNELS[n] = np.stack([np.fft.rfft(response(1.0, *at, n // 2), n) for at in SCAN]).astype(np.complex64)
        drivers = np.fft.rfft(np.stack([self.rain, self.evaporation]), n).astype(np.complex64)
        sides, out = np.empty((len(SCAN), 2, len(self.at))), np.empty((len(DECAYS), len(SCAN)))
        for k in range(0, len(SCAN), 8):
            sides[k : k + 8] = np.fft.irfft(drivers * _KERNELS[n][k : k + 8, None], n)[:, :, self.at]
        sides[:, 1] = sides[:, 0] - most * sides[:, 1]
        for row, alpha in zip(out, DECAYS):
            x, (one, y) = self.whitened(sides, alpha), self.whitened(self.plain[2:], alpha)
            ones = one @ one
            y = y - (y @ one) / ones * one
            (u, v), (m, k) = (x @ y).T, (x @ one).T
            p, q, s = (np.einsum("gn,gn->g", x[:, i], x[:, j]) - a * b / ones for i, j, a, b in ((0, 0, m, m), (0, 1, m, k), (1, 1, k, k)))
            with np.errstate(divide="ignore", invalid="ignore"):
                det = p * s - q * q
                g, h = (s * u - q * v) / det, (p * v - q * u) / det
                e, f = np.where(u > 0, u / p, 0.0), np.where(v > 0, v / s, 0.0)
                both, first = (det > 1e-13 * p * s) & (g >= 0) & (h >= 0), e * u >= f * v
                fell = np.where(both, g * u + h * v, np.where(first, e * u, f * v))
                row[:] = y @ y - np.where(np.where(both, g + h, np.where(first, e, f)) <= BOUNDS["gain"][1], fell, 0.0)
        return np.where(np.isfinite(out), out, np.finfo(float).max)

    def residual(self, gain: float, shape: float, scale: float, factor: float, base: float) -> np.ndarray:
        rain, evaporation = self.unit(shape, scale)
        return self.level - base - gain * (rain - factor * evaporation)

    def weights(self, alpha: float) -> tuple:
        """What a residual keeps of the one before, the spread of the rest and each one's weight: what a longer gap leaves unknown counts less."""
        if alpha != self.noise[0]:
            kept = np.exp(-self.gap / alpha)
            spread = np.sqrt(np.maximum(1 - kept**2, 1e-12))
            self.noise = alpha, kept, spread, np.exp(np.log(spread).mean()) / spread
        return self.noise[1:]

    def whitened(self, x: np.ndarray, alpha: float) -> np.ndarray:
        """Innovations, weighted, of series along the last axis."""
        kept, _, weight = self.weights(alpha)
        out = x.copy()
        out[..., 1:] = (x[..., 1:] - kept * x[..., :-1]) * weight
        return out

    def innovations(self, p: np.ndarray) -> np.ndarray:
        """Of (gain, shape, scale, factor, base, alpha)."""
        return self.whitened(self.residual(*p[:5]), p[5])

    def slopes(self, p: np.ndarray) -> np.ndarray:
        """Derivatives of the innovations, a row each, by the logarithms of shape, scale and alpha."""
        gain, shape, scale, factor, _, alpha = p
        days = lags(shape, scale, len(self.rain))
        n, (wet, dry) = self.spectrum(days)
        moved = np.fft.irfft((-gain * (wet - factor * dry)) * np.fft.rfft(shares(shape, scale, days, True), n), n)[:, self.at]
        r, out = self.residual(*p[:5]), np.empty((3, len(self.at)))
        kept, spread, weight = self.weights(alpha)
        out[:2], out[2, 0] = self.whitened(moved, alpha), 0.0
        kept_by = kept * self.gap / alpha
        spread_by = np.where(1 - kept**2 > 1e-12, -kept * kept_by / spread**2, 0.0)  # of its logarithm
        out[2, 1:] = weight * (-kept_by * r[:-1] + (r[1:] - kept * r[:-1]) * (spread_by.mean() - spread_by))
        return out


def shared(a: np.ndarray, most: float, low: np.ndarray, high: np.ndarray) -> tuple[float, float, float]:
    """Gain, factor and base by least squares within bounds, from the products of the responses at no and at the ``most`` factor, of one and of the level, whitened all. A
    gain and a factor are shares of these two responses that are not negative, so few cases are to be looked at."""

    def parts(c: np.ndarray) -> tuple[float, float]:
        (p, q), (q_, s), (u, v) = c[0, :2], c[1, :2], c[:2, 3]
        det = p * s - q * q_
        if det > 1e-13 * p * s:
            x, y = (s * u - q * v) / det, (p * v - q * u) / det
            if x >= 0 and y >= 0:
                return x, y
        x, y = (max(t, 0.0) / w if w > 0 else 0.0 for t, w in ((u, p), (v, s)))
        return (x, 0.0) if x * u >= y * v else (0.0, y)

    def based(x: float, y: float) -> float:
        return (a[2, 3] - x * a[0, 2] - y * a[1, 2]) / a[2, 2] if a[2, 2] > 0 else 0.0

    x, y = parts(a - np.outer(a[2], a[2]) / a[2, 2] if a[2, 2] > 0 else a)
    base = based(x, y)
    if not low[4] <= base <= high[4]:
        base = min(max(base, low[4]), high[4])
        fixed = a.copy()
        fixed[:, 3] -= base * a[:, 2]
        x, y = parts(fixed)
    gain = x + y
    factor = most * y / gain if gain > 0 else most / 2
    if not low[0] <= gain <= high[0]:
        gain = min(max(gain, low[0]), high[0])
        base = min(max(based(gain * (1 - factor / most), gain * factor / most), low[4]), high[4])
    return gain, factor, base


#: Places of shape, scale and alpha, whose logarithms are sought, by steps no longer than STRIDE. A round that lowers the cost by a smaller share than ENOUGH is the last; one that
#: can't, by the slopes, isn't tried, and neither is one that would have to lower it HOPE times as much to come to where another start ended.
SOUGHT, STRIDE, ENOUGH, HOPE = [1, 2, 5], 2.0, 1e-9, 20


def bounded(m: np.ndarray, g: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The step from ``least`` to ``most``: of what would lead over a bound the first to reach it stops there, and the others are sought again beside it."""
    step, free = np.zeros(len(g)), ~(((least >= 0) & (g > 0)) | ((most <= 0) & (g < 0)))
    while free.any():
        # What isn't free has its step already.
        sought = np.linalg.solve(np.where(free[:, None], m, np.eye(len(g))), np.where(free, -g, step))
        over = free & ((sought < least) | (sought > most))
        if not over.any():
            return sought
        held = np.clip(sought, least, most)
        first = np.divide(held, sought, out=np.full(len(g), np.inf), where=over).argmin()
        step[first], free[first] = held[first], False
    return step


class Fit:
    """Parameters of a record with the best gain, factor and base for its shape, scale and decay."""

    def __init__(self, record: Record, u: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.u, (shape, scale, alpha) = u, (min(max(math.exp(v), low[k]), high[k]) for k, v in zip(SOUGHT, u.tolist()))
        rain, evaporation = record.unit(shape, scale)
        record.longest = max(record.longest, alpha)
        sides = record.plain.copy()
        sides[0], sides[1] = rain, rain - high[3] * evaporation
        self.sides = record.whitened(sides, alpha)
        self.products = self.sides @ self.sides.T
        gain, factor, base = shared(self.products, high[3], low, high)
        self.p = np.array([gain, shape, scale, factor, base, alpha])
        self.parts = np.array([gain * (1 - factor / high[3]), gain * factor / high[3], base])
        self.r = self.sides[3] - self.parts @ self.sides[:3]
        self.cost = float(self.r @ self.r)

    def slopes(self, record: Record, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Derivatives, less what gain, factor and base make good of them."""
        j, (gain, *_, base, _) = record.slopes(self.p), self.p
        inner = low[0] < gain < high[0]
        free = [k for k, f in enumerate((inner and self.parts[0] > 0, inner and self.parts[1] > 0, low[4] < base < high[4])) if f]
        sides = self.sides[free]
        a = sides @ sides.T
        a.flat[:: len(a) + 1] *= 1 + 1e-12
        return j - np.linalg.solve(a, sides @ j.T).T @ sides


def solve(record: Record, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt on shape, scale and alpha, gain, factor and base being the best for them at each step (variable projection). What the products of the slopes leave
    out of the cost's curvature, much where noise is most of the level, is learnt from how the gradient changes (symmetric updates of rank one)."""
    lo, hi = np.log(low[SOUGHT]), np.log(high[SOUGHT])
    now, damping = Fit(record, np.clip(np.log(start[SOUGHT]), lo, hi), low, high), 1e-2
    left_out, step, g = np.zeros((3, 3)), None, None
    for _ in range(rounds):
        j = now.slopes(record, low, high)
        before, g, m = g, j @ now.r, j @ j.T
        if step is not None:
            off = g - before - (m + left_out) @ step
            if abs(off @ step) > 1e-8 * math.sqrt((off @ off) * (step @ step)):
                left_out = left_out + np.outer(off, off) / (off @ step)
        least, most, unit = np.maximum(lo - now.u, -STRIDE), np.minimum(hi - now.u, STRIDE), np.diag(np.maximum(np.diag(m), 1e-12 * now.cost + 1e-300))
        fell = 0.0
        while damping < 1e10:
            curved = m + left_out + damping * unit
            step = bounded(curved, g, least, most) if np.linalg.eigvalsh(curved)[0] > 0 else None
            hoped = -1.0 if step is None else -step @ (2 * g + (m + left_out) @ step)
            if hoped < 0:
                damping *= 4
                continue
            if hoped <= 0.1 * ENOUGH * now.cost or HOPE * hoped < now.cost - record.least:
                break
            new = Fit(record, now.u + step, low, high)
            if (gained := now.cost - new.cost) > 0:
                fell, now = gained / now.cost, new
                damping = max(damping / 5, 1e-9) if gained > 0.5 * hoped else damping if gained > 0.2 * hoped else damping * 2
                break
            damping *= 4
        if fell < ENOUGH:
            break
    return now.p, now.cost


def calibrate(record: Record) -> tuple:
    """COLUMNS of a record."""
    y = record.level
    names = ("gain", "shape", "scale", "factor")
    low = np.array([*(BOUNDS[n][0] for n in names), y.min() - 10 * (np.ptp(y) + 1), BOUNDS["alpha"][0]])
    high = np.array([*(BOUNDS[n][1] for n in names), y.max() + 10 * (np.ptp(y) + 1), BOUNDS["alpha"][1]])
    evp = lambda p: 100 * (1 - np.var(record.residual(*p[:5])) / np.var(y)) if np.var(y) > 0 else float("nan")

    told, costs = {}, record.scan(high[3])

    def best(top: float) -> tuple[np.ndarray, float]:
        found, limit, where = None, np.r_[high[:5], top], np.log(SCAN)
        left, record.least = costs.copy(), math.inf
        for _ in range(STARTS):
            decay, at = np.unravel_index(left.argmin(), left.shape)
            got, longest, beaten = told.get((decay, at), (None, math.inf, None))
            # A fit whose decay stayed under this bound goes the same way again.
            if not (longest < top and beaten == record.least):
                record.longest = 0.0
                got = solve(record, np.array([1.0, *SCAN[at], 0.5, 0.0, DECAYS[decay]]), low, limit)
                told[decay, at] = got, max(record.longest, got[0][5]), record.least
            if found is None or got[1] < found[1]:
                found, record.least = got, got[1]
            left[:, np.abs(where - where[at]).max(1) < 1.3] = np.inf
        return found

    (p, cost), rescued = best(high[5]), False
    own = evp(p)
    if not np.isfinite(own) or own < LEAST_EVP or p[5] > 10 * LONGEST_DECAY:
        again, other = best(LONGEST_DECAY)
        if np.isfinite(new := evp(again)) and (not np.isfinite(own) or new > own):
            p, cost, own, rescued = again, other, new, True
    v = record.innovations(p)[1:]
    lag = float(np.corrcoef(v[1:], v[:-1])[0, 1]) if len(v) > 3 and v.std() > 0 else 0.0
    return (*map(float, p), float(record.residual(*p[:5]).std(ddof=1)), cost, float(own), lag, rescued, len(y))


def transfer(levels: DataFrame, drivers: DataFrame, least: int = 60, warm_up: int = 3650) -> DataFrame:
    """(key, and COLUMNS) of levels (key, date, value) and drivers (key, date, rain, evaporation). Days without a driver have none; drivers count from
    ``warm_up`` days before the first level on. Keys with fewer than ``least`` levels, or whose levels are all one, have no row; of levels on one day the
    mean counts."""
    d = levels.na.drop(subset=["date", "value"]).groupBy("key", "date").agg(F.avg(F.col("value").cast("double")).alias("value"))
    e = drivers.na.drop(subset=["date"]).groupBy("key", "date").agg(*[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in ("rain", "evaporation")])
    both = d.select("key", F.unix_date("date").alias("day"), "value", F.lit(0.0).alias("rain"), F.lit(0.0).alias("evaporation")).unionByName(e.select("key", F.unix_date("date").alias("day"), F.lit(None).cast("double").alias("value"), "rain", "evaporation"))
    from pyspark.sql.pandas.types import to_arrow_schema

    result = f"key {levels.schema['key'].dataType.simpleString()}, {COLUMNS}"
    names, kind = [c.split()[0] for c in COLUMNS.split(", ")], to_arrow_schema(T.StructType.fromDDL(result))

    def fitted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        day, level, rain, evaporation = (rows[c].to_numpy() for c in ("day", "value", "rain", "evaporation"))
        seen, told = np.flatnonzero(~np.isnan(level)), np.isnan(level)
        seen = seen[np.argsort(day[seen], kind="stable")]
        found = []
        if len(seen) >= least and np.ptp(level[seen]) > 0:
            first, end = int(day[seen[0]]), int(day[seen[-1]])
            start = min(max(int(day[told].min()) if told.any() else first, first - warm_up), first)
            told &= (day >= start) & (day <= end)
            daily = np.zeros((2, end - start + 1))
            daily[:, day[told] - start] = rain[told], evaporation[told]
            found = [dict(zip(names, calibrate(Record(day[seen] - start, level[seen], *daily))), key=key[0].as_py())]
        return pa.Table.from_pylist(found, kind)

    # A key takes as long as its fit and not as its bytes, so tasks aren't merged by size.
    return spread(both).groupBy("key").applyInArrow(fitted, result)
