"""Sampled futures of a key: a member's path at random, with noise that hangs together from day to day and has given marginals.

A key's samples live in one task's numpy arrays (samples x horizon) and only their summary leaves it; draws are seeded by key, so results don't depend
on which task a key lands in."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import spread


def seed(key) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(str(key).encode()))


def noise_paths(n: int, sd: np.ndarray, phi: float, draws: np.random.Generator) -> np.ndarray:
    """(n, days): first-order noise with correlation ``phi`` of neighbours and standard deviation sd[k] on day k (where sd falls faster than the
    correlation lets it, the day keeps what the one before gives it)."""
    fresh = np.sqrt(np.maximum(np.r_[sd[0] ** 2, sd[1:] ** 2 - phi**2 * sd[:-1] ** 2], 0.0))
    z = np.ascontiguousarray((fresh * draws.standard_normal((n, len(sd)))).T)  # a day's samples side by side, as days follow each other
    for k in range(1, len(sd)):
        z[k] += phi * z[k - 1]
    return z.T


def crossings(paths: np.ndarray, bound: float, below: bool, window: int) -> dict[str, float]:
    """Of (n, days) paths: the share that meets the bound, and does so within ``window`` days, the quartiles of the first day (from 1) and the last day's median."""
    hit = paths <= bound if below else paths >= bound
    met = hit.any(1)
    first = np.quantile(hit[met].argmax(1) + 1, (0.25, 0.5, 0.75)) if met.any() else [None] * 3
    p = float(met.mean())
    return {"p_breach": p, "p_window": float(hit[:, :window].any(1).mean()), "censored": 1 - p, **dict(zip(("first_p25", "first_median", "first_p75"), first)), "end_median": float(np.median(paths[:, -1]))}


KIND = "key long, days int, samples int, p_breach double, p_window double, censored double, first_p25 double, first_median double, first_p75 double, end_median double"


def breach(members: DataFrame, bounds: DataFrame, samples: int = 4000, below: bool = False, window: int = 14) -> DataFrame:
    """One row a key of (key, member, date, value, sd) and (key, bound, alpha): the chance that a sampled path meets the bound, when first, and where it
    ends. A path is a member's, plus noise of correlation exp(-1 / alpha); sd is that of its day. A null bound gives the end alone. Every member has
    every day; days that a member lacks are nobody's."""

    def sample(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        days, date = np.unique(rows["date"].to_numpy(), return_inverse=True)
        names, member = np.unique(rows["member"].to_numpy(), return_inverse=True)
        wide, sd = np.full((len(days), len(names)), np.nan), np.full(len(days), np.nan)
        if np.bincount(date * len(names) + member, minlength=1).max() > 1:
            raise ValueError("a member has a day twice")
        wide[date, member] = rows["value"].to_numpy(float)
        np.fmax.at(sd, date, rows["sd"].to_numpy(float))
        whole = ~np.isnan(wide).any(1)
        wide, sd = wide[whole], sd[whole]
        bound, alpha = rows["bound"].iloc[0], float(rows["alpha"].iloc[0])
        if not len(wide):
            return pd.DataFrame(columns=[c.split()[0] for c in KIND.split(", ")])
        draws = seed(key[0])
        paths = (wide[:, draws.integers(0, wide.shape[1], samples)] + noise_paths(samples, sd, float(np.exp(-1 / alpha)), draws).T).T
        told = crossings(paths, np.inf if pd.isna(bound) else float(bound), below and not pd.isna(bound), window)
        if pd.isna(bound):
            told |= {"p_breach": None, "p_window": None, "censored": None}
        return pd.DataFrame([{"key": key[0], "days": len(wide), "samples": samples, **told}])

    # Days as numbers: a date would be an object a row.
    numbered = members.withColumn("date", F.unix_date("date")) if members.schema["date"].dataType.typeName() == "date" else members
    return spread(numbered.select("key", "member", "date", "value", "sd")).join(bounds.select("key", "bound", "alpha"), "key").groupBy("key").applyInPandas(sample, KIND)


def monthly_outlook(traces: DataFrame, weights: DataFrame, sd: DataFrame, samples: int = 2000) -> DataFrame:
    """(key, month, p10, p50, p90, mean) of weighted traces (key, trace, month, value), (key, trace, weight) and (key, month, sd): sampled traces by weight
    plus noise of the month's sd. Keys whose weights sum to nothing weigh all traces alike."""

    def sample(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="trace", columns="month", values="value").sort_index().dropna(axis=1)
        w = rows.groupby("trace")["weight"].first().reindex(wide.index).fillna(0.0).to_numpy(float)
        w = w / w.sum() if w.sum() > 0 else np.full(len(wide), 1 / len(wide))
        noise = rows.groupby("month")["sd"].first().reindex(wide.columns).fillna(0.0).to_numpy(float)
        draws = seed(key[0])
        x = wide.to_numpy(float)[draws.choice(len(wide), samples, p=w)] + noise * draws.standard_normal((samples, wide.shape[1]))
        q = np.quantile(x, (0.1, 0.5, 0.9), axis=0)
        return pd.DataFrame({"key": key[0], "month": wide.columns, "p10": q[0], "p50": q[1], "p90": q[2], "mean": x.mean(0)})

    rows = traces.join(weights, ["key", "trace"], "left").join(sd, ["key", "month"], "left")
    return rows.groupBy("key").applyInPandas(sample, "key long, month date, p10 double, p50 double, p90 double, mean double")
