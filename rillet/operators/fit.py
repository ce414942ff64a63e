"""Model fits and simulations a key: grouped numpy, where a key's series is small. Random draws are seeded by key, so results don't depend
on which task a key lands in."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ols_multi(df: DataFrame, xs: list[str], y: str, least: int) -> DataFrame:
    """(key, n, coefficients, r2) with the constant first; the least-norm solution. Only Gram sums are shuffled: one small row a task and
    key, so a key with a third of the rows is as cheap as any other."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k = len(cols)
    gram = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    sums = df.na.drop(subset=[*xs, y]).groupBy("key").agg(*gram, *[F.sum(c * F.col(y)).alias(f"m{i}") for i, c in enumerate(cols)], F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("ys"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)

    def solve(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                m = np.array([r[f"m{i}"] for i in range(k)])
                c = np.linalg.pinv(g) @ m
                left, all_ = r["yy"] - c @ m, r["yy"] - r["ys"] ** 2 / r["n"]
                out.append((r["key"], r["n"], c.tolist(), float(1 - left / all_) if all_ > 0 else 0.0))
            yield pd.DataFrame(out, columns=["key", "n", "coefficients", "r2"])

    return sums.mapInPandas(solve, "key long, n long, coefficients array<double>, r2 double")


def ar1_fan(series: DataFrame, horizon: int, samples: int) -> DataFrame:
    """(key, lead, p10, p50, p90, phi, sigma): AR(1) around the last value, fitted on consecutive days."""

    def simulate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("date")
        x = s["value"].to_numpy(float)
        d = x - x.mean()
        phi = float(np.clip((d[1:] @ d[:-1]) / (d @ d), 0.0, 0.99)) if len(d) > 2 and d @ d > 0 else 0.0
        sigma = float(np.std(d[1:] - phi * d[:-1])) if len(d) > 2 else 0.0
        draw = np.random.default_rng(zlib.crc32(str(key[0]).encode()))
        level, out = np.full(samples, d[-1]), []
        for lead in range(1, horizon + 1):
            level = phi * level + sigma * draw.standard_normal(samples)
            out.append((key[0], lead, *(np.quantile(level, (0.1, 0.5, 0.9)) + x.mean()).tolist(), phi, sigma))
        return pd.DataFrame(out, columns=["key", "lead", "p10", "p50", "p90", "phi", "sigma"])

    return series.groupBy("key").applyInPandas(simulate, "key long, lead int, p10 double, p50 double, p90 double, phi double, sigma double")


def hindcast(series: DataFrame, stride: int, horizon: int) -> DataFrame:
    """(lead, mae, bias, n) of persistence from every ``stride``-th row of a key; natively, by one window and a frame of days."""
    w = Window.partitionBy("key").orderBy("date")
    origins = series.withColumn("i", F.row_number().over(w)).filter(F.col("i") % stride == 1).select("key", F.col("date").alias("origin"), F.col("value").alias("seed"))
    ahead = origins.select("key", "origin", "seed", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lead")).withColumn("date", F.date_add("origin", F.col("lead")))
    off = F.col("value") - F.col("seed")
    return ahead.join(series, ["key", "date"]).groupBy("lead").agg(F.avg(F.abs(off)).alias("mae"), F.avg(off).alias("bias"), F.count(F.lit(1)).alias("n"))
