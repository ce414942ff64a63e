"""Verification of probabilistic forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pinball, total


def crps_ensemble(members: DataFrame) -> DataFrame:
    """(case, crps, n) of (case, value, obs): mean distance to the observation less half the members' mean distance, by ranks in O(n log n)."""
    w = Window.partitionBy("case").orderBy("value")
    r = members.withColumns({"i": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("case"))})
    gini = F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("value")) / F.pow(F.max("n"), 2)
    return r.groupBy("case").agg((F.avg(F.abs(F.col("value") - F.col("obs"))) - gini).alias("crps"), F.max("n").alias("n"))


def brier(df: DataFrame, by: list[str], p: str, hit: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(hit).cast("double"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def rps(df: DataFrame, ps: list[str], observed: str) -> DataFrame:
    """rps: of class probabilities ``ps`` in order against the number (from 0) of the class observed."""
    parts = [F.pow(total([F.col(c) for c in ps[: i + 1]]) - F.when(F.col(observed) <= i, 1.0).otherwise(0.0), 2) for i in range(len(ps) - 1)]
    return df.withColumn("rps", total(parts) / (len(ps) - 1))


def band_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, misses either way, errors, widths and pinball losses of (p10, p50, p90, obs); nulls don't count. ``by`` may be grouping sets."""
    ok = df.filter("obs is not null and p10 is not null and p50 is not null and p90 is not null")
    share = lambda e: F.avg(F.expr(e).cast("double"))
    y = F.col("obs")
    return ok.rollup(*by).agg(
        share("obs between p10 and p90").alias("coverage"), share("obs < p10").alias("below"), share("obs > p90").alias("above"), F.avg(F.abs(y - F.col("p50"))).alias("mae"), F.avg(F.col("p90") - F.col("p10")).alias("width"),
        F.avg((pinball(F.col("p10"), y, 0.1) + pinball(F.col("p50"), y, 0.5) + pinball(F.col("p90"), y, 0.9)) / 3).alias("pinball"), F.count(F.lit(1)).alias("n"),
    )


def pit_histogram(df: DataFrame, pit: str, bins: int = 10) -> DataFrame:
    """(bin, n, share, off): counts of equal bins, the last one closed, empty ones included; off is the largest distance from flat."""
    b = F.least(F.floor(F.col(pit) * bins).cast("int") + 1, F.lit(bins))
    counts = df.filter(F.col(pit).between(0, 1)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    all_ = Window.partitionBy()
    out = every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("share", F.try_divide("n", F.sum("n").over(all_)))
    return out.withColumn("off", F.max(F.abs(F.col("share") - 1 / bins)).over(all_))


def by_lead(df: DataFrame) -> DataFrame:
    """Per lead: mean scores of forecast and baseline, skill, spread and error of (lead, score, base, sd, mean, obs)."""
    return df.groupBy("lead").agg(F.avg("score").alias("score"), F.avg("base").alias("base"), (1 - F.try_divide(F.avg("score"), F.avg("base"))).alias("skill"), F.avg("sd").alias("spread"), F.sqrt(F.avg(F.pow(F.col("mean") - F.col("obs"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n"))
