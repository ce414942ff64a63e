"""Trend screens over monthly series (key, month, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import correlation, water_year


def years(month: Column, over) -> Column:
    return F.datediff(month, F.min(month).over(over)) / 365.25


def ols(series: DataFrame, least: int = 3) -> DataFrame:
    """(key, slope, intercept, r2, n): value per year; r2 is 0 for a constant series."""
    x = series.withColumn("x", years(F.col("month"), Window.partitionBy("key")))
    out = x.groupBy("key").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.regr_r2("value", "x").alias("r2"), F.count(F.lit(1)).alias("n"), F.var_pop("value").alias("v"))
    return out.filter(F.col("n") >= least).select("key", "slope", "intercept", F.when(F.col("v") == 0, 0.0).otherwise(F.col("r2")).alias("r2"), "n")


def theil_sen(series: DataFrame) -> DataFrame:
    """(key, slope): the median of slopes between all pairs of a key's months, per year. A key's months are one row of two arrays, a few
    hundred values for decades; the pairs exist as a numpy vector within the row and never as rows."""
    @F.pandas_udf("double")
    def median_slope(days: pd.Series, values: pd.Series) -> pd.Series:
        def one(x, y):
            i, j = np.triu_indices(len(x), 1)
            dx, dy = x[j] - x[i], y[j] - y[i]
            return float(np.median(dy[dx != 0] / (dx[dx != 0] / 365.25))) if (dx != 0).any() else None

        return pd.Series([one(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(days, values)], dtype="float64")

    points = series.filter("value is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("month", "value"))).alias("a"))
    days = F.transform("a", lambda p: F.datediff(p["month"], F.lit("1970-01-01").cast("date")).cast("double"))
    return points.select("key", median_slope(days, F.col("a.value")).alias("slope")).filter("slope is not null")


def seasonal_amplitude(series: DataFrame, least_months: int = 12, least_in_year: int = 6) -> DataFrame:
    """(key, amplitude): the median over water years of the range of the trend's residuals."""
    x = years(F.col("month"), Window.partitionBy("key"))
    left = series.withColumn("x", x).join(ols(series).filter(F.col("n") >= least_months), "key").withColumn("e", F.col("value") - F.col("slope") * F.col("x") - F.col("intercept"))
    per = left.groupBy("key", water_year(F.col("month")).alias("wy")).agg((F.max("e") - F.min("e")).alias("range"), F.count(F.lit(1)).alias("n"))
    return per.filter(F.col("n") >= least_in_year).groupBy("key").agg(F.median("range").alias("amplitude"))


def anomalies(series: DataFrame) -> DataFrame:
    """anomaly: from the key's mean of the calendar month."""
    return series.withColumn("anomaly", F.col("value") - F.avg("value").over(Window.partitionBy("key", F.month("month"))))


def coherence(series: DataFrame, driver: DataFrame, least: int = 12) -> DataFrame:
    """(key, corr, months): of a series' anomalies with its driver's cumulated anomalies."""
    cum = F.sum("anomaly").over(Window.partitionBy("key").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    both = anomalies(series).select("key", "month", "anomaly").join(anomalies(driver).select("key", "month", cum.alias("cum")), ["key", "month"])
    return both.groupBy("key").agg(F.when(F.count(F.lit(1)) >= least, correlation(F.col("anomaly"), F.col("cum"))).alias("corr"), F.count(F.lit(1)).alias("months"))


def isolation(slopes: DataFrame, neighbours: DataFrame, slope_min: float, ratio: float = 3.0, least: int = 2) -> DataFrame:
    """(key, neighbours, median, class) of slopes (key, slope) and pairs (a, b)."""
    near = neighbours.join(slopes.select(F.col("key").alias("b"), F.col("slope").alias("s2")), "b").groupBy(F.col("a").alias("key")).agg(F.median("s2").alias("median"), F.count("s2").alias("neighbours"))
    return beside(slopes, near, slope_min, ratio, least)


def beside(slopes: DataFrame, near: DataFrame, slope_min: float, ratio: float = 3.0, least: int = 2) -> DataFrame:
    """``isolation`` with neighbours told as (key, median, neighbours), as ``quantiles.median_of_others`` gives them."""
    out = slopes.join(near, "key", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    med, s = F.col("median"), F.col("slope")
    kind = (
        F.when((F.col("neighbours") < least) | s.isNull(), "no_neighbours").when((F.abs(med) < slope_min) & (F.abs(s) >= ratio * F.greatest(F.abs(med), F.lit(1e-6))), "isolated")
        .when((F.signum(med) == F.signum(s)) & (F.abs(med) >= slope_min), "regional").otherwise("no_neighbours")
    )
    return out.select("key", "slope", "neighbours", "median", kind.alias("class"))


def residual_checks(series: DataFrame) -> DataFrame:
    """(key, lag1, seasonal_share): autocorrelation of anomalies' neighbours and the share of variance between calendar months."""
    w = Window.partitionBy("key").orderBy("month")
    a = series.withColumn("before", F.lag("value").over(w)).withColumn("mm", F.avg("value").over(Window.partitionBy("key", F.month("month"))))
    return a.groupBy("key").agg(correlation(F.col("value"), F.col("before")).alias("lag1"), F.try_divide(F.var_pop("mm"), F.var_pop("value")).alias("seasonal_share"))
