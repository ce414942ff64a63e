"""Climate of a series, and where its latest value stands in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladder_percentile, status, trend_class
from .resample import monthly

LADDER = (0.1, 1 / 3, 0.5, 2 / 3, 0.9)
RUNGS = ("p10", "t1", "median", "t2", "p90")


def monthly_normals(series: DataFrame, before, least: int = 5, how: str = "avg") -> DataFrame:
    """(key, month, p10, t1, median, t2, p90, years) by calendar month from whole months before ``before`` (a date column);
    each month is one number, whatever its number of rows."""
    m = monthly(series, how).filter(F.col("month") < F.trunc(before, "MM"))
    q = m.groupBy("key", F.month("month").alias("month")).agg(F.percentile("value", F.array(*map(F.lit, LADDER))).alias("q"), F.count(F.lit(1)).alias("years"))
    return q.filter(F.col("years") >= least).select("key", "month", *[F.col("q")[i].alias(n) for i, n in enumerate(RUNGS)], "years")


def latest(series: DataFrame, back: int = 7) -> DataFrame:
    """(key, date, level, change): the last value and its change from the last one at least ``back`` days before. One exchange by key serves
    the window and the aggregation."""
    s = series.withColumn("_old", F.col("date") <= F.date_sub(F.max("date").over(Window.partitionBy("key")), back))
    then = F.max_by("value", F.when(F.col("_old"), F.col("date")))
    return s.groupBy("key").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("level"), then.alias("_then")).select("key", "date", "level", (F.col("level") - F.col("_then")).alias("change"))


def current_status(series: DataFrame, before, eps: float = 0.02, least: int = 5) -> DataFrame:
    """(key, date, level, percentile, status, change, trend) of each key."""
    now = latest(series).withColumn("month", F.month("date"))
    own = now.join(monthly_normals(series, before, least), ["key", "month"], "left")
    level = F.col("level")
    return own.select("key", "date", "level", ladder_percentile(level, *map(F.col, RUNGS)).alias("percentile"), status(level, F.col("t1"), F.col("t2")).alias("status"), "change", trend_class(F.col("change"), eps).alias("trend"))


def day_climatology(series: DataFrame) -> DataFrame:
    """(key, doy, mean), with the overall mean for days that never had a value."""
    days = series.groupBy("key").agg(F.avg("value").alias("all")).select("key", "all", F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy"))
    own = series.groupBy("key", F.dayofyear("date").alias("doy")).agg(F.avg("value").alias("m"))
    return days.join(own, ["key", "doy"], "left").select("key", "doy", F.coalesce("m", "all").alias("mean"))


def envelope(series: DataFrame, axis, before_year, least: int = 3) -> DataFrame:
    """(key, axis_day, lo, mid, hi, years) of past years by a day of the season."""
    past = series.filter(F.year("date") < before_year)
    e = past.groupBy("key", axis.alias("axis_day")).agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.countDistinct(F.year("date")).alias("years"))
    return e.filter(F.col("years") >= least).select("key", "axis_day", F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"), "years")
