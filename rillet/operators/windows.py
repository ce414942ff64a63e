"""Series functions over (key, date, value): calendar-true, so a gap never passes for a neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_number, weibull_kernel
from .spatial import _cut


def _days(back_from: int, back_to: int):
    return Window.partitionBy("key").orderBy("_n").rangeBetween(back_from, back_to)


def calendar_lags(series: DataFrame, lags=(1, 7, 30)) -> DataFrame:
    """lag_n: the value n days before, null if that day has none. One sort a key serves all lags."""
    df = series.withColumn("_n", day_number(F.col("date")))
    return df.select("*", *[F.max("value").over(_days(-n, -n)).alias(f"lag_{n}") for n in lags]).drop("_n")


def rolling_full(series: DataFrame, spans=(3, 7)) -> DataFrame:
    """sum_n: the sum of the last n days, null unless all of them have values."""
    df = series.withColumn("_n", day_number(F.col("date")))
    return df.select("*", *[F.when(F.count("value").over(_days(1 - n, 0)) == n, F.sum("value").over(_days(1 - n, 0))).alias(f"sum_{n}") for n in spans]).drop("_n")


def weibull_recharge(grid: DataFrame, shape: float, scale: float, length: int, valid: float = 0.95) -> DataFrame:
    """recharge: the last ``length`` days before each, weighted by a Weibull kernel; gaps count as 0. Null in a key's first days and where
    fewer than ``valid`` of the days have values. ``grid`` holds every day. Native: one sort a key and an array of ``length`` values a row."""
    w = Window.partitionBy("key").orderBy("date")
    back = w.rowsBetween(-length, -1)
    kernel = F.array(*map(F.lit, reversed(weibull_kernel(shape, scale, length))))
    past = F.collect_list(F.coalesce("value", F.lit(0.0))).over(back)
    weighed = F.aggregate(F.zip_with(past, kernel, lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    enough = (F.row_number().over(w) > length) & (F.count("value").over(back) >= valid * length)
    return grid.withColumn("recharge", F.when(enough, weighed))


def differences(series: DataFrame) -> DataFrame:
    """change: from the day before, null after a gap."""
    w = Window.partitionBy("key").orderBy("date")
    before = F.lag(F.struct("date", "value")).over(w)
    return series.withColumn("change", F.when(F.datediff("date", before["date"]) == 1, F.col("value") - before["value"]))


def steps(series: DataFrame, bound: float, times: float = 4.0) -> DataFrame:
    """(key, max_step, n_steps): changes over ``bound`` and over ``times`` the key's 95th percentile."""
    d = differences(series).select("key", F.abs("change").alias("d")).filter("d is not null")
    scale = d.groupBy("key").agg(F.percentile("d", F.lit(0.95)).alias("scale"), F.max("d").alias("max_step"))
    return d.join(scale, "key").groupBy("key").agg(F.max("max_step").alias("max_step"), F.sum(F.when((F.col("d") > bound) & (F.col("d") > times * F.col("scale")), 1).otherwise(0)).alias("n_steps"))


def fill(grid: DataFrame) -> DataFrame:
    """filled: the last value before, else the first after, else 0."""
    w = Window.partitionBy("key").orderBy("date")
    before, after = F.last("value", True).over(w), F.first("value", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return grid.withColumn("filled", F.coalesce(before, after, F.lit(0.0)))


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", n).filter("_r = 1").drop("_r")


def recession(series: DataFrame, span: int = 14) -> DataFrame:
    """(key, drop): the median change over ``span`` days, by an equi-join of each day with the one so much later."""
    later = series.select("key", F.date_sub("date", span).alias("date"), F.col("value").alias("then"))
    return series.join(later, ["key", "date"]).groupBy("key").agg(F.median(F.col("then") - F.col("value")).alias("change"))


def noise(series: DataFrame, least: int = 10) -> DataFrame:
    """(key, sd): 1.4826 times the median absolute deviation of day-to-day changes; null under ``least`` of them."""
    d = differences(series).filter("change is not null")
    mid = d.groupBy("key").agg(F.median("change").alias("mid"), F.count(F.lit(1)).alias("n"))
    return d.join(mid, "key").groupBy("key", "n").agg((1.4826 * F.median(F.abs(F.col("change") - F.col("mid")))).alias("sd")).select("key", F.when(F.col("n") >= least, F.col("sd")).alias("sd"))


def recurrence(series: DataFrame, decay: float, gain: float) -> DataFrame:
    """(key, state): s' = decay * s + gain * value along a key's days, from 0. Native, over one ordered array a key, so for short horizons."""
    a = series.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("a"))
    return a.select("key", F.aggregate("a", F.lit(0.0), lambda s, x: decay * s + gain * x["value"]).alias("state"))


def split_by_time(series: DataFrame, share: float) -> DataFrame:
    """part: train for the first ``share`` of a key's rows, else test."""
    w = Window.partitionBy("key").orderBy("date")
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return series.withColumn("part", F.when(F.row_number().over(w) <= F.floor(n * share), "train").otherwise("test"))


def places_in_order(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place (long, from 1) in a total ``order``: ranges of the order are ranked apart, and each starts after the
    rows of those before it, so no task holds more than a range."""
    ranged = _cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn(name, own).join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + F.col(name)).drop("_p", "_before")
