"""From readings to regular series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day, sound


def daily(df: DataFrame, key: str, ts: str, value: str, how: str = "avg", out: str = "value") -> DataFrame:
    """(key, date, out): one row a key and day that has values; avg, sum, min, max or median of them."""
    return df.groupBy(F.col(key).alias("key"), day(F.col(ts)).alias("date")).agg(getattr(F, how)(sound(F.col(value))).alias(out)).filter(F.col(out).isNotNull())


def multi(df: DataFrame, key: str, ts: str, value: str, unit: str = "hour") -> DataFrame:
    """Sum, mean, extremes and count of each key and hour (or another unit), in one aggregation."""
    v = F.col(value)
    return df.groupBy(F.col(key).alias("key"), F.date_trunc(unit, ts).alias("at")).agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v).alias("n"))


def monthly(series: DataFrame, how: str = "avg") -> DataFrame:
    """(key, month, value) of (key, date, value); month is its first day."""
    return series.groupBy("key", F.trunc("date", "MM").alias("month")).agg(getattr(F, how)("value").alias("value"))


def grid(series: DataFrame) -> DataFrame:
    """Every day from a key's first to its last, value null where it has none. One row a key is exploded, so nothing is shuffled but sums."""
    span = series.groupBy("key").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("key", F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(series, ["key", "date"], "left")


def year_chunks(df: DataFrame, start: str, end: str, years: int = 1) -> DataFrame:
    """Ranges of at most so many years that cover [start, end], end excluded but for the last."""
    steps = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"interval {years} year"))).alias("from")
    out = df.select("*", steps)
    return out.withColumn("to", F.least(F.add_months("from", 12 * years), F.col(end)))
