"""Late and corrected data: precedence, retention and ranges, as batch operators; ``rillet.streaming`` applies them to streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precedence(df: DataFrame, keys: list[str], rank: Column, recent: Column) -> DataFrame:
    """One row a key: the source with the least rank, of it the most recent row. Audited rows replace live ones and never the reverse."""
    first = F.max_by(F.struct(*df.columns), F.struct(rank.isNull(), -rank, recent))  # with partial results in each task, so a hot key is a row a task
    found = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("_row"))
    return found.select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def newest(df: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """A key's ``most`` newest rows."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc()))
    return df.withColumn("_r", r).filter(F.col("_r") <= most).drop("_r")


def missing_ranges(series: DataFrame) -> DataFrame:
    """(key, from, to, days): a key's gaps between its first and last date, from neighbours alone."""
    w = Window.partitionBy("key").orderBy("date")
    nxt = series.select("key", "date").distinct().withColumn("n", F.lead("date").over(w))
    return nxt.filter(F.datediff("n", "date") > 1).select("key", F.date_add("date", 1).alias("from"), F.date_sub("n", 1).alias("to"), (F.datediff("n", "date") - 1).alias("days"))


def freshness(df: DataFrame, key: str, at: str, now: Column, bands=(7, 30, 90, 365)) -> DataFrame:
    """(key, last, age, label) against a given now, never the clock."""
    last = df.groupBy(F.col(key).alias("key")).agg(F.max(F.to_date(at)).alias("last"))
    age = F.datediff(now, F.col("last"))
    label = F.when(age <= bands[0], "current").when(age <= bands[1], "recent").when(age <= bands[2], "ageing").when(age <= bands[3], "old").otherwise("stale")
    return last.select("key", "last", age.alias("age"), label.alias("label"))


def bridge(observed: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Observed history, over which the forecast wins where they overlap."""
    return upsert(observed, forecast, keys)


def coverage_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that one side alone has."""
    a, b = left.select(F.col(key).alias("key")).distinct(), right.select(F.col(key).alias("key")).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def top_up(archive: DataFrame, fresh: DataFrame, key: str = "key", at: str = "date", overlap: int = 14) -> DataFrame:
    """The archive with what came: from ``overlap`` days before a key's last archived row on, fresh rows win where both have the (key, at); older fresh rows are
    left out. Keys that the archive lacks are taken whole."""
    since = archive.groupBy(key).agg(F.max(at).alias("_last")).select(F.col(key).alias("_key"), F.date_sub("_last", overlap).alias("_since"))
    new = fresh.join(since, F.col(key) == F.col("_key"), "left").filter(F.col("_since").isNull() | (F.col(at) >= F.col("_since"))).drop("_key", "_since")
    return upsert(archive, new, [key, at])


def fetch_since(source: DataFrame, starts: DataFrame, key: str = "key", at: str = "ts", most: int | None = None) -> DataFrame:
    """Rows of ``source`` from each key's ``start`` of (key, start) on, all rows for a key without one. A source that gives a key's ``most`` oldest rows in
    answer to one question has cut that key short if it gave as many: then all that it holds of the key is taken."""
    rows = source.join(starts.select(F.col(key).alias("_key"), "start"), F.col(key) == F.col("_key"), "left")
    wanted = F.col("start").isNull() | (F.col(at) >= F.col("start"))
    if most is not None:
        rows = rows.withColumn("_n", F.count(F.when(wanted, 1)).over(Window.partitionBy(key)))
        wanted = wanted | (F.col("_n") >= most)
    return rows.filter(wanted).select(*source.columns)


def tail_append(archive: DataFrame, new: DataFrame, live: Column, fence: float = 5.0) -> DataFrame:
    """``archive`` (key, date, value, source) with audited ``new`` rows after each key's last audited date, those outside the median of its record and ``fence``
    interquartile ranges being left out. Audited rows replace ``live`` ones of their dates and are never replaced."""
    record = archive.groupBy("key").agg(F.max(F.when(~live, F.col("date"))).alias("_last"), F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("_q"), F.count("value").alias("_n"))
    half = (F.col("_q")[2] - F.col("_q")[0]) * fence
    fits = (F.col("_n") < 4) | F.coalesce(half <= 0, F.lit(True)) | (F.abs(F.col("value") - F.col("_q")[1]) <= half)
    own = new.join(record, "key", "left").filter((F.col("_last").isNull() | (F.col("date") > F.col("_last"))) & (F.col("_n").isNull() | fits)).drop("_last", "_q", "_n")
    return upsert(archive, own, ["key", "date"])


def whole_days(readings: DataFrame, since: Column) -> DataFrame:
    """(key, date, value): sums of (key, ts, value) by day, from the first midnight at or after ``since`` on, as the day that it cuts is not whole."""
    first = F.to_date(since) + F.when(since == F.date_trunc("day", since), 0).otherwise(1)
    return readings.filter((F.to_date("ts") >= first) & F.col("value").isNotNull()).groupBy("key", F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))
