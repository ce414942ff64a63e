"""Scans along a key's time that no key makes long: what was last known, or is known next, by stretches of the calendar.

A key's rows are sorted by stretches (months, unless told otherwise), each on its own. A stretch is summed up in one row, its last and its first known values, by
aggregation with partial sums; the summaries, one a key and stretch, are scanned, and what each hands on goes back to its rows by the key that they
are dealt by anyway. So a key with a third of all rows is as many tasks as it has stretches, and rows move once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month(at: str) -> Column:
    return F.trunc(at, "month")


def known(df: DataFrame, what: dict[str, Column], order: list[str], stretch: Column, ahead: bool = False, now: bool = True) -> DataFrame:
    """``df`` (key and others) with a column for each of ``what``: its last value that isn't null at or before a row in ``order``, or with ``ahead`` its first at or
    behind it; ``now`` false leaves the row itself out. ``order``, columns without nulls, has to follow ``stretch``; rows that tie in it come in any order. A
    null key is a key."""
    cut = df.withColumn("_stretch", stretch).withColumns({f"_own_{n}": c for n, c in what.items()})
    place = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    ends = cut.groupBy("key", "_stretch").agg(*[pick(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), place)).alias(f"_end_{n}") for n in what])
    beside = Window.partitionBy("key").orderBy(F.desc("_stretch") if ahead else F.asc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(F.col("key").alias("_of"), F.col("_stretch").alias("_at"), *[F.last(f"_end_{n}", True).over(beside).alias(f"_from_{n}") for n in what])
    rows = cut.join(handed, F.col("key").eqNullSafe(F.col("_of")) & F.col("_stretch").eqNullSafe(F.col("_at")), "left")
    inner = Window.partitionBy("key", "_stretch").orderBy(*[F.desc(c) if ahead else F.asc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if now else -1)
    out = rows.withColumns({n: F.coalesce(F.last(f"_own_{n}", True).over(inner), f"_from_{n}") for n in what})
    return out.select(*df.columns, *what)


def as_of(axis: DataFrame, obs: DataFrame, tolerance: int, stretch: Column | None = None) -> DataFrame:
    """(key, date, value, seen) for each (key, date) of ``axis``: the last value at or before it, if it is ``tolerance`` days old at most. A union instead of a range
    join."""
    both = axis.select("key", "date", F.lit(None).cast("double").alias("value"), F.lit(1).alias("ask")).unionByName(obs.select("key", "date", "value", F.lit(0).alias("ask")))
    told = known(both, {"last": F.when(F.col("ask") == 0, F.struct("date", "value"))}, ["date", "ask"], month("date") if stretch is None else stretch)
    near = F.datediff("date", "last.date") <= tolerance
    return told.filter("ask = 1").select("key", "date", F.when(near, F.col("last.value")).alias("value"), F.when(near, F.col("last.date")).alias("seen"))


def interpolate(grid: DataFrame, most: int = 30, stretch: Column | None = None) -> DataFrame:
    """filled: linear between the neighbours that have values, where both are within ``most`` days."""
    stretch = month("date") if stretch is None else stretch
    there = F.when(F.col("value").isNotNull(), F.struct("date", "value"))
    df = known(known(grid, {"_a": there}, ["date"], stretch), {"_b": there}, ["date"], stretch, ahead=True)
    gone, left = F.datediff("date", F.col("_a.date")), F.datediff(F.col("_b.date"), "date")
    line = F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * gone / (gone + left)
    return df.withColumn("filled", F.when(F.col("value").isNotNull(), F.col("value")).when((gone <= most) & (left <= most), line)).drop("_a", "_b")


def stuck(readings: DataFrame, hours: float = 24.0, stretch: Column | None = None) -> DataFrame:
    """(key, last_value, run_start, run_end, stuck) of (key, ts, value): whether the key's last run of equal values lasts longer. The run starts at the last row that
    differs from the one before, which aggregation finds."""
    told = known(readings, {"_before": F.struct("value")}, ["ts"], month("ts") if stretch is None else stretch, now=False)
    new = F.coalesce(F.col("value") != F.col("_before.value"), F.lit(True))
    last = told.groupBy("key").agg(F.max_by("value", "ts").alias("last_value"), F.max(F.when(new, F.col("ts"))).alias("run_start"), F.max("ts").alias("run_end"))
    seconds = F.unix_micros(F.col("run_end").cast("timestamp")) - F.unix_micros(F.col("run_start").cast("timestamp"))
    return last.withColumn("stuck", seconds > hours * 3_600_000_000)


def spread(rows: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` by key over all shuffle partitions, which adaptive plans leave as many: for work a key that its bytes don't tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
