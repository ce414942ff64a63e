"""Scans by stretches equal plain scans, on a key with nearly all rows too, and no task gets that key whole."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillet.operators import segments


def hot(spark, rng, n=3000):
    day = lambda: dt.date(2015, 1, 1) + dt.timedelta(rng.randrange(3000))
    rows = {(k, day()): rng.choice([None, *map(float, range(4))]) for k in [1] * n + [2, 3, None] * 40}
    rows |= {(4, dt.date(2015, 1, 1)): None, (5, dt.date(2020, 1, 1)): 1.0}
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "key long, date date, value double").repartition(7)


def told(df):
    return sorted(map(repr, df.collect()))


def test_known_before_and_ahead(spark):
    df = hot(spark, random.Random(1))
    w = Window.partitionBy("key").orderBy("date")
    behind, front = Window.unboundedPreceding, Window.unboundedFollowing
    for ahead, now in ((False, True), (False, False), (True, True), (True, False)):
        got = segments.known(df, {"x": F.col("value"), "d": F.when(F.col("value") > 1, F.col("date"))}, ["date"], segments.month("date"), ahead, now)
        frame = w.rowsBetween(0 if now else 1, front) if ahead else w.rowsBetween(behind, 0 if now else -1)
        pick = F.first if ahead else F.last
        want = df.withColumns({"x": pick("value", True).over(frame), "d": pick(F.when(F.col("value") > 1, F.col("date")), True).over(frame)})
        assert told(got) == told(want)


def test_operators_on_a_hot_key(spark):
    df = hot(spark, random.Random(2))
    w = Window.partitionBy("key").orderBy("date")
    obs = df.filter("value is not null")
    axis = df.select("key").distinct().select("key", F.explode(F.expr("sequence(date'2014-12-01', date'2023-06-01', interval 9 day)")).alias("date"))
    both = axis.withColumns({"value": F.lit(None).cast("double"), "ask": F.lit(1)}).unionByName(obs.withColumn("ask", F.lit(0)))
    last = F.last(F.when(F.col("ask") == 0, F.struct("date", "value")), True).over(Window.partitionBy("key").orderBy("date", "ask"))
    near = F.datediff("date", F.col("l.date")) <= 5
    want = both.withColumn("l", last).filter("ask = 1").select("key", "date", F.when(near, F.col("l.value")).alias("value"), F.when(near, F.col("l.date")).alias("seen"))
    assert told(segments.as_of(axis, obs, 5)) == told(want)
    runs = df.na.drop(subset=["key"]).withColumn("value", F.when(F.col("date") > "2022-06-01", 3.0).otherwise(F.col("value"))).select("key", F.col("date").cast("timestamp").alias("ts"), "value")
    v = Window.partitionBy("key").orderBy("ts")
    marked = runs.withColumn("n", F.when(F.col("value") == F.lag("value").over(v), 0).otherwise(1)).withColumn("r", F.sum("n").over(v))
    per = marked.groupBy("key", "r").agg(F.first("value").alias("last_value"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    end = per.groupBy("key").agg(F.max_by(F.struct("last_value", "a", "b"), "r").alias("x")).select("key", "x.*")
    assert told(segments.stuck(runs)) == told(end.select("key", "last_value", F.col("a").alias("run_start"), F.col("b").alias("run_end"), (F.unix_seconds("b") - F.unix_seconds("a") > 86400).alias("stuck")))


def test_no_task_gets_the_hot_key_whole(spark):
    df = hot(spark, random.Random(3))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = segments.known(df, {"x": F.col("value")}, ["date"], segments.month("date")).withColumn("p", F.spark_partition_id())
        most, all_ = got.groupBy("p").count().agg(F.max("count"), F.sum("count")).head()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most < 0.25 * all_ and df.filter("key = 1").count() > 0.9 * all_
