"""Streams give what the batch operators give on all rows at once."""

import datetime as dt

from pyspark.sql import functions as F

from rillet.operators import incremental, resample
from rillet.streaming import daily_totals, deduplicated, stuck_flags, upsert_stream
from rillet.streaming.tables import latest_version

SCHEMA = "key long, ts timestamp, value double, source string"


def land(spark, path, rows, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={n}")


def read(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/batch=*")


def rows():
    t = lambda d, h=0: dt.datetime(2024, 1, 1 + d, h)
    return [(1, t(0), 1.0, "live"), (1, t(1), 2.0, "live"), (2, t(0), 5.0, "live")], [(1, t(0), 1.5, "audited"), (1, t(1), 9.0, "live"), (2, t(2), 6.0, "live")], [(1, t(0), 7.0, "live"), (2, t(2), 6.0, "live")]


def rank():
    return F.when(F.col("source") == "audited", 0).otherwise(1)


def test_upserts_keep_precedence(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, r in enumerate(rows()):
        land(spark, src, r, n)
        upsert_stream(read(spark, src).withColumn("date", F.to_date("ts")), out, ["key", "date"], rank, "ts", str(tmp_path / "cp")).awaitTermination()
    got = {(r.key, r.date.day): (r.value, r.source) for r in latest_version(spark, out).collect()}
    assert got[(1, 1)] == (1.5, "audited") and got[(2, 3)] == (6.0, "live") and len(got) == 4
    all_ = spark.createDataFrame([x for r in rows() for x in r], SCHEMA).withColumn("date", F.to_date("ts"))
    assert {(r.key, r.date.day) for r in incremental.precedence(all_, ["key", "date"], rank(), F.col("ts")).collect()} == set(got)


def test_daily_totals_and_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    for n, r in enumerate(rows()):
        land(spark, src, r, n)
    q = daily_totals(read(spark, src)).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    want = resample.daily(spark.createDataFrame([x for r in rows() for x in r], SCHEMA), "key", "ts", "value", "sum")
    assert {(r.key, r.day, r.total) for r in spark.table("totals").collect()} == {tuple(r) for r in want.collect()}
    q = deduplicated(read(spark, src), ["key", "ts"]).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == spark.table("once").select("key", "ts").distinct().count() == 4


def test_stuck_flags(spark, tmp_path):
    src = str(tmp_path / "in")
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    land(spark, src, [(1, t(0), 3.0, "a"), (1, t(20), 3.0, "a")], 0)
    land(spark, src, [(1, t(30), 3.0, "a"), (1, t(31), 4.0, "a")], 1)
    q = stuck_flags(read(spark, src).select("key", "ts", "value")).writeStream.format("memory").queryName("stuck").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.stuck for r in spark.table("stuck").orderBy("ts").collect()] == [False, False, True, False]


def test_upserts_rewrite_touched_parts_and_forget_old_versions(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = lambda d: dt.datetime(2024, 1, 1 + d)
    batches = [[(k, t(0), float(k), "live") for k in range(40)], *[[(3, t(n), float(n), "live")] for n in range(1, 6)]]
    for n, r in enumerate(batches):
        land(spark, src, r, n)
        upsert_stream(read(spark, src), out, ["key"], rank, "ts", str(tmp_path / "cp"), parts=8).awaitTermination()
    got = {r.key: r.value for r in latest_version(spark, out).collect()}
    assert got == {**{k: float(k) for k in range(40)}, 3: 5.0}
    parts = {v.name: len(list(v.glob("_part=*"))) for v in (tmp_path / "out").iterdir()}
    assert parts["v=0"] == 7 and parts["v=4"] == parts["v=5"] == 1 and parts["v=1"] == parts["v=3"] == 0
    late = upsert_stream(read(spark, src), str(tmp_path / "short"), ["key", "ts"], rank, "ts", str(tmp_path / "cp2"), retention=2, parts=1)
    late.awaitTermination()
    assert min(r.ts for r in latest_version(spark, str(tmp_path / "short")).collect()) == t(3)
