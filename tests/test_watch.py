"""Silent keys turn stale and go by themselves; restarts go on from the checkpoint."""

import datetime as dt

import pytest

from rillet.streaming import watch

SCHEMA = "key long, ts timestamp, value double"


def at(days, hours=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days, hours=hours)


def test_timers(spark, tmp_path):
    old = spark.conf.get(watch.STORE[0], None)
    spark.conf.set(*watch.STORE)
    try:
        src, out = str(tmp_path / "in"), str(tmp_path / "out")

        def land(n, rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/batch={n}")

        def run():
            stream = spark.readStream.schema(SCHEMA).parquet(f"{src}/batch=*")
            q = watch.watched(stream, stuck=24, stale=48, forget=240).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
            q.processAllAvailable()
            rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
            q.stop()
            return rows[-1]

        said = lambda: {(r.key, r.state, r.ts) for r in spark.read.schema(watch.TOLD).parquet(out).collect()}
        land(0, [(1, at(0), 3.0), (1, at(0, 20), 3.0), (1, at(1, 6), 3.0), (2, at(0), 1.0)])
        run()
        assert said() == {(1, "live", at(0)), (1, "live", at(0, 20)), (1, "stuck", at(1, 6)), (2, "live", at(0))}
        land(1, [(2, at(5), 2.0), (2, at(5, 1), 2.0)])  # nothing of key 1
        before = run()
        assert (1, "stale", at(3, 6)) in said() and not [s for s in said() if s[1] == "gone"]
        land(2, [(2, at(30), 2.0)])
        after = run()
        assert (1, "gone", at(11, 6)) in said() and (2, "stuck", at(30)) in said() and after < before
        land(3, [(1, at(30, 1), 3.0)])  # back again, with nothing remembered
        run()
        assert (1, "live", at(30, 1)) in said() and len([s for s in said() if s[:2] == (1, "stale")]) == 1
    finally:
        spark.conf.unset(watch.STORE[0]) if old is None else spark.conf.set(watch.STORE[0], old)


def test_order_of_the_ends():
    with pytest.raises(ValueError):
        watch.watched(None, stale=10, forget=5)
