"""Packs, registers, geometry blobs, grids and timescales."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet.functions import geodesy, units
from rillet.sources import is_fresh, line_points, prune, publish, register, to_box


def test_publish_swaps_whole_packs(spark, tmp_path):
    path = str(tmp_path / "pack")
    publish({"a": spark.range(3), "b": spark.range(1)}, path)
    publish({"a": spark.range(5)}, path)
    assert spark.read.json(f"{path}/a").count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["pack"] and sorted(p.name for p in (tmp_path / "pack").iterdir()) == ["a"]
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        publish({"a": spark.range(9), "c": bad}, path)
    assert spark.read.json(f"{path}/a").count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["pack"]


def test_prune_keeps_the_newest(spark, tmp_path):
    import os

    for i in range(4):
        (tmp_path / f"c{i}").mkdir()
        os.utime(tmp_path / f"c{i}", (i * 86_400, i * 86_400))
    assert prune(spark, str(tmp_path), 10 * 86_400_000, 8.5, 1) == ["c1", "c0"] and prune(spark, str(tmp_path), 90 * 86_400_000, 1, 1) == ["c2"]
    assert prune(spark, str(tmp_path / "none"), 0, 1) == []


def test_register_and_freshness(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"key": "a", "threshold": 2.5}, {"key": "b"}]))
    assert [tuple(r) for r in register(spark, str(tmp_path / "r.json"), "key string, threshold double").collect()] == [("a", 2.5), ("b", None)]
    out = str(tmp_path / "t")
    assert not is_fresh(spark, str(tmp_path / "r.json"), out)
    spark.range(1).write.parquet(out)
    assert is_fresh(spark, str(tmp_path / "r.json"), out)


def test_line_points(spark):
    pts = [(1.0, 2.0), (3.0, 4.5)]
    flat = struct.pack("<BII", 1, 2, 2) + b"".join(struct.pack("<dd", *p) for p in pts)
    big = struct.pack(">BII", 0, 1002, 2) + b"".join(struct.pack(">ddd", *p, 9.0) for p in pts)
    header = b"GP\x00\x03" + struct.pack("<i", 27700) + struct.pack("<dddd", 0, 0, 0, 0)
    several = struct.pack("<BII", 1, 5, 1) + flat
    blobs = [flat, big, header + flat, several, None, b"", struct.pack("<BII", 1, 1, 0), flat[:-3]]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b binary").select("i", line_points("b").alias("p")).orderBy("i").collect()
    assert [r.p and [(q.x, q.y) for q in r.p] for r in got] == [pts] * 4 + [None] * 4


def test_grid_and_back(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(50, 58, 50), rng.uniform(-6, 1.5, 50))]
    d = spark.createDataFrame(rows, "lat double, lon double")
    east, north = geodesy.to_grid(F.col("lat"), F.col("lon"))
    there = spark.createDataFrame([tuple(r) for r in d.select("lat", "lon", east, north).collect()], "lat double, lon double, e double, n double")
    for r in there.withColumn("x", geodesy.from_grid(F.col("e"), F.col("n"))).collect():
        assert abs(r.x.lat - r.lat) < 2e-6 and abs(r.x.lon - r.lon) < 2e-6


def test_memory_days(spark):
    # With shape 1 the response is exponential: 95 % after ln 20 scales; shape 2 has (1 + x) exp(-x) = 0.05.
    rows = [(1.0, 50.0, 10.0), (2.0, 50.0, None), (1.0, 1.0, 90.0), (None, 5.0, None), (0.5, 1e5, 1.0), (1.0, 50.0, 400.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "n double, a double, alpha double").select(units.memory_days("n", "a", "alpha")).collect()]
    assert np.allclose(got, [50 * np.log(20), 50 * 4.743864518, 90.0, 30.0, 2000.0, 400.0], rtol=1e-6)


def test_to_box(spark):
    x, y = to_box(F.col("lon"), F.col("lat"), (-2.0, 50.0, 0.0, 52.0), 100.0, 100.0)
    got = spark.createDataFrame([(-1.0, 51.0), (-2.0, 52.0), (0.0, 50.0)], "lon double, lat double").select(x, y).collect()
    half = 50 * float(np.cos(np.radians(51)))
    assert np.allclose([tuple(r) for r in got], [(50, 50), (50 - half, 0), (50 + half, 100)])
