import json

import pytest
from pyspark.sql import functions as F

from rillet import sources


def test_csv_readings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dateTime,value,quality\n2024-01-01T00:00:00Z,1.5,Good\nrubbish,2,Good\n2024-01-02T00:00:00Z,n/a,Bad\n2024-01-03T00:00:00Z,NaN,Bad\n")
    got = sources.csv_readings(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.dateTime.day, r.value) for r in got] == [(1, 1.5)]


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2.0)], "stationGuid int, Lat double")
    got = sources.pick(df, {"id": ["stationguid", "notation"], "lat": ["latitude"]}, {"town": []})
    assert got.columns == ["id", "lat", "town"] and got.head().town is None
    with pytest.raises(ValueError):
        sources.pick(df, {"lon": ["long"]})


def test_gate(spark):
    df = spark.range(100)
    assert sources.quality_gate(df, F.col("id") < 0) == "ok" and sources.quality_gate(df, F.col("id") < 3) == "warn"
    with pytest.raises(ValueError):
        sources.quality_gate(df, F.col("id") < 10)


def test_json_members(spark):
    p = json.dumps({"time": ["a", "b"], "m1": [1.0, None], "m2": [3.0, 4.0]})
    got = sorted((r.time, r.member, r.value) for r in sources.json_members(spark.createDataFrame([(7, p)], "k int, p string"), "p", ["m1", "m2"]).collect() if r.value)
    assert got == [("a", "m1", 1.0), ("a", "m2", 3.0), ("b", "m2", 4.0)]


def test_key_folders_prune(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 5).alias("key"), F.col("id").alias("n"), F.lit("x").alias("s"))
    sources.write_by_key(df, str(tmp_path / "t"))
    one = sources.read_key(spark, str(tmp_path / "t"), "key", 3, ["n"])
    assert one.count() == 20 and "PartitionFilters: [isnotnull(key" in one._jdf.queryExecution().toString()
    assert sources.manifest(spark, str(tmp_path / "t")).count() >= 5


def test_bilinear(spark):
    tiles = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(3) for j in range(3)], "i long, j long, v double")
    got = sources.bilinear(spark.createDataFrame([(1, 5.0, 2.5), (2, 99.0, 0.0)], "id int, x double, y double"), tiles, 5.0).orderBy("id").collect()
    assert got[0].height == pytest.approx(1 + 5) and got[1].height is None


def test_polygons(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"name": "a"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]]]}}]}))
    assert sources.polygons(spark, str(tmp_path / "g.json")) == [("a", [[(0, 0), (1, 0), (1, 1)]])]


def test_documents_hold_no_nan(spark, tmp_path):
    sources.write_documents(spark.createDataFrame([(1, float("nan")), (2, 1.5)], "k int, v double"), str(tmp_path / "d"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "d")).collect()) == ['{"k":1}', '{"k":2,"v":1.5}']
