"""Joins of places: rows of one place are compared as one, and every pair of them comes out."""

import pytest
from pyspark.sql import functions as F

from rillet.operators import cover, extra, picks, spatial


def spots(spark, n, places, step=0.01):
    return spark.range(n).select("id", (50 + F.col("id") % places * step).alias("lat"), F.lit(1.0).alias("lon"))


def test_within_compares_places(spark):
    own = spots(spark, 6000, 3)
    assert spatial.blocks(own, ["lat", "lon"]).count() <= 3 * 2
    assert spatial.within(own, own, 0.5).count() == 3 * 2000**2
    near = spatial.within(own, own, 1.2)
    assert near.count() == 3 * 2000**2 + 4 * 2000**2
    assert "REPARTITION_BY_NUM" in near._jdf.queryExecution().toString()


def test_within_works_out_a_distance_before_ids_are_paired(spark):
    """And pairs one left id after the other, behind a sort, whatever the sides' sizes."""
    own = spots(spark, 600, 3)
    plan = spatial.within(own, own, 1.2, digits=6)._jdf.queryExecution().sparkPlan().toString()
    at = [plan.index(c) for c in ("explode(ids2", "round(", "SortMergeJoin", "explode(ids1")]
    assert at == sorted(at) and "BroadcastHashJoin [i#" not in plan
    got = {r.km for r in spatial.within(own, own, 1.2, digits=3).collect()}
    assert got == {0.0, 1.112} and spatial.within(own, own, 1.2).filter("km <> round(km, 3)").count() == 4 * 200**2


def test_within_carries_columns_and_own_radius(spark):
    r = spark.createDataFrame([(1, 50.0, 1.0, 2.0), (2, 50.0, 1.0, 0.1), (3, 50.02, 1.0, None)], "id long, lat double, lon double, km double")
    got = spatial.within(spots(spark, 2, 2), r.withColumn("id", F.struct("id", "km")), 3.0, F.col("km")).select("a", "b.id").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (0, 2), (1, 1)]


@pytest.mark.parametrize("most", [100_000, 0])
def test_nearest_asks_once_a_place(spark, monkeypatch, most):
    asked = []
    whole = spatial._nearest
    monkeypatch.setattr(spatial, "_nearest", lambda l, r, *a: asked.append((l.count(), r.count())) or whole(l, r, *a))
    got = spatial.nearest(spots(spark, 400, 4), spots(spark, 300, 2, 0.015), 3, most).collect()
    assert asked == [(4, 6)]
    assert len(got) == 1200 and {(r.b, r.slot) for r in got if r.a % 4 == 0} == {(0, 1), (2, 2), (4, 3)} and {(r.b, r.slot) for r in got if r.a % 4 == 2} == {(1, 1), (3, 2), (5, 3)}


def test_regions_look_no_further_than_a_polygon_that_holds_the_cell(spark, monkeypatch):
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]]
    wide = [[(-1.0, -1.0), (3.0, -1.0), (3.0, 3.0), (-1.0, 3.0)]]
    rows = [(f"s{k}", k % 3 + 1, square) for k in range(20)] + [(f"w{k}", 2, [[(x - 0.01 * k, y) for x, y in wide[0]]]) for k in range(20)]
    p = spark.createDataFrame(rows, "region string, place int, rings array<array<struct<x: double, y: double>>>")
    cut, kept = cover._cut, []
    monkeypatch.setattr(cover, "_cut", lambda df: kept.append(cut(df)) or kept[-1])
    points = spark.createDataFrame([(1, 1.1, 1.1), (2, 1.1, 1.1), (3, -0.5, 2.5), (4, 9.0, 9.0), (5, None, 1.0)], "id int, lon double, lat double")
    got = {r.id: r.region for r in cover.regions(points, p).collect()}
    assert got == {1: "s0", 2: "s0", 3: "w0", 4: None, 5: None}
    assert kept[-1].filter("array_contains(transform(cells, c -> c.polygon.region), 's0')").agg(F.min(F.size("cells"))).head()[0] == 1


def test_boxes_are_compared_once(spark):
    a = spark.range(3000).select("id", *[F.lit(v).alias(c) for c, v in (("x1", 0.9), ("y1", 0.9), ("x2", 1.1), ("y2", 1.1))], F.lit(None).cast("string").alias("form"))
    b = a.withColumn("form", F.when(F.col("id") % 3 == 0, "canal").when(F.col("id") % 3 == 1, "river"))
    met = extra.box_overlaps(spark, a, b, "canal")
    assert met.count() == 3000 * 2000 and met.distinct().count() == 3000 * 2000
    assert "REPARTITION_BY_NUM" in met._jdf.queryExecution().toString()


def test_spans_shared(spark):
    p = spark.sql("SELECT struct(1L AS id, date'2000-01-01' AS first, date'2003-01-01' AS last) AS a, struct(2L AS id, date'2000-06-01' AS first, date'2009-01-01' AS last) AS b")
    assert [tuple(r) for r in picks.spans_shared(p, 730).collect()] == [(1, 2, 944)] and not picks.spans_shared(p, 945).count()
