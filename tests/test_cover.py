"""Polygon coverings against ray casting of every point with every polygon."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillet.operators import cover

KIND = "region string, place int, rings array<array<struct<x double, y double>>>"


def ray(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if (y1 > y) != (y2 > y) and x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1:
                odd = not odd
    return odd


def star(rng, x, y, r, n):
    return [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def made(rng, n):
    out = []
    for k in range(n):
        x, y, r = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice([0.02, 0.3, 1.5])
        rings = [star(rng, x, y, r, rng.randint(3, 40))]
        if k % 2:
            rings.append(star(rng, x, y, r * 0.2, 5))
        out.append((f"r{k}", k // 2, rings))
    square = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]  # closed, level and upright edges in round numbers
    return [*out, ("square", 500, [square, [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]]), ("none", 501, [[(0.0, 0.0), (1.0, 1.0)]]), ("empty", 502, [])]


@pytest.mark.parametrize("size,most", [(0.25, cover.MOST_BYTES), (1.7, 0), (0.05, cover.MOST_BYTES)])
def test_regions(spark, size, most):
    rng = random.Random(8)
    polygons = made(rng, 60)
    points = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(1500)] + [(2000 + i, (i % 9 - 4) / 4, (i // 9 - 4) / 4) for i in range(81)] + [(3000, None, 1.0), (3001, 1.0, None)]
    table = spark.createDataFrame([(n, p, [[(float(x), float(y)) for x, y in r] for r in rings]) for n, p, rings in polygons], KIND)
    got = {r.id: r.region for r in cover.regions(spark.createDataFrame(points, "id long, lon double, lat double").repartition(3), table, size, most).collect()}
    assert len(got) == len(points)
    for i, x, y in points:
        want = None if x is None or y is None else next((n for n, _, rings in sorted(polygons, key=lambda p: (p[1], p[0])) if ray(rings, x, y)), None)
        assert got[i] == want, (i, x, y)
    assert len(set(got.values())) > 20


def test_inner_cells_have_no_edges(spark):
    table = spark.createDataFrame([("a", 1, [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]])], KIND).select(F.col("region").alias("polygon"), "rings")
    cells = cover.covering(table, 1.0).collect()
    assert len({(c.i, c.j) for c in cells}) == len(cells)
    inner = [c for c in cells if c.edges is None]
    assert len(inner) == 81 and all(c.inside for c in inner)  # the grid's shift puts the sides into cells -1 to 9
    assert all(len(c.edges) <= 2 for c in cells if c.edges is not None)


def test_no_polygons_and_plan(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id long, lon double, lat double")
    none = spark.createDataFrame([], KIND)
    assert [r.region for r in cover.regions(points, none).collect()] == [None]
    plan = cover.regions(points, spark.createDataFrame([("a", 1, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]])], KIND), most_bytes=0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
