"""Joins of points with polygons that are a table: a covering of grid cells stands for them.

A polygon is cut into cells of ``size`` degrees. A cell that no edge touches is inside or outside as a whole; one that edges touch keeps these edges and
whether its lower left corner is inside. A point's cell is an equi-join; in a cell with edges the way from the corner up the left side and across to
the point crosses edges as often as it changes sides. Edges are dealt out by bands of a cell's height and never gathered by polygon: what meets is a
cell's edges, or a polygon's crossings of one line. Sides are worked out as even-odd ray casting does, so holes are rings like others.

The grid is shifted by an odd fraction of a degree, so that no vertex in round numbers lies on a line of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import _cut

SHIFT = (0.000314159265358979, 0.000271828182845904)
#: Bytes of cells that may go to every executor.
MOST_BYTES = 64 << 20


def _line(at: Column, axis: int, size: float) -> Column:
    return at * F.lit(size) + F.lit(SHIFT[axis])


def _cell(v: Column, axis: int, size: float) -> Column:
    return F.floor((v - F.lit(SHIFT[axis])) / F.lit(size))


def edges(polygons: DataFrame) -> DataFrame:
    """(polygon, x1, y1, x2, y2) of (polygon, rings), rings being arrays of arrays of (x, y), closed or open; edges without length are none."""
    ring = polygons.select("polygon", F.explode("rings").alias("r")).filter(F.size("r") > 2)
    ends = F.arrays_zip(F.col("r").alias("a"), F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1)).alias("b"))
    flat = ring.select("polygon", F.explode(ends).alias("e")).select("polygon", *[F.col(f"e.{p}.{c}").cast("double").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in "xy"])
    return flat.filter("x1 <> x2 or y1 <> y2")


def covering(polygons: DataFrame, size: float) -> DataFrame:
    """(i, j, polygon, inside, edges) of (polygon, rings): ``inside`` is that of the cell's lower left corner, ``edges`` an array, null where none touches."""
    e = edges(polygons)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # Crossings of the grid's level lines, for the corners; ``at`` is the cell that a crossing lies in.
    lines = F.sequence(_cell(low, 1, size), _cell(high, 1, size) + 1)
    met = e.withColumn("j", F.explode(lines)).withColumn("y", _line(F.col("j"), 1, size)).filter((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    crossed = met.select("polygon", "j", _cell((F.col("y") - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))) + F.col("x1"), 0, size).alias("at"))
    rows = crossed.groupBy("polygon", "j").agg(F.sort_array(F.collect_list("at"), asc=False).alias("ats"))
    # Cells that an edge touches, band by band.
    band = e.withColumn("j", F.explode(F.sequence(_cell(low, 1, size), _cell(high, 1, size))))
    y0, y1 = (F.greatest(F.least(_line(F.col("j") + k, 1, size), high), low) for k in (0, 1))
    x = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise((y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))) + F.col("x1"))
    level = F.col("y1") == F.col("y2")
    left = F.when(level, F.least("x1", "x2")).otherwise(F.least(x(y0), x(y1))) - 1e-9
    right = F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(x(y0), x(y1))) + 1e-9
    touched = band.withColumn("i", F.explode(F.sequence(_cell(left, 0, size), _cell(right, 0, size))))
    border = touched.groupBy("polygon", "i", "j").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    odd = lambda i: F.size(F.filter(F.coalesce("ats", F.array().cast("array<bigint>")), lambda a: a >= i)) % 2 == 1
    border = border.join(rows, ["polygon", "j"], "left").select("i", "j", "polygon", odd(F.col("i")).alias("inside"), "edges")
    # Between an odd crossing and the next, counted from the right, corners are inside.
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.size("ats"), F.lit(2)), lambda k: F.struct((F.get("ats", k) + 1).alias("a"), F.get("ats", k - 1).alias("b"))), lambda p: p["a"] <= p["b"])
    runs = rows.select("polygon", "j", F.explode(pairs).alias("p"))
    inner = runs.select(F.explode(F.sequence("p.a", "p.b")).alias("i"), "j", "polygon").join(border.select("i", "j", "polygon"), ["i", "j", "polygon"], "left_anti")
    return border.unionByName(inner.withColumn("inside", F.lit(True)), allowMissingColumns=True)


def _holds(lon: Column, lat: Column, i: Column, j: Column, cell: Column, size: float) -> Column:
    """Whether the cell's polygon holds the point: its corner's side, changed by each edge on the way."""
    x0, y0 = _line(i, 0, size), _line(j, 1, size)
    up = lambda e: ((e["x1"] > x0) != (e["x2"] > x0)) & ((x0 - e["x1"]) * ((e["y2"] - e["y1"]) / (e["x2"] - e["x1"])) + e["y1"]).between(y0, lat)
    crossing = lambda e: (lat - e["y1"]) * ((e["x2"] - e["x1"]) / (e["y2"] - e["y1"])) + e["x1"]
    across = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (crossing(e) > x0) & ~(lon < crossing(e))
    walked = F.aggregate(cell["edges"], cell["inside"], lambda side, e: (side != up(e)) != across(e))
    return F.when(cell["edges"].isNull(), cell["inside"]).otherwise(walked)


def regions(points: DataFrame, polygons: DataFrame, size: float = 0.25, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``points`` (lon, lat and others) with region: the first in order, of (region, place, rings), whose polygon holds the point, else null; ties in place go to the
    smaller region. A region may have several polygons. Each place is asked once, however many points are there. The covering goes to every executor if it fits
    ``most_bytes``, so places stay where they are; else both sides meet by cell, and AQE splits a cell that holds many. Points without a place are in no region."""
    # Of equal polygons the first in order answers for all.
    named = polygons.groupBy("rings").agg(F.min(F.struct("place", "region")).alias("polygon"))
    # Polygons of one place and region are taken together, as parts that don't overlap. What comes after a polygon that holds the whole cell is never the first.
    covered = _cut(covering(named, size))
    whole = covered.filter("edges is null and inside").groupBy("i", "j").agg(F.min("polygon").alias("whole"))
    reached = covered.join(whole, ["i", "j"], "left").filter(F.col("whole").isNull() | (F.col("polygon") <= F.col("whole")))
    cells = reached.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("polygon", "inside", "edges"))).alias("cells"))
    cells = _cut(cells)
    width = 40 + F.aggregate("cells", F.lit(0), lambda n, c: n + 48 + 40 * F.coalesce(F.size(c["edges"]), F.lit(0)))
    small = (cells.agg(F.sum(width)).head()[0] or 0) <= most_bytes
    at = {"_i": _cell(F.col("lon"), 0, size), "_j": _cell(F.col("lat"), 1, size)}
    side = cells.select(F.col("i").alias("_ci"), F.col("j").alias("_cj"), F.col("cells").alias("_cells"))
    joined = points.select("lon", "lat").distinct().withColumns(at).join(F.broadcast(side) if small else side, (F.col("_i") == F.col("_ci")) & (F.col("_j") == F.col("_cj")), "left")
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    first = F.filter("_cells", lambda c: _holds(lon, lat, F.col("_i"), F.col("_j"), c, size))
    told = joined.select("lon", "lat", F.get(first, F.lit(0))["polygon"]["region"].alias("region"))
    return points.join(told, ["lon", "lat"], "left").select(*points.columns, "region")
