"""Distance and region joins. Distance joins meet in grid cells of the radius's size, so their work follows the neighbours and not the
product of the sides."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import EARTH_KM, haversine_km, in_polygon

KM_A_DEGREE = 111.0


def _bands(km: float) -> float:
    """Height of a band of cells in degrees: no less than the radius."""
    return km / KM_A_DEGREE


def _columns(band: Column, km: float) -> Column:
    """Cells around a band: each at least as wide as the radius where the band is narrowest, one at a pole."""
    edge = F.least(F.greatest(F.abs(band * _bands(km)), F.abs((band + 1) * _bands(km))), F.lit(90.0))
    return F.greatest(F.lit(1).cast("long"), F.floor(360 * KM_A_DEGREE * F.cos(F.radians(edge)) / km))


#: Rows of one place are dealt in blocks of about so many; a cell's places in so many parts, each of which meets all of the other side's.
BLOCK, PARTS = 1000, 8


def blocks(rows: DataFrame, at: list[str], id: str = "id") -> DataFrame:
    """(at, ids): rows of equal ``at`` as arrays of their ids, each of about BLOCK at most, so that what holds for a place is worked out once."""
    n = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    dealt = rows.select(*at, F.col(id).alias("_id")).join(n, at).withColumn("_block", F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / BLOCK)))
    return dealt.groupBy(*at, "_block").agg(F.collect_list("_id").alias("ids")).drop("_block")


def meeting(here: DataFrame, there: DataFrame, cell: list[str], kept: Column, **told: Column) -> DataFrame:
    """(a, b, and what is ``told`` of both sides): every pair of ids of rows (cell, ids and their own columns; ids1 here, ids2 there) that meet in a cell and are ``kept``. The left
    side's are dealt in PARTS, the right side's go to each, in tasks that aren't merged by their size: what comes out of them is larger than what goes in. What is told is worked out
    once for a left id and a right row, before that row's ids are paired with it. The left ids are sorted into the join one by one, since a task holds all that comes of one row of
    its left side before it hands on any, and of a row of many ids that is too much."""
    tasks = int(here.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = here.withColumn("_part", F.pmod(F.xxhash64("ids1"), F.lit(PARTS)).cast("int")).repartition(tasks, *cell, "_part").withColumn("a", F.explode("ids1")).drop("ids1")
    other = there.withColumn("_part", F.explode(F.array(*map(F.lit, range(PARTS))))).repartition(tasks, *cell, "_part")
    met = own.join(other.hint("merge"), [*cell, "_part"]).filter(kept).select("a", "ids2", *[c.alias(n) for n, c in told.items()])
    return met.select("a", F.explode("ids2").alias("b"), *told)


def within(left: DataFrame, right: DataFrame, km: float, radius: Column | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, km) of ids in ``left`` and ``right`` (id, lat, lon) at ``km`` at most, or at the right row's own ``radius`` that is no larger,
    anywhere on the globe; km comes rounded to ``digits`` if told. Cells are bands of latitude cut into columns by the band's own girth; a right row goes to the columns of its own and
    the two bands beside it that its circle meets, poles and the turn of longitude included, so a pair meets once. Rows of one place are compared as one; ids may be structs that carry further columns.
    Rows without a place meet nothing."""
    here = blocks(left.filter("lat is not null and lon is not null"), ["lat", "lon"]).select(F.col("ids").alias("ids1"), "lat", "lon", F.floor(F.col("lat") / _bands(km)).alias("i"))
    column = lambda lon, n: F.floor((lon + 180) / 360 * n)
    n = _columns(F.col("i"), km)
    here = here.withColumn("j", F.pmod(column(F.col("lon"), n), n))
    own = right.filter("lat is not null and lon is not null").withColumn("_r", radius if radius is not None else F.lit(km)).filter("_r is not null")
    own = blocks(own, ["lat", "lon", "_r"])
    turn = km / EARTH_KM
    # How far the circle reaches in longitude; all around where it holds a pole.
    reach = F.when(F.abs("lat") + math.degrees(turn) >= 90 - 1e-6, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(math.sin(min(turn, math.pi / 2)) / F.cos(F.radians("lat")), F.lit(1.0)))) + 1e-6)
    there = own.select(F.col("ids").alias("ids2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "_r", reach.alias("reach"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda s: F.floor(F.col("lat") / _bands(km)) + s)).alias("i"))
    there = there.withColumn("n", _columns(F.col("i"), km))
    first, last = column(F.col("lon2") - F.col("reach"), F.col("n")), column(F.col("lon2") + F.col("reach"), F.col("n"))
    met = F.transform(F.sequence(first, F.least(last, first + F.col("n") - 1)), lambda j: F.pmod(j, F.col("n")))
    there = there.select("ids2", "lat2", "lon2", "_r", "i", F.explode(met).alias("j"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return meeting(here, there, ["i", "j"], d <= F.col("_r"), km=d if digits is None else F.round(d, digits))


def nearest(left: DataFrame, right: DataFrame, k: int, most_right: int = 100_000) -> DataFrame:
    """(a, b, km, slot): the ``k`` nearest of ``right`` (id, lat, lon) for each of ``left``; ties by id. Rows of ``left`` at one place have one answer, and of ``right``'s rows at
    one place only the first k can be in it. Up to ``most_right`` of these, a table of three numbers each, are sent to the workers once and compared with
    Arrow batches of places by numpy, chunk by chunk, with no pair ever a row. Beyond that, grid cells grow until each place has k neighbours that
    are surely the nearest."""
    own = left.filter("lat is not null and lon is not null")
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("id"))
    few = right.filter("lat is not null and lon is not null").withColumn("_n", first).filter(F.col("_n") <= k).select("id", "lat", "lon")
    at = own.select("lat", "lon").distinct().select(F.struct("lat", "lon").alias("id"), "lat", "lon")
    found = _nearest(at, _cut(few), k, most_right).select(F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"), "b", "km", "slot")
    return own.select(F.col("id").alias("a"), "lat", "lon").join(found, ["lat", "lon"]).select("a", "b", "km", "slot")


def _nearest(left: DataFrame, right: DataFrame, k: int, most_right: int) -> DataFrame:
    if right.limit(most_right + 1).count() <= most_right:
        return _nearest_of_few(left, right, k)
    radius, open_, done = 2.5, left.filter("lat is not null and lon is not null"), None
    while True:
        near = within(open_, right, radius)
        r = F.row_number().over(Window.partitionBy("a").orderBy(F.round("km", 9), "b"))
        near = _cut(near.withColumn("slot", r).filter(F.col("slot") <= k))
        full = near.groupBy("a").count().filter(F.col("count") >= k).select("a")
        part = near.join(full, "a", "left_semi") if radius < 20_000 else near
        done = part if done is None else done.unionByName(part)
        open_ = _cut(open_.join(full, open_["id"] == full["a"], "left_anti"))
        if radius >= 20_000 or not open_.head(1):
            return done
        radius *= 3


def _cut(df: DataFrame) -> DataFrame:
    """A round's state: checkpointed where the cluster has a folder for it, else cached."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def _nearest_of_few(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    table = right.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).toPandas().sort_values("id")
    kind = T.ArrayType(T.StructType([T.StructField("b", right.schema["id"].dataType), T.StructField("km", T.DoubleType()), T.StructField("slot", T.IntegerType())]))
    own = left.sparkSession.sparkContext.broadcast((table["id"].tolist(), np.radians(table["lat"].to_numpy()), np.radians(table["lon"].to_numpy())))

    @F.pandas_udf(kind)
    def best(lat: pd.Series, lon: pd.Series) -> pd.Series:
        ids, lat2, lon2 = own.value
        out, step = [], max(1, 2_000_000 // max(1, len(ids)))
        for at in range(0, len(lat), step):
            p, q = np.radians(lat[at : at + step].to_numpy(float))[:, None], np.radians(lon[at : at + step].to_numpy(float))[:, None]
            h = np.sin((lat2 - p) / 2) ** 2 + np.cos(p) * np.cos(lat2) * np.sin((lon2 - q) / 2) ** 2
            km = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))
            rounded = np.round(km, 9)
            last = np.partition(rounded, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1] if len(ids) else []
            for d, r, m in zip(km, rounded, last):
                near = np.flatnonzero(r <= m)
                near = near[np.argsort(r[near], kind="stable")][:k]  # ids ascend, so ties keep their order
                out.append([{"b": ids[j], "km": float(d[j]), "slot": n} for n, j in enumerate(near, 1)])
        return pd.Series(out, index=lat.index)

    near = left.filter("lat is not null and lon is not null").select(F.col("id").alias("a"), F.explode(best("lat", "lon")).alias("x"))
    return near.select("a", "x.b", "x.km", "x.slot") if len(table) else near.limit(0).select("a", "x.b", "x.km", "x.slot")


def first_region(points: DataFrame, regions: list[tuple[str, list]]) -> DataFrame:
    """``points`` (lon, lat) with region: the first whose polygon (outer ring, holes) holds the point. A few polygons are expressions in
    the scan's stage: no join at all, and boxes go first."""
    out = None
    for name, rings in regions:
        xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
        hit = F.col("lon").between(min(xs), max(xs)) & F.col("lat").between(min(ys), max(ys)) & in_polygon(F.col("lon"), F.col("lat"), rings)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return points.withColumn("region", out if out is not None else F.lit(None).cast("string"))
