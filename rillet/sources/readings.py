"""Sources and sinks: declared schemas, tolerant casts, pruning by partition."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField("dateTime", T.StringType()), T.StructField("value", T.StringType()), T.StructField("quality", T.StringType())])


def csv_readings(spark: SparkSession, path: str, schema: T.StructType = RAW, ts: str = "dateTime", value: str = "value") -> DataFrame:
    """(ts, value, ...) of a CSV with a header: times in UTC, numbers or null, rows without either dropped. No inference pass."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    v = F.expr(f"try_cast(`{value}` as double)")
    out = df.withColumns({ts: F.try_to_timestamp(F.col(ts)), value: F.when(~F.isnan(v), v)})
    return out.na.drop(subset=[ts, value])


def pick(df: DataFrame, aliases: dict[str, list[str]], optional: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns under canonical names, each from the first of its aliases that is there (letter case ignored); required ones raise, optional
    ones are null."""
    have = {c.lower(): c for c in df.columns}
    found = lambda names: next((have[n.lower()] for n in names if n.lower() in have), None)
    out = []
    for name, names in aliases.items():
        if not (c := found([name, *names])):
            raise ValueError(f"no column for {name}: one of {[name, *names]} is needed, there are {df.columns}")
        out.append(F.col(f"`{c}`").alias(name))
    for name, names in (optional or {}).items():
        c = found([name, *names])
        out.append((F.col(f"`{c}`") if c else F.lit(None)).alias(name))
    return df.select(*out)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if gone := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns missing: {gone}")
    return df


def quality_gate(df: DataFrame, bad: Column, warn: float = 0.01, fail: float = 0.05) -> str:
    """ok, warn, or an error where the share of bad rows is over ``fail``; one aggregation."""
    share = df.agg(F.avg(F.when(bad, 1.0).otherwise(0.0))).head()[0] or 0.0
    if share > fail:
        raise ValueError(f"{share:.1%} of rows are bad; at most {fail:.0%} may be")
    return "warn" if share > warn else "ok"


def json_members(df: DataFrame, payload: str, names: list[str], key: str = "time") -> DataFrame:
    """(time, member, value) of JSON payloads with parallel arrays: wide members made long."""
    kind = T.StructType([T.StructField(key, T.ArrayType(T.StringType())), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])
    p = df.withColumn("_p", F.from_json(payload, kind))
    zipped = p.select(*df.columns, F.explode(F.arrays_zip(*[F.col(f"_p.{n}").alias(n) for n in (key, *names)])).alias("_z"))
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("member"), F.col(f"_z.{n}").alias("value")) for n in names]))
    return zipped.select(*[c for c in df.columns if c != payload], F.col(f"_z.{key}").alias(key), long.alias("_m")).select("*", "_m.*").drop("_m")


def increments(series: DataFrame, scale: float = 1.0) -> DataFrame:
    """Daily amounts of an accumulated series (key, date, value), never negative; the first is its own amount."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("key").orderBy("date"))
    return series.withColumn("value", F.greatest(F.col("value") - F.coalesce(before, F.lit(0.0)), F.lit(0.0)) * scale)


def write_by_key(series: DataFrame, path: str, key: str = "key") -> None:
    """One folder a key, for reads of single keys; rows of a key meet in one task first, so a key has one file."""
    series.repartition(key).sortWithinPartitions(key).write.mode("overwrite").partitionBy(key).parquet(path)


def read_key(spark: SparkSession, path: str, key: str, value, columns: list[str]) -> DataFrame:
    """A key's rows: the folder is pruned and only the named columns are read."""
    return spark.read.parquet(path).filter(F.col(key) == value).select(*columns)


def polygons(spark: SparkSession, path: str) -> list[tuple[str, list]]:
    """(name, rings) of a GeoJSON file's polygons; a bounded register, read on the driver by Spark's own reader."""
    out = []
    for (text,) in spark.read.option("wholetext", True).text(path).collect():
        for f in json.loads(text)["features"]:
            g = f["geometry"]
            for rings in [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]:
                out.append((str(f.get("properties", {}).get("name", "")), [[tuple(p[:2]) for p in r] for r in rings]))
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bilinear(points: DataFrame, tiles: DataFrame, cell: float) -> DataFrame:
    """``points`` (x, y) with height from a long raster (i, j, v) of nodes ``cell`` apart: four cells meet each point by equi-join."""
    at = points.withColumns({"_i": F.floor(F.col("x") / cell), "_j": F.floor(F.col("y") / cell)})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    four = at.withColumn("_c", corner).withColumns({"i": F.col("_i") + F.col("_c.a"), "j": F.col("_j") + F.col("_c.b")})
    fx, fy = F.col("x") / cell - F.col("_i"), F.col("y") / cell - F.col("_j")
    w = F.when(F.col("_c.a") == 1, fx).otherwise(1 - fx) * F.when(F.col("_c.b") == 1, fy).otherwise(1 - fy)
    joined = four.join(tiles.select("i", "j", "v"), ["i", "j"], "left")
    return joined.groupBy(*points.columns).agg(F.when(F.count("v") == 4, F.sum(w * F.col("v"))).alias("height"))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a line; nulls stay out and NaN can't get in, as numbers that aren't are made null."""
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
