"""Published packs and what is kept beside them, by Spark's own file system, so on any store that Spark writes to."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def store(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def publish(pack: dict[str, DataFrame], path: str) -> None:
    """Write each frame of a pack as JSON lines at path/name. All are written beside the pack first, and the folder takes the old one's place by a rename, so
    a reader sees the old pack or the new one, and a failure leaves the old one. (A store without renames copies; readers then need a marker file.)"""
    spark = next(iter(pack.values())).sparkSession
    fs, make = store(spark, path)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        for name, df in pack.items():
            df.write.option("ignoreNullFields", "false").json(f"{new}/{name}")
        if fs.exists(make(path)):
            fs.rename(make(path), make(old))
        if not fs.rename(make(new), make(path)):
            fs.rename(make(old), make(path))
            raise OSError(f"{new} could not take the place of {path}")
    finally:
        for left in (new, old):
            fs.delete(make(left), True)


def prune(spark: SparkSession, path: str, now_ms: int, days: float, least: int = 1) -> list[str]:
    """Delete what lies in a folder and was last written more than ``days`` before ``now_ms`` (milliseconds), but for the ``least`` newest; the names deleted. A
    folder's listing is a few cycles, so it is read by the driver."""
    fs, make = store(spark, path)
    if not fs.exists(make(path)):
        return []
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(make(path))), reverse=True)
    gone = [n for at, n in found[least:] if at < now_ms - days * 86_400_000]
    for n in gone:
        fs.delete(make(f"{path}/{n}"), True)
    return gone


def register(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A hand-kept register (a JSON list of records, or YAML where a reader for it is installed) as a frame of ``columns`` (a DDL string). Registers are a few
    hundred lines, parsed by the driver; fields that are missing are null."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        rows = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        rows = yaml.safe_load(text)
    names = [f.name for f in spark.createDataFrame([], columns).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows or []], columns)


def is_fresh(spark: SparkSession, source: str, target: str) -> bool:
    """Whether a table was written completely, and after what it is made from."""
    fs, make = store(spark, target)
    done = make(f"{target}/_SUCCESS")
    newest = lambda p: max([s.getModificationTime() for s in fs.listStatus(p)], default=0)
    return bool(fs.exists(done)) and fs.getFileStatus(done).getModificationTime() >= newest(make(source))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def line_points(blobs: pd.Series) -> pd.Series:
    """The points of a line in a geometry blob: a header of 8 bytes and an envelope (by its flags) before well-known binary, or that alone. Lines of 2, 3 or 4
    numbers a point, and of several lines the first; null for what is no line."""

    def one(b: bytes | None):
        if b is None:
            return None
        b = bytes(b)
        at = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get(b[3] >> 1 & 7, 0) if b[:2] == b"GP" and len(b) > 8 else 0
        while len(b) >= at + 9:
            order = "<" if b[at] else ">"
            kind, n = np.frombuffer(b, f"{order}u4", 2, at + 1).tolist()
            size = 2 + (kind // 1000 in (1, 2) or bool(kind >> 30 & 3)) + (kind // 1000 == 3) * 2 + (kind >> 30 & 3 == 3)
            kind = (kind & 0x1FFFFFFF) % 1000
            at += 9
            if kind == 5 and n:
                continue
            if kind != 2 or len(b) < at + 8 * size * n:
                return None
            xy = np.frombuffer(b, f"{order}f8", size * n, at).reshape(n, size)[:, :2]
            return [{"x": float(x), "y": float(y)} for x, y in xy]
        return None

    return blobs.map(one)


def to_box(lon: Column, lat: Column, bounds: tuple[float, float, float, float], width: float, height: float) -> tuple[Column, Column]:
    """(x, y) in a box of ``width`` by ``height``, y downwards, of places within (west, south, east, north): true shapes at the middle latitude, centred."""
    west, south, east, north = bounds
    squeeze = float(np.cos(np.radians((south + north) / 2)))
    scale = min(width / ((east - west) * squeeze), height / (north - south))
    left, top = (width - (east - west) * squeeze * scale) / 2, (height - (north - south) * scale) / 2
    return left + (lon - west) * squeeze * scale, top + (north - lat) * scale
