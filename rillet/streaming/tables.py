"""Streams of readings (key, ts, value, source) into tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import precedence


#: Parts of a table by hash of its key; a batch rewrites the parts that it touches, and of each part so many versions stay.
PARTS, VERSIONS = 64, 2


def upsert_stream(stream: DataFrame, path: str, keys: list[str], rank: Callable[[], Column], recent: str, checkpoint: str, retention: int | None = None, parts: int = PARTS) -> StreamingQuery:
    """Keep at ``path`` one row a key: the least rank's most recent. Keys lie in ``parts`` by hash (path/v=batch/_part=n). A batch is merged with the
    newest version before it of the parts that its keys lie in, and only these are written, as version v=batch; so a batch that runs again after a failure
    overwrites only its own. Readers take each part's newest complete version; older ones than the last VERSIONS of a part are deleted.
    ``retention``: days of ``recent`` to keep, counted back from the newest in the part when it is written."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        touched = [r[0] for r in new.select("_part").distinct().collect()]  # at most ``parts``
        old = _read(spark, path, number, touched)
        both = new if old is None else old.unionByName(new)
        best = precedence(both, keys, rank(), F.col(recent))
        if retention is not None:
            last = F.max(recent).over(Window.partitionBy("_part"))
            best = best.withColumn("_last", last).filter(F.col(recent) >= F.col("_last") - F.expr(f"interval {retention} days")).drop("_last")
        if touched:
            best.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/v={number}")
            _forget(spark, path, touched)
        new.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _store(spark, path: str):
    """Spark's own file system of a path (any store it can read), and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _versions(spark, path: str) -> dict[int, list[int]]:
    """The complete versions of each part, newest first."""
    fs, make = _store(spark, path)
    if not fs.exists(make(path)):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(make(path))]
    found: dict[int, list[int]] = {}
    for v in sorted((int(n[2:]) for n in names if n.startswith("v=") and fs.exists(make(f"{path}/{n}/_SUCCESS"))), reverse=True):
        for s in fs.listStatus(make(f"{path}/v={v}")):
            if (n := s.getPath().getName()).startswith("_part="):
                found.setdefault(int(n[6:]), []).append(v)
    return found


def _read(spark, path: str, before: int | None, parts: list[int] | None = None) -> DataFrame | None:
    newest = {p: max(k) for p, v in _versions(spark, path).items() if (parts is None or p in parts) and (k := [x for x in v if before is None or x < before])}
    if not newest:
        return None
    read = [spark.read.parquet(f"{path}/v={v}/_part={p}").withColumn("_part", F.lit(p)) for p, v in sorted(newest.items())]
    out = read[0]
    for df in read[1:]:
        out = out.unionByName(df)
    return out


def _forget(spark, path: str, parts: list[int]) -> None:
    fs, make = _store(spark, path)
    known = _versions(spark, path)
    for p in parts:
        for v in known.get(p, [])[VERSIONS:]:
            fs.delete(make(f"{path}/v={v}/_part={p}"), True)


def latest_version(spark, path: str, before: int | None = None) -> DataFrame | None:
    """Each part's newest complete version; None where there is none yet."""
    found = _read(spark, path, before)
    return None if found is None else found.drop("_part")


def daily_totals(stream: DataFrame, delay: str = "14 days") -> DataFrame:
    """(key, day, total, n) in windows of a day; ``delay`` bounds how late a reading may come, and with it the state."""
    return stream.withWatermark("ts", delay).groupBy("key", F.window("ts", "1 day").alias("w")).agg(F.sum("value").alias("total"), F.count("value").alias("n")).select("key", F.to_date("w.start").alias("day"), "total", "n")


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "14 days") -> DataFrame:
    """The first row of each key within the watermark: an idempotent append."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stuck_flags(stream: DataFrame, hours: float = 24.0) -> DataFrame:
    """(key, ts, value, stuck): whether the key has said the same value for longer than so many hours. State is one value and one time a key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        value, since = state.get if state.exists else (None, None)
        at, v = rows["ts"].to_numpy("datetime64[us]").astype("int64"), rows["value"].to_numpy(float)
        new = np.r_[value is None or v[0] != value, v[1:] != v[:-1]]
        # Each row's run began at the last boundary before it, or before this batch.
        start = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
        began = np.where(start < 0, 0 if since is None else since, at[np.maximum(start, 0)])
        state.update((float(v[-1]), int(began[-1])))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "value": v, "stuck": at - began > hours * 3_600_000_000})

    return stream.groupBy("key").applyInPandasWithState(step, "key long, ts timestamp, value double, stuck boolean", "value double, since long", "append", "NoTimeout")
