"""Records about series: links, catalogues, catalogued readings, forecasts by lead month, paths and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import half_up
from ..functions.units import MONTH_SECONDS


def used_measures(links: DataFrame, columns: list[str], catalogue: DataFrame, length: int = 36) -> DataFrame:
    """(measure, station, ...): the distinct measures in any of the ``columns`` of wide ``links``, with what ``catalogue`` (station, ...; the first row by
    its other columns counts) knows of the station that the first ``length`` characters name."""
    measures = links.select(F.explode(F.array(*columns)).alias("measure")).filter("measure is not null").distinct()
    rest = [c for c in catalogue.columns if c != "station"]
    own = catalogue.groupBy("station").agg(F.min(F.struct(*rest)).alias("x")).select("station", "x.*")
    return measures.withColumn("station", F.substring("measure", 1, length)).join(own, "station", "left").select("measure", "station", *rest)


def complete_rows(series: dict[str, DataFrame]) -> DataFrame:
    """(key, date, one column a series) where every one of the (key, date, value) series has a value."""
    out = None
    for name, df in series.items():
        own = df.filter("value is not null").select("key", "date", F.col("value").alias(name))
        out = own if out is None else out.join(own, ["key", "date"])
    return out


def history_stats(series: DataFrame) -> DataFrame:
    """(key, mean, sd): both null under two values."""
    n = F.count("value")
    return series.groupBy("key").agg(F.when(n >= 2, F.avg("value")).alias("mean"), F.when(n >= 2, F.stddev_samp("value")).alias("sd"))


def month_totals(rates: DataFrame) -> DataFrame:
    """(key, member, month, total) in mm of (key, member, reference, lead, rate): a mean rate in m/s over the calendar month that is ``lead`` - 1 after the reference's."""
    month = F.trunc(F.add_months("reference", F.col("lead") - 1), "MM")
    return rates.select("key", "member", month.alias("month"), (F.col("rate") * MONTH_SECONDS(month) * 1000).alias("total"))


def references(records: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """(id, reference): each distinct reference of a record, upper case, trimmed, not empty."""
    parts = F.array_distinct(F.filter(F.transform(F.array(*columns), lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    return records.select(id, F.explode(parts).alias("reference"))


def sampled_ages(matched: DataFrame, key: str, readings: DataFrame, now: Column, most: int) -> DataFrame:
    """``most`` rows of ``matched`` (key not null), the first by a hash of the key, with latest (of readings (key, ts)) and age_minutes. The sample is the
    feature: it says how fresh matches are without asking for all."""
    some = matched.filter(F.col(key).isNotNull()).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(most)
    last = readings.join(F.broadcast(some.select(F.col(key).alias("key")).distinct()), "key", "left_semi").groupBy("key").agg(F.max("ts").alias("latest"))
    out = some.join(last, F.col(key) == F.col("key"), "left").drop(*(["key"] if key != "key" else []))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 60_000_000
    return out.withColumn("age_minutes", half_up(age))


def pilots(history: DataFrame, *having: DataFrame, most: int = 0) -> DataFrame:
    """(key, rows, place): keys of ``history`` that all of ``having`` (key) hold too, the longest first, ``most`` at most (0: all)."""
    own = history.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    for df in having:
        own = own.join(df.select("key").distinct(), "key", "left_semi")
    from .windows import places_in_order

    placed = places_in_order(own, [F.col("rows").desc(), F.col("key")])
    return placed.filter(F.col("place") <= most) if most else placed


def member_bridge(members: DataFrame, links: DataFrame, provider: str) -> DataFrame:
    """(key, member, date, value, provider): each key's mean over the gauges that it is linked to (key, gauge) of members (gauge, member, date, value)."""
    return links.select("key", "gauge").distinct().join(members, "gauge").groupBy("key", "member", "date").agg(F.avg("value").alias("value")).withColumn("provider", F.lit(provider))


def assembled(parts: dict[str, DataFrame]) -> DataFrame:
    """(key, date, one column a part): all days that any part has, of keys that every part has a value of."""
    named = [df.filter("value is not null").select("key", "date", F.col("value").alias(n)) for n, df in parts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.join(df, ["key", "date"], "full")
    for df in named:
        out = out.join(df.select("key").distinct(), "key", "left_semi")
    return out


def met_at(fields: dict[str, DataFrame], kelvin: tuple[str, ...] = ()) -> DataFrame:
    """(key, date, one column a field) where all fields have the day; ``kelvin`` ones come out in degrees Celsius."""
    return complete_rows(fields).withColumns({n: F.col(n) - 273.15 for n in kelvin}) if kelvin else complete_rows(fields)


def path_points(points: DataFrame, spacing: float) -> DataFrame:
    """(key, i, x, y): of each path (key, i, x, y) its first point, its last, and each at which the way since the last one kept reaches ``spacing``. Native,
    over one ordered array a path, as each step rests on where the one before was kept."""
    a = points.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("a"))

    def step(s: Column, p: Column) -> Column:
        way = s["way"] + F.hypot(p["x"] - s["at"]["x"], p["y"] - s["at"]["y"])
        far = (way >= spacing) | (p["i"] == s["end"])
        return F.struct(p.alias("at"), F.when(far, F.lit(0.0)).otherwise(way).alias("way"), F.when(far, F.concat(s["kept"], F.array(p))).otherwise(s["kept"]).alias("kept"), s["end"].alias("end"))

    first = F.element_at("a", 1)
    start = F.struct(first.alias("at"), F.lit(0.0).alias("way"), F.array(first).alias("kept"), F.element_at("a", -1)["i"].alias("end"))
    kept = F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), start, step)["kept"]
    return a.select("key", F.explode(kept).alias("p")).select("key", "p.i", "p.x", "p.y")


def coarse_points(points: DataFrame, step: float, width: float, height: float) -> DataFrame:
    """(x, y): points on a grid of ``step``, once each, within the box from the origin."""
    at = lambda c: (half_up(F.col(c) / step)).cast("long")
    own = points.select(at("x").alias("x"), at("y").alias("y")).distinct()
    return own.select(F.least(F.greatest(F.col("x") * step, F.lit(0.0)), F.lit(width)).alias("x"), F.least(F.greatest(F.col("y") * step, F.lit(0.0)), F.lit(height)).alias("y"))


def live_readings(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(measure, ts, value) of JSON payloads {"items": [{"measure", "dateTime", "value"}]}, where a measure, and a value, is a scalar or a list of which the
    first counts. What doesn't parse is left out."""
    item = "struct<measure:string,dateTime:string,value:string>"
    items = F.from_json(F.col(column), f"struct<items:array<{item}>>")["items"]
    first = lambda c: F.coalesce(F.get_json_object(c, "$[0]"), c)
    rows = payloads.select(F.explode(items).alias("x"))
    told = rows.select(first(F.col("x.measure")).alias("measure"), F.try_to_timestamp(F.col("x.dateTime")).alias("ts"), first(F.col("x.value")).try_cast("double").alias("value"))
    return told.na.drop()


def thresholds(register: DataFrame) -> DataFrame:
    """(key, threshold) of a register (key, threshold) that may hold a key several times: the highest counts; rows without a number don't."""
    return register.select("key", F.col("threshold").try_cast("double").alias("threshold")).filter("threshold is not null and not isnan(threshold)").groupBy("key").agg(F.max("threshold").alias("threshold"))
