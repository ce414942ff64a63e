"""Choices, counts and pairings: one row of several, one source of several, one rung of a ladder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import correlation, haversine_km
from .windows import keep_latest


def day_summary(readings: DataFrame, flag: Column) -> DataFrame:
    """(key, date, mean, mid, flagged, label) of readings (key, ts, value, label, id): whether any was flagged, and the label of the least id."""
    return readings.groupBy("key", F.to_date("ts").alias("date")).agg(F.avg("value").alias("mean"), F.median("value").alias("mid"), F.max(F.when(flag, 1).otherwise(0)).alias("flagged"), F.min_by("label", "id").alias("label"))


def parity(pairs: DataFrame, least: int = 5) -> DataFrame:
    """(key, r, mae, mid, n) of two providers' values (key, a, b): correlation, mean and median absolute difference; keys with ``least`` pairs."""
    off = F.abs(F.col("a") - F.col("b"))
    return pairs.groupBy("key").agg(correlation(F.col("a"), F.col("b")).alias("r"), F.avg(off).alias("mae"), F.median(off).alias("mid"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def kernel_recharge(grid: DataFrame, kernel: Column, length: int) -> DataFrame:
    """recharge: the last ``length`` days before each of a grid (key, date, value), weighed by a kernel (array, oldest first) that may differ by row; gaps
    count as 0; null in a key's first days."""
    w = Window.partitionBy("key").orderBy("date")
    past = F.collect_list(F.coalesce("value", F.lit(0.0))).over(w.rowsBetween(-length, -1))
    weighed = F.aggregate(F.zip_with(past, kernel, lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    return grid.withColumn("recharge", F.when(F.row_number().over(w) > length, weighed))


def trailing(series: DataFrame, days: int) -> DataFrame:
    """Each key's rows of the ``days`` up to its last."""
    last = F.max("date").over(Window.partitionBy("key"))
    return series.withColumn("_last", last).filter(F.col("date") >= F.date_sub("_last", days)).drop("_last")


def overlaps(pairs: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """(a, b, days) of pairs whose records (key, first, last) share ``least`` days."""
    one, other = spans.select(F.col("key").alias("a"), "first", "last"), spans.select(F.col("key").alias("b"), F.col("first").alias("first2"), F.col("last").alias("last2"))
    met = pairs.join(one, "a").join(other, "b")
    return spans_shared(met.select(F.struct(F.col("a").alias("id"), "first", "last").alias("a"), F.struct(F.col("b").alias("id"), F.col("first2").alias("first"), F.col("last2").alias("last")).alias("b")), least)


def spans_shared(pairs: DataFrame, least: int) -> DataFrame:
    """``overlaps`` of pairs that carry their spans: a and b are (id, first, last)."""
    days = F.datediff(F.least("a.last", "b.last"), F.greatest("a.first", "b.first")).cast("long")
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), days.alias("days")).filter(F.col("days") >= least)


def paired(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_b") -> DataFrame:
    """Rows that meet on ``keys``, columns that both have told apart by ``suffix``, and off: the left value less the right."""
    own = right.select(*keys, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c not in keys])
    return left.join(own, keys).withColumn("off", F.col("value") - F.col(f"value{suffix}"))


def inverted(links: DataFrame, by: str, key: str) -> DataFrame:
    """(by, n, keys): who links to each, in order. A target's links are one array, for registers of links."""
    return links.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("keys"))


def verified(forecasts: DataFrame, observed: DataFrame, least: int = 8) -> DataFrame:
    """(key, n, coverage, mae) of forecasts (key, date, run, p10, p50, p90) against (key, date, value): of several runs for a day the newest counts."""
    met = keep_latest(forecasts.join(observed.select("key", "date", F.col("value").alias("obs")), ["key", "date"]), ["key", "date"], [F.col("run").desc()])
    inside = F.col("obs").between(F.col("p10"), F.col("p90")).cast("double")
    return met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"), F.avg(F.abs(F.col("obs") - F.col("p50"))).alias("mae")).filter(F.col("n") >= least)


def first_kind(*sources: tuple[DataFrame, str]) -> DataFrame:
    """(id, kind): each id once, under the kind of the first of the (id) sources that has it."""
    rows = [df.select("id", F.lit(kind).alias("kind"), F.lit(i).alias("_p")) for i, (df, kind) in enumerate(sources)]
    return reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.min_by("kind", "_p").alias("kind"))


def resolved(*candidates: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, source): the first candidate that isn't null, and its name; none."""
    source = reduce(lambda w, c: w.when(c[1].isNotNull(), c[0]), candidates[1:], F.when(candidates[0][1].isNotNull(), candidates[0][0]))
    return F.coalesce(*[c for _, c in candidates]), source.otherwise("none")


def refresh_start(keys: DataFrame, tails: DataFrame, back: int = 7) -> DataFrame:
    """One row (start, missing): ``back`` days before the earliest of the keys' last dates, null (from the beginning) if a key has none."""
    last = keys.select("key").join(tails.select("key", "date"), "key", "left").groupBy("key").agg(F.max("date").alias("d"))
    missing = F.count(F.lit(1)) - F.count("d")
    return last.agg(F.when(missing == 0, F.date_sub(F.min("d"), back)).alias("start"), missing.alias("missing"))


def newest_run(rows: DataFrame, months: list[int]) -> DataFrame:
    """(key, m1, ...): of (key, run, month, value) each key's newest run, its months as columns."""
    latest = rows.join(rows.groupBy("key").agg(F.max("run").alias("run")), ["key", "run"])
    return latest.groupBy("key").agg(*[F.max(F.when(F.col("month") == m, F.col("value"))).alias(f"m{m}") for m in months])


def error_sd(errors: DataFrame, floor: float = 1e-3) -> DataFrame:
    """(lead, sd) of (lead, error): no less than ``floor``, null under two errors."""
    return errors.groupBy("lead").agg(F.when(F.count("error") >= 2, F.greatest(F.stddev_samp("error"), F.lit(floor))).alias("sd"))


def neighbourhood(cells: DataFrame, reach: int = 1) -> DataFrame:
    """(i, j, lo, hi): extremes of (i, j, v) over each cell and those ``reach`` around it. A cell is sent to all that it is near, so this is an aggregation
    and no range join."""
    to = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
    around = cells.select(to.alias("c"), "v").groupBy("c.i", "c.j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return around.join(cells.select("i", "j"), ["i", "j"], "left_semi").select("i", "j", "lo", "hi")


def spread_panel(places: DataFrame, n: int) -> DataFrame:
    """(id) of ``n`` places (id, lat, lon): the northernmost, southernmost, easternmost and westernmost (ties: the least id), then those nearest the mean place."""
    order = lambda c, s: F.struct(s * F.col(c), F.col("id"))
    far = places.agg(*[F.min_by("id", order(c, s)).alias(f"{c}{s}") for c in ("lat", "lon") for s in (-1, 1)], F.avg("lat").alias("y"), F.avg("lon").alias("x")).head()
    ids = sorted({x for x in far[:4] if x is not None})
    if not ids:
        return places.select("id").limit(0)
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(far.y), F.lit(far.x)), 6)
    rest = places.filter(~F.col("id").isin(ids) & F.col("lat").isNotNull()).orderBy(km, "id").limit(max(0, n - len(ids)))
    return places.filter(F.col("id").isin(ids)).select("id").unionByName(rest.select("id"))


def first_rule(*rules: tuple[Column, str], other: str) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda w, r: w.when(*r), rules[1:], F.when(*rules[0])).otherwise(other)


def strongest(signals: dict[str, Column], floor: float = 0.5) -> Column:
    """The name of the largest signal of ``floor`` or more (ties: the first); null if there is none."""
    all_ = F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, v) in enumerate(signals.items())])
    return F.array_max(F.filter(all_, lambda s: s["v"] >= floor))["n"]


def marker_radius(v: Column, most: float, low: float = 4.0, high: float = 14.0) -> Column:
    """A radius whose square grows with the value, within bounds."""
    return low + (high - low) * F.sqrt(F.least(F.greatest(v, F.lit(0.0)), F.lit(most)) / most)


def oriented(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) from the lesser end to the greater, and turned: whether they were the other way round."""
    return edges.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b"), "turned": F.col("a") > F.col("b")})


def winner(errors: dict[str, Column], weights: dict[str, float]) -> Column:
    """The name of the least weighed error (ties: the first)."""
    return F.array_min(F.array(*[F.struct((e * weights.get(n, 1.0)).alias("s"), F.lit(i).alias("o"), F.lit(n).alias("n")) for i, (n, e) in enumerate(errors.items())]))["n"]


def selection(df: DataFrame, without: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows in ``order`` whose key ``without`` lacks; a top list, so the limit is the feature."""
    return df.join(without.select(key), key, "left_anti").orderBy(*order).limit(most)


def codes(df: DataFrame, name: str) -> DataFrame:
    """``df`` with code: the place of its name among the names in order, from 0. Ranked over the names alone, so the window holds a register and not the rows."""
    names = df.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("code", (F.row_number().over(Window.orderBy(name)) - 1).cast("long"))
    return df.join(names, name, "left")


def notable(df: DataFrame, by: str, value: str, id: str, lows: int = 2, highs: int = 1) -> DataFrame:
    """(by, id, value, kind): each group's ``lows`` lowest and ``highs`` highest, a row that is both being lowest."""
    lo = F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).asc_nulls_last(), id))
    hi = F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc_nulls_last(), id))
    a = df.withColumns({"_lo": lo, "_hi": hi}).filter((F.col("_lo") <= lows) | (F.col("_hi") <= highs))
    return a.select(by, id, value, F.when(F.col("_lo") <= lows, "lowest").otherwise("highest").alias("kind"))


def attributed(errors: DataFrame, most: float) -> DataFrame:
    """(date, source, e): each day's source of the least error (date, source, e), where that is ``most`` at most (ties: the first name)."""
    return errors.groupBy("date").agg(F.min_by("source", F.struct("e", "source")).alias("source"), F.min("e").alias("e")).filter(F.col("e") <= most)


def interior(days: DataFrame) -> DataFrame:
    """``days`` (date, source) with interior: whether the days before and after, where they are there, have the same source. One row a day: a window over
    all of them is a window over a calendar."""
    w = Window.orderBy("date")
    near = lambda f, n: F.when(F.datediff(f("date").over(w), F.col("date")) == n, f("source").over(w)).otherwise(F.col("source"))
    return days.withColumn("interior", (near(F.lag, -1) == F.col("source")) & (near(F.lead, 1) == F.col("source")))


def bias(x: Column, y: Column, n: Column, least: int = 30, low: float = 0.2, high: float = 5.0) -> Column:
    """The factor from mean ``x`` to mean ``y`` of ``n`` pairs, within bounds; 1 where there is too little to tell."""
    return F.when((x > 0) & y.isNotNull() & (n >= least), F.least(F.greatest(F.try_divide(y, x), F.lit(low)), F.lit(high))).otherwise(1.0)


def weekly(readings: DataFrame, least: int = 5) -> DataFrame:
    """(week, mean, n): the mean over keys of (key, ts, value) of a week's total, of weeks in which the key has ``least`` days."""
    d = readings.groupBy("key", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.countDistinct(F.to_date("ts")).alias("days"), F.sum("value").alias("v"))
    return d.filter(F.col("days") >= least).groupBy("week").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


def nearest_rank(series: DataFrame, shares: dict[str, float], least: int = 26) -> DataFrame:
    """(key, one column a share): the value at the share's rank, no mean of two. A key's values are one ordered array, for decades of weeks."""
    n = F.size("a")
    a = series.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("a")).filter(n >= least)
    return a.select("key", *[F.element_at("a", F.least(n, F.floor(p * n) + 1).cast("int")).alias(name) for name, p in shares.items()])


def modal(df: DataFrame, by: str, what: str) -> DataFrame:
    """The rows of each group whose ``what`` is the group's most frequent (ties: the least)."""
    m = df.groupBy(by, what).agg(F.count(F.lit(1)).alias("_n"))
    k = m.groupBy(by).agg(F.max("_n").alias("_n"))
    best = m.join(k, [by, "_n"]).groupBy(by).agg(F.min(what).alias("_mode"))
    return df.join(best, by).filter(F.col(what) == F.col("_mode")).drop("_mode")


def at_least(rung: Column, ladder: list[str], floor: str) -> Column:
    """Whether a rung is ``floor`` or higher; null for what is no rung."""
    place = F.array_position(F.array(*map(F.lit, ladder)), rung)
    return F.when(place > 0, place > ladder.index(floor))


def tier(p: Column) -> Column:
    """Of a chance."""
    return F.when(p >= 0.5, "high").when(p >= 0.2, "elevated").when(p > 0, "low").otherwise("none")


def urgency(p: Column, size: Column, unit: float, most: float = 50.0) -> Column:
    """A chance in percent, and half a size in units, up to ``most`` of them."""
    return 100 * p + F.least(size / unit, F.lit(most)) / 2
