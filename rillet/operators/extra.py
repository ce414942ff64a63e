"""Further series, join and rule operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import correlation, day_number
from .spatial import blocks, meeting


def trace_windows(series: DataFrame, start_month: int, start_day: int, length: int) -> DataFrame:
    """(key, year, lead, value): the same days of every year from a month and day on; 29 February counts as 28."""
    years = series.groupBy("key").agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b"))
    own = years.select("key", F.explode(F.sequence("a", "b")).alias("year"))
    last = F.day(F.last_day(F.make_date("year", F.lit(start_month), F.lit(1))))
    begin = F.make_date("year", F.lit(start_month), F.least(F.lit(start_day), last, F.lit(28) if (start_month, start_day) == (2, 29) else F.lit(31)))
    days = own.select("key", "year", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("lead"), begin.alias("begin")).select("key", "year", "lead", F.date_add("begin", F.col("lead")).alias("date"))
    return days.join(series, ["key", "date"]).select("key", "year", "lead", "value")


def downsample(series: DataFrame, most: int) -> DataFrame:
    """A key's rows at ``most`` evenly spread places (ends included, halves to even), all rows of shorter keys."""
    w = Window.partitionBy("key")
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("date")) - 1
    # Row i is kept if it is the rounded place of a step near it.
    step = (n - 1) / F.lit(max(1, most - 1))
    near = F.floor(F.col("_i") / F.col("_s"))
    hit = (F.bround(near * F.col("_s")) == F.col("_i")) | (F.bround((near + 1) * F.col("_s")) == F.col("_i"))
    df = series.withColumns({"_n": n, "_i": i, "_s": step.cast("double")})
    return df.filter((F.col("_n") <= most) | hit).drop("_n", "_i", "_s")


def rising_days(df: DataFrame, by: str, order: str, day: str) -> DataFrame:
    """fixed: the day made to rise by at least one from row to row."""
    w = Window.partitionBy(by).orderBy(order)
    i = F.row_number().over(w)
    return df.withColumn("_i", i).withColumn("fixed", (F.max(F.col(day) - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i")).cast("int")).drop("_i")


def momentum(series: DataFrame, most: int = 14) -> DataFrame:
    """(key, level, per_day): of the last two values, 0 per day if they are further apart than ``most`` days."""
    w = Window.partitionBy("key").orderBy(F.col("date").desc())
    two = series.withColumns({"_r": F.row_number().over(w), "_d": F.lead("date").over(w), "_v": F.lead("value").over(w)}).filter("_r = 1")
    gap = F.datediff("date", "_d")
    return two.select("key", F.col("value").alias("level"), F.when(gap.between(1, most), (F.col("value") - F.col("_v")) / gap).otherwise(0.0).alias("per_day"))


def guardrails(series: DataFrame, changes: DataFrame, margin: float = 0.1) -> DataFrame:
    """(key, lo_step, hi_step, lo, hi): first and last percentiles of changes, and the range widened by a margin."""
    c = changes.filter("change is not null").groupBy("key").agg(F.percentile("change", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    span = F.max("value") - F.min("value")
    s = series.groupBy("key").agg((F.min("value") - margin * span).alias("lo"), (F.max("value") + margin * span).alias("hi"))
    return s.join(c, "key", "left").select("key", F.col("q")[0].alias("lo_step"), F.col("q")[1].alias("hi_step"), "lo", "hi")


def dry_months(series: DataFrame, least: float = 0.05, dry: float = 1e-4) -> DataFrame:
    """(key, months): calendar months that are dry at least so often, in order."""
    m = series.groupBy("key", F.month("date").alias("m")).agg(F.avg(F.when(F.col("value") <= dry, 1.0).otherwise(0.0)).alias("share"))
    return m.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("share") >= least, F.col("m")))).alias("months"))


def band_counts(df: DataFrame, by: list[str], percentile: str, bounds=(13, 28, 72, 87)) -> DataFrame:
    p, edges = F.col(percentile), [-math.inf, *bounds, math.inf]
    names = ("very_low", "low", "normal", "high", "very_high")
    return df.groupBy(*by).agg(*[F.count_if((p >= F.lit(float(a))) & (p < F.lit(float(b)))).alias(n) for n, a, b in zip(names, edges, edges[1:])])


def gap_diagnostics(series: DataFrame) -> DataFrame:
    """(key, median_gap, max_gap, n)."""
    w = Window.partitionBy("key").orderBy("date")
    g = series.withColumn("g", F.datediff("date", F.lag("date").over(w)))
    return g.groupBy("key").agg(F.median("g").alias("median_gap"), F.max("g").alias("max_gap"), F.count(F.lit(1)).alias("n"))


def frame_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, max_off, mean_off, n) of two frames' common rows, by one unpivot and one aggregation."""
    both = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns]), keys)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("off")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.max("off").alias("max_off"), F.avg("off").alias("mean_off"), F.count("off").alias("n"))


def nearest_lead(df: DataFrame, by: list[str], lead: str, wanted: int) -> DataFrame:
    """A group's row whose lead is nearest; of equal distances the smaller lead."""
    best = df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(lead) - wanted), F.col(lead))).alias("x"))
    return best.select("x.*")


def mean_of_series(long: DataFrame, by: str = "date") -> DataFrame:
    """(date, value, n): the mean over the series that have the day; a full outer join of any number of series without a join."""
    return long.groupBy(by).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def box_overlaps(spark, a: DataFrame, b: DataFrame, exclude: str) -> DataFrame:
    """(a, b) of overlapping boxes (id, x1, y1, x2, y2, form), rows of ``b`` of one form left out and those without a form kept: as SQL.
    Equal boxes are compared as one. Boxes meet in unit cells, each pair in the first common one."""
    sides = ["x1", "y1", "x2", "y2"]
    kept = spark.sql("SELECT * FROM {b} b WHERE b.form IS NULL OR b.form <> :form", args={"form": exclude}, b=b)

    def cells(df: DataFrame, n: int) -> DataFrame:
        own = blocks(df.na.drop(subset=sides), sides).withColumnsRenamed({c: f"{c}_{n}" for c in sides} | {"ids": f"ids{n}"})
        return own.withColumn("cx", F.explode(F.sequence(F.floor(f"x1_{n}"), F.floor(f"x2_{n}")))).withColumn("cy", F.explode(F.sequence(F.floor(f"y1_{n}"), F.floor(f"y2_{n}"))))

    meet = F.expr("x1_1 <= x2_2 AND x1_2 <= x2_1 AND y1_1 <= y2_2 AND y1_2 <= y2_1 AND cx = floor(greatest(x1_1, x1_2)) AND cy = floor(greatest(y1_1, y1_2))")
    return meeting(cells(a, 1), cells(kept, 2), ["cx", "cy"], meet).select("a", "b")


def longest_path(edges: DataFrame) -> DataFrame:
    """(group, nodes, length): each group's longest directed path over (group, a, b, length). Where nothing but cycles and what lies behind them is
    left, the smallest node left starts anew, without the links into it. A group is one river system, a few thousand links, and is solved by
    dynamic programming in its task."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, into = {}, {}
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["length"]):
            out.setdefault(a, []).append((b, w))
            into[b] = into.get(b, 0) + 1
        nodes = set(out) | set(into)
        ready = sorted(n for n in nodes if not into.get(n))
        best = {n: (0.0, None) for n in nodes}
        left, by_name = set(nodes), sorted(nodes, reverse=True)
        while left:
            if ready:
                n = ready.pop()
            else:
                while by_name[-1] not in left:
                    by_name.pop()
                n = by_name.pop()
            if n not in left:
                continue
            left.discard(n)
            for m, w in out.get(n, []):
                if m not in left:
                    continue
                if best[n][0] + w > best[m][0]:
                    best[m] = (best[n][0] + w, n)
                into[m] -= 1
                if not into[m]:
                    ready.append(m)
        end = max(sorted(nodes), key=lambda n: best[n][0])
        path, n = [], end
        while n is not None:
            path.append(int(n))
            n = best[n][1]
        return pd.DataFrame([(key[0], path[::-1], best[end][0])], columns=["group", "nodes", "length"])

    return edges.groupBy("group").applyInPandas(solve, "group long, nodes array<long>, length double")


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """(id, points): each line's points (array of x, y) by Douglas and Peucker."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def fewer(lists: pd.Series) -> pd.Series:
        def one(points):
            pts = [(p["x"], p["y"]) for p in points]
            keep, todo = {0, len(pts) - 1}, [(0, len(pts) - 1)]
            while todo:
                a, b = todo.pop()
                (x1, y1), (x2, y2) = pts[a], pts[b]
                n = math.hypot(x2 - x1, y2 - y1)
                far, at = max(((abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / n if n else math.hypot(x - x1, y - y1), i) for i, (x, y) in enumerate(pts[a + 1 : b], a + 1)), default=(0, 0))
                if far > tolerance:
                    keep.add(at)
                    todo += [(a, at), (at, b)]
            return [{"x": pts[i][0], "y": pts[i][1]} for i in sorted(keep)]

        return lists.map(one)

    return lines.select("id", fewer("points").alias("points"))


def watch(stations: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule, word) of stations (key, level, lo, hi) and rules (rule, kind, bound): breach, floor against a fan's low end, or percentile
    comparators. Rules are a register of a few rows, checked before it is sent to every executor."""
    few = rules.limit(10_001)
    if few.count() > 10_000:
        raise ValueError("a register of more than 10000 rules needs a key to join by")
    v = F.when(F.col("kind") == "above", F.col("level") > F.col("bound")).when(F.col("kind") == "below", F.col("level") < F.col("bound")).when(F.col("kind") == "fan_above", F.col("hi") >= F.col("bound")).when(F.col("kind") == "fan_below", F.col("lo") <= F.col("bound"))
    return stations.crossJoin(F.broadcast(few)).select("key", "rule", F.when(v, "met").when(v.isNull(), "unknown").otherwise("clear").alias("word"))


def worst(words: DataFrame, order=("clear", "unknown", "met")) -> DataFrame:
    """(key, word): each key's worst word in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("word"))
    return words.groupBy("key").agg(F.max_by("word", rank).alias("word"))


def sigma_growth(phi: Column, sigma: Column, lead: Column, floor: Column) -> Column:
    """Spread of an autoregressive error after so many steps, with a noise floor added in quadrature."""
    grown = sigma * F.sqrt((1 - F.pow(phi, 2 * lead)) / F.greatest(1 - phi * phi, F.lit(1e-9)))
    return F.sqrt(grown * grown + floor * floor)


def inflation(df: DataFrame, by: str, z: str) -> DataFrame:
    """(by, k): max(1, 80th percentile of |z| over its normal value), at least 8 values."""
    return df.groupBy(by).agg(F.greatest(F.lit(1.0), F.percentile(F.abs(z), F.lit(0.8)) / 1.2815515655446004).alias("k"), F.count(z).alias("n")).filter("n >= 8").select(by, "k")


def baselines(series: DataFrame, lead: int) -> DataFrame:
    """(key, date, persistence, damped): the value ``lead`` days before, and its anomaly damped by the lag-one correlation."""
    w = Window.partitionBy("key").orderBy("_n")
    df = series.withColumn("_n", day_number(F.col("date")))
    fit = df.withColumn("b", F.max("value").over(w.rangeBetween(-1, -1))).groupBy("key").agg(F.avg("value").alias("m"), F.greatest(F.coalesce(correlation(F.col("value"), F.col("b")), F.lit(0.0)), F.lit(0.0)).alias("phi"))
    then = F.max("value").over(w.rangeBetween(-lead, -lead))
    out = df.withColumn("persistence", then).join(fit, "key")
    return out.select("key", "date", "persistence", (F.col("m") + F.pow("phi", F.lit(lead)) * (F.col("persistence") - F.col("m"))).alias("damped"))


def greedy_sites(df: DataFrame, apart: float) -> DataFrame:
    """(group, id): of each group's (group, id, x, y, rank) those kept when taken in order of rank, each at least ``apart`` from all kept
    before; natively, as a fold over a group's ordered array (a group is a handful of candidates for one site)."""
    a = df.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "x", "y"))).alias("a"))
    empty = F.slice("a", 1, 0)
    near = lambda kept, c: F.exists(kept, lambda k: F.hypot(k["x"] - c["x"], k["y"] - c["y"]) < apart)
    kept = F.aggregate("a", empty, lambda acc, c: F.when(near(acc, c), acc).otherwise(F.concat(acc, F.array(c))))
    return a.select("group", F.explode(kept).alias("k")).select("group", "k.id")
