"""Exact quantiles of groups of any size.

``percentile`` keeps each distinct value of a group in one task. Groups over ``bound`` rows are narrowed down instead: each rank that is asked for has a range
that holds it, rounds count the range's values in BINS parts with map-side partial sums, and the part that the rank falls into, between its own
least and greatest value, is the next range; a part of one value ends it. What is shuffled is a histogram a task, and rows of big groups never move:
there are no more of these than rows / bound, so their ranges go to every executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import _cut

BINS, BOUND = 1024, 1_000_000
#: Ranges, of some 80 bytes each, that may go to every executor; beyond them rows and ranges meet by key.
MOST_RANGES = 1_000_000


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bound: int = BOUND, most_ranges: int = MOST_RANGES) -> DataFrame:
    """(keys, n, quantiles): of each group's values that aren't null the linear quantiles at ``probs``, as an array; groups without a value have n 0 and nulls. Values
    are doubles without nan. Null keys are keys."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = _cut(rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    big = sizes.filter(F.col("n") > bound)
    told = big.count()
    near = (lambda d: F.broadcast(d)) if told * 2 * len(probs) <= most_ranges else (lambda d: d)
    other = big.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    few = rows.join(near(other), _all([F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), "left_anti") if told else rows
    few = few.groupBy(*keys).agg(F.count("_v").alias("n"), F.percentile("_v", probs).alias("quantiles"))
    few = few.select(*keys, "n", F.when(F.col("n") > 0, F.col("quantiles")).otherwise(F.array_repeat(F.lit(None).cast("double"), len(probs))).alias("quantiles"))
    if not told:
        return few
    # Ranks from 0; between two of them a quantile is interpolated.
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    open_ = big.select(*keys, "lo", "hi", F.explode(ranks).alias("rank")).withColumn("left", F.col("rank"))
    done = None
    while True:
        known = open_.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
        done = known if done is None else done.unionByName(known)
        open_ = _cut(open_.filter("lo < hi"))
        if not open_.head(1):
            break
        ranges = open_.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        meet = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        held = rows.join(near(ranges), _all([*meet, F.col("_v").between(F.col("lo"), F.col("hi"))]))
        part = F.least(F.floor(_share(F.col("_v"), F.col("lo"), F.col("hi")) * BINS), F.lit(BINS - 1)).cast("int")
        counted = held.groupBy(*keys, "rank", "left", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        found = counted.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c")))
        open_ = found.select(*keys, "lo", "hi", "rank", (F.col("left") - F.col("before")).alias("left"))
    values = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    named = values.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    both = big.join(named, _all([F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]))

    def between(p: float) -> Column:
        low, high = (F.col("at")[f(place(p)).cast("long")] for f in (F.floor, F.ceil))
        part = place(p) - F.floor(place(p))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return few.unionByName(both.select(*keys, "n", F.array(*map(between, probs)).alias("quantiles")))


def median_of_others(members: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """(key, median, neighbours) of members (by, value, count: how many have it) and asked (key, by, own): the median of a group's values without the asked one's own, which
    is null if it isn't one of them, and how many are left. No pair is made: leaving a value out moves the middle by one place, so four values at the middle of
    a group answer for all. What a group sorts are its distinct values with their counts."""
    counts = members.filter("value is not null").groupBy(*by, "value").agg(F.sum("count").alias("_c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"_to": F.sum("_c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_c").over(w)})
    # Places from 0 of the two middle values of all, and of all but one.
    n = F.col("n")
    places = {"all1": F.floor((n - 1) / 2), "all2": F.floor(n / 2), "low": F.floor((n - 2) / 2), "high": F.floor((n - 1) / 2)}
    places |= {f"{k}_next": places[k] + 1 for k in ("low", "high")}
    at = lambda p: F.max(F.when((F.col("_to") - F.col("_c") <= p) & (p < F.col("_to")), F.col("value")))
    middle = ranked.groupBy(*by).agg(F.max("n").alias("n"), *[at(p).alias(k) for k, p in places.items()])
    without = lambda k: F.when(F.col("own") > F.col(k), F.col(k)).otherwise(F.col(f"{k}_next"))
    both = asked.join(middle, by)
    low, high = (F.when(F.col("own").isNull(), F.col(a)).otherwise(without(b)) for a, b in (("all1", "low"), ("all2", "high")))
    left = n - F.when(F.col("own").isNull(), 0).otherwise(1)
    return both.select("key", F.when(left > 0, F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)).alias("median"), left.alias("neighbours"))


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """How far up its range a value is, from 0 to 1: by magnitude while the range holds both signs, or spans more magnitudes than there are parts, so that a few rounds
    are enough for any values."""
    signed = lambda c: F.signum(c) * (F.ln(F.abs(c) + 1e-300) + 691)
    part = lambda f: (f(v) - f(lo)) / (f(hi) - f(lo))
    wide = lambda a, b: (a > 0) & (b / BINS > a)
    return F.when((lo <= 0) & (hi >= 0), part(signed)).when(wide(lo, hi) | wide(-hi, -lo), part(signed)).otherwise(part(lambda c: c / 2))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
