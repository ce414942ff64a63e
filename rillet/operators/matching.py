"""Entity matching in tiers, the best tier winning."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normal_name
from .spatial import _cut, within
from .windows import keep_latest

#: Over this ratio names that aren't equal share a pair of neighbouring characters for sure; up to it they are compared by single ones.
PAIRS_OVER = 0.8


def _marks(name: Column, width: int) -> Column:
    """The name's runs of ``width`` characters, each with its number among equal ones, so that marks in common count as often as both have them."""
    runs = F.transform(F.sequence(F.lit(1), F.length(name) - width + 1), lambda i: F.substr(name, i, F.lit(width)))
    runs = F.when(F.length(name) >= width, runs).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(runs), lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, 1, i), lambda y: y == x)).cast("string"))))[0]


def _shared(ratio: float, width: int, both: Column) -> Column:
    """Marks that names of ``both`` characters together share at least, if their ratio is reached: m characters match, 2 m being the ratio's part of both, in
    both - 2 m + 1 runs at most, and a run of k characters has k - 1 pairs."""
    least = F.lit(1.5 * ratio - 1) * both - 1 if width == 2 else F.lit(ratio / 2) * both
    return F.greatest(F.ceil(least - 1e-6).cast("int"), F.lit(0))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over both lengths."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], index=a.index, dtype=float)


def candidates(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """(norm, other, b): pairs of ``left`` (norm) and ``right`` (norm, b) that may reach the ratio, none lost. Names have their marks in order of rarity over both
    sides; names that share enough marks share one among the first few of each, so the sides meet by those, within the lengths that the ratio allows,
    and a pair stands once, under its first mark in common. What is left has the marks in common that it needs."""
    width = 2 if ratio > PAIRS_OVER else 1
    l = left.filter("norm <> ''").select("norm").distinct()
    r = right.filter("norm <> ''").groupBy("norm").agg(F.min("b").alias("b"))
    both = l.select("norm", F.lit(True).alias("own")).unionByName(r.select("norm", F.lit(False).alias("own")))
    marks = _cut(both.select("norm", "own", F.explode(_marks(F.col("norm"), width)).alias("mark")))
    rare = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    ordered = marks.join(rare, "mark").groupBy("norm", "own").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "mark"))), lambda x: x["mark"]).alias("marks"))
    # The fewest marks that any partner of allowed length shares with it; one less may be missing from the first ones.
    shortest = F.ceil(F.length("norm") * (ratio / (2 - ratio)) - 1e-6)
    need = F.greatest(_shared(ratio, width, F.length("norm") + shortest), F.lit(1))
    first = ordered.withColumn("first", F.slice("marks", 1, F.greatest(F.size("marks") - need + 1, F.lit(0))))
    side = lambda own: first.filter("own" if own else "not own").select(F.col("norm").alias("norm" if own else "other"), F.explode("first").alias("mark"), F.col("first").alias("f1" if own else "f2"), F.col("marks").alias("m1" if own else "m2"))
    met = side(True).join(side(False), "mark")
    size1, size2 = F.length("norm"), F.length("other")
    fits = 2 * F.least(size1, size2) >= ratio * (size1 + size2) - 1e-9
    once = F.get(F.array_intersect("f1", "f2"), F.lit(0)) == F.col("mark")
    enough = F.size(F.array_intersect("m1", "m2")) >= _shared(ratio, width, size1 + size2)
    pairs = met.filter(fits & once & enough).select("norm", "other")
    # Names too short for any mark to be needed are similar only if they are equal.
    same = l.join(r.select(F.col("norm")), "norm").select("norm", F.col("norm").alias("other"))
    pairs = pairs.filter("norm <> other").unionByName(same)
    return pairs.join(r.select(F.col("norm").alias("other"), "b"), "other").select("norm", "other", "b")


def similar(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """(norm, b, s): for each ``norm`` of ``left`` the ``b`` of the most similar ``norm`` of ``right`` (b, norm), if its ratio is ``ratio`` or more; ties to the
    smallest ``b``, null ones first."""
    told = candidates(left, right, ratio).withColumn("s", similarity("norm", "other")).filter(F.col("s") >= ratio)
    best = told.groupBy("norm").agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("b").isNotNull().alias("known"), "b")).alias("x"))
    return best.select("norm", "x.b", (-F.col("x.s")).alias("s"))


def _beside(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """(a, b, off): the nearest of ``right`` for each of ``left``, of equal distances the least id, where one is within ``km``. Places are compared, not rows."""
    of = lambda df: df.groupBy("lat", "lon").agg(F.min("id").alias("least"))
    near = within(of(left).withColumn("id", F.struct("lat", "lon")), of(right).withColumnRenamed("least", "id"), km)
    best = near.groupBy("a").agg(F.min(F.struct(F.round("km", 6).alias("off"), "b")).alias("x"))
    return left.join(best.select("a.lat", "a.lon", "x.b", "x.off"), ["lat", "lon"]).select(F.col("id").alias("a"), "b", "off")


def cascade(left: DataFrame, right: DataFrame, metres: float = 50.0, ratio: float = 0.9, names: bool = True) -> DataFrame:
    """(a, b, tier, score): for each of ``left`` (id, name, lat, lon, ref) its match in ``right`` by reference, else by distance, else by equal normal
    name, else by the similarity of word-sorted names, each compared with all names of the right. Names are compared for rows that no tier before has
    matched, as the best tier wins; of equal references and names the least id does."""
    n = lambda df: df.withColumn("norm", normal_name(F.col("name")))
    l, r = n(left), n(right)
    least = lambda by: r.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min("id").alias("b"))
    equal = lambda by, tier: l.join(least(by), by).select(F.col("id").alias("a"), "b", F.lit(tier).alias("tier"), F.lit(0.0).alias("off"))
    all_ = equal("ref", 1).unionByName(_beside(left, right, metres / 1000).select("a", "b", F.lit(2).alias("tier"), F.col("off")))
    if names:
        all_ = _cut(keep_latest(all_.unionByName(equal("norm", 3)), ["a"], [F.col("tier"), F.col("off"), F.col("b")]))
        open_ = l.join(all_.select(F.col("a").alias("id")), "id", "left_anti")
        near = similar(open_, r.select(F.col("id").alias("b"), "norm"), ratio)
        all_ = all_.unionByName(open_.select(F.col("id").alias("a"), "norm").join(near, "norm").select("a", "b", F.lit(4).alias("tier"), (1 - F.col("s")).alias("off")))
    return keep_latest(all_, ["a"], [F.col("tier"), F.col("off"), F.col("b")]).select("a", "b", "tier", (1 - F.col("off")).alias("score"))
