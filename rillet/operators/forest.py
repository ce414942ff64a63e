"""Regression forests of all keys at once, grown level by level from histograms, and the roll that steps one.

A feature's values become bins once: all its values where a key has few, else quantiles of a mergeable sketch. Each level is one aggregation by (key,
tree, node, feature, bin) with map-side partial sums: what is shuffled is a histogram a task, however many rows a key has. Rows keep no state: their
nodes follow from the trees so far, which are a few numbers a key. A tree sees a row as often as a hash of the row says (Poisson, mean 1), so
results don't depend on where rows lie."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import _cut

NODE = "struct<feature:int,edge:double,value:double>"


def bin_edges(flat: DataFrame, most: int) -> DataFrame:
    """(key, edges): for each feature of (key, x) the values at which it can be cut, rising; a value goes left of an edge that it doesn't exceed."""
    values = flat.select("key", F.posexplode("x").alias("f", "v"))
    known = values.groupBy("key", "f", "v").count()
    counted = known.groupBy("key", "f").agg(F.count(F.lit(1)).alias("n"))
    few = known.join(counted.filter(F.col("n") <= most), ["key", "f"]).groupBy("key", "f").agg(F.sort_array(F.collect_set("v")).alias("e"))
    probs = [i / most for i in range(1, most)]
    many = values.join(counted.filter(F.col("n") > most), ["key", "f"]).groupBy("key", "f").agg(F.array_distinct(F.percentile_approx("v", probs, 10_000)).alias("e"))
    # No cut behind the largest value.
    edges = few.select("key", "f", F.slice("e", 1, F.greatest(F.size("e") - 1, F.lit(0))).alias("e")).unionByName(many)
    return edges.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("both")).select("key", F.transform("both", lambda b: b["e"]).alias("edges"))


def draws(trees: int, seed: int, *row: str) -> Column:
    """How often each tree sees a row."""
    mass = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]
    u = lambda t: F.pmod(F.xxhash64(*row, F.lit(seed), t), F.lit(1 << 40)) / float(1 << 40)
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: sum((F.when(u(t) >= m, 1).otherwise(0) for m in mass), F.lit(0)))


def _reached(tree: Column, x: Column, steps: int, cut) -> Column:
    """The node that a row comes to, counted as in a heap from 1. ``cut``: whether a node sends it right."""

    def step(node: Column, _: Column) -> Column:
        here = F.element_at(tree, node)
        return F.when(here["feature"].isNull(), node).otherwise(node * 2 + F.when(cut(here, x), 1).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1), step) if steps else F.lit(1)


def _as_arrays(nodes: DataFrame, size: int, place: str) -> DataFrame:
    """(key, trees) of nodes: per tree an array by node."""
    tree = nodes.groupBy("key", "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", F.col(place).alias("edge"), "value")))).alias("m"))
    full = tree.select("key", "tree", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda n: F.try_element_at("m", n)).alias("nodes"))
    return full.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("tree", "nodes"))).alias("t")).select("key", F.transform("t", lambda t: t["nodes"]).alias("trees"))


def grow(rows: DataFrame, xs: list[str], y: str, by: str, trees: int = 20, depth: int = 5, least: int = 5, bins: int = 64, bagged: bool = True, seed: int = 0) -> DataFrame:
    """(key, trees) of (key, xs, y, by): each tree an array of nodes as in a heap, inner ones with a feature's number and edge, all with the mean of their rows. A
    node is cut where the squared error falls most, ties to the first feature and lowest edge; both sides keep ``least`` draws. Rows with nulls are left out;
    ``by`` names a row within its key."""
    flat = rows.na.drop(subset=[*xs, y]).select("key", F.col(by).alias("by"), F.array(*[F.col(x).cast("double") for x in xs]).alias("x"), F.col(y).cast("double").alias("y"))
    edges = _cut(bin_edges(flat, bins))
    binned = F.transform(F.arrays_zip("x", "edges"), lambda z: F.size(F.filter(z["edges"], lambda e: e < z["x"])))
    weights = draws(trees, seed, "key", "by") if bagged else F.array_repeat(F.lit(1), trees)
    rows = _cut(flat.join(edges, "key").select("key", "y", binned.alias("x"), weights.alias("w")))
    nodes = None
    for level in range(depth + 1):
        if nodes is None:
            at = rows.select("key", "x", "y", F.posexplode("w").alias("tree", "w")).withColumn("node", F.lit(1))
        else:
            now = _as_arrays(nodes, 2**level - 1, "bin")
            trees_now = rows.join(now, "key").select("key", "x", "y", F.posexplode(F.arrays_zip("w", "trees")).alias("tree", "z"))
            at = trees_now.select("key", "x", "y", "tree", F.col("z.w").alias("w"), _reached(F.col("z.trees"), F.col("x"), level, lambda here, x: F.get(x, here["feature"]) > here["edge"]).alias("node"))
            at = at.filter(F.col("node") >= 2**level)
        seen = at.filter("w > 0").select("key", "tree", "node", F.posexplode("x").alias("feature", "bin"), "w", (F.col("w") * F.col("y")).alias("wy"), (F.col("w") * F.col("y") * F.col("y")).alias("wyy"))
        histogram = seen.groupBy("key", "tree", "node", "feature", "bin").agg(F.sum("w").alias("n"), F.sum("wy").alias("s"), F.sum("wyy").alias("q"))
        one = Window.partitionBy("key", "tree", "node", "feature")
        so_far = one.orderBy("bin")
        cuts = histogram.select("key", "tree", "node", "feature", "bin", *[F.sum(c).over(so_far).alias(f"{c}1") for c in "ns"], *[F.sum(c).over(one).alias(c) for c in "nsq"])
        left, right = F.col("s1") * F.col("s1") / F.col("n1"), F.try_divide((F.col("s") - F.col("s1")) * (F.col("s") - F.col("s1")), F.col("n") - F.col("n1"))
        whole = F.col("q") - F.col("s") * F.col("s") / F.col("n")
        share = F.when((F.col("n1") >= least) & (F.col("n") - F.col("n1") >= least) & (whole > 0), F.round((left + right - F.col("s") * F.col("s") / F.col("n")) / whole, 9))
        best = F.when(share > 0, F.struct(share.alias("share"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
        found = cuts.groupBy("key", "tree", "node").agg(F.max(best).alias("best"), (F.first("s") / F.first("n")).alias("value"))
        cut = F.lit(level < depth)
        found = found.select("key", "tree", "node", F.when(cut, -F.col("best.f")).alias("feature"), F.when(cut, -F.col("best.b")).alias("bin"), "value")
        nodes = _cut(found if nodes is None else nodes.unionByName(found))
    placed = nodes.join(edges, "key").withColumn("edge", F.get(F.get("edges", F.col("feature")), F.col("bin")))
    return _as_arrays(placed, 2 ** (depth + 1) - 1, "edge")


def predicted(trees: Column, x: Column, depth: int) -> Column:
    """The mean of the trees' values for features ``x`` (array)."""
    value = lambda t: F.element_at(t, _reached(t, x, depth, lambda here, v: F.get(v, here["feature"]) > here["edge"]))["value"]
    return F.aggregate(trees, F.lit(0.0), lambda s, t: s + value(t)) / F.size(trees)


def roll(drivers: DataFrame, params: DataFrame, seeds: DataFrame, depth: int, lag_at: int, lag_days: int = 7) -> DataFrame:
    """(key, member, date, value) of every day of ``drivers`` (key, member, date, x): the forest of ``params`` (key, trees, lo, hi, lo_change, hi_change) says each
    day's change from the seed's level on. Feature ``lag_at``, the level ``lag_days`` ago, is the roll's own where that day was rolled. Changes and levels
    stay in their bounds; null bounds don't bind."""
    days = F.array_sort(F.collect_list(F.struct("date", "x"))).alias("days")
    a = drivers.groupBy("key", "member").agg(days).join(params, "key").join(seeds.select("key", "level"), "key")
    within = lambda v, lo, hi: F.least(F.greatest(v, F.col(lo)), F.col(hi))

    def step(s: Column, day: Column) -> Column:
        own = F.try_element_at(s["levels"], F.nullif(F.array_position(s["dates"], F.date_sub(day["date"], lag_days)).cast("int"), F.lit(0)))
        x = F.transform(day["x"], lambda v, i: F.when(i == lag_at, F.coalesce(own, v)).otherwise(v))
        moved = F.transform(F.array(x), lambda v: within(s["level"] + within(predicted(F.col("trees"), v, depth), "lo_change", "hi_change"), "lo", "hi"))
        return F.transform(moved, lambda level: F.struct(level.alias("level"), F.concat(s["dates"], F.array(day["date"])).alias("dates"), F.concat(s["levels"], F.array(level)).alias("levels")))[0]

    start = F.struct(F.col("level").cast("double").alias("level"), F.array().cast("array<date>").alias("dates"), F.array().cast("array<double>").alias("levels"))
    rolled = a.select("key", "member", F.aggregate("days", start, step).alias("s"))
    return rolled.select("key", "member", F.explode(F.arrays_zip(F.col("s.dates").alias("date"), F.col("s.levels").alias("value"))).alias("r")).select("key", "member", "r.date", "r.value")
