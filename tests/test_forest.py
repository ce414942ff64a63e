"""Forests against a plain grower over all cuts, and their roll against a loop."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet.operators import forest


def grower(x, y, w, depth, least):
    """One tree over all cuts, as {node: (feature, edge, value)}."""
    nodes = {}

    def cut(node, rows, level):
        n, s = w[rows].sum(), (w[rows] * y[rows]).sum()
        whole = (w[rows] * y[rows] ** 2).sum() - s * s / n
        best = None
        if level < depth and whole > 0:
            for f in range(x.shape[1]):
                for e in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= e]
                    n1, s1 = w[left].sum(), (w[left] * y[left]).sum()
                    if n1 >= least and n - n1 >= least:
                        share = round((s1**2 / n1 + (s - s1) ** 2 / (n - n1) - s * s / n) / whole, 9)
                        if share > 0 and (best is None or share > best[0]):
                            best = (share, f, e)
        nodes[node] = (best and best[1], best and best[2], s / n)
        if best:
            side = x[rows, best[1]] > best[2]
            cut(2 * node, rows[~side], level + 1)
            cut(2 * node + 1, rows[side], level + 1)

    cut(1, np.flatnonzero(w > 0), 0)
    return nodes


def value(nodes, x):
    node = 1
    while nodes[node][0] is not None:
        node = 2 * node + int(x[nodes[node][0]] > nodes[node][1])
    return nodes[node][2]


@pytest.fixture(scope="module")
def grown(spark):
    rng = random.Random(11)
    rows = [(k, d, float(rng.randint(0, 12)), float(rng.randint(0, 5)), rng.choice([0.0, 1.0])) for k in (1, 2) for d in range(150)]
    rows = [(*r, 2 * r[2] + (5 if r[3] > 2 else 0) * r[4] + rng.gauss(0, 1)) for r in rows] + [(3, 0, 1.0, 1.0, 1.0, 7.0), (3, 1, 2.0, 1.0, None, 9.0)]
    df = spark.createDataFrame(rows, "key long, day int, a double, b double, c double, y double").repartition(5)
    return rows, df, forest.grow(df, ["a", "b", "c"], "y", "day", trees=3, depth=3, least=4).cache()


def plain_trees(spark, rows, df):
    drawn = {(r.key, r.day): r.w for r in df.select("key", "day", forest.draws(3, 0, "key", "day").alias("w")).collect()}
    out = {}
    for k in (1, 2):
        own = [r for r in rows if r[0] == k]
        x, y = np.array([r[2:5] for r in own]), np.array([r[5] for r in own])
        out[k] = [grower(x, y, np.array([drawn[k, r[1]][t] for r in own]), 3, 4) for t in range(3)]
    return out


def test_equal_to_a_plain_grower(spark, grown):
    rows, df, model = grown
    want = plain_trees(spark, rows, df)
    got = {r.key: r.trees for r in model.collect()}
    assert set(got) == {1, 2, 3} and [n for n in got[3][0] if n and n.feature is not None] == []
    for k, trees in want.items():
        for own, tree in zip(trees, got[k]):
            here = {i: n for i, n in enumerate(tree, 1) if n is not None}
            assert set(here) == set(own)
            for i, (f, e, v) in own.items():
                assert (here[i].feature, here[i].edge) == (f, e) and here[i].value == pytest.approx(v)
    told = model.join(df, "key").filter("key < 3").select("key", "a", "b", "c", forest.predicted(F.col("trees"), F.array("a", "b", "c"), 3).alias("p")).collect()
    for r in told:
        assert r.p == pytest.approx(np.mean([value(t, (r.a, r.b, r.c)) for t in want[r.key]]))


def test_draws_are_poisson(spark):
    w = np.array([r.w for r in spark.range(20_000).select(forest.draws(2, 5, "id").alias("w")).collect()])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w.T)[0, 1]) < 0.03


def test_roll_equals_a_loop(spark, grown):
    rows, df, model = grown
    rng = random.Random(12)
    want = plain_trees(spark, rows, df)
    first = datetime.date(2024, 2, 20)
    drivers = [(k, m, first + datetime.timedelta(d), [float(rng.randint(0, 12)), float(rng.randint(0, 5)), float(d % 2)]) for k in (1, 2, 9) for m in (0, 1) for d in range(20) if d != 6]
    params = model.withColumns({"lo": F.lit(-20.0), "hi": F.lit(40.0), "lo_change": F.when(F.col("key") == 1, -3.0), "hi_change": F.when(F.col("key") == 1, 4.0)})
    got = {(r.key, r.member, r.date): r.value for r in forest.roll(spark.createDataFrame(drivers, "key long, member int, date date, x array<double>"), params, spark.createDataFrame([(1, 10.0), (2, 11.0)], "key long, level double"), 3, 0).collect()}
    for k in (1, 2):
        for m in (0, 1):
            level, known = 9.0 + k, {}
            for _, _, d, x in sorted(r for r in drivers if r[:2] == (k, m)):
                back = d - datetime.timedelta(7)
                move = np.mean([value(t, [known.get(back, x[0]), *x[1:]]) for t in want[k]])
                level = min(max(level + (min(max(move, -3.0), 4.0) if k == 1 else move), -20.0), 40.0)
                known[d] = level
                assert got[k, m, d] == pytest.approx(level)
    assert len(got) == 2 * 2 * 19


def test_many_values_take_quantiles(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("key"), F.array(F.rand(3), (F.col("id") % 5).cast("double")).alias("x"))
    for r in forest.bin_edges(df, 16).collect():
        assert r.edges[1] == [0.0, 1.0, 2.0, 3.0] and len(r.edges[0]) == 15
        assert all(abs(e - (i + 1) / 16) < 0.03 for i, e in enumerate(r.edges[0]))
