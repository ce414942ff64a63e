"""Medians of a group's other values, without pairs."""

import random
import statistics

from rillet.operators import quantiles


def test_median_of_others_equals_pairs(spark):
    draws = random.Random(3)
    rows = [(k, k % 7 if k % 50 else None, draws.choice([1.0, 1.5, 2.0, 2.5, 9.0, 0.1 * k]), k % 5 < 2) for k in range(300)] + [(1000, 99, 4.0, True), (1001, 98, 4.0, False), (1002, 98, 5.0, True)]
    members = spark.createDataFrame([(g, v, 1) for _, g, v, m in rows if m], "g int, value double, count int")
    asked = spark.createDataFrame([(k, g, v if m else None) for k, g, v, m in rows], "key long, g int, own double")
    got = {r.key: (r.neighbours, r.median) for r in quantiles.median_of_others(members, asked, ["g"]).collect()}
    for k, g, _, _ in rows:
        others = [v for k2, g2, v, m in rows if m and g is not None and g2 == g and k2 != k]
        assert got.get(k, (0, None)) == (len(others), statistics.median(others) if others else None)


def test_counts_stand_for_copies(spark):
    members = spark.createDataFrame([(1, 3.0, 1000), (1, 5.0, 1000), (1, 7.0, 1)], "g int, value double, count int")
    asked = spark.createDataFrame([(1, 1, 3.0), (2, 1, 5.0), (3, 1, 7.0), (4, 1, None)], "key long, g int, own double")
    got = {r.key: (r.neighbours, r.median) for r in quantiles.median_of_others(members, asked, ["g"]).collect()}
    assert got == {1: (2000, 5.0), 2: (2000, 4.0), 3: (2000, 4.0), 4: (2001, 5.0)}
